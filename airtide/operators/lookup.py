"""Join a fact to a table with one row per key, also where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one key that a task may well take. Keys with as many or more are heavy: of N
#: rows there are at most N / HEAVY_ROWS such keys, a million in a trillion rows.
HEAVY_ROWS = 1_000_000


def attach(
    facts: DataFrame,
    table: DataFrame,
    on: dict[str, Column],
    *,
    row_id: str = "id",
    weight: str | None = None,
    matched: str | None = None,
) -> DataFrame:
    """Left join ``facts`` to ``table``; every fact row comes back exactly once.

    ``on`` maps the key columns of ``table`` (unique together) to expressions over
    ``facts``; a NULL expression means the row looks nothing up. All other columns of
    ``table`` are added, and ``matched`` names an optional flag column.

    The rows of every heavy key, one with ``HEAVY_ROWS`` rows or more, are served by a
    broadcast of a row per heavy key; it tells of a heavy key also that ``table`` lacks
    it. Any other key holds fewer rows, so the rest joins with an ordinary shuffle
    (or a broadcast, where the optimizer sees that ``table`` is small). Rows that are
    served already, or look nothing up, are spread by a hash of ``row_id`` and not by
    their key.

    Without ``weight`` the keys are counted. It may name a column of ``table`` that holds
    the row count of the key, if ``table`` has every heavy key.
    """
    keys = list(on)
    values = [c for c in table.columns if c not in on]
    probe_keys = [f"_probe_{k}" for k in keys]
    probe = facts.withColumns(dict(zip(probe_keys, on.values())))

    table = table.withColumn("_known", F.lit(True))
    heavy = F.broadcast(
        _heavy_rows(probe, probe_keys, table, keys, weight).selectExpr(
            *_prefixed(keys, values, "_heavy_"), "true AS _heavy_hit"
        )
    )
    probe = probe.join(heavy, _same(probe_keys, keys, "_heavy_"), "left")

    served = " OR ".join(["_heavy_hit IS NOT NULL"] + [f"{p} IS NULL" for p in probe_keys])
    probe = probe.selectExpr(
        *[f"`{c}`" for c in facts.columns],
        *[f"`_heavy_{v}`" for v in [*values, "_known"]],
        *[f"IF({served}, NULL, {p}) AS {p}" for p in probe_keys],
        f"IF({served}, xxhash64({row_id}), xxhash64({', '.join(probe_keys)})) AS _spread",
    )
    rest = table.selectExpr(
        *_prefixed(keys, values, "_rest_"), f"xxhash64({', '.join(keys)}) AS _rest_spread"
    )
    on_rest = _same(probe_keys, keys, "_rest_") & F.expr("_spread = _rest_spread")
    added = [f"coalesce(`_heavy_{v}`, `_rest_{v}`) AS `{v}`" for v in values]
    if matched:
        added.append(f"coalesce(_heavy__known, _rest__known, false) AS {matched}")
    return probe.join(rest, on_rest, "left").selectExpr(
        *[f"`{c}`" for c in facts.columns], *added
    )


def _same(probe_keys: list[str], keys: list[str], prefix: str) -> Column:
    return F.expr(" AND ".join(f"{p} = {prefix}{k}" for p, k in zip(probe_keys, keys)))


def _heavy_rows(
    probe: DataFrame,
    probe_keys: list[str],
    table: DataFrame,
    keys: list[str],
    weight: str | None,
) -> DataFrame:
    """The heavy keys, with their row of ``table`` if any."""
    if weight:
        return table.where(F.col(weight) >= HEAVY_ROWS)
    frequent = (
        probe.na.drop(subset=probe_keys)
        .groupBy([F.col(p).alias(k) for p, k in zip(probe_keys, keys)])
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= HEAVY_ROWS)
        .select(*keys)
    )
    known = table.join(F.broadcast(frequent), keys, "left_semi")
    return frequent.join(F.broadcast(known), keys, "left")


def _prefixed(keys: list[str], values: list[str], prefix: str) -> list[str]:
    return [f"`{c}` AS `{prefix}{c}`" for c in [*keys, *values, "_known"]]
