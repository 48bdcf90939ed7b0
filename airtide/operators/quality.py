"""Keys and NOT NULL rules as reports, and the keyed upsert."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from airtide.operators.lookup import attach

#: Tables that are checked at a time.
JOBS = 4


@dataclass(frozen=True)
class TableRule:
    """``cells`` names an array of structs that holds the rest of each row's rows: then the
    fields of its structs are columns of the table, too, and stand last in the key."""

    name: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    cells: str | None = None


def constraint_report(tables: list[tuple[DataFrame, TableRule]]) -> DataFrame:
    """Per table: rows, rows beyond the first of their key, NULLs in required columns.

    Done in two phases. The first counts rows per hash of the key, shuffling (hash, counts)
    and no keys; it brings one row per table to the driver. Equal keys
    have equal hashes, so a table without a repeated hash has no repeated key. Only the
    rows of repeated hashes, if any, are grouped by their whole keys in the second.
    """
    with ThreadPool(JOBS) as pool:  # small jobs that do not wait for each other
        target = inheritable_thread_target(tables[0][0].sparkSession)(_totals)
        found = pool.starmap(target, tables)
    reports = []
    for (table, rule), totals in zip(tables, found):
        if totals["suspects"]:
            duplicates = _repeated(table, rule)
        else:
            duplicates = table.sparkSession.range(1).select(F.lit(0).alias("n"))
        reports.append(
            duplicates.select(
                F.lit(rule.name).alias("table_name"),
                F.lit(",".join(rule.key)).alias("key"),
                _long(totals["rows"]).alias("n_rows"),
                (F.col("n") + _long(totals["inner"])).alias("n_duplicates"),
                _long(totals["nulls"]).alias("n_nulls"),
            )
        )
    return reduce(DataFrame.unionByName, reports)


def _totals(table: DataFrame, rule: TableRule) -> dict[str, int]:
    """The first phase; ``inner`` are the duplicates within the rows of hashes that are single."""
    per_hash = _hashed(table, rule).groupBy("hash").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("rows", "nulls", "inner")]
    )
    row = per_hash.agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum(F.when(F.col("n") == 1, F.col("inner"))).alias("inner"),
        F.count_if(F.col("n") > 1).alias("suspects"),
    ).first()
    return {name: value or 0 for name, value in row.asDict().items()}


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _split(table: DataFrame, names: tuple[str, ...], rule: TableRule) -> tuple[list[str], list[str]]:
    """Names of columns of the row, and of fields of its cells."""
    own = [c for c in names if not rule.cells or c in table.columns]
    return own, [c for c in names if c not in own]


def _hashed(table: DataFrame, rule: TableRule) -> DataFrame:
    """(hash of the row's key columns, rows, NULLs, rows that repeat a cell's key)."""
    key, cell_key = _split(table, rule.key, rule)
    required, cell_required = _split(table, rule.required or rule.key, rule)
    n_rows, inner = F.lit(1), F.lit(0)
    if rule.cells:
        n_rows = F.size(rule.cells)
        keys = F.transform(rule.cells, lambda c: F.struct(*[c[k] for k in cell_key]))
        inner = n_rows - F.size(F.array_distinct(keys))
    nulls = n_rows * sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))
    for name in cell_required:
        nulls = nulls + F.size(F.filter(rule.cells, lambda c: c[name].isNull()))
    return table.select(
        F.xxhash64(*key).alias("hash"),
        n_rows.cast("bigint").alias("rows"),
        nulls.cast("bigint").alias("nulls"),
        inner.cast("bigint").alias("inner"),
    )


def _repeated(table: DataFrame, rule: TableRule) -> DataFrame:
    """How many rows follow another one of the same key, among the rows of repeated hashes."""
    key, cell_key = _split(table, rule.key, rule)
    hashed = table.select(
        *[F.col(c).alias(f"_key_{c}") for c in key],
        *([F.col(rule.cells).alias("_cells")] if rule.cells else []),
        F.xxhash64(*key).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    suspects = hashed.groupBy(F.col("_hash").alias("hash")).agg(F.count("*").alias("n"))
    found = attach(
        hashed, suspects.where("n > 1"), {"hash": F.col("_hash")},
        row_id="_row", weight="n", matched="_hit",
    ).where("_hit")
    if rule.cells:
        found = found.withColumn("_cell", F.explode("_cells"))
    keys = [f"_key_{c}" for c in key] + [F.col("_cell")[c].alias(c) for c in cell_key]
    per_key = found.groupBy(*keys).agg(F.count("*").alias("rows"))
    return per_key.agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n"))


def upsert_by_key(
    current: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None
) -> DataFrame:
    """``current`` with the rows of ``changes`` put in place of those of the same key.

    Where ``changes`` holds a key more than once, the row with the largest ``order``
    stays; without ``order`` one that holds the key once is expected. Columns go by name.
    """
    if order:
        changes = last_changes(changes, keys, order).select(*current.columns)
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes)


def last_changes(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    last = F.max_by(F.struct("*"), F.col(order)).alias("last")
    return changes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("last.*")
