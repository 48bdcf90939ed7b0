"""How many channels are live at once, and how that relates to performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import growth_percent, log_growth
from airtide.operators.lookup import attach

#: Levels with a column of their own in the wide tables; the days above go to one more.
SHOWN_LEVELS = 10


def _live_rows(facts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Facts of known channels with their log performance.

    The first platform that is live with viewers counts, even if it has no baseline.
    """
    bases = baseline.select("channel_id", "yt_log_geo_avg", "tw_log_geo_avg")
    yt, tw = F.col("youtube"), F.col("twitch")
    performance = F.when(
        (F.col("yt_number") != 0) & (yt > 0), F.ln(yt) - F.col("yt_log_geo_avg")
    ).when((F.col("tw_number") != 0) & (tw > 0), F.ln(tw) - F.col("tw_log_geo_avg"))
    streams = facts.where(F.col("yt_number").isNotNull() | F.col("tw_number").isNotNull())
    return (
        attach(streams, bases, {"channel_id": F.col("channel")}, matched="known")
        .where("known")
        .select("id", "date", "time", performance.alias("performance"))
    )


def _slot_totals(live_rows: DataFrame) -> DataFrame:
    return (
        live_rows.groupBy("date", "time")
        .agg(F.count("id").alias("live_count"), F.avg("performance").alias("mean"))
        .select(
            "date",
            "time",
            "live_count",
            growth_percent(F.col("mean")).alias("geo_perf_percent"),
        )
    )


def concurrent_slots(facts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Live rows per date and slot, and their geometric mean performance in percent."""
    return _slot_totals(_live_rows(facts, baseline))


def concurrent_slot_members(facts: DataFrame, baseline: DataFrame) -> DataFrame:
    """The ids that ``concurrent_slots`` counts, one row each."""
    return _live_rows(facts, baseline).select("date", "time", "id")


def concurrency_effect(slots: DataFrame) -> DataFrame:
    """Geometric mean performance per number of rows live at once."""
    return (
        slots.where(F.col("geo_perf_percent").isNotNull())
        .groupBy("live_count")
        .agg(
            growth_percent(F.avg(log_growth(F.col("geo_perf_percent")))).alias(
                "avg_geo_perf_percent"
            ),
            F.count("*").alias("sample_cnt"),
        )
    )


def concurrency_long(slots: DataFrame, start: str, end: str, n_days: int) -> DataFrame:
    """On how many of the days in [start, end) a slot has so many rows live.

    One row per slot and level that occurs, whatever the level, and one for level 0: the
    days without a live row. ``start`` and ``end`` are ``yyyy-MM-dd HH:MM``.
    """
    moment = F.concat_ws(" ", "date", "time")
    in_range = (
        F.col("date").between(start[:10], end[:10]) & (moment >= start) & (moment < end)
    )
    levels = slots.where(in_range).groupBy("time", "live_count").agg(F.count("*").alias("cnt"))
    silent = levels.groupBy("time").agg(
        F.lit(0).cast("bigint").alias("live_count"), (n_days - F.sum("cnt")).alias("cnt")
    )
    return levels.unionByName(silent)


def _shown(levels: int) -> list[Column]:
    """Days at each shown level, and at all levels above."""
    level, days = F.col("live_count"), F.col("cnt")
    shown = [F.sum(F.when(level == k, days).otherwise(0)) for k in range(levels + 1)]
    return [*shown, F.sum(F.when(level > levels, days).otherwise(0))]


def concurrency_distribution(
    long: DataFrame, n_days: int, levels: int = SHOWN_LEVELS
) -> DataFrame:
    """The mean level per slot, over all levels, and the days at the lowest levels.

    ``cnt_over`` has the days above ``levels``, ``cnt_0`` those without a live row. (A
    table that keeps the shown levels only takes cnt_0 + cnt_over for its cnt_0.)
    """
    names = [*[f"cnt_{k}" for k in range(levels + 1)], "cnt_over"]
    weighted = F.sum(F.col("live_count") * F.col("cnt"))
    return long.groupBy("time").agg(
        F.round(weighted / float(n_days), 2).alias("avg_live_count"),
        *[days.alias(name) for days, name in zip(_shown(levels), names)],
    )


def concurrency_heatmap(long: DataFrame, levels: int = SHOWN_LEVELS) -> DataFrame:
    """Slot x level matrix, with the days above ``levels`` in one column."""
    names = [*[str(k) for k in range(levels + 1)], "over"]
    return (
        long.groupBy("time")
        .agg(*[days.alias(name) for days, name in zip(_shown(levels), names)])
        .orderBy("time")
    )


def slot_pressure(long: DataFrame, effect: DataFrame, n_days: int) -> DataFrame:
    """Performance to expect per slot: levels weighted by their days.

    ``expected_perf`` is NULL as soon as any level up to the highest that occurs in a
    slot lacks an effect, even one that never occurs; ``expected_perf_known`` takes a
    missing effect as 0.
    """
    level, value = F.col("live_count"), F.col("avg_geo_perf_percent")
    effects = effect.where(value.isNotNull()).select(level, value)
    live = long.where(level > 0)
    highest = live.agg(F.max(level)).scalar()
    n_known = effects.where(level.between(1, highest)).agg(F.count("*")).scalar()
    share = F.sum(F.col("cnt") * value)
    return (
        live.join(effects, "live_count", "left")
        .groupBy("time")
        .agg(share.alias("share"))
        .select(
            "time",
            F.when(n_known == highest, F.col("share") / n_days).alias("expected_perf"),
            (F.coalesce("share", F.lit(0.0)) / n_days).alias("expected_perf_known"),
        )
        .orderBy("time")
    )


def avg_concurrency_series(distribution: DataFrame) -> DataFrame:
    return distribution.select("time", "avg_live_count").orderBy("time")
