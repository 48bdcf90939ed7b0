"""Effect of the time of day over all channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import (
    growth_percent,
    log_growth,
    log_growth_or_zero,
    weighted_mean_of_rounded,
)
from airtide.functions.slots import (
    in_evening,
    is_whole_hour,
    minutes_from_noon_order,
    time_slots,
)


def _units(value: Column, per_one: int) -> Column:
    """A rounded value as a whole number of ``1/per_one``."""
    return F.round(value * per_one, 0).cast("bigint")


def slot_effect_weighted(
    yt_profile: DataFrame, tw_profile: DataFrame, slot_minutes: int = 15
) -> DataFrame:
    """Mean difference per slot, weighted by live count, without the empty -100 cells.

    ``all_avg`` weighs each platform's sums by the number of channels the other platform
    has in the slot (1 if none), which is what sums over a join of both profiles on the
    slot come to. ``all_avg_pooled`` is the plain mean over both.
    """

    def totals(profile: DataFrame, p: str) -> DataFrame:
        live = F.col("live_count")
        return (
            profile.where(F.col("diff_percent") != -100)
            .groupBy("time")
            .agg(
                F.count("*").alias(f"{p}_rows"),
                F.sum(live).alias(f"{p}_live"),
                F.sum(_units(F.col("diff_percent"), 100) * live).alias(f"{p}_diff"),
            )
        )

    def exact(name: str, if_none: int) -> Column:
        return F.coalesce(F.col(name), F.lit(if_none)).cast("decimal(19,0)")

    yt_times, tw_times = exact("tw_rows", 1), exact("yt_rows", 1)
    yt_diff, tw_diff = exact("yt_diff", 0), exact("tw_diff", 0)
    yt_live, tw_live = exact("yt_live", 0), exact("tw_live", 0)

    def mean(diff: Column, live: Column) -> Column:
        return F.coalesce(weighted_mean_of_rounded(diff, live, 100, 2), F.lit(0.0))

    return (
        time_slots(yt_profile.sparkSession, slot_minutes)
        .join(totals(yt_profile, "yt"), "time", "left")
        .join(totals(tw_profile, "tw"), "time", "left")
        .select(
            "time",
            mean(yt_diff, yt_live).alias("yt_avg"),
            mean(tw_diff, tw_live).alias("tw_avg"),
            mean(
                yt_times * yt_diff + tw_times * tw_diff,
                yt_times * yt_live + tw_times * tw_live,
            ).alias("all_avg"),
            mean(yt_diff + tw_diff, yt_live + tw_live).alias("all_avg_pooled"),
        )
    )


def slot_series_percent(effect: DataFrame) -> DataFrame:
    return effect.select(
        "time",
        "yt_avg",
        "tw_avg",
        "all_avg",
        is_whole_hour(F.col("time")).alias("whole_hour"),
    ).orderBy("time")


def slot_series_log(effect: DataFrame) -> DataFrame:
    return effect.select(
        "time",
        *[
            log_growth_or_zero(F.col(f"{p}_avg")).alias(f"{p}_log")
            for p in ("yt", "tw", "all")
        ],
        is_whole_hour(F.col("time")).alias("whole_hour"),
    ).orderBy("time")


def slot_series_one_platform(effect: DataFrame, prefix: str = "tw") -> DataFrame:
    return effect.select(
        "time", f"{prefix}_avg", is_whole_hour(F.col("time")).alias("whole_hour")
    ).orderBy("time")


def slot_global_profile(yt_profile: DataFrame, tw_profile: DataFrame) -> DataFrame:
    """Per slot and platform: rows, weighted mean viewers, weighted geometric difference.

    A cell without difference adds to the weight but not to the sum.
    """

    def totals(profile: DataFrame, p: str) -> DataFrame:
        live = F.col("live_count")
        total = F.col(f"{p}_sum")
        growth = growth_percent(F.try_divide(F.col("log_sum"), total))
        return (
            profile.groupBy("time")
            .agg(
                F.sum(live).alias(f"{p}_sum"),
                F.sum(_units(F.col("avg_viewers"), 10) * live).alias("viewers_sum"),
                F.sum(log_growth(F.col("diff_percent")) * live).alias("log_sum"),
            )
            .select(
                "time",
                f"{p}_sum",
                weighted_mean_of_rounded(F.col("viewers_sum"), total, 10, 2).alias(
                    f"{p}_weighted_avg"
                ),
                F.round(growth, 2).alias(f"{p}_weighted_diff"),
            )
        )

    return totals(yt_profile, "yt").join(totals(tw_profile, "tw"), "time", "full")


def evening_profile(
    global_profile: DataFrame, first_hour: int = 18, end_hour: int = 5
) -> DataFrame:
    """The evening part of the global profile in broadcast order, empty cells as 0."""
    time = F.col("time")
    return (
        global_profile.where(in_evening(time, first_hour, end_hour))
        .na.fill(0)
        .withColumn("sort_key", minutes_from_noon_order(time))
        .orderBy("sort_key")
    )
