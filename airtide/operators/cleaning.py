"""Cleaning: quality filter, 15-minute slots, per-stream slot means, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import is_true
from airtide.functions.slots import slot_start
from airtide.operators.lookup import HEAVY_ROWS, attach
from airtide.plans.staging import stage
from airtide.settings import PLATFORMS, Platform

SNAPSHOT_COLUMNS = [
    "id", "date", "time", "channel", "youtube", "twitch", "yt_number", "tw_number",
]


def _is_kept(min_viewers: int) -> Column:
    """Possibly live somewhere, and possibly watched; never NULL.

    Only what is certainly noise goes: a NULL leaves the verdict open. Plain comparisons,
    so that the filter reaches the scan.
    """
    maybe_live, maybe_watched = F.lit(False), F.lit(False)
    for p in PLATFORMS:
        number, viewers = F.col(p.number), F.col(p.viewers)
        maybe_live = maybe_live | number.isNull() | (number != 0)
        maybe_watched = maybe_watched | viewers.isNull() | (viewers >= min_viewers)
    return maybe_live & maybe_watched


def quality_filter(snapshots: DataFrame, min_viewers: int = 10) -> DataFrame:
    """Drop the rows that are certainly noise; rows with an unknown verdict stay."""
    return snapshots.where(_is_kept(min_viewers))


def quality_counts(min_viewers: int = 10) -> list[Column]:
    """What the filter makes of the rows it is given, as aggregates."""
    kept = _is_kept(min_viewers)
    return [
        F.count("*").alias("n_before"),
        F.count_if(~kept).alias("n_deleted"),
        F.count_if(kept).alias("n_after"),
    ]


def quality_filter_audit(snapshots: DataFrame, min_viewers: int = 10) -> DataFrame:
    return snapshots.agg(*quality_counts(min_viewers))


def to_slots(snapshots: DataFrame, slot_minutes: int = 15) -> DataFrame:
    return snapshots.withColumn("time", slot_start(F.col("time"), slot_minutes))


def stream_means(slotted: DataFrame) -> DataFrame:
    """Whole mean viewers of the streams whose rows differ within a slot.

    One pass for both platforms: (platform, date, time, number) -> mean, n_rows. A stream
    with one row, or with equal rows, in a slot has its mean already and is left out; in
    ordinary data that leaves little to join. Heavy streams stay in, as ``attach`` has to
    know all of them.
    """
    viewers = F.col("viewers")
    return (
        slotted.select(
            "date",
            "time",
            F.expr(
                "stack(2, 'yt', yt_number, youtube, 'tw', tw_number, twitch)"
                " AS (platform, number, viewers)"
            ),
        )
        .where("number != 0")
        .groupBy("platform", "date", "time", "number")
        .agg(
            F.avg(viewers).cast("bigint").alias("mean"),
            F.count("*").alias("n_rows"),
            F.min(viewers).alias("lowest"),
            F.max(viewers).alias("highest"),
        )
        .where((F.col("lowest") < F.col("highest")) | (F.col("n_rows") >= HEAVY_ROWS))
        .drop("lowest", "highest")
    )


def _with_stream_mean(rows: DataFrame, means: DataFrame, platform: Platform) -> DataFrame:
    own = means.where(F.col("platform") == platform.prefix).select(
        "date", "time", "number", F.col("mean").alias("_mean"), "n_rows"
    )
    number = F.col(platform.number)
    looked_up = attach(
        rows,
        own,
        {
            "date": F.col("date"),
            "time": F.col("time"),
            "number": F.when(number != 0, number),
        },
        weight="n_rows",
    )
    return looked_up.select(
        *[c for c in SNAPSHOT_COLUMNS if c != platform.viewers],
        F.coalesce("_mean", platform.viewers).alias(platform.viewers),
    )


def slot_mean(slotted: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Replace viewers by the stream's mean in the slot, where live; other rows stay.

    ``means`` is a written table of :func:`stream_means`; without it one is written here.

    The mean is over all rows of (date, time, stream number): channels that share a
    stream share the value. Fractions are cut off.
    """
    if means is None:
        means = stage(stream_means(slotted), "stream-means")
    rows = slotted
    for platform in PLATFORMS:
        rows = _with_stream_mean(rows, means, platform)
    return rows.select(SNAPSHOT_COLUMNS)


def slot_dedup(slotted: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """``slot_mean``, then one row (the lowest id) per set of otherwise equal rows.

    Where a channel is live, its mean is a function of (date, time, stream number), so
    the rows that will be equal are known before the means are: they collapse first,
    and only one row of each set is joined to its mean. Its viewers matter only where
    there is no mean to join, and there all rows of the set have the same.
    """
    if means is None:
        means = stage(stream_means(slotted), "stream-means")
    key = [F.col(c) for c in ("date", "time", "channel", "yt_number", "tw_number")]
    key += [
        F.when(~is_true(F.col(p.number) != 0), F.col(p.viewers)).alias(f"own_{p.prefix}")
        for p in PLATFORMS
    ]
    rows = slotted.groupBy(*key).agg(
        F.min("id").alias("id"), *[F.min(p.viewers).alias(p.viewers) for p in PLATFORMS]
    )
    for platform in PLATFORMS:
        rows = _with_stream_mean(rows, means, platform)
    return rows.select(SNAPSHOT_COLUMNS)


def slot_dedup_audit(slotted: DataFrame, deduped: DataFrame) -> DataFrame:
    """How many rows the deduplication removes and leaves."""
    before = slotted.agg(F.count("*").alias("n_before"), F.lit(0).alias("n_after"))
    after = deduped.agg(F.lit(0).alias("n_before"), F.count("*").alias("n_after"))
    return before.unionByName(after).agg(
        (F.sum("n_before") - F.sum("n_after")).alias("n_duplicates"),
        F.sum("n_after").alias("n_after"),
    )
