"""How each channel does in each slot of the day, compared with its own baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import growth_percent, percent_difference, positive_ln
from airtide.functions.slots import (
    hour_from_noon_order,
    minutes_from_noon_order,
    slot_label_array,
    slot_labels_from_noon,
)
from airtide.settings import PLATFORMS, Platform


def slot_totals(facts: DataFrame) -> DataFrame:
    """Sums per channel and slot for both platforms, over the rows live there.

    Both the profile of a channel and its means over all slots follow from these few
    rows, so one pass over the facts serves every profile.
    """
    sums: list[Column] = []
    for p in PLATFORMS:
        viewers = F.when(F.col(p.number) != 0, F.col(p.viewers))
        sums += [
            F.count(viewers).alias(f"{p.prefix}_n"),
            F.sum(viewers).alias(f"{p.prefix}_total"),
            F.count(positive_ln(viewers)).alias(f"{p.prefix}_ln_n"),
            F.sum(positive_ln(viewers)).alias(f"{p.prefix}_ln_total"),
        ]
    return facts.groupBy(F.col("channel").alias("channel_id"), "time").agg(*sums)


def _by_channel(
    totals: DataFrame,
    streamers: DataFrame,
    platform: Platform,
    difference: Callable[[Column, Column], Column],
    slot_minutes: int,
) -> DataFrame:
    """One row per streamer with a mean on the platform, with a cell for every slot.

    The totals shrink to one row per channel, which holds its means and a map of its
    slots (at most a day of them). Only those rows meet the streamers.
    """
    n, total, ln_n, ln_total = (
        F.col(f"{platform.prefix}_{c}") for c in ("n", "total", "ln_n", "ln_total")
    )
    slot = F.struct(
        n.alias("live_count"),
        (total / n).alias("mean"),
        F.try_divide(ln_total, ln_n).alias("ln_mean"),
    )
    by_channel = (
        totals.where(n > 0)
        .groupBy("channel_id")
        .agg(
            F.round(F.sum(total) / F.sum(n), 1).alias("base"),
            F.try_divide(F.sum(ln_total), F.sum(ln_n)).alias("ln_base"),
            F.map_from_entries(F.collect_list(F.struct("time", slot))).alias("slots"),
        )
        .where("base != 0")
    )
    slots = F.transform(
        slot_label_array(slot_minutes),
        lambda time: F.struct(time.alias("time"), F.col("slots")[time].alias("slot")),
    )
    cells = F.transform(
        slots,
        lambda s: F.struct(
            s["time"].alias("time"),
            F.coalesce(s["slot"]["live_count"], F.lit(0)).alias("live_count"),
            F.coalesce(F.round(s["slot"]["mean"], 1), F.lit(0.0)).alias("avg_viewers"),
            difference(s["slot"]["mean"], s["slot"]["ln_mean"]).alias("diff_percent"),
        ),
    )
    return (
        streamers.select("channel_id", "channel_name")
        .join(by_channel, "channel_id")
        .select("channel_id", "channel_name", cells.alias("cells"))
    )


def as_profile(by_channel: DataFrame) -> DataFrame:
    """One row per channel and cell. The grid is dense and appears last: no shuffle sees it."""
    return by_channel.select("channel_id", "channel_name", F.inline("cells"))


def as_channels(profile: DataFrame) -> DataFrame:
    """Inverse of :func:`as_profile`, for profiles that were written as rows."""
    cell = F.struct("time", "live_count", "avg_viewers", "diff_percent")
    return profile.groupBy("channel_id", "channel_name").agg(F.collect_list(cell).alias("cells"))


def slot_profile_by_channel(
    totals: DataFrame, streamers: DataFrame, platform: Platform, slot_minutes: int = 15
) -> DataFrame:
    """Percent above the arithmetic mean; a slot without rows is at -100."""

    def difference(mean: Column, _: Column) -> Column:
        return F.round(percent_difference(F.coalesce(mean, F.lit(0.0)), F.col("base")), 2)

    return _by_channel(totals, streamers, platform, difference, slot_minutes)


def slot_profile_geo_by_channel(
    totals: DataFrame, streamers: DataFrame, platform: Platform, slot_minutes: int = 15
) -> DataFrame:
    """Percent above the geometric mean; NULL for a slot without rows."""

    def difference(mean: Column, ln_mean: Column) -> Column:
        growth = growth_percent(ln_mean - F.col("ln_base"))
        no_viewers = (F.col("base") <= 0) | (mean <= 0)
        return F.when(no_viewers, F.lit(0.0)).otherwise(F.round(growth, 2))

    return _by_channel(totals, streamers, platform, difference, slot_minutes)


def slot_profile(
    totals: DataFrame, streamers: DataFrame, platform: Platform, slot_minutes: int = 15
) -> DataFrame:
    return as_profile(slot_profile_by_channel(totals, streamers, platform, slot_minutes))


def slot_profile_geo(
    totals: DataFrame, streamers: DataFrame, platform: Platform, slot_minutes: int = 15
) -> DataFrame:
    return as_profile(slot_profile_geo_by_channel(totals, streamers, platform, slot_minutes))


def channel_directory(*channels: DataFrame) -> DataFrame:
    """The channels that occur in any of the tables, by name."""
    names = [c.select("channel_id", "channel_name") for c in channels]
    listed = names[0]
    for other in names[1:]:
        listed = listed.unionByName(other)
    return listed.distinct().orderBy("channel_name", "channel_id")


def channel_id_of(directory: DataFrame, channel_name: str | Column) -> DataFrame:
    """The first channel of that name, as a table of at most one row."""
    return (
        directory.where(F.col("channel_name") == channel_name)
        .orderBy("channel_id")
        .limit(1)
        .select("channel_id")
    )


def _cells_by_time() -> Column:
    return F.map_from_entries(F.transform("cells", lambda c: F.struct(c["time"], c)))


def channel_slot_overlay(
    yt_channels: DataFrame,
    tw_channels: DataFrame,
    channel_id: str | Column | None = None,
    *,
    first: bool = False,
) -> DataFrame:
    """Both platforms of a channel side by side per slot; all channels if none is named.

    ``first`` takes the first channel by name, then id. Channels are joined, one row each,
    and then unfolded into their slots.
    """

    def side(channels: DataFrame, prefix: str) -> DataFrame:
        if channel_id is not None:
            channels = channels.where(F.col("channel_id") == channel_id)
        return channels.select(
            "channel_id",
            F.col("channel_name").alias(f"{prefix}_name"),
            _cells_by_time().alias(prefix),
        )

    none = F.array().cast("array<string>")
    times = F.array_union(
        F.coalesce(F.map_keys("yt"), none), F.coalesce(F.map_keys("tw"), none)
    )
    channels = (
        side(yt_channels, "yt")
        .join(side(tw_channels, "tw"), "channel_id", "full")
        .withColumn("channel_name", F.coalesce("yt_name", "tw_name"))
    )
    if first:
        named = channels.where("channel_name IS NOT NULL")
        channels = named.orderBy("channel_name", "channel_id").limit(1)
    merged = (
        channels.select("*", F.explode(times).alias("time"))
        .select(
            "channel_id",
            "channel_name",
            "time",
            hour_from_noon_order(F.col("time")).alias("sort_key"),
            *[
                F.col(p)[F.col("time")][field].alias(f"{p}_{name}")
                for p in ("yt", "tw")
                for field, name in (("live_count", "live"), ("avg_viewers", "avg"))
            ],
        )
    )
    if channel_id is None and not first:
        return merged
    return merged.orderBy(minutes_from_noon_order(F.col("time")))


def diff_heatmap(
    channels: DataFrame, streamers: DataFrame, slot_minutes: int = 15
) -> DataFrame:
    """Channel x slot matrix of the difference, from noon to noon, in streamer order."""
    labels = slot_labels_from_noon(slot_minutes)
    at = channels.select("channel_id", _cells_by_time().alias("at"))
    cell = "coalesce(round(at['{t}'].diff_percent, 2), 0D) AS `{t}`"
    order = streamers.select(F.col("id").alias("streamer_id"), "channel_id", "channel_name")
    return (
        order.join(at, "channel_id")
        .selectExpr(
            "streamer_id", "channel_id", "channel_name", *[cell.format(t=t) for t in labels]
        )
        .orderBy("streamer_id")
    )


def diff_bound(*channels: DataFrame) -> DataFrame:
    """Largest absolute difference over all cells."""
    size = F.transform(
        "cells", lambda c: F.abs(F.round(F.coalesce(c["diff_percent"], F.lit(0.0)), 2))
    )
    largest = [c.select(F.array_max(size).alias("largest")) for c in channels]
    cells = largest[0]
    for other in largest[1:]:
        cells = cells.unionByName(other)
    return cells.agg(F.max("largest").alias("max_abs"))
