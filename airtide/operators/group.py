"""Restriction of the study to one group of streamers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airtide.functions.numeric import is_true


def group_facts(facts: DataFrame, streamers: DataFrame, group: str) -> DataFrame:
    """Facts of the channels that belong to ``group``."""
    members = streamers.where(F.col("grp") == group).select("channel_id")
    return facts.join(members, F.col("channel") == F.col("channel_id"), "left_semi")


def group_streamers(streamers: DataFrame, group: str) -> DataFrame:
    """Streamers outside ``group`` go; those whose group is unknown stay."""
    return streamers.where(~is_true(F.col("grp") != group))


def member_baselines(baseline: DataFrame, streamers: DataFrame, group: str) -> DataFrame:
    """Baselines of the channels of ``group``."""
    members = streamers.where(F.col("grp") == group).select("channel_id")
    return baseline.join(members, "channel_id", "left_semi")


def present_baselines(baseline: DataFrame, facts: DataFrame) -> DataFrame:
    """Baselines of the channels that have facts."""
    present = facts.select(F.col("channel").alias("channel_id")).distinct()
    return baseline.join(present, "channel_id", "left_semi")
