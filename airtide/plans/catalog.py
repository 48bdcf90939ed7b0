"""Named results of a study; each reads what the study has written already."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from airtide.operators import effect
from airtide.operators.concurrency import avg_concurrency_series
from airtide.operators.profile import channel_slot_overlay
from airtide.operators.quality import upsert_by_key
from airtide.plans.history import History
from airtide.plans.staging import new_folder
from airtide.plans.study import Study
from airtide.settings import Settings
from airtide.sources.tables import merge_partitions, write_partitions


def rounded(table: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Show unrounded results at a fixed precision; only for output."""
    return table.withColumns({c: F.round(c, digits) for c in columns})


def one_channel_overlay(study: Study) -> DataFrame:
    """The overlay of one channel: the first name of all."""
    return channel_slot_overlay(*study.geo_channels(), first=True)


def history(study: Study, facts: str) -> History:
    """The days of a table of facts, kept in two runs that meet in the middle of the period.

    The second run brings the middle day again; so the first one need not have had it all.
    """
    spark, table = study.snapshots.sparkSession, study.table(facts)
    kept = History(spark, new_folder(spark, "history"), study.settings)
    middle = study.settings.middle_date
    kept.add(table.where(F.col("date") <= middle))
    kept.add(table.where(F.col("date") >= middle))
    return kept


#: Slots that the registered merge changes, and so the folders that it rewrites.
CHANGED_FROM = "18:00"


def upsert_last_wins(study: Study) -> DataFrame:
    """The profile, split by slot, after a merge whose changes hold keys twice."""
    spark, current = study.snapshots.sparkSession, study.plan("yt_profile")
    path = new_folder(spark, "merged-profile")
    write_partitions(current, path, "time")
    late = study.table("geo_yt_profile").where(F.col("time") >= CHANGED_FROM)
    corrected = late.where("live_count > 0").withColumn("diff_percent", F.round("diff_percent", 0))
    changes = late.withColumn("version", F.lit(1)).unionByName(
        corrected.withColumn("version", F.lit(2))
    )
    merge_partitions(spark, path, changes, ["channel_id", "time"], "time", "version")
    return spark.read.schema(current.schema).parquet(path).select(*current.columns)


RESULTS: dict[str, Callable[[Study], DataFrame]] = {
    "snapshot_scan": lambda s: s.snapshots,
    "quality_filter": lambda s: s.plan("clean"),
    "quality_filter_audit": lambda s: s.plan("clean_audit"),
    "slot15": lambda s: s.plan("slotted"),
    "slot_mean": lambda s: s.plan("slot_mean"),
    "slot_dedup": lambda s: s.plan("facts"),
    "slot_dedup_audit": lambda s: s.plan("facts_audit"),
    "channel_baseline": lambda s: s.plan("baseline"),
    "outlier_cut_2s": lambda s: s.plan("cut"),
    "outlier_audit": lambda s: s.plan("cut_audit"),
    "channel_baseline_clean": lambda s: s.plan("clean_baseline"),
    "slot_profile_yt": lambda s: s.plan("yt_profile"),
    "slot_profile_tw": lambda s: s.plan("tw_profile"),
    "slot_effect_weighted": lambda s: s.plan("slot_effect"),
    "slot_series_percent": lambda s: effect.slot_series_percent(s.plan("slot_effect")),
    "slot_series_log": lambda s: rounded(
        effect.slot_series_log(s.plan("slot_effect")), 6, "yt_log", "tw_log", "all_log"
    ),
    "slot_series_one_platform": lambda s: effect.slot_series_one_platform(s.plan("slot_effect")),
    "group_only_main": lambda s: s.plan("group_facts"),
    "group_only_streamer": lambda s: s.plan("group_streamers"),
    "group_only_channel_avg": lambda s: s.plan("group_baseline"),
    "outlier_cut_low3": lambda s: s.plan("group_cut"),
    "outlier_audit_low3": lambda s: s.plan("group_cut_audit"),
    "channel_baseline_geo": lambda s: rounded(
        s.plan("geo_baseline"), 6, "yt_log_geo_avg", "tw_log_geo_avg"
    ),
    "slot_profile_geo_yt": lambda s: s.plan("geo_yt_profile"),
    "slot_profile_geo_tw": lambda s: s.plan("geo_tw_profile"),
    "slot_global_profile": lambda s: s.plan("global_profile"),
    "channel_directory": lambda s: s.plan("channel_directory"),
    "channel_slot_overlay": lambda s: s.plan("channel_overlay"),
    "one_channel_overlay": one_channel_overlay,
    "evening_profile": lambda s: effect.evening_profile(s.plan("global_profile")),
    "diff_heatmap_yt": lambda s: s.plan("yt_heatmap"),
    "diff_heatmap_tw": lambda s: s.plan("tw_heatmap"),
    "diff_heatmap_bound": lambda s: s.plan("diff_bound"),
    "concurrent_slots": lambda s: rounded(
        s.plan("concurrent_slots"), 6, "geo_perf_percent"
    ),
    "concurrent_slot_members": lambda s: s.plan("concurrent_slot_members"),
    "concurrency_effect": lambda s: rounded(
        s.plan("concurrency_effect"), 6, "avg_geo_perf_percent"
    ),
    "stream_sessions": lambda s: s.plan("sessions"),
    "concurrency_distribution": lambda s: s.plan("concurrency_distribution"),
    "concurrency_long": lambda s: s.plan("concurrency_long").orderBy("time", "live_count"),
    "concurrency_heatmap": lambda s: s.plan("concurrency_heatmap"),
    "slot_pressure": lambda s: rounded(
        s.plan("slot_pressure"), 6, "expected_perf", "expected_perf_known"
    ),
    "avg_concurrency_series": lambda s: avg_concurrency_series(
        s.plan("concurrency_distribution")
    ),
    "upsert_by_key": lambda s: upsert_by_key(
        s.plan("yt_profile"), s.plan("geo_yt_profile"), ["channel_id", "time"]
    ),
    "constraint_report": lambda s: s.plan("constraint_report"),
}

#: The same tables maintained day by day or by merges, not computed from all facts.
MAINTAINED: dict[str, Callable[[Study], DataFrame]] = {
    "channel_baseline_days": lambda s: history(s, "facts").baseline(s.streamers),
    "channel_baseline_clean_days": lambda s: history(s, "cut").baseline_clean(s.streamers),
    "channel_baseline_geo_days": lambda s: rounded(
        history(s, "group_cut").baseline_geo(s.group_streamers),
        6, "yt_log_geo_avg", "tw_log_geo_avg",
    ),
    "stream_sessions_days": lambda s: history(s, "facts").sessions,
    "upsert_last_wins": upsert_last_wins,
}

EVENTS_SETTINGS = Settings(
    group="BUILDING", start="2024-01-01 12:00", end="2024-01-30 12:00"
)
