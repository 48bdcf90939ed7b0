"""The whole study: every result as a property, wired to the inputs it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from airtide.functions.slots import time_slots
from airtide.operators import (
    baseline as bl,
    cleaning,
    concurrency,
    effect,
    group,
    outliers,
    profile,
    sessions,
)
from airtide.operators.concurrency import SHOWN_LEVELS
from airtide.operators.quality import TableRule, constraint_report
from airtide.plans.staging import stage
from airtide.settings import Platform, Settings, TWITCH, YOUTUBE


class Study:
    """Results of one pair of input tables.

    ``table(name)`` writes a result as a stage table the first time it is asked for; it
    serves inputs that are read more than once. ``plan(name)`` takes the stage table if
    there is one and the unwritten plan otherwise; it serves inputs that are read once.
    So reading a property returns a lazy plan of the last steps, but first runs the jobs
    that write the stage tables below it, unless they are there already.

    Two branches start from ``facts``: the slot effect, after the two-sided cut of all
    channels; and the group branch with its concurrency analysis, where one group's
    facts get the one-sided cut only.

    With ``observe`` the audits cost no pass over the data: what they count is counted while
    the tables are written, and ``stage`` gets an observation ``rows`` for the number of
    rows it writes. An audit of a table that was not written makes its own pass.
    """

    def __init__(
        self,
        snapshots: DataFrame,
        streamers: DataFrame,
        settings: Settings,
        stage: Callable[..., DataFrame] = stage,
        observe: bool = False,
    ):
        self.snapshots = snapshots
        self.streamers = streamers
        self.settings = settings
        self._stage = stage
        self._tables: dict[str, DataFrame] = {}
        self._observe = observe
        self._writing: list[str] = []
        self._rows: dict[str, Observation] = {}
        self._watches: dict[str, Observation] = {}
        self._two_sided = outliers.beyond(settings.z_two_sided)
        self._low = outliers.below(settings.z_low)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._writing.append(name)
            plan = getattr(self, name)
            self._writing.pop()
            rows = {"rows": self._rows.setdefault(name, Observation())} if self._observe else {}
            self._tables[name] = self._stage(plan, name, **rows)
        return self._tables[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        """The tables that are written."""
        return dict(self._tables)

    def _watched(self, rows: DataFrame, name: str, counts: list[Column]) -> DataFrame:
        """``rows``, which are counted on their way into the table ``name``."""
        if not self._observe or self._writing[-1:] != [name]:
            return rows
        self._watches[name] = Observation()
        return rows.observe(self._watches[name], *counts)

    def _counted(self, name: str, n_before: str | None = None) -> dict[str, int] | None:
        """What was counted while the table was written, if it was.

        Rows that a shuffle follows may be counted again when an executor is lost. So where
        the rows come from the table ``n_before``, they must be as many as were written there.
        """
        if name not in self._tables or name not in self._watches:
            return None
        counts = self._watches[name].get
        if n_before and counts["n_before"] != self._n_rows(n_before):
            return None
        return counts

    def _n_rows(self, name: str) -> int | None:
        """Rows of a table that was written, as its writers counted them."""
        return self._rows[name].get["n_rows"] if name in self._tables and self._observe else None

    def _one_row(self, counts: dict[str, int]) -> DataFrame:
        values = [F.lit(value).cast("bigint").alias(name) for name, value in counts.items()]
        return self.snapshots.sparkSession.range(1).select(*values)

    def plan(self, name: str) -> DataFrame:
        return self._tables[name] if name in self._tables else getattr(self, name)

    # Cleaning

    @property
    def clean(self) -> DataFrame:
        least = self.settings.min_viewers
        snapshots = self._watched(self.snapshots, "slotted", cleaning.quality_counts(least))
        return cleaning.quality_filter(snapshots, least)

    @property
    def clean_audit(self) -> DataFrame:
        if counts := self._counted("slotted"):
            return self._one_row(counts)
        return cleaning.quality_filter_audit(self.snapshots, self.settings.min_viewers)

    @property
    def slotted(self) -> DataFrame:
        return cleaning.to_slots(self.clean, self.settings.slot_minutes)

    @property
    def stream_means(self) -> DataFrame:
        return cleaning.stream_means(self.plan("slotted"))

    @property
    def slot_mean(self) -> DataFrame:
        return cleaning.slot_mean(self.plan("slotted"), self.table("stream_means"))

    @property
    def facts(self) -> DataFrame:
        return cleaning.slot_dedup(self.plan("slotted"), self.table("stream_means"))

    @property
    def facts_audit(self) -> DataFrame:
        before, after = self._counted("slotted"), self._n_rows("facts")
        if before and after is not None:
            n = before["n_after"]
            return self._one_row({"n_duplicates": n - after, "n_after": after})
        return cleaning.slot_dedup_audit(self.plan("slotted"), self.plan("facts"))

    @property
    def sessions(self) -> DataFrame:
        return sessions.stream_sessions(self.plan("facts"), self.settings.slot_minutes)

    @property
    def baseline(self) -> DataFrame:
        return bl.channel_baseline(
            self.plan("facts"), self.streamers, self.settings.z_two_sided
        )

    # Slot effect over all channels

    @property
    def cut(self) -> DataFrame:
        verdicts = outliers.judged(
            self.table("facts"), self.table("baseline"), self._two_sided, only_known=False
        )
        return outliers.kept(self._watched(verdicts, "cut", outliers.cut_counts()))

    @property
    def cut_audit(self) -> DataFrame:
        if counts := self._counted("cut", n_before="facts"):
            return self._one_row(counts)
        return outliers.outlier_audit(
            self.table("facts"), self.table("baseline"), self._two_sided
        )

    @property
    def clean_baseline(self) -> DataFrame:
        return bl.channel_baseline_clean(self.plan("cut"), self.streamers)

    @property
    def time_slots(self) -> DataFrame:
        return time_slots(self.snapshots.sparkSession, self.settings.slot_minutes)

    @property
    def slot_totals(self) -> DataFrame:
        return profile.slot_totals(self.plan("cut"))

    def _linear(self, platform: Platform) -> DataFrame:
        """A profile with one row per channel."""
        totals = self.table("slot_totals")
        return profile.slot_profile_by_channel(
            totals, self.streamers, platform, self.settings.slot_minutes
        )

    @property
    def yt_profile(self) -> DataFrame:
        return profile.as_profile(self._linear(YOUTUBE))

    @property
    def tw_profile(self) -> DataFrame:
        return profile.as_profile(self._linear(TWITCH))

    @property
    def slot_effect(self) -> DataFrame:
        return effect.slot_effect_weighted(
            self.plan("yt_profile"), self.plan("tw_profile"), self.settings.slot_minutes
        )

    # One group of channels, starting from the uncut facts

    @property
    def group_facts(self) -> DataFrame:
        return group.group_facts(
            self.table("facts"), self.streamers, self.settings.group
        )

    @property
    def group_streamers(self) -> DataFrame:
        return group.group_streamers(self.streamers, self.settings.group)

    @property
    def group_baseline(self) -> DataFrame:
        """Baselines of the group's channels that have facts."""
        return group.present_baselines(self._member_baseline, self.table("facts"))

    @property
    def _member_baseline(self) -> DataFrame:
        self.table("facts")  # staged before the baseline reads it
        return group.member_baselines(
            self.table("baseline"), self.streamers, self.settings.group
        )

    def _group_verdicts(self) -> DataFrame:
        """Group restriction and cut in one join: only members have a baseline here."""
        baseline = self._member_baseline
        facts = self._tables.get("group_facts", self.table("facts"))
        return outliers.judged(facts, baseline, self._low, only_known=True)

    @property
    def group_cut(self) -> DataFrame:
        verdicts = self._group_verdicts()
        return outliers.kept(self._watched(verdicts, "group_cut", outliers.cut_counts()))

    @property
    def group_cut_audit(self) -> DataFrame:
        if counts := self._counted("group_cut", n_before="group_facts"):
            return self._one_row(counts)
        return self._group_verdicts().agg(*outliers.cut_counts())

    @property
    def geo_baseline(self) -> DataFrame:
        return bl.channel_baseline_geo(self.plan("group_cut"), self.group_streamers)

    @property
    def group_slot_totals(self) -> DataFrame:
        return profile.slot_totals(self.plan("group_cut"))

    def _geometric(self, platform: Platform) -> DataFrame:
        totals = self.table("group_slot_totals")
        return profile.slot_profile_geo_by_channel(
            totals, self.group_streamers, platform, self.settings.slot_minutes
        )

    def geo_channels(self) -> tuple[DataFrame, DataFrame]:
        """Both geometric profiles with one row per channel."""
        return self._geometric(YOUTUBE), self._geometric(TWITCH)

    @property
    def geo_yt_profile(self) -> DataFrame:
        return profile.as_profile(self._geometric(YOUTUBE))

    @property
    def geo_tw_profile(self) -> DataFrame:
        return profile.as_profile(self._geometric(TWITCH))

    @property
    def global_profile(self) -> DataFrame:
        return effect.slot_global_profile(
            self.plan("geo_yt_profile"), self.plan("geo_tw_profile")
        )

    @property
    def channel_directory(self) -> DataFrame:
        return profile.channel_directory(*self.geo_channels())

    @property
    def channel_overlay(self) -> DataFrame:
        return profile.channel_slot_overlay(*self.geo_channels())

    def _heatmap(self, platform: Platform) -> DataFrame:
        return profile.diff_heatmap(
            self._geometric(platform), self.group_streamers, self.settings.slot_minutes
        )

    @property
    def yt_heatmap(self) -> DataFrame:
        return self._heatmap(YOUTUBE)

    @property
    def tw_heatmap(self) -> DataFrame:
        return self._heatmap(TWITCH)

    @property
    def diff_bound(self) -> DataFrame:
        return profile.diff_bound(*self.geo_channels())

    # Concurrency within the group

    @property
    def concurrent_slots(self) -> DataFrame:
        facts = self.table("group_cut")
        return concurrency.concurrent_slots(facts, self.table("geo_baseline"))

    @property
    def concurrent_slot_members(self) -> DataFrame:
        facts = self.table("group_cut")
        return concurrency.concurrent_slot_members(facts, self.table("geo_baseline"))

    @property
    def concurrency_effect(self) -> DataFrame:
        return concurrency.concurrency_effect(self.plan("concurrent_slots"))

    @property
    def concurrency_long(self) -> DataFrame:
        s = self.settings
        return concurrency.concurrency_long(
            self.plan("concurrent_slots"), s.start, s.end, s.n_days
        )

    @property
    def concurrency_distribution(self) -> DataFrame:
        return concurrency.concurrency_distribution(
            self.plan("concurrency_long"), self.settings.n_days
        )

    @property
    def concurrency_heatmap(self) -> DataFrame:
        return concurrency.concurrency_heatmap(self.plan("concurrency_long"))

    @property
    def slot_pressure(self) -> DataFrame:
        self.table("concurrent_slots")  # read by both inputs
        return concurrency.slot_pressure(
            self.table("concurrency_long"),
            self.plan("concurrency_effect"),
            self.settings.n_days,
        )

    # Checks

    @property
    def constraint_report(self) -> DataFrame:
        """Keys and NOT NULL columns as the tables of the study declare them."""
        self.table("concurrent_slots")
        channel_slot = ("channel_id", "time")
        levels = [f"cnt_{k}" for k in range(SHOWN_LEVELS + 1)]
        tables = [
            (
                self.snapshots,
                TableRule("main", ("id",), ("id", "date", "time", "channel", "youtube", "twitch")),
            ),
            (
                self.streamers,
                TableRule("streamer", ("channel_id",), ("channel_id", "channel_name")),
            ),
            (self.table("baseline"), TableRule("channel_avg", ("channel_id",))),
            (self._linear(YOUTUBE), TableRule("yt_time_profile", channel_slot, cells="cells")),
            (self._linear(TWITCH), TableRule("tw_time_profile", channel_slot, cells="cells")),
            (self.plan("slot_effect"), TableRule("yt_tw_time_avg", ("time",))),
            (self.plan("global_profile"), TableRule("time_global_profile", ("time",))),
            (
                self.plan("concurrent_slots"),
                TableRule("live_concurrent", ("date", "time"), ("date", "time", "live_count")),
            ),
            (
                self.plan("concurrent_slot_members"),
                TableRule("live_concurrent_members", ("id",), ("date", "time", "id")),
            ),
            (
                self.plan("concurrency_effect"),
                TableRule(
                    "concurrent_effect", ("live_count",),
                    ("live_count", "avg_geo_perf_percent", "sample_cnt"),
                ),
            ),
            (
                self.plan("concurrency_distribution"),
                TableRule("live_count_by_time", ("time",), ("time", "avg_live_count", *levels)),
            ),
            (
                self.plan("sessions"),
                TableRule(
                    "stream_analysis",
                    ("platform", "stream_id", "channel"),
                    (
                        "platform", "stream_id", "channel", "start_time", "end_time",
                        "avg_viewers", "max_viewers", "max_time", "min_viewers", "min_time",
                        "expected_points", "actual_points", "missing_points",
                    ),
                ),
            ),
        ]
        return constraint_report(tables)
