"""What is kept of each day, so that a new day does not read the days before.

Two tables below one folder, split by date: the state of each channel (for baselines) and
of each stream (for sessions). Adding facts replaces the folders of their dates and no
others, so that a day may be added again. Baselines and sessions over all days are merged
from the states, one row per channel or stream and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airtide.operators import baseline, sessions
from airtide.settings import Settings
from airtide.sources.tables import write_partitions

STATES = {"channel_days": baseline.channel_days, "session_days": sessions.session_days}


class History:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.settings = spark, settings
        self._folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def add(self, facts: DataFrame) -> None:
        """Keep the state of the facts' days; ``facts`` holds all facts of each of its days."""
        for name, state in STATES.items():
            write_partitions(state(facts), self.path(name), "date")

    def _days(self, name: str) -> DataFrame:
        """The kept states; dates are strings, as in the facts."""
        facts_dates = self.spark.read.parquet(self.path(name))
        return facts_dates.withColumn("date", facts_dates["date"].cast("string"))

    @property
    def channel_statistics(self) -> DataFrame:
        return baseline.merged_statistics(self._days("channel_days"))

    def baseline(self, streamers: DataFrame) -> DataFrame:
        return baseline.baseline_with_band(
            self.channel_statistics, streamers, self.settings.z_two_sided
        )

    def baseline_clean(self, streamers: DataFrame) -> DataFrame:
        return baseline.baseline_clean(self.channel_statistics, streamers)

    def baseline_geo(self, streamers: DataFrame) -> DataFrame:
        return baseline.baseline_geo(self.channel_statistics, streamers)

    @property
    def sessions(self) -> DataFrame:
        return sessions.sessions_of_days(self._days("session_days"), self.settings.slot_minutes)
