"""Parameters of the study; every threshold of the analysis lives here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass(frozen=True)
class Platform:
    """Names of one platform's columns in the snapshot table."""

    prefix: str
    viewers: str
    number: str


YOUTUBE = Platform("yt", "youtube", "yt_number")
TWITCH = Platform("tw", "twitch", "tw_number")
PLATFORMS = (YOUTUBE, TWITCH)


@dataclass(frozen=True)
class Settings:
    """``group`` names the streamers of the group branch, ``start`` and ``end`` the period
    whose days the concurrency tables count; the rest are fixed values."""

    group: str
    start: str = "2025-06-29 12:00"
    end: str = "2025-12-26 12:00"
    min_viewers: int = 10
    slot_minutes: int = 15
    z_two_sided: float = 2.5
    z_low: float = -3.0

    def __post_init__(self) -> None:
        if self.slot_minutes < 1 or 60 % self.slot_minutes:
            raise ValueError(f"slot_minutes must divide 60, not {self.slot_minutes}")
        if self._period <= timedelta(0) or self._period % timedelta(days=1):
            raise ValueError("start and end must be a whole number of days apart")

    @property
    def _period(self) -> timedelta:
        start, end = (datetime.strptime(t, "%Y-%m-%d %H:%M") for t in (self.start, self.end))
        return end - start

    @property
    def n_days(self) -> int:
        return self._period.days

    @property
    def middle_date(self) -> str:
        """The date halfway through the period, ``yyyy-MM-dd``."""
        start = datetime.strptime(self.start, "%Y-%m-%d %H:%M")
        return (start + self._period / 2).strftime("%Y-%m-%d")
