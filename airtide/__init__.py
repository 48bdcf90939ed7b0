"""airtide: live-audience analytics as Spark DataFrame operators.

``functions``  Column expressions (slots, rounding, log ratios)
``sources``    reading, writing and adapting tables
``operators``  DataFrame -> DataFrame analytics
``plans``      the operators wired into the full study
"""

from airtide.settings import Platform, Settings, TWITCH, YOUTUBE

__all__ = ["Platform", "Settings", "TWITCH", "YOUTUBE"]
