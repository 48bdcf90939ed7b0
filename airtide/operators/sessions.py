"""Stream sessions: start, end, extremes and missing samples of every stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import round_binary_half_even
from airtide.functions.slots import minute_number, minute_text

# Viewers and a minute share one decimal: the extreme and its first time come from one
# plain max or min. Minutes since 1970 fit in 26 bits until the year 2097.
_MINUTE_RANGE = 2**26
_CODE = "decimal(29, 0)"


def _code(viewers: Column, minute: Column) -> Column:
    whole = viewers.cast("decimal(19, 0)") * F.lit(_MINUTE_RANGE).cast("decimal(9, 0)")
    return (whole + minute.cast("decimal(9, 0)")).cast(_CODE)


def _minute_in(code: Column, viewers: Column) -> Column:
    return (code - _code(viewers, F.lit(0))).cast("bigint")


def _points(facts: DataFrame) -> DataFrame:
    """A row per platform that a fact is live on."""
    minute, viewers = F.col("minute"), F.col("viewers")
    return (
        facts.select(
            "date",
            "channel",
            minute_number(F.col("date"), F.col("time")).alias("minute"),
            F.expr(
                "stack(2, 'YT', yt_number, youtube, 'TW', tw_number, twitch)"
                " AS (platform, stream_id, viewers)"
            ),
        )
        .where("stream_id != 0")
        .withColumn("latest_first", _code(viewers, _MINUTE_RANGE - 1 - minute))
        .withColumn("earliest_first", _code(viewers, minute))
    )


_STREAM = ["platform", "channel", "stream_id"]


def _partial(points: DataFrame, *by: str) -> DataFrame:
    return points.groupBy(*by, *_STREAM).agg(
        F.min("minute").alias("first"),
        F.max("minute").alias("last"),
        F.sum(F.col("viewers").cast("decimal(19, 0)")).alias("total"),
        F.count("viewers").alias("known_points"),
        F.max("viewers").alias("max_viewers"),
        F.max("latest_first").alias("max_code"),
        F.min("viewers").alias("min_viewers"),
        F.min("earliest_first").alias("min_code"),
        F.count("*").alias("actual_points"),
    )


def session_days(facts: DataFrame) -> DataFrame:
    """What each day holds of each stream; a stream over midnight has two rows or more."""
    return _partial(_points(facts), "date")


def stream_sessions(facts: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """One row per platform, channel and stream number.

    ``expected_points`` counts the slots from start to end; ``missing_points`` goes
    negative where a slot has several rows.
    """
    return _sessions(_partial(_points(facts)), slot_minutes)


def sessions_of_days(days: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """``stream_sessions`` of all facts, from what their days hold of each stream."""
    merged = days.groupBy(*_STREAM).agg(
        *[F.min(c).alias(c) for c in ("first", "min_viewers", "min_code")],
        *[F.max(c).alias(c) for c in ("last", "max_viewers", "max_code")],
        *[F.sum(c).alias(c) for c in ("total", "known_points", "actual_points")],
    )
    return _sessions(merged, slot_minutes)


def _sessions(sessions: DataFrame, slot_minutes: int) -> DataFrame:
    expected = F.floor((F.col("last") - F.col("first")) / slot_minutes) + 1
    mean = F.try_divide(F.col("total").cast("double"), F.col("known_points").cast("double"))
    max_minute = _MINUTE_RANGE - 1 - _minute_in(F.col("max_code"), F.col("max_viewers"))
    min_minute = _minute_in(F.col("min_code"), F.col("min_viewers"))
    return sessions.select(
        "platform",
        "stream_id",
        "channel",
        minute_text(F.col("first")).alias("start_time"),
        minute_text(F.col("last")).alias("end_time"),
        round_binary_half_even(mean, 1).alias("avg_viewers"),
        "max_viewers",
        minute_text(max_minute).alias("max_time"),
        "min_viewers",
        minute_text(min_minute).alias("min_time"),
        expected.alias("expected_points"),
        "actual_points",
        (expected - F.col("actual_points")).alias("missing_points"),
    )
