"""Clock-time expressions: slots of the day and their display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MINUTES_PER_DAY = 24 * 60


def _hour(time: Column) -> Column:
    return F.substring_index(time, ":", 1).cast("int")


def _minute(time: Column) -> Column:
    return F.substring_index(F.substring_index(time, ":", 2), ":", -1).cast("int")


def _two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def slot_start(time: Column, slot_minutes: int = 15) -> Column:
    """``HH:MM:SS`` -> ``HH:MM`` of the slot it falls into."""
    minute = _minute(time)
    return F.concat(
        _two_digits(_hour(time)),
        F.lit(":"),
        _two_digits(minute - minute % slot_minutes),
    )


def slot_labels(slot_minutes: int = 15) -> list[str]:
    """All slots of a day, from midnight."""
    return [
        f"{m // 60:02d}:{m % 60:02d}" for m in range(0, MINUTES_PER_DAY, slot_minutes)
    ]


def slot_label_array(slot_minutes: int = 15) -> Column:
    """All slots of a day as one constant array column."""
    return F.split(F.lit(",".join(slot_labels(slot_minutes))), ",")


def slot_labels_from_noon(slot_minutes: int = 15) -> list[str]:
    """All slots of a day in broadcast order, from noon to noon."""
    labels = slot_labels(slot_minutes)
    half = len(labels) // 2
    return labels[half:] + labels[:half]


def time_slots(spark: SparkSession, slot_minutes: int = 15) -> DataFrame:
    """One row per slot of the day."""
    start = F.col("id") * slot_minutes
    return spark.range(MINUTES_PER_DAY // slot_minutes).select(
        F.concat(
            _two_digits(F.floor(start / 60)),
            F.lit(":"),
            _two_digits(start % 60),
        ).alias("time")
    )


def minutes_from_noon_order(time: Column) -> Column:
    """Sort key that runs 12:00 .. 23:45, 00:00 .. 11:45."""
    hour = _hour(time)
    return hour * 60 + _minute(time) + F.when(hour < 12, MINUTES_PER_DAY).otherwise(0)


def hour_from_noon_order(time: Column) -> Column:
    """Hour-level form of the noon-first sort key."""
    hour = _hour(time)
    return F.when(hour >= 12, hour).otherwise(hour + 24)


def in_evening(time: Column, first_hour: int = 18, end_hour: int = 5) -> Column:
    """True from ``first_hour`` through midnight up to ``end_hour``."""
    hour = _hour(time)
    return (hour >= first_hour) | (hour < end_hour)


def is_whole_hour(time: Column) -> Column:
    return time.endswith(":00")


def minute_number(date: Column, time: Column) -> Column:
    """Minutes since 1970-01-01 00:00 of a ``yyyy-MM-dd`` date and ``HH:MM`` time."""
    days = F.unix_date(F.to_date(date)).cast("bigint")
    return days * MINUTES_PER_DAY + _hour(time) * 60 + _minute(time)


def minute_text(number: Column) -> Column:
    """Inverse of :func:`minute_number`, as ``yyyy-MM-dd HH:MM``."""
    of_day = F.pmod(number, F.lit(MINUTES_PER_DAY))
    day = F.floor((number - of_day) / MINUTES_PER_DAY).cast("int")
    return F.concat(
        F.date_from_unix_date(day).cast("string"),
        F.lit(" "),
        _two_digits(F.floor(of_day / 60)),
        F.lit(":"),
        _two_digits(of_day % 60),
    )
