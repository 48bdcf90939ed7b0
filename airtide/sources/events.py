"""Adapter: an ``events`` log and a ``customer`` table read as audience snapshots.

Every rule is plain arithmetic on one row, so that it can be restated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NO_GROUP_SEGMENT = "MACHINERY"


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _stream_number(channels_per_stream: int) -> Column:
    """Neighbouring channels share one stream per day of the month."""
    return (
        1
        + F.floor(F.col("user_id") / channels_per_stream) * 31
        + F.dayofmonth("ts")
    ).cast("bigint")


def snapshots_from_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    signup = kind == "signup"
    purchase = kind == "purchase"
    on_youtube = kind.isin("view", "click", "signup")
    on_twitch = purchase | signup
    whole = F.floor("value")
    half = F.floor(F.col("value") * 0.5)
    stamp = F.col("ts").cast("string")

    youtube = (
        F.when(purchase & _every(67), 15)
        .when(signup & _every(61), 0)
        .when(signup & _every(53), 1)
        .when(signup & _every(59), whole + 10)
        .when(on_youtube, whole)
        .otherwise(0)
    )
    twitch = (
        F.when(signup & _every(61), whole + 10)
        .when(signup & _every(53), half + 10)
        .when(signup & _every(59), 1)
        .when(purchase, whole)
        .when(signup, half)
        .otherwise(0)
    )
    yt_number = (
        F.when(_every(97), F.lit(None)).when(on_youtube, _stream_number(2)).otherwise(0)
    )
    tw_number = F.when(on_twitch, _stream_number(3)).otherwise(0)

    return events.select(
        F.col("event_id").alias("id"),
        F.substring(stamp, 1, 10).alias("date"),
        F.substring(stamp, 12, 8).alias("time"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("channel"),
        youtube.cast("bigint").alias("youtube"),
        twitch.cast("bigint").alias("twitch"),
        yt_number.cast("bigint").alias("yt_number"),
        tw_number.cast("bigint").alias("tw_number"),
    )


def streamers_from_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("channel_id"),
        F.col("c_name").alias("channel_name"),
        F.expr(f"nullif(c_mktsegment, '{NO_GROUP_SEGMENT}')").alias("grp"),
    )


def read_events_as_study_tables(
    spark: SparkSession, folder: str
) -> tuple[DataFrame, DataFrame]:
    """(snapshots, streamers) from ``events.parquet`` and ``customer.parquet``."""
    return (
        snapshots_from_events(spark.read.parquet(f"{folder}/events.parquet")),
        streamers_from_customers(spark.read.parquet(f"{folder}/customer.parquet")),
    )
