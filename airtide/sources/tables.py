"""Canonical input tables and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from airtide.operators.quality import last_changes, upsert_by_key
from airtide.plans.staging import stage

SNAPSHOT_SCHEMA = (
    "id bigint, date string, time string, channel string, "
    "youtube bigint, twitch bigint, yt_number bigint, tw_number bigint"
)
STREAMER_SCHEMA = "id bigint, channel_id string, channel_name string, grp string"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot fact in the canonical layout. A missing path raises on read."""
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)


def read_streamers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STREAMER_SCHEMA).parquet(path)


def as_snapshots(table: DataFrame) -> DataFrame:
    """Canonical snapshots from a table of the same columns in another store or type."""
    return table.selectExpr(*_casts(SNAPSHOT_SCHEMA))


def as_streamers(table: DataFrame) -> DataFrame:
    """Canonical streamers; the source calls the group column ``group``."""
    if "grp" not in table.columns:
        table = table.withColumnRenamed("group", "grp")
    return table.selectExpr(*_casts(STREAMER_SCHEMA))


def _casts(schema: str) -> list[str]:
    columns = [field.split() for field in schema.split(", ")]
    return [f"CAST({name} AS {kind}) AS {name}" for name, kind in columns]


def write_snapshots(snapshots: DataFrame, path: str, rows: Observation | None = None) -> None:
    """Write the fact split by date, so that date ranges prune whole folders.

    Rebalancing gives each date files of even size: a small date one, a large date many,
    written by as many tasks. ``rows`` observes ``n_rows``.
    """
    rebalanced = counted(snapshots.hint("rebalance", "date"), rows)
    rebalanced.write.mode("overwrite").partitionBy("date").parquet(path)


def write_table(table: DataFrame, path: str, rows: Observation | None = None) -> None:
    """Replace a table. Read inputs must live at other paths. ``rows`` observes ``n_rows``."""
    counted(table, rows).write.mode("overwrite").parquet(path)


def counted(table: DataFrame, rows: Observation | None) -> DataFrame:
    """The table, whose rows are counted by the tasks that write it.

    Nothing is shuffled between here and the writer, and of a task that runs twice only
    the attempt that is committed counts.
    """
    return table.observe(rows, F.count("*").alias("n_rows")) if rows else table


def write_partitions(table: DataFrame, path: str, partition: str) -> None:
    """Replace the folders of the values of ``partition`` that occur; others stay as they are."""
    (
        table.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def merge_partitions(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    keys: list[str],
    partition: str,
    order: str | None = None,
) -> None:
    """Upsert ``changes`` into a table that is split by ``partition``, one of ``keys``.

    Changes have the table's columns and ``order``: of changes of one key the one with the
    largest ``order`` counts. Only folders that
    a change falls into are read and rewritten; the others keep their files. The new
    rows are written beside the table first, so that a run that fails leaves it whole.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys, or a row could change its folder")
    if order:
        changes = last_changes(changes, keys, order).drop(order)
    changes = stage(changes, "changes")
    current = spark.read.schema(changes.schema).parquet(path)
    touched = changes.select(partition).distinct()
    near = current.join(touched, current[partition].eqNullSafe(touched[partition]), "left_semi")
    merged = stage(upsert_by_key(near, changes, keys), "merged")
    write_partitions(merged, path, partition)


def with_created_at(table: DataFrame) -> DataFrame:
    """Add the time of the run, as the default of the effect table does."""
    return table.withColumn("created_at", F.current_timestamp())
