"""Run the whole study and keep every result as a parquet table.

    python -m airtide.plans.batch SNAPSHOTS STREAMERS OUTPUT GROUP [--start T] [--end T]
"""

from __future__ import annotations

import argparse
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession

from airtide.plans.catalog import RESULTS
from airtide.plans.study import Study
from airtide.settings import Settings
from airtide.sources.tables import (
    read_snapshots,
    read_streamers,
    with_created_at,
    write_snapshots,
    write_table,
)

# In the order of their inputs, so that each table is read by the later ones.
TABLES = [
    "slotted",
    "stream_means",
    "facts",
    "sessions",
    "baseline",
    "cut",
    "clean_baseline",
    "slot_totals",
    "yt_profile",
    "tw_profile",
    "slot_effect",
    "group_streamers",
    "group_facts",
    "group_cut",
    "geo_baseline",
    "group_slot_totals",
    "geo_yt_profile",
    "geo_tw_profile",
    "global_profile",
    "concurrent_slots",
    "concurrent_slot_members",
    "concurrency_effect",
    "concurrency_long",
    "concurrency_distribution",
    "slot_pressure",
]


#: Results that are written at a time; they wait for no other.
JOBS = 4


def write_study(
    snapshots: DataFrame, streamers: DataFrame, settings: Settings, output: str
) -> dict[str, str]:
    """Write every table of :data:`TABLES` below ``output`` and every named result below
    ``output``/results; name -> path.

    The tables serve as stage tables: each is computed once, and the results read them.
    A result that is one of them is not written again: its path is the table's. The scan
    of the snapshots is its own input and has no path. The facts are split by date. Audits
    are counted while the tables are written.
    """
    spark = snapshots.sparkSession
    paths: dict[str, str] = {}

    def write(table: DataFrame, name: str, rows: Observation | None = None) -> DataFrame:
        paths[name] = f"{output.rstrip('/')}/{name}"
        if name == "concurrency_effect":
            table = with_created_at(table)
        if name in ("facts", "group_cut"):
            write_snapshots(table, paths[name], rows)
        else:
            write_table(table, paths[name], rows)
        return spark.read.schema(table.schema).parquet(paths[name]).select(*table.columns)

    study = Study(snapshots, streamers, settings, stage=write, observe=True)
    for name in TABLES:
        study.table(name)
    written = {id(table): name for name, table in study.tables.items()}
    left: list[tuple[DataFrame, str]] = []
    for name, result in RESULTS.items():
        table = result(study)
        if id(table) in written:
            paths[f"results/{name}"] = paths[written[id(table)]]
        elif table is not snapshots:
            left.append((table, f"results/{name}"))
    with ThreadPool(JOBS) as pool:
        pool.starmap(inheritable_thread_target(spark)(write), left)
    return paths


def main() -> None:
    parser = argparse.ArgumentParser(description="Run the whole study.")
    for name in ("snapshots", "streamers", "output", "group"):
        parser.add_argument(name)
    for name, default in (("start", Settings.start), ("end", Settings.end)):
        parser.add_argument(f"--{name}", default=default, help="yyyy-MM-dd HH:MM")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("airtide").getOrCreate()
    write_study(
        read_snapshots(spark, args.snapshots),
        read_streamers(spark, args.streamers),
        Settings(group=args.group, start=args.start, end=args.end),
        args.output,
    )


if __name__ == "__main__":
    main()
