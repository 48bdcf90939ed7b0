from __future__ import annotations

import os
import re
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as contract
from airtide.operators import cleaning
from airtide.plans import batch, staging
from airtide.plans.catalog import EVENTS_SETTINGS, MAINTAINED, RESULTS
from airtide.plans.study import Study
from airtide.settings import Settings
from airtide.sources import tables
from airtide.sources.events import read_events_as_study_tables

SF = "/root/testdata/sf0.001"


def plan_of(table):
    return table._jdf.queryExecution().toString()


class _Cluster:
    """Stands for a session on a cluster, with or without a shared folder."""

    class _Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    def __init__(self, folder):
        self.sparkContext = self._Context()
        self.conf = {staging.CHECKPOINT_DIR: folder} if folder else {}


def test_stage_folder_comes_from_the_session(spark, tmp_path):
    assert staging.stage_folder(_Cluster("hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        staging.stage_folder(_Cluster(None))
    for folder in ("file:/mnt/shared", "/mnt/shared"):  # may be mounted everywhere, or not
        with pytest.warns(UserWarning, match="mount"):
            assert staging.stage_folder(_Cluster(folder)) == folder
    table = spark.range(5)
    staged = staging.stage(table, "five")
    assert sorted(r.id for r in staged.collect()) == list(range(5))
    assert staging.stage_folder(spark) in staged.inputFiles()[0]
    assert staging.stage(table, "five").inputFiles() != staged.inputFiles()


def test_snapshot_table_round_trip(spark, tmp_path):
    snapshots, streamers = read_events_as_study_tables(spark, SF)
    path = str(tmp_path / "snapshots")
    tables.write_snapshots(snapshots, path)
    read = tables.read_snapshots(spark, path)
    assert dict(read.dtypes) == dict(snapshots.dtypes)
    assert read.count() == snapshots.count()
    assert read.select(snapshots.columns).exceptAll(snapshots).isEmpty()
    per_date = Counter(os.path.dirname(f) for f in read.inputFiles())
    assert len(per_date) == 30 and max(per_date.values()) == 1
    day = read.where("date = '2024-01-05'")
    assert "PartitionFilters: [isnotnull(date" in plan_of(day)
    with pytest.raises(AnalysisException):
        tables.read_snapshots(spark, str(tmp_path / "missing"))


def test_tables_of_other_types_become_canonical(spark):
    raw = spark.createDataFrame(
        [("1", "c1", "One", "http://x", None, "g")],
        "id string, channel_id string, channel_name string, yt_url string, tw_url string,"
        " `group` string",
    )
    assert tables.as_streamers(raw).first().asDict() == {
        "id": 1, "channel_id": "c1", "channel_name": "One", "grp": "g",
    }
    fact = spark.createDataFrame(
        [(1, "2024-01-01", "10:00:00", "c1", 5, 6, None, 0)],
        "id int, date string, time string, channel string, youtube int, twitch int,"
        " yt_number int, tw_number int",
    )
    assert dict(tables.as_snapshots(fact).dtypes)["youtube"] == "bigint"
    assert tables.as_snapshots(fact).first().yt_number is None


def test_queries_of_one_dict_share_stage_tables(spark):
    queries = contract.queries()
    first = queries["outlier_cut_2s"](spark, SF).inputFiles()
    assert set(queries["outlier_cut_2s"](spark, SF).inputFiles()) == set(first)
    assert not set(contract.queries()["outlier_cut_2s"](spark, SF).inputFiles()) & set(first)


def test_batch_run_matches_the_single_queries(spark, tmp_path):
    snapshots, streamers = read_events_as_study_tables(spark, SF)
    paths = batch.write_study(snapshots, streamers, EVENTS_SETTINGS, str(tmp_path))
    study = Study(snapshots, streamers, EVENTS_SETTINGS)
    for name in ("sessions", "slot_effect", "global_profile"):
        written = spark.read.parquet(paths[name])
        single = getattr(study, name).select(written.columns)
        assert written.exceptAll(single).isEmpty() and single.exceptAll(written).isEmpty()
    effect = spark.read.parquet(paths["concurrency_effect"])
    assert effect.where(F.col("created_at").isNull()).isEmpty()
    assert set(paths) == {
        *batch.TABLES, *[f"results/{name}" for name in RESULTS if name != "snapshot_scan"],
    }
    tables = {paths[name] for name in batch.TABLES}
    assert paths["results/slot_dedup"] == paths["facts"]  # a result that is a table
    for name, result in RESULTS.items():
        path = paths.get(f"results/{name}")
        assert path is None or path in tables or path == f"{tmp_path}/results/{name}"
    assert sum(p in tables for n, p in paths.items() if n.startswith("results/")) > 15
    assert all(os.path.exists(f"{p}/_SUCCESS") for p in paths.values())
    assert any(name.startswith("date=") for name in os.listdir(paths["facts"]))
    distribution = spark.read.parquet(paths["results/concurrency_distribution"])
    assert distribution.count() > 0 and distribution.agg(F.max("cnt_1")).first()[0] > 0
    for name in AUDITS:
        written = spark.read.parquet(paths[f"results/{RESULT_OF[name]}"])
        assert written.collect() == getattr(study, name).select(written.columns).collect()


AUDITS = ["clean_audit", "facts_audit", "cut_audit", "group_cut_audit"]
RESULT_OF = {
    "clean_audit": "quality_filter_audit", "facts_audit": "slot_dedup_audit",
    "cut_audit": "outlier_audit", "group_cut_audit": "outlier_audit_low3",
}


def observed_study(spark):
    def write(table, name, rows=None):
        return staging.stage(tables.counted(table, rows), name)

    return Study(*read_events_as_study_tables(spark, SF), EVENTS_SETTINGS, stage=write, observe=True)


def test_audits_are_counted_while_tables_are_written(spark):
    study = observed_study(spark)
    for name in ("slotted", "facts", "cut", "group_facts", "group_cut"):
        study.table(name)
    plain = contract.study(spark, SF)
    for name in AUDITS:
        audit = getattr(study, name)
        assert "Scan parquet" not in plan_of(audit) and "Scan parquet" in plan_of(getattr(plain, name))
        assert audit.collect() == getattr(plain, name).collect(), name


def test_counts_that_do_not_fit_the_written_rows_are_not_used(spark, monkeypatch):
    """As when a task below a shuffle ran twice: the audit then makes a pass of its own."""
    study = observed_study(spark)
    for name in ("facts", "cut", "group_facts", "group_cut"):
        study.table(name)
    monkeypatch.setattr(study, "_n_rows", lambda name: -1)
    for name in ("cut_audit", "group_cut_audit"):
        assert "Scan parquet" in plan_of(getattr(study, name))
        assert getattr(study, name).collect() == getattr(contract.study(spark, SF), name).collect()


def test_without_tables_audits_make_a_pass(spark):
    study = observed_study(spark)
    study.clean, study.cut  # plans that nobody writes
    assert study.clean_audit.collect() == contract.study(spark, SF).clean_audit.collect()
    assert study.cut_audit.first()["n_before"] > 0


@pytest.mark.parametrize("minutes", [0, 7, 25, 90])
def test_slots_divide_the_hour(minutes):
    with pytest.raises(ValueError):
        Settings(group="g", slot_minutes=minutes)


def test_days_follow_from_the_period():
    assert Settings(group="g").n_days == 180
    assert Settings(group="g", start="2024-01-01 12:00", end="2024-01-31 12:00").n_days == 30
    for end in ("2024-01-01 12:00", "2024-01-02 11:45"):
        with pytest.raises(ValueError):
            Settings(group="g", start="2024-01-01 12:00", end=end)


def test_members_are_found_before_the_facts_are_shuffled(spark):
    """No exchange of the facts lies below the semi join that restricts them."""
    study = contract.study(spark, SF)
    for name in ("group_facts", "group_cut"):
        lines = getattr(study, name)._jdf.queryExecution().executedPlan().toString().split("\n")
        depth = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
        assert not any(re.search(r"Exchange hashpartitioning\((channel|_spread)#", line) for line in lines[depth:])


def test_the_quality_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    tables.write_table(read_events_as_study_tables(spark, SF)[0], path)
    text = plan_of(cleaning.quality_filter(tables.read_snapshots(spark, path)))
    assert "PushedFilters: [Or(Or(Or(IsNull(yt_number),Not(EqualTo(yt_number,0)))" in text


def test_the_scan_reads_only_what_a_query_needs(spark):
    study = contract.study(spark, SF)
    facts = staging.stage(cleaning.to_slots(study.clean), "plan-facts")
    live = facts.where(F.col("yt_number") != 0).groupBy("channel", "time").agg(F.avg("youtube"))
    text = plan_of(live)
    assert "PushedFilters: [IsNotNull(yt_number), Not(EqualTo(yt_number,0))]" in text
    assert "ReadSchema: struct<time:string,channel:string,youtube:bigint,yt_number:bigint>" in text


def test_no_plan_leaves_the_jvm_or_pairs_all_rows(spark):
    queries = contract.queries()  # share their stage tables
    for name in RESULTS | MAINTAINED:
        text = plan_of(queries[name](spark, SF))
        for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in text, (name, word)


def test_entry(spark):
    assert contract.entry(spark).count() == 96


def test_no_grid_of_channels_and_slots_is_shuffled(spark):
    """No exchange of rows by key stands above the step that makes the grid."""
    study = contract.study(spark, SF)
    for name in ("channel_overlay", "yt_heatmap", "channel_directory"):
        lines = getattr(study, name)._jdf.queryExecution().executedPlan().toString().split("\n")
        made = [i for i, line in enumerate(lines) if "Generate explode" in line or "Generate inline" in line]
        assert not any("Exchange hash" in line for i in made for line in lines[:i]), name


def test_stream_means_are_written_once_per_study(spark):
    written = []

    def counting(table, name):
        written.append(name)
        return staging.stage(table, name)

    study = Study(*read_events_as_study_tables(spark, SF), EVENTS_SETTINGS, stage=counting)
    for name in ("slot_mean", "facts", "facts_audit", "baseline", "cut", "group_cut"):
        study.plan(name)
    assert written.count("stream_means") == 1 and len(written) == len(set(written))


def test_a_period_reads_the_folders_of_its_dates_only(spark, tmp_path):
    """Facts that are stored by date: the concurrency branch prunes them to its period."""

    def write(table, name):
        if name != "group_cut":
            return staging.stage(table, name)
        path = str(tmp_path / name)
        tables.write_snapshots(table, path)
        return spark.read.schema(table.schema).parquet(path).select(*table.columns)

    settings = Settings(group="BUILDING", start="2024-01-10 12:00", end="2024-01-15 12:00")
    inputs = read_events_as_study_tables(spark, SF)
    pruned = Study(*inputs, settings, stage=write).concurrency_long
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(pruned))
    assert any("date" in f and ">= 2024-01-10" in f and "<= 2024-01-15" in f for f in filters)
    plain = Study(*inputs, settings).concurrency_long
    assert sorted(pruned.collect()) == sorted(plain.collect()) != []
