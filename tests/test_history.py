"""Tables that are kept by day, and merges that rewrite single folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from airtide.operators import baseline, sessions
from airtide.plans.catalog import EVENTS_SETTINGS
from airtide.plans.history import History
from airtide.settings import Settings
from airtide.sources import tables

SF = "/root/testdata/sf0.01"


def rows(table):
    return sorted(map(repr, table.select(*sorted(table.columns)).collect()))


def files(path):
    return {
        os.path.relpath(os.path.join(folder, name), path): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet")
    }


@pytest.fixture(scope="module")
def study(spark):
    return contract.study(spark, SF)


def test_merged_days_equal_the_whole_run(spark, study, tmp_path):
    facts, streamers = study.table("facts"), study.streamers
    history = History(spark, str(tmp_path), EVENTS_SETTINGS)
    for first, last in (("2024-01-01", "2024-01-11"), ("2024-01-12", "2024-01-12"), ("2024-01-13", "2024-12-31")):
        history.add(facts.where(F.col("date").between(first, last)))
    z = EVENTS_SETTINGS.z_two_sided
    assert rows(history.baseline(streamers)) == rows(baseline.channel_baseline(facts, streamers, z))
    assert rows(history.baseline_clean(streamers)) == rows(baseline.channel_baseline_clean(facts, streamers))
    assert rows(history.sessions) == rows(sessions.stream_sessions(facts))


def test_a_new_day_leaves_the_files_of_others(spark, study, tmp_path):
    facts = study.table("facts")
    history = History(spark, str(tmp_path), EVENTS_SETTINGS)
    history.add(facts.where("date < '2024-01-05'"))
    before = {name: files(history.path(name)) for name in ("channel_days", "session_days")}
    history.add(facts.where("date BETWEEN '2024-01-04' AND '2024-01-06'"))
    for name, kept in before.items():
        after = files(history.path(name))
        same = {f for f in kept if after.get(f) == kept[f]}
        assert {f.split("/")[0] for f in same} == {f"date=2024-01-0{d}" for d in (1, 2, 3)}
        assert {f.split("/")[0] for f in after} == {f"date=2024-01-0{d}" for d in (1, 2, 3, 4, 5, 6)}
    assert rows(history.sessions) == rows(sessions.stream_sessions(facts.where("date <= '2024-01-06'")))


def test_a_stream_over_midnight_is_one_session(spark, snapshots, tmp_path):
    facts = snapshots(
        (1, "2024-01-01", "23:30", "c", 10, 0, 5, 0),
        (2, "2024-01-01", "23:45", "c", 30, 0, 5, 0),
        (3, "2024-01-02", "00:00", "c", 30, 0, 5, 0),
        (4, "2024-01-02", "00:30", "c", 5, 0, 5, 0),
        (5, "2024-01-02", "00:30", "c", 7, 0, None, None),
    )
    history = History(spark, str(tmp_path), Settings(group="g"))
    history.add(facts.where("date = '2024-01-02'"))
    history.add(facts.where("date = '2024-01-01'"))
    session = history.sessions.collect()
    assert len(session) == 1
    s = session[0]
    assert (s.start_time, s.end_time) == ("2024-01-01 23:30", "2024-01-02 00:30")
    assert (s.max_viewers, s.max_time) == (30, "2024-01-01 23:45")
    assert (s.min_viewers, s.min_time, s.avg_viewers) == (5, "2024-01-02 00:30", 18.8)
    assert (s.expected_points, s.actual_points, s.missing_points) == (5, 4, 1)


def test_constant_and_silent_channels(spark, snapshots, streamers, tmp_path):
    facts = snapshots(*[
        (i, f"2024-01-0{1 + i % 3}", "10:00", "c", 77, 0, 3, 0) for i in range(9)
    ], (20, "2024-01-01", "10:00", "d", 0, 0, 4, 0))
    known = streamers((1, "c", "C", "g"), (2, "d", "D", "g"), (3, "e", "E", None))
    history = History(spark, str(tmp_path), Settings(group="g"))
    history.add(facts)
    assert rows(history.baseline(known)) == rows(baseline.channel_baseline(facts, known))
    assert rows(history.baseline_geo(known)) == rows(baseline.channel_baseline_geo(facts, known))


def test_merge_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "k bigint, day string, v bigint"
    current = spark.createDataFrame(
        [(i, f"10:0{i % 4}", i) for i in range(40)] + [(None, "10:01", 5)], schema
    )
    tables.write_partitions(current, path, "day")
    before = files(path)
    changes = spark.createDataFrame(
        [(1, "10:01", 100, 1), (1, "10:01", 102, 3), (1, "10:01", 101, 2), (99, "10:09", 7, 1), (4, "10:01", 8, 1)],
        schema + ", version int",
    )
    tables.merge_partitions(spark, path, changes, ["k", "day"], "day", "version")
    after = files(path)
    same = {f.split("/")[0] for f in before if after.get(f) == before[f]}
    assert same == {f"day=10%3A0{i}" for i in (0, 2, 3)}
    found = {(r.k, r.day): r.v for r in spark.read.schema(schema).parquet(path).collect()}
    want = {(i, f"10:0{i % 4}"): i for i in range(40)} | {(None, "10:01"): 5}
    assert found == want | {(1, "10:01"): 102, (99, "10:09"): 7, (4, "10:01"): 8}
    with pytest.raises(ValueError):
        tables.merge_partitions(spark, path, changes, ["k"], "day", "version")
