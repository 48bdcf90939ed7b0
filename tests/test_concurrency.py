from __future__ import annotations

import math

import pytest

from airtide.operators import concurrency

DAY = "2024-01-01"
RANGE = {"start": "2024-01-01 12:00", "end": "2024-01-03 12:00", "n_days": 2}


@pytest.fixture
def bases(spark):
    return spark.createDataFrame(
        [("a", math.log(100), math.log(10)), ("b", None, math.log(10))],
        "channel_id string, yt_log_geo_avg double, tw_log_geo_avg double",
    )


@pytest.fixture
def slots(spark):
    """(date, time, live_count, geo_perf_percent)"""
    schema = "date string, time string, live_count bigint, geo_perf_percent double"
    return lambda *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def effects(spark):
    return lambda *rows: spark.createDataFrame(
        list(rows), "live_count bigint, avg_geo_perf_percent double"
    )


def test_concurrent_slots(snapshots, bases):
    facts = snapshots(
        (1, DAY, "10:00", "a", 200, 0, 1, 0),
        (2, DAY, "10:00", "a", 50, 0, 2, 0),  # second row of the channel counts too
        (3, DAY, "10:15", "b", 40, 20, 1, 1),  # YouTube wins, though it has no baseline
        (4, DAY, "10:30", "b", 0, 20, 1, 1),  # no viewers there: Twitch counts
        (5, DAY, "10:30", "stranger", 9, 9, 1, 1),
        (6, DAY, "10:30", "a", 70, 70, None, None),
        (7, DAY, "10:30", "a", 70, 70, None, 0),  # live nowhere, but known
    )
    rows = {r.time: r for r in concurrency.concurrent_slots(facts, bases).collect()}
    assert {t: r.live_count for t, r in rows.items()} == {"10:00": 2, "10:15": 1, "10:30": 2}
    assert rows["10:00"].geo_perf_percent == pytest.approx(0.0, abs=1e-9)
    assert rows["10:15"].geo_perf_percent is None
    assert rows["10:30"].geo_perf_percent == pytest.approx(100.0)


def test_members_are_the_rows_that_are_counted(snapshots, bases):
    facts = snapshots(
        *[(i, DAY, "10:00", "a", 100, 0, i + 1, 0) for i in range(250)],
        (900, DAY, "10:15", "a", 100, 0, 7, 0),
        (901, DAY, "10:15", "stranger", 100, 0, 7, 0),
    )
    members = concurrency.concurrent_slot_members(facts, bases).collect()
    assert sorted(r.id for r in members if r.time == "10:00") == list(range(250))
    assert [r.id for r in members if r.time == "10:15"] == [900]
    counts = {r.time: r.live_count for r in concurrency.concurrent_slots(facts, bases).collect()}
    assert counts == {"10:00": 250, "10:15": 1}


def test_effect_is_a_geometric_mean(slots):
    table = slots(
        (DAY, "10:00", 1, 100.0), (DAY, "10:15", 1, -50.0), (DAY, "10:30", 2, None),
        (DAY, "10:45", 3, 10.0), (DAY, "11:00", 4, -100.0),
    )
    rows = {r.live_count: r for r in concurrency.concurrency_effect(table).collect()}
    assert rows[1].avg_geo_perf_percent == pytest.approx(0.0, abs=1e-9)
    assert rows[1].sample_cnt == 2 and 2 not in rows
    assert rows[4].avg_geo_perf_percent is None and rows[4].sample_cnt == 1


@pytest.fixture
def long(slots):
    return lambda *rows: concurrency.concurrency_long(slots(*rows), **RANGE)


def test_range_and_levels(long):
    table = long(
        ("2024-01-01", "11:45", 1, 0.0),  # before the first noon
        ("2024-01-01", "12:00", 2, 0.0),
        ("2024-01-02", "12:00", 25, 0.0),  # above the shown levels: not a day with none
        ("2024-01-03", "11:45", 3, 0.0),
        ("2024-01-03", "12:00", 3, 0.0),  # after the last noon
    )
    assert {tuple(r) for r in table.collect()} == {
        ("12:00", 0, 0), ("12:00", 2, 1), ("12:00", 25, 1), ("11:45", 0, 1), ("11:45", 3, 1),
    }
    wide = concurrency.concurrency_distribution(table, RANGE["n_days"])
    rows = {r.time: r for r in wide.collect()}
    noon, before = rows["12:00"], rows["11:45"]
    assert (noon.cnt_0, noon.cnt_2, noon.cnt_over, noon.avg_live_count) == (0, 1, 1, 13.5)
    assert (before.cnt_0, before.cnt_3, before.cnt_over, before.avg_live_count) == (1, 1, 0, 1.5)
    for r in rows.values():
        assert sum(r[f"cnt_{k}"] for k in range(11)) + r.cnt_over == 2
    matrix = {r.time: r for r in concurrency.concurrency_heatmap(table).collect()}
    assert [matrix["12:00"][str(k)] for k in range(11)] == [0, 0, 1] + [0] * 8
    assert (matrix["12:00"]["over"], matrix["11:45"]["0"]) == (1, 1)


def test_pressure_strict_and_known(long, effects):
    table = long(
        ("2024-01-01", "12:00", 1, 0.0), ("2024-01-02", "12:00", 2, 0.0),
        ("2024-01-02", "12:15", 13, 0.0),
    )
    every = [(k, 2.0 * k) for k in range(1, 14)]
    rows = {r.time: r for r in concurrency.slot_pressure(table, effects(*every), 2).collect()}
    assert (rows["12:00"].expected_perf, rows["12:00"].expected_perf_known) == (3.0, 3.0)
    assert rows["12:15"].expected_perf == 13.0  # no level is left out
    # Level 7 never occurs, and still its missing effect hides the sums.
    for gap in (every[:6] + every[7:], every[:6] + [(7, None)] + every[7:]):
        rows = concurrency.slot_pressure(table, effects(*gap), 2).collect()
        assert {(r.time, r.expected_perf, r.expected_perf_known) for r in rows} == {
            ("12:00", None, 3.0), ("12:15", None, 13.0),
        }
    # Levels above the highest that occurs do not matter.
    low = concurrency.slot_pressure(table.where("live_count < 13"), effects(*every[:2]), 2)
    assert low.first().expected_perf == 3.0
