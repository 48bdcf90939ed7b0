from __future__ import annotations

import math

import pytest

from airtide.functions.slots import slot_labels
from airtide.operators import effect, profile
from airtide.settings import TWITCH, YOUTUBE

DAY = "2024-01-01"
PROFILE = (
    "channel_id string, channel_name string, time string, live_count bigint, "
    "avg_viewers double, diff_percent double"
)


@pytest.fixture
def profiles(spark):
    """Profile rows from (channel, time, live_count, diff_percent)."""
    return lambda *rows: spark.createDataFrame(
        [(c, c.upper(), t, n, 10.0 * n, d) for c, t, n, d in rows], PROFILE
    )


def cells(table):
    return {(r.channel_id, r.time): r for r in table.collect()}


def by_time(table):
    return {r.time: r for r in table.collect()}


@pytest.fixture
def facts(snapshots):
    return snapshots(
        (1, DAY, "10:00", "a", 100, 0, 1, 0),
        (2, "2024-01-02", "10:00", "a", 200, 0, 2, 0),
        (3, DAY, "10:15", "a", 0, 0, 1, 0),
        (4, DAY, "10:30", "a", 900, 0, 0, 7),  # not live on YouTube
        (5, DAY, "10:00", "t", 0, 60, 0, 5),
    )


def test_linear_profile_grid(facts, streamers):
    names = streamers((1, "a", "A", None), (2, "t", "T", None), (3, "quiet", "Q", None))
    totals = profile.slot_totals(facts)
    grid = cells(profile.slot_profile(totals, names, YOUTUBE))
    # 96 slots for every channel with a mean on the platform, and no other channel
    assert sorted(t for c, t in grid if c == "a") == slot_labels()
    assert {c for c, _ in grid} == {"a"}
    assert (grid["a", "10:00"].live_count, grid["a", "10:00"].avg_viewers) == (2, 150.0)
    assert grid["a", "10:00"].diff_percent == 50.0
    assert grid["a", "10:15"].diff_percent == -100.0 and grid["a", "10:15"].live_count == 1
    assert grid["a", "10:30"].diff_percent == -100.0 and grid["a", "10:30"].live_count == 0
    twitch = cells(profile.slot_profile(totals, names, TWITCH))
    assert twitch["t", "10:00"].diff_percent == 0.0
    live = sum(r.live_count for r in grid.values())
    assert live == 3


def test_geometric_profile_empty_and_zero_slots(facts, streamers):
    names = streamers((1, "a", "A", "g"))
    grid = cells(profile.slot_profile_geo(profile.slot_totals(facts), names, YOUTUBE))
    assert grid["a", "10:30"].diff_percent is None  # no rows
    assert grid["a", "10:15"].diff_percent == 0.0  # rows, but no viewers
    assert grid["a", "10:00"].diff_percent == 0.0  # the whole geometric mean


def test_a_channel_without_viewers_has_no_grid(snapshots, streamers):
    zero = snapshots((1, DAY, "10:00", "z", 0, 9, 1, 1), (2, DAY, "10:15", "z", 0, 0, 1, 1))
    totals = profile.slot_totals(zero)
    names = streamers((1, "z", "Z", None))
    assert profile.slot_profile(totals, names, YOUTUBE).isEmpty()
    assert profile.slot_profile(totals, names, TWITCH).count() == 96


def literal_effect(yt, tw, time):
    """Sums over the join of both profiles on the slot."""
    ys = [(n, d) for _, t, n, d in yt if t == time and d != -100] or [None]
    ws = [(n, d) for _, t, n, d in tw if t == time and d != -100] or [None]
    pairs = [(y, w) for y in ys for w in ws]

    def total(side, f):
        return sum(f(p[side]) for p in pairs if p[side])

    weight = sum(total(s, lambda x: x[0]) for s in (0, 1))
    value = sum(total(s, lambda x: x[0] * x[1]) for s in (0, 1))
    return value / weight if weight else 0.0


def test_effect_follows_the_fan_out(profiles):
    yt = [("a", "10:00", 3, 10.0), ("b", "10:00", 1, -30.0), ("a", "11:00", 2, 8.0),
          ("c", "10:00", 5, -100.0)]
    tw = [("a", "10:00", 2, 50.0), ("b", "10:00", 2, 0.0), ("c", "10:00", 7, 4.0)]
    result = by_time(effect.slot_effect_weighted(profiles(*yt), profiles(*tw)))
    assert len(result) == 96
    ten = result["10:00"]
    assert ten.yt_avg == 0.0 and ten.tw_avg == round(128 / 11, 2)
    assert ten.all_avg == round(literal_effect(yt, tw, "10:00"), 2)
    assert ten.all_avg_pooled == round(128 / 15, 2)
    assert ten.all_avg != ten.all_avg_pooled
    assert (result["11:00"].yt_avg, result["11:00"].tw_avg, result["11:00"].all_avg) == (
        8.0, 0.0, 8.0,
    )
    assert tuple(result["12:00"])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_effect_rounds_exact_ties_away_from_zero(profiles):
    yt = profiles(("a", "10:00", 1, 0.01), ("b", "10:00", 1, 0.02))
    result = by_time(effect.slot_effect_weighted(yt, profiles()))
    assert result["10:00"].yt_avg == 0.02


def test_series(profiles):
    yt = profiles(("a", "10:00", 1, 50.0), ("a", "10:15", 1, -250.0))
    table = effect.slot_effect_weighted(yt, profiles())
    percent = effect.slot_series_percent(table).collect()
    assert [r.time for r in percent] == slot_labels()
    assert sum(r.whole_hour for r in percent) == 24
    logs = by_time(effect.slot_series_log(table))
    assert logs["10:00"].yt_log == pytest.approx(math.log(1.5))
    assert logs["10:15"].yt_log == 0.0
    assert effect.slot_series_one_platform(table).columns == ["time", "tw_avg", "whole_hour"]


def test_global_profile(profiles):
    yt = profiles(
        ("a", "20:00", 2, 21.0), ("b", "20:00", 2, -100.0), ("a", "20:15", 0, None)
    )
    tw = profiles(("a", "08:00", 1, 10.0))
    table = effect.slot_global_profile(yt, tw)
    rows = by_time(table)
    # the -100 cell has no log: it adds weight only
    assert rows["20:00"].yt_weighted_diff == 10.0
    assert (rows["20:00"].yt_sum, rows["20:00"].yt_weighted_avg) == (4, 20.0)
    assert (rows["20:15"].yt_sum, rows["20:15"].yt_weighted_diff) == (0, None)
    assert rows["08:00"].yt_sum is None and rows["08:00"].tw_sum == 1
    evening = effect.evening_profile(table).collect()
    assert [r.time for r in evening] == ["20:00", "20:15"]
    assert evening[1].yt_weighted_diff == 0.0 and evening[0].tw_sum == 0


def test_directory_and_overlay(profiles):
    yt = profiles(("b", "13:00", 1, 1.0), ("b", "02:00", 2, 1.0))
    tw = profiles(("b", "13:00", 3, 1.0), ("a", "12:00", 4, 1.0))
    yt, tw = profile.as_channels(yt), profile.as_channels(tw)
    directory = profile.channel_directory(yt, tw)
    assert [r.channel_id for r in directory.collect()] == ["a", "b"]
    assert profile.channel_id_of(directory, "B").first().channel_id == "b"
    assert profile.channel_id_of(directory, "nobody").isEmpty()
    everyone = profile.channel_slot_overlay(yt, tw)
    assert everyone.count() == 3
    one = profile.channel_slot_overlay(yt, tw, "b").collect()
    assert [(r.time, r.sort_key, r.yt_live, r.tw_live) for r in one] == [
        ("13:00", 13, 1, 3), ("02:00", 26, 2, None),
    ]
    assert one[1].channel_name == "B"


def test_heatmap(profiles, streamers):
    yt = profiles(("b", "13:00", 1, 5.5), ("b", "02:00", 2, None), ("a", "13:00", 1, -7.25))
    names = streamers((2, "a", "A", None), (1, "b", "B", None), (3, "quiet", "Q", None))
    yt = profile.as_channels(yt)
    rows = profile.diff_heatmap(yt, names).collect()
    assert [r.channel_id for r in rows] == ["b", "a"]
    assert len(rows[0]) == 3 + 96 and rows[0].__fields__[3] == "12:00"
    assert rows[0]["13:00"] == 5.5 and rows[0]["02:00"] == 0.0 and rows[1]["13:00"] == -7.25
    assert profile.diff_bound(yt, profile.as_channels(profiles())).first().max_abs == 7.25
