from __future__ import annotations

import math
from statistics import pstdev

import pytest

from airtide.operators import baseline, group, outliers

DAY = "2024-01-01"


def by_channel(table):
    return {r.channel_id: r for r in table.collect()}


def facts_of(snapshots, viewers, channel="a", number=1):
    return snapshots(
        *[(i, DAY, "10:00", channel, v, 0, number, 0) for i, v in enumerate(viewers)]
    )


def test_statistics_and_band(snapshots, streamers):
    viewers = [100, 200, 400, 0]
    table = baseline.channel_baseline(
        facts_of(snapshots, viewers), streamers((1, "a", "A", None))
    )
    row = by_channel(table)["a"]
    logs = [math.log(v) for v in viewers if v > 0]
    mean, sigma = sum(logs) / 3, pstdev(logs)
    assert row.yt_avg == 175.0 and row.yt_std == round(pstdev(viewers), 1)
    assert row.yt_ln_avg == round(mean, 3) and row.yt_ln_std == round(sigma, 3)
    # the band is not the smallest and largest value
    assert row.yt_min == round(math.exp(mean - 2.5 * sigma), 1)
    assert row.yt_max == round(math.exp(mean + 2.5 * sigma), 1)
    assert row.tw_avg is None


def test_silent_channels(snapshots, streamers):
    facts = facts_of(snapshots, [50])
    names = streamers((1, "a", "A", "g"), (2, "quiet", "Q", None))
    assert by_channel(baseline.channel_baseline(facts, names))["quiet"].yt_avg is None
    clean = by_channel(baseline.channel_baseline_clean(facts, names))["quiet"]
    assert (clean.yt_avg, clean.yt_std, clean.yt_geo_avg, clean.yt_log_geo_avg) == (
        0.0, 0.0, 0.0, None,
    )
    geo = by_channel(baseline.channel_baseline_geo(facts, names))["quiet"]
    assert (geo.yt_avg, geo.yt_log_geo_avg) == (0.0, None)


def test_clean_baseline_names_the_means_rightly(snapshots, streamers):
    table = baseline.channel_baseline_clean(
        facts_of(snapshots, [10, 1000]), streamers((1, "a", "A", None))
    )
    row = by_channel(table)["a"]
    assert row.yt_geo_avg == 100.0
    assert row.yt_log_geo_avg == pytest.approx(math.log(100), abs=1e-6)


def test_squares_beyond_32_bits_and_constant_viewers(snapshots, streamers):
    names = streamers((1, "a", "A", None))
    wide = baseline.channel_baseline(facts_of(snapshots, [46341, 3_000_000]), names)
    assert by_channel(wide)["a"].yt_std == round(pstdev([46341, 3_000_000]), 1)
    constant = baseline.channel_baseline_clean(facts_of(snapshots, [77] * 9), names)
    assert by_channel(constant)["a"].yt_std == 0.0


def test_two_sided_cut_uses_rounded_statistics(snapshots, streamers):
    viewers = [100] * 30 + [101] * 10 + [5000]
    facts = facts_of(snapshots, viewers)
    stats = baseline.channel_baseline(facts, streamers((1, "a", "A", None)))
    cut = outliers.outlier_cut(facts, stats, outliers.beyond(2.5))
    assert cut.count() == 40
    audit = outliers.outlier_audit(facts, stats, outliers.beyond(2.5))
    assert tuple(audit.first()) == (41, 1, 0, 40)


def test_deviation_that_rounds_to_zero_disables_the_cut(snapshots, streamers):
    viewers = [1_000_000] * 200 + [1_001_000]
    facts = facts_of(snapshots, viewers)
    stats = baseline.channel_baseline(facts, streamers((1, "a", "A", None)))
    assert by_channel(stats)["a"].yt_ln_std == 0.0
    assert outliers.outlier_cut(facts, stats, outliers.beyond(2.5)).count() == 201


def test_cut_ignores_the_stream_number_and_unknown_channels(snapshots, streamers):
    facts = snapshots(
        *[(i, DAY, "10:00", "a", v, 0, 1, 0) for i, v in enumerate([100, 110] * 20)],
        (90, DAY, "10:00", "a", 9000, 50, 0, 1),  # not live, but the viewers are far out
        (91, DAY, "10:00", "a", 0, 50, 0, 1),  # no viewers: never an outlier
        (92, DAY, "10:00", "stranger", 9000, 0, 1, 0),
    )
    stats = baseline.channel_baseline(facts, streamers((1, "a", "A", None)))
    kept = {r.id for r in outliers.outlier_cut(facts, stats, outliers.beyond(2.5)).collect()}
    assert 90 not in kept and {91, 92} <= kept
    known = outliers.outlier_cut(facts, stats, outliers.beyond(2.5), only_known=True)
    assert {r.id for r in known.collect()} == kept - {92}


def test_low_cut_is_one_sided_and_counts_apart(snapshots, streamers):
    normal = [(i, DAY, "10:00", "a", 1000 + i % 7, 1000 + i % 5, 1, 1) for i in range(60)]
    facts = snapshots(
        *normal,
        (100, DAY, "10:00", "a", 2, 2, 1, 1),  # low on both: counted for YouTube
        (101, DAY, "10:00", "a", 9000, 1001, 1, 1),
    )
    stats = baseline.channel_baseline(facts, streamers((1, "a", "A", None)))
    audit = outliers.outlier_audit(facts, stats, outliers.below(-3.0))
    assert tuple(audit.first()) == (62, 1, 0, 61)


def test_group_restriction(snapshots, streamers):
    facts = snapshots(
        (1, DAY, "10:00", "in", 50, 0, 1, 0),
        (2, DAY, "10:00", "out", 50, 0, 2, 0),
        (3, DAY, "10:00", "none", 50, 0, 3, 0),
        (4, DAY, "10:00", "stranger", 50, 0, 4, 0),
    )
    names = streamers(
        (1, "in", "I", "g"), (2, "out", "O", "h"), (3, "none", "N", None),
        (4, "quiet", "Q", "g"),
    )
    only = group.group_facts(facts, names, "g")
    assert [r.id for r in only.collect()] == [1]
    kept = {r.channel_id for r in group.group_streamers(names, "g").collect()}
    assert kept == {"in", "none", "quiet"}  # an unknown group is not another group
    stats = baseline.channel_baseline(facts, names)
    present = group.present_baselines(stats, only)
    assert [r.channel_id for r in present.collect()] == ["in"]
    members = group.member_baselines(stats, names, "g")
    assert {r.channel_id for r in members.collect()} == {"in", "quiet"}
