from __future__ import annotations

import random
from collections import defaultdict

import pytest

from airtide.operators import cleaning, lookup

DAY = "2024-01-01"


def rows_of(table):
    return sorted(tuple(r) for r in table.select(cleaning.SNAPSHOT_COLUMNS).collect())


def random_snapshots(seed, n=400):
    random.seed(seed)
    rows = []
    for i in range(n):
        yt = random.choice([0, None, 1, 1, 2, 3])
        tw = random.choice([0, 0, 1, 2, None])
        rows.append(
            (
                i, random.choice([DAY, "2024-01-02"]),
                f"{random.choice([9, 10]):02d}:{random.randrange(60):02d}:07",
                random.choice("abcdef"), random.choice([0, 5, 20, 21, 22]),
                random.choice([0, 30, 31]), yt, tw,
            )
        )
    return rows


def brute_force_mean(rows):
    groups = {"yt": defaultdict(list), "tw": defaultdict(list)}
    for _, date, time, _, youtube, twitch, yt, tw in rows:
        groups["yt"][date, time, yt].append(youtube)
        groups["tw"][date, time, tw].append(twitch)
    result = []
    for i, date, time, channel, youtube, twitch, yt, tw in rows:
        if yt:
            values = groups["yt"][date, time, yt]
            youtube = sum(values) // len(values)
        if tw:
            values = groups["tw"][date, time, tw]
            twitch = sum(values) // len(values)
        result.append((i, date, time, channel, youtube, twitch, yt, tw))
    return sorted(result)


def brute_force_dedup(rows):
    lowest = {}
    for row in sorted(rows):
        lowest.setdefault(row[1:], row)
    return sorted(lowest.values())


def test_quality_filter_keeps_unknown_verdicts(snapshots):
    table = snapshots(
        (1, DAY, "10:00:00", "a", 50, 0, None, 0),  # live on YouTube unknown: stays
        (2, DAY, "10:00:00", "a", 5, 5, None, 0),  # hardly watched anyway: goes
        (3, DAY, "10:00:00", "a", 50, 50, 0, 0),  # live nowhere: goes
        (4, DAY, "10:00:00", "a", 9, 10, 1, 0),
        (5, DAY, "10:00:00", "a", 9, 9, 1, 1),
        (6, DAY, "10:00:00", "a", 10, 0, 0, None),
    )
    kept = cleaning.quality_filter(table)
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 4, 6]
    assert tuple(cleaning.quality_filter_audit(table).first()) == (6, 3, 3)
    assert tuple(cleaning.quality_filter_audit(table.limit(0)).first()) == (0, 0, 0)


def test_shared_stream_shares_the_truncated_mean(snapshots):
    table = snapshots(
        (1, DAY, "10:00", "a", 2, 7, 8, 0),
        (2, DAY, "10:00", "b", 3, 7, 8, 0),
        (3, DAY, "10:15", "b", 9, 7, 8, 0),
    )
    means = {r.id: (r.youtube, r.twitch) for r in cleaning.slot_mean(table).collect()}
    assert means == {1: (2, 7), 2: (2, 7), 3: (9, 7)}


def test_large_viewer_numbers(snapshots):
    big = 3_000_000_000
    table = snapshots(
        (1, DAY, "10:00", "a", big, 0, 8, 0), (2, DAY, "10:00", "a", big + 1, 0, 8, 0)
    )
    assert {r.youtube for r in cleaning.slot_mean(table).collect()} == {big}


@pytest.mark.parametrize("heavy_rows", [100_000, 10, 1])
def test_mean_and_dedup_against_brute_force(snapshots, monkeypatch, heavy_rows):
    monkeypatch.setattr(cleaning, "HEAVY_ROWS", heavy_rows)
    monkeypatch.setattr(lookup, "HEAVY_ROWS", heavy_rows)
    for seed in (1, 2):
        slotted = cleaning.to_slots(snapshots(*random_snapshots(seed)))
        slotted_rows = rows_of(slotted)
        meaned = brute_force_mean(slotted_rows)
        assert rows_of(cleaning.slot_mean(slotted)) == meaned
        deduped = cleaning.slot_dedup(slotted)
        want = brute_force_dedup(meaned)
        assert rows_of(deduped) == want
        assert len(want) < len(meaned)
        audit = cleaning.slot_dedup_audit(slotted, deduped).first()
        assert tuple(audit) == (len(meaned) - len(want), len(want))


def test_dedup_ignores_partitioning(snapshots):
    slotted = cleaning.to_slots(snapshots(*random_snapshots(3)))
    assert rows_of(cleaning.slot_dedup(slotted.coalesce(1))) == rows_of(
        cleaning.slot_dedup(slotted.repartition(7))
    )


def test_equal_copies_collapse_to_one_row(snapshots):
    copies = [(i, DAY, "10:00:00", "a", 20, 0, 1, 0) for i in range(500)]
    other = (999, DAY, "10:00:00", "b", 41, 0, 1, 0)
    deduped = cleaning.slot_dedup(cleaning.to_slots(snapshots(*copies, other)))
    # 500 copies of 20 and one 41: every copy counts in the mean
    assert rows_of(deduped) == [
        (0, DAY, "10:00", "a", 20, 0, 1, 0), (999, DAY, "10:00", "b", 20, 0, 1, 0),
    ]
