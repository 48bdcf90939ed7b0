from __future__ import annotations

import pytest

from airtide.operators.sessions import stream_sessions

DAY = "2024-01-01"


def test_two_platforms_of_one_row(snapshots):
    rows = [
        (1, DAY, "10:00", "a", 30, 8, 1, 3),
        (2, DAY, "10:30", "a", 50, 8, 1, 3),
        (3, DAY, "10:15", "a", 50, 9, 1, 0),  # not live on Twitch
        (4, DAY, "11:00", "a", 10, 7, None, 3),  # unknown on YouTube
        (5, DAY, "10:00", "b", 20, 0, 1, None),  # same number, other channel
    ]
    assert {tuple(r) for r in stream_sessions(snapshots(*rows)).collect()} == {
        ("YT", 1, "a", f"{DAY} 10:00", f"{DAY} 10:30", 43.3, 50, f"{DAY} 10:15", 30,
         f"{DAY} 10:00", 3, 3, 0),
        ("TW", 3, "a", f"{DAY} 10:00", f"{DAY} 11:00", 7.7, 8, f"{DAY} 10:00", 7,
         f"{DAY} 11:00", 5, 3, 2),
        ("YT", 1, "b", f"{DAY} 10:00", f"{DAY} 10:00", 20.0, 20, f"{DAY} 10:00", 20,
         f"{DAY} 10:00", 1, 1, 0),
    }


def test_gap_over_midnight_and_leap_day(snapshots):
    rows = [
        (1, "2024-02-28", "23:30", "a", 5, 0, 1, 0),
        (2, "2024-02-29", "00:00", "a", 6, 0, 1, 0),
        (3, "2024-03-01", "00:15", "a", 5, 0, 1, 0),
    ]
    row = stream_sessions(snapshots(*rows)).first()
    assert (row.expected_points, row.actual_points, row.missing_points) == (100, 3, 97)
    assert (row.min_time, row.max_time) == ("2024-02-28 23:30", "2024-02-29 00:00")


def test_rounding_of_means(snapshots):
    for values, want in [((12, 12, 12, 13), 12.2), ((12, 13, 13, 13), 12.8)]:
        rows = [(i, DAY, f"10:{15 * i:02d}", "a", v, 0, 1, 0) for i, v in enumerate(values)]
        assert stream_sessions(snapshots(*rows)).first().avg_viewers == want


def test_several_rows_in_one_slot_and_midnight(snapshots):
    rows = [
        (1, DAY, "23:45", "a", 30, 0, 1, 0),
        (2, DAY, "23:45", "a", 30, 0, 1, 5),
        (3, "2024-01-02", "00:00", "a", 30, 0, 1, 0),
    ]
    row = [r for r in stream_sessions(snapshots(*rows)).collect() if r.platform == "YT"][0]
    assert (row.expected_points, row.actual_points, row.missing_points) == (2, 3, -1)
    assert (row.max_time, row.min_time) == (f"{DAY} 23:45", f"{DAY} 23:45")
    assert row.end_time == "2024-01-02 00:00"


@pytest.mark.parametrize("big", [2**36, 2**38, 2**62])
def test_large_viewers_keep_their_time(snapshots, big):
    rows = [
        (1, DAY, "10:00", "a", big - 1, 0, 1, 0), (2, DAY, "10:15", "a", big, 0, 1, 0),
        (3, DAY, "10:30", "a", big, 0, 1, 0),
    ]
    row = stream_sessions(snapshots(*rows)).first()
    assert (row.max_viewers, row.max_time) == (big, f"{DAY} 10:15")
    assert (row.min_viewers, row.min_time) == (big - 1, f"{DAY} 10:00")
