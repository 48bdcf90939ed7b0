"""SQL oracles for DuckDB, written from each definition.

They share no plan with the Spark operators: means are windows, the slot effect is a
fan-out join, levels are scalar subqueries. ``ln`` is guarded (DuckDB gives -inf or NaN
where the result is NULL), integer casts truncate first, and weighted means of rounded
values sum exact integers.
"""

from __future__ import annotations

import re

START, END, N_DAYS, GROUP = "2024-01-01 12:00", "2024-01-30 12:00", 29, "BUILDING"


def _ln(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def _baseline_columns(p: str, v: str, num: str) -> str:
    live = f"FILTER (WHERE m.{num} <> 0)"
    logged = f"FILTER (WHERE m.{num} <> 0 AND m.{v} > 0)"
    ln = _ln(f"m.{v}")
    return f"""
        avg(m.{v}) {live} AS {p}_mean, stddev_pop(m.{v}) {live} AS {p}_sigma,
        avg({ln}) {logged} AS {p}_ln_mean, stddev_pop({ln}) {logged} AS {p}_ln_sigma"""


def _statistics(facts: str, streamers: str) -> str:
    return f"""
    SELECT s.id, s.channel_id, s.channel_name,
        {_baseline_columns("yt", "youtube", "yt_number")},
        {_baseline_columns("tw", "twitch", "tw_number")}
    FROM {streamers} s LEFT JOIN {facts} m ON m.channel = s.channel_id
    GROUP BY s.id, s.channel_id, s.channel_name"""


def _mean_std(p: str) -> str:
    return (
        f"coalesce(round({p}_mean, 1), 0) AS {p}_avg,"
        f" coalesce(round({p}_sigma, 1), 0) AS {p}_std"
    )


def _band(p: str) -> str:
    return f"""
        round({p}_mean, 1) AS {p}_avg, round({p}_sigma, 1) AS {p}_std,
        round({p}_ln_mean, 3) AS {p}_ln_avg, round({p}_ln_sigma, 3) AS {p}_ln_std,
        round(exp({p}_ln_mean - 2.5 * {p}_ln_sigma), 1) AS {p}_min,
        round(exp({p}_ln_mean + 2.5 * {p}_ln_sigma), 1) AS {p}_max"""


def _score(p: str, v: str) -> str:
    """Deviations from the channel's mean; NULL where no verdict is possible."""
    return (
        f"CASE WHEN f.{v} > 0 AND b.{p}_ln_std > 0"
        f" THEN (ln(f.{v}) - b.{p}_ln_avg) / b.{p}_ln_std END AS z_{p}"
    )


def _scores(facts: str) -> str:
    return f"""
    SELECT f.*, {_score("yt", "youtube")}, {_score("tw", "twitch")}
    FROM {facts} f LEFT JOIN baseline b ON b.channel_id = f.channel"""


_FACT = "id, date, time, channel, youtube, twitch, yt_number, tw_number"


def _cells(v: str, num: str, facts: str) -> str:
    return f"""
    SELECT channel, time, count({v}) AS n, avg({v}) AS mean, avg({_ln(v)}) AS ln_mean
    FROM {facts} WHERE {num} <> 0 GROUP BY channel, time"""


def _profile(p: str, cells: str, base: str, diff: str) -> str:
    return f"""
    SELECT g.channel_id, g.channel_name, g.time, coalesce(x.n, 0) AS live_count,
        coalesce(round(x.mean, 1), 0) AS avg_viewers, {diff} AS diff_percent
    FROM (SELECT * FROM {base}, time_slots WHERE {p}_avg <> 0) g
    LEFT JOIN {cells} x ON (x.channel, x.time) = (g.channel_id, g.time)"""


def _linear(p: str) -> str:
    diff = f"round((coalesce(x.mean, 0) - g.{p}_avg) / g.{p}_avg * 100, 2)"
    return _profile(p, f"cells_{p}", "clean_stats", diff)


def _geometric(p: str) -> str:
    growth = f"round((exp(x.ln_mean - g.{p}_log_geo_avg) - 1) * 100, 2) + 0.0"
    diff = f"CASE WHEN g.{p}_avg <= 0 OR x.mean <= 0 THEN 0 ELSE {growth} END"
    return _profile(p, f"geo_cells_{p}", "geo_stats", diff)


def _global_side(p: str) -> str:
    ratio = "1 + diff_percent / 100.0"
    return f"""
    SELECT time, CAST(sum(live_count) AS BIGINT) AS total,
        sum(CAST(round(avg_viewers * 10, 0) AS BIGINT) * live_count) AS viewers,
        sum(({_ln(ratio)}) * live_count) AS logs
    FROM geo_profile_{p} GROUP BY time"""


def _heatmap(p: str) -> str:
    slots = [f"{m // 60:02d}:{m % 60:02d}" for m in range(0, 1440, 15)]
    slots = slots[48:] + slots[:48]
    cells = ",\n".join(
        f"coalesce(max(round(h.diff_percent, 2)) FILTER (WHERE h.time = '{t}'), 0)"
        f' AS "{t}"'
        for t in slots
    )
    return f"""
    SELECT s.id AS streamer_id, s.channel_id, s.channel_name, {cells}
    FROM geo_profile_{p} h JOIN group_streamers s ON s.channel_id = h.channel_id
    GROUP BY s.id, s.channel_id, s.channel_name"""


def _level_counts(prefix: str, levels: int = 10) -> str:
    """Days of slot ``o`` at each level, one scalar subquery each."""
    at = "(SELECT count(*) FROM days d WHERE d.time = o.time{more}) AS \"{name}\""
    shown = [
        at.format(more=f" AND d.live_count = {k}", name=f"{prefix}{k}")
        for k in range(1, levels + 1)
    ]
    none = f"{N_DAYS} - {at.format(more='', name=f'{prefix}0')}"
    over = at.format(more=f" AND d.live_count > {levels}", name=f"{prefix}over")
    return ", ".join([none, *shown, over])


def _sessions(platform: str, v: str, num: str) -> str:
    moment = "strptime(date || ' ' || time, '%Y-%m-%d %H:%M')"
    return f"""
    SELECT '{platform}' AS platform, stream_id, channel,
        strftime(start_dt, '%Y-%m-%d %H:%M') AS start_time,
        strftime(end_dt, '%Y-%m-%d %H:%M') AS end_time,
        CAST(format('{{:.1f}}', total / points) AS DOUBLE) AS avg_viewers, max_viewers,
        (SELECT strftime(min(r.dt), '%Y-%m-%d %H:%M') FROM points_{platform} r
         WHERE r.channel = a.channel AND r.stream_id = a.stream_id
             AND r.viewers = a.max_viewers) AS max_time,
        min_viewers,
        (SELECT strftime(min(r.dt), '%Y-%m-%d %H:%M') FROM points_{platform} r
         WHERE r.channel = a.channel AND r.stream_id = a.stream_id
             AND r.viewers = a.min_viewers) AS min_time,
        expected AS expected_points, points AS actual_points,
        expected - points AS missing_points
    FROM (
        SELECT channel, stream_id, min(dt) AS start_dt, max(dt) AS end_dt,
            CAST(sum(viewers) AS DOUBLE) AS total, count(*) AS points,
            max(viewers) AS max_viewers, min(viewers) AS min_viewers,
            CAST(date_diff('minute', min(dt), max(dt)) // 15 + 1 AS BIGINT) AS expected
        FROM points_{platform} GROUP BY channel, stream_id
    ) a""", f"""
    SELECT channel, {num} AS stream_id, {moment} AS dt, {v} AS viewers
    FROM facts WHERE {num} <> 0"""


_SESSIONS_YT, _POINTS_YT = _sessions("YT", "youtube", "yt_number")
_SESSIONS_TW, _POINTS_TW = _sessions("TW", "twitch", "tw_number")
_NOISE = "(yt_number = 0 AND tw_number = 0) OR (youtube < 10 AND twitch < 10)"
_KEY7 = "date, time, channel, yt_number, tw_number, youtube, twitch"


def _check(name: str, table: str, key: str, required: str) -> str:
    nulls = " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL)" for c in required.split(",")
    )
    return f"""
    SELECT '{name}' AS table_name, '{key}' AS key, count(*) AS n_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {table}))
            AS n_duplicates,
        {nulls} AS n_nulls
    FROM {table}"""


def _weighted(numerator: str, weight: str) -> str:
    return (
        f"coalesce(round(CAST({numerator} AS DOUBLE)"
        f" / nullif(CAST({weight} AS DOUBLE), 0), 0) / 100, 0)"
    )


def _units(side: str) -> str:
    return f"CAST(round({side}.diff_percent * 100, 0) AS BIGINT) * {side}.live_count"


_PARTS: dict[str, str] = {
    "streamers": """
    SELECT c_custkey AS id, 'c' || c_custkey AS channel_id, c_name AS channel_name,
        nullif(c_mktsegment, 'MACHINERY') AS grp
    FROM customer""",
    "snapshots": """
    SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS date,
        strftime(ts, '%H:%M:%S') AS time, 'c' || user_id AS channel,
        CAST(CASE
            WHEN event_type = 'purchase' AND event_id % 67 = 0 THEN 15
            WHEN event_type = 'signup' AND event_id % 61 = 0 THEN 0
            WHEN event_type = 'signup' AND event_id % 53 = 0 THEN 1
            WHEN event_type = 'signup' AND event_id % 59 = 0 THEN floor(value) + 10
            WHEN event_type IN ('view', 'click', 'signup') THEN floor(value)
            ELSE 0 END AS BIGINT) AS youtube,
        CAST(CASE
            WHEN event_type = 'signup' AND event_id % 61 = 0 THEN floor(value) + 10
            WHEN event_type = 'signup' AND event_id % 53 = 0 THEN floor(value * 0.5) + 10
            WHEN event_type = 'signup' AND event_id % 59 = 0 THEN 1
            WHEN event_type = 'purchase' THEN floor(value)
            WHEN event_type = 'signup' THEN floor(value * 0.5)
            ELSE 0 END AS BIGINT) AS twitch,
        CAST(CASE
            WHEN event_id % 97 = 0 THEN NULL
            WHEN event_type IN ('view', 'click', 'signup')
                THEN 1 + (user_id // 2) * 31 + day(ts)
            ELSE 0 END AS BIGINT) AS yt_number,
        CAST(CASE
            WHEN event_type IN ('purchase', 'signup')
                THEN 1 + (user_id // 3) * 31 + day(ts)
            ELSE 0 END AS BIGINT) AS tw_number
    FROM events""",
    "clean": f"SELECT * FROM snapshots WHERE NOT coalesce({_NOISE}, false)",
    "slotted": """
    SELECT id, date,
        substr(time, 1, 2) || ':'
            || lpad(CAST(CAST(substr(time, 4, 2) AS INTEGER) // 15 * 15 AS VARCHAR), 2, '0')
            AS time,
        channel, youtube, twitch, yt_number, tw_number
    FROM clean""",
    "meaned": """
    SELECT id, date, time, channel,
        CASE WHEN yt_number <> 0 THEN CAST(trunc(
            avg(youtube) OVER (PARTITION BY date, time, yt_number)) AS BIGINT)
            ELSE youtube END AS youtube,
        CASE WHEN tw_number <> 0 THEN CAST(trunc(
            avg(twitch) OVER (PARTITION BY date, time, tw_number)) AS BIGINT)
            ELSE twitch END AS twitch,
        yt_number, tw_number
    FROM slotted""",
    "facts": f"""
    SELECT * FROM meaned
    QUALIFY row_number() OVER (PARTITION BY {_KEY7} ORDER BY id) = 1""",
    "statistics": _statistics("facts", "streamers"),
    "baseline": f"""
    SELECT channel_id, channel_name, {_band("yt")}, {_band("tw")} FROM statistics""",
    "scores": _scores("facts"),
    "cut": f"""
    SELECT {_FACT} FROM scores
    WHERE coalesce(abs(z_yt), 0) <= 2.5 AND coalesce(abs(z_tw), 0) <= 2.5""",
    "cut_statistics": _statistics("cut", "streamers"),
    "clean_stats": f"""
    SELECT channel_id, channel_name,
        {_mean_std("yt")}, coalesce(round(exp(yt_ln_mean), 1), 0) AS yt_geo_avg,
        round(yt_ln_mean, 6) AS yt_log_geo_avg,
        {_mean_std("tw")}, coalesce(round(exp(tw_ln_mean), 1), 0) AS tw_geo_avg,
        round(tw_ln_mean, 6) AS tw_log_geo_avg
    FROM cut_statistics""",
    "time_slots": """
    SELECT lpad(CAST(h.h AS VARCHAR), 2, '0') || ':' || q.q AS time
    FROM range(24) h(h) CROSS JOIN (VALUES ('00'), ('15'), ('30'), ('45')) q(q)""",
    "cells_yt": _cells("youtube", "yt_number", "cut"),
    "cells_tw": _cells("twitch", "tw_number", "cut"),
    "profile_yt": _linear("yt"),
    "profile_tw": _linear("tw"),
    "time_effect": f"""
    SELECT t.time,
        {_weighted(f"sum({_units('y')})", "sum(y.live_count)")} AS yt_avg,
        {_weighted(f"sum({_units('w')})", "sum(w.live_count)")} AS tw_avg,
        {_weighted(
            f"(coalesce(sum({_units('y')}), 0) + coalesce(sum({_units('w')}), 0))",
            "(coalesce(sum(y.live_count), 0) + coalesce(sum(w.live_count), 0))",
        )} AS all_avg
    FROM time_slots t
    LEFT JOIN profile_yt y ON y.time = t.time AND y.diff_percent <> -100
    LEFT JOIN profile_tw w ON w.time = t.time AND w.diff_percent <> -100
    GROUP BY t.time""",
    "pooled": f"""
    SELECT t.time, {_weighted(f"sum({_units('b')})", "sum(b.live_count)")} AS all_avg_pooled
    FROM time_slots t
    LEFT JOIN (SELECT * FROM profile_yt UNION ALL SELECT * FROM profile_tw) b
        ON b.time = t.time AND b.diff_percent <> -100
    GROUP BY t.time""",
    "slot_effect": """
    SELECT e.time, e.yt_avg, e.tw_avg, e.all_avg, p.all_avg_pooled
    FROM time_effect e JOIN pooled p ON p.time = e.time""",
    "group_facts": f"""
    SELECT * FROM facts
    WHERE channel IN (SELECT channel_id FROM streamers WHERE grp = '{GROUP}')""",
    "group_streamers": f"""
    SELECT * FROM streamers WHERE NOT coalesce(grp <> '{GROUP}', false)""",
    "group_baseline": """
    SELECT * FROM baseline b
    WHERE EXISTS (SELECT 1 FROM group_facts f WHERE f.channel = b.channel_id)""",
    "group_scores": _scores("group_facts"),
    "group_cut": f"""
    SELECT {_FACT} FROM group_scores
    WHERE coalesce(z_yt, 0) >= -3 AND coalesce(z_tw, 0) >= -3""",
    "geo_statistics": _statistics("group_cut", "group_streamers"),
    "geo_stats": f"""
    SELECT channel_id, channel_name, {_mean_std("yt")}, yt_ln_mean AS yt_log_geo_avg,
        {_mean_std("tw")}, tw_ln_mean AS tw_log_geo_avg
    FROM geo_statistics""",
    "geo_cells_yt": _cells("youtube", "yt_number", "group_cut"),
    "geo_cells_tw": _cells("twitch", "tw_number", "group_cut"),
    "geo_profile_yt": _geometric("yt"),
    "geo_profile_tw": _geometric("tw"),
    "global_yt": _global_side("yt"),
    "global_tw": _global_side("tw"),
    "global_profile": """
    SELECT coalesce(y.time, w.time) AS time, y.total AS yt_sum,
        round(CAST(y.viewers * 10 AS DOUBLE) / nullif(y.total, 0), 0) / 100
            AS yt_weighted_avg,
        round((exp(y.logs / nullif(y.total, 0)) - 1) * 100, 2) + 0.0 AS yt_weighted_diff,
        w.total AS tw_sum,
        round(CAST(w.viewers * 10 AS DOUBLE) / nullif(w.total, 0), 0) / 100
            AS tw_weighted_avg,
        round((exp(w.logs / nullif(w.total, 0)) - 1) * 100, 2) + 0.0 AS tw_weighted_diff
    FROM global_yt y FULL JOIN global_tw w ON w.time = y.time""",
    "counted": """
    SELECT *,
        CASE WHEN yt_number <> 0 AND youtube > 0 THEN 'yt'
            WHEN tw_number <> 0 AND twitch > 0 THEN 'tw' END AS platform
    FROM group_cut WHERE coalesce(yt_number, tw_number) IS NOT NULL""",
    "performances": f"""
    SELECT r.id, r.date, r.time, CASE r.platform
        WHEN 'yt' THEN {_ln("r.youtube")} - g.yt_log_geo_avg
        WHEN 'tw' THEN {_ln("r.twitch")} - g.tw_log_geo_avg END AS performance
    FROM counted r JOIN geo_stats g ON g.channel_id = r.channel""",
    "concurrent": """
    SELECT date, time, count(id) AS live_count,
        (exp(avg(performance)) - 1) * 100 AS geo_perf_percent
    FROM performances GROUP BY date, time""",
    "effect": f"""
    SELECT live_count,
        (exp(avg({_ln("1 + geo_perf_percent / 100.0")})) - 1) * 100
            AS avg_geo_perf_percent,
        count(*) AS sample_cnt
    FROM concurrent WHERE geo_perf_percent IS NOT NULL GROUP BY live_count""",
    "days": f"""
    SELECT time, live_count FROM concurrent
    WHERE concat(date, ' ', time) >= '{START}' AND concat(date, ' ', time) < '{END}'""",
    "observed": "SELECT DISTINCT time FROM days",
    "levels_long": f"""
    SELECT o.time, l.live_count,
        CASE l.live_count
            WHEN 0 THEN {N_DAYS} - (SELECT count(*) FROM days d WHERE d.time = o.time)
            ELSE (SELECT count(*) FROM days d
                WHERE d.time = o.time AND d.live_count = l.live_count) END AS cnt
    FROM observed o JOIN (
        SELECT DISTINCT time, live_count FROM days
        UNION ALL SELECT time, 0 FROM observed
    ) l ON l.time = o.time""",
    "distribution": f"""
    SELECT o.time,
        (SELECT round(CAST(sum(d.live_count) AS DOUBLE) / {N_DAYS}, 2) FROM days d
         WHERE d.time = o.time) AS avg_live_count,
        {_level_counts("cnt_")}
    FROM observed o""",
    "points_YT": _POINTS_YT,
    "points_TW": _POINTS_TW,
    "sessions": f"{_SESSIONS_YT}\nUNION ALL\n{_SESSIONS_TW}",
}


def _audit(scores: str, yt_out: str, tw_out: str) -> str:
    yt, tw = f"coalesce({yt_out}, false)", f"coalesce({tw_out}, false)"
    return f"""
    SELECT count(*) AS n_before, count(*) FILTER (WHERE {yt}) AS n_cut_yt,
        count(*) FILTER (WHERE NOT {yt} AND {tw}) AS n_cut_tw,
        count(*) FILTER (WHERE NOT {yt} AND NOT {tw}) AS n_after
    FROM {scores}"""


def _log_or_zero(p: str) -> str:
    ratio = f"1 + {p}_avg / 100.0"
    return (
        f"round(CASE WHEN {ratio} <= 0 THEN 0 ELSE {_ln(ratio)} END, 6) + 0.0 AS {p}_log"
    )


_WHOLE_HOUR = "time LIKE '%:00' AS whole_hour"
_HOUR = "CAST(substr({t}, 1, 2) AS INTEGER)"

_ORACLES: dict[str, str] = {
    "snapshot_scan": "SELECT * FROM snapshots",
    "quality_filter": "SELECT * FROM clean",
    "quality_filter_audit": f"""
    SELECT count(*) AS n_before, count(*) FILTER (WHERE {_NOISE}) AS n_deleted,
        (SELECT count(*) FROM clean) AS n_after
    FROM snapshots""",
    "slot15": "SELECT * FROM slotted",
    "slot_mean": "SELECT * FROM meaned",
    "slot_dedup": "SELECT * FROM facts",
    "slot_dedup_audit": """
    SELECT (SELECT count(*) FROM meaned) - count(*) AS n_duplicates, count(*) AS n_after
    FROM facts""",
    "channel_baseline": "SELECT * FROM baseline",
    "outlier_cut_2s": "SELECT * FROM cut",
    "outlier_audit": _audit("scores", "abs(z_yt) > 2.5", "abs(z_tw) > 2.5"),
    "channel_baseline_clean": "SELECT * FROM clean_stats",
    "slot_profile_yt": "SELECT * FROM profile_yt",
    "slot_profile_tw": "SELECT * FROM profile_tw",
    "slot_effect_weighted": "SELECT * FROM slot_effect",
    "slot_series_percent": f"""
    SELECT time, yt_avg, tw_avg, all_avg, {_WHOLE_HOUR} FROM slot_effect ORDER BY time""",
    "slot_series_log": f"""
    SELECT time, {_log_or_zero("yt")}, {_log_or_zero("tw")}, {_log_or_zero("all")},
        {_WHOLE_HOUR}
    FROM slot_effect ORDER BY time""",
    "slot_series_one_platform": f"""
    SELECT time, tw_avg, {_WHOLE_HOUR} FROM slot_effect ORDER BY time""",
    "group_only_main": "SELECT * FROM group_facts",
    "group_only_streamer": "SELECT * FROM group_streamers",
    "group_only_channel_avg": "SELECT * FROM group_baseline",
    "outlier_cut_low3": "SELECT * FROM group_cut",
    "outlier_audit_low3": _audit("group_scores", "z_yt < -3", "z_tw < -3"),
    "channel_baseline_geo": """
    SELECT channel_id, channel_name,
        yt_avg, yt_std, round(yt_log_geo_avg, 6) AS yt_log_geo_avg,
        tw_avg, tw_std, round(tw_log_geo_avg, 6) AS tw_log_geo_avg
    FROM geo_stats""",
    "slot_profile_geo_yt": "SELECT * FROM geo_profile_yt",
    "slot_profile_geo_tw": "SELECT * FROM geo_profile_tw",
    "slot_global_profile": "SELECT * FROM global_profile",
    "channel_directory": """
    SELECT channel_id, channel_name FROM geo_profile_yt
    UNION SELECT channel_id, channel_name FROM geo_profile_tw
    ORDER BY channel_name""",
    "channel_slot_overlay": f"""
    SELECT coalesce(y.channel_id, w.channel_id) AS channel_id,
        coalesce(y.channel_name, w.channel_name) AS channel_name,
        coalesce(y.time, w.time) AS time,
        CASE WHEN {_HOUR.format(t="coalesce(y.time, w.time)")} >= 12
            THEN {_HOUR.format(t="coalesce(y.time, w.time)")}
            ELSE {_HOUR.format(t="coalesce(y.time, w.time)")} + 24 END AS sort_key,
        y.live_count AS yt_live, y.avg_viewers AS yt_avg,
        w.live_count AS tw_live, w.avg_viewers AS tw_avg
    FROM geo_profile_yt y FULL JOIN geo_profile_tw w
        ON w.channel_id = y.channel_id AND w.time = y.time""",
    "one_channel_overlay": f"""
    SELECT channel_id, channel_name, time, {_HOUR.format(t="time")}
            + CASE WHEN {_HOUR.format(t="time")} < 12 THEN 24 ELSE 0 END AS sort_key,
        max(live_count) FILTER (WHERE side = 'yt') AS yt_live,
        max(avg_viewers) FILTER (WHERE side = 'yt') AS yt_avg,
        max(live_count) FILTER (WHERE side = 'tw') AS tw_live,
        max(avg_viewers) FILTER (WHERE side = 'tw') AS tw_avg
    FROM (
        SELECT *, 'yt' AS side FROM geo_profile_yt UNION ALL
        SELECT *, 'tw' AS side FROM geo_profile_tw
    )
    WHERE channel_id = (
        SELECT channel_id FROM (
            SELECT channel_id, channel_name FROM geo_profile_yt
            UNION SELECT channel_id, channel_name FROM geo_profile_tw
        ) ORDER BY channel_name, channel_id LIMIT 1)
    GROUP BY channel_id, channel_name, time""",
    "evening_profile": f"""
    SELECT time, coalesce(yt_sum, 0) AS yt_sum,
        coalesce(yt_weighted_avg, 0) AS yt_weighted_avg,
        coalesce(yt_weighted_diff, 0) AS yt_weighted_diff,
        coalesce(tw_sum, 0) AS tw_sum,
        coalesce(tw_weighted_avg, 0) AS tw_weighted_avg,
        coalesce(tw_weighted_diff, 0) AS tw_weighted_diff,
        {_HOUR.format(t="time")} * 60 + CAST(substr(time, 4, 2) AS INTEGER)
            + CASE WHEN {_HOUR.format(t="time")} < 12 THEN 1440 ELSE 0 END AS sort_key
    FROM global_profile
    WHERE {_HOUR.format(t="time")} >= 18 OR {_HOUR.format(t="time")} < 5
    ORDER BY sort_key""",
    "diff_heatmap_yt": _heatmap("yt"),
    "diff_heatmap_tw": _heatmap("tw"),
    "diff_heatmap_bound": """
    SELECT max(abs(coalesce(round(diff_percent, 2), 0))) AS max_abs
    FROM (SELECT * FROM geo_profile_yt UNION ALL SELECT * FROM geo_profile_tw)""",
    "concurrent_slots": """
    SELECT date, time, live_count, round(geo_perf_percent, 6) + 0.0 AS geo_perf_percent
    FROM concurrent""",
    "concurrent_slot_members": "SELECT date, time, id FROM performances",
    "concurrency_effect": """
    SELECT live_count, round(avg_geo_perf_percent, 6) AS avg_geo_perf_percent, sample_cnt
    FROM effect""",
    "stream_sessions": "SELECT * FROM sessions",
    "concurrency_distribution": "SELECT * FROM distribution",
    "concurrency_long": "SELECT * FROM levels_long ORDER BY time, live_count",
    "concurrency_heatmap": f"SELECT time, {_level_counts('')} FROM observed o",
    "slot_pressure": f"""
    SELECT time,
        CASE WHEN (SELECT bool_and(e.avg_geo_perf_percent IS NOT NULL)
            FROM range(1, (SELECT max(live_count) + 1 FROM days)) k(k)
            LEFT JOIN effect e ON e.live_count = k.k)
            THEN round(sum(avg_geo_perf_percent) / {N_DAYS}, 6) END AS expected_perf,
        round(sum(coalesce(avg_geo_perf_percent, 0)) / {N_DAYS}, 6) AS expected_perf_known
    FROM days LEFT JOIN effect USING (live_count) GROUP BY time""",
    "avg_concurrency_series": "SELECT time, avg_live_count FROM distribution ORDER BY time",
    "upsert_by_key": """
    SELECT channel_id, channel_name, time, live_count, avg_viewers, diff_percent
    FROM (
        SELECT *, row_number() OVER (
            PARTITION BY channel_id, time ORDER BY version DESC) AS rank
        FROM (
            SELECT *, 1 AS version FROM profile_yt
            UNION ALL SELECT *, 2 AS version FROM geo_profile_yt
        )
    ) WHERE rank = 1""",
    "constraint_report": "\nUNION ALL\n".join(
        [
            _check("main", "snapshots", "id", "id,date,time,channel,youtube,twitch"),
            _check("streamer", "streamers", "channel_id", "channel_id,channel_name"),
            _check("channel_avg", "baseline", "channel_id", "channel_id"),
            _check("yt_time_profile", "profile_yt", "channel_id,time", "channel_id,time"),
            _check("tw_time_profile", "profile_tw", "channel_id,time", "channel_id,time"),
            _check("yt_tw_time_avg", "slot_effect", "time", "time"),
            _check("time_global_profile", "global_profile", "time", "time"),
            _check("live_concurrent", "concurrent", "date,time", "date,time,live_count"),
            _check("live_concurrent_members", "performances", "id", "date,time,id"),
            _check(
                "concurrent_effect", "effect", "live_count",
                "live_count,avg_geo_perf_percent,sample_cnt",
            ),
            _check(
                "live_count_by_time", "distribution", "time",
                "time,avg_live_count," + ",".join(f"cnt_{k}" for k in range(11)),
            ),
            _check(
                "stream_analysis", "sessions", "platform,stream_id,channel",
                "platform,stream_id,channel,start_time,end_time,avg_viewers,max_viewers,max_time,"
                "min_viewers,min_time,expected_points,actual_points,missing_points",
            ),
        ]
    ),
}

# Tables that are maintained day by day equal those computed at once.
for _maintained in (
    "channel_baseline", "channel_baseline_clean", "channel_baseline_geo", "stream_sessions",
):
    _ORACLES[f"{_maintained}_days"] = _ORACLES[_maintained]
_ORACLES["upsert_last_wins"] = """
    SELECT channel_id, channel_name, time, live_count, avg_viewers, diff_percent
    FROM (
        SELECT *, row_number() OVER (
            PARTITION BY channel_id, time ORDER BY version DESC) AS rank
        FROM (
            SELECT *, 0 AS version FROM profile_yt
            UNION ALL SELECT *, 1 AS version FROM geo_profile_yt WHERE time >= '18:00'
            UNION ALL SELECT * REPLACE (round(diff_percent, 0) AS diff_percent), 2 AS version
            FROM geo_profile_yt WHERE time >= '18:00' AND live_count > 0
        )
    ) WHERE rank = 1"""


def _parts_of(sql: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\w+", sql):
        if name in _PARTS and name not in found:
            _parts_of(_PARTS[name], found)
            found[name] = None


def oracle_queries() -> dict[str, str]:
    """Each oracle with the parts it needs, in order, as common table expressions."""
    result = {}
    for key, sql in _ORACLES.items():
        parts: dict[str, None] = {}
        _parts_of(sql, parts)
        ctes = ",\n".join(f"{p} AS MATERIALIZED ({_PARTS[p].strip()})" for p in parts)
        result[key] = f"WITH {ctes}\n{sql.strip()}"
    return result
