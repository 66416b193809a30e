"""Queries on balance, burnout, energy, stress, rest, breaks, focus and careers, with SQL written from the rules."""

from __future__ import annotations

from ..functions.dims import COMM_APPS
from ..operators import sessions as S
from ..operators import wellbeing as W
from ..sources.tables import ACTIVITIES, activities
from .productivity import PREPARED, TYPES, as_of, sql_in
from .registry import add, dates_as_text

FACTS = f"""
facts AS (
  SELECT user_id, day AS date, sum(secs) / 3600 AS total_hours, min(hour(occurred_at)) AS start_hour, max(hour(occurred_at)) AS end_hour, count(*) FILTER (type = 'break') AS break_count,
         coalesce(sum(secs) FILTER (type = 'meeting'), 0) / 3600 AS meeting_hours, sum(switched) AS context_switches, count(*) FILTER (app IN {sql_in(COMM_APPS)}) AS messages_sent, isodow(day) >= 6 AS is_weekend
  FROM prepared GROUP BY 1, 2)"""
ALL = (ACTIVITIES, PREPARED, FACTS)


def facts(s, d):
    return W.day_facts(activities(s, d))


def runs_sql(test: str, name: str) -> str:
    """The longest run of a user's rows, in order of date, that pass a test."""
    return f"""{name} AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) FILTER (ok) AS n FROM (
      SELECT user_id, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY date) AS g FROM (SELECT *, {test} AS ok FROM facts)) GROUP BY 1, 2) GROUP BY 1)"""


add("d28_work_life_balance", lambda s, d: W.work_life_balance(facts(s, d)),
    """SELECT user_id, n AS days_analyzed, round(x, 4) AS score, CASE WHEN x >= 80 THEN 'excellent' WHEN x >= 60 THEN 'good' WHEN x >= 40 THEN 'fair' ELSE 'poor' END AS level,
              round(h, 4) AS hours_score, round(b, 4) AS boundary_score, round(w, 4) AS weekend_score, round(r, 4) AS break_score, v AS violations, k AS weekend_work_days
       FROM (SELECT *, h * 0.35::DOUBLE + b * 0.25::DOUBLE + w * 0.2::DOUBLE + r * 0.2::DOUBLE AS x FROM (
         SELECT user_id, count(*) AS n, greatest(0.0::DOUBLE, 100 - abs(avg(total_hours) - 7.5) * 15) AS h, greatest(0.0::DOUBLE, 100 - sum(start_hour < 7) * 1.0 / count(*) * 200 - sum(end_hour > 21) * 1.0 / count(*) * 200) AS b,
                greatest(0.0::DOUBLE, 100 - 30 * count(*) FILTER (is_weekend AND total_hours > 1)) AS w, least(100.0::DOUBLE, avg(break_count) / 3 * 100) AS r,
                (sum((start_hour < 7)::INT) + sum((end_hour > 21)::INT))::BIGINT AS v, count(*) FILTER (is_weekend AND total_hours > 1) AS k FROM facts GROUP BY 1))""".replace("sum(start_hour < 7)", "sum((start_hour < 7)::INT)").replace("sum(end_hour > 21)", "sum((end_hour > 21)::INT)"), *ALL)  # fmt: skip
add("d28_burnout_risk", lambda s, d: W.burnout_risk(facts(s, d)),
    """SELECT user_id, n AS days_analyzed, round(least(100.0, p1 + p2 + p3 + p4 + p5 + p6), 4)::DOUBLE AS risk_score,
              CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 <= 30 THEN 'low' WHEN p1 + p2 + p3 + p4 + p5 + p6 <= 60 THEN 'moderate' WHEN p1 + p2 + p3 + p4 + p5 + p6 <= 80 THEN 'high' ELSE 'critical' END AS risk_level,
              concat_ws(', ', CASE WHEN p1 > 0 THEN 'Overwork Streak' END, CASE WHEN p2 > 0 THEN 'High Average Hours' END, CASE WHEN p3 > 0 THEN 'Insufficient Breaks' END, CASE WHEN p4 > 0 THEN 'Frequent Late Work' END,
                        CASE WHEN p5 > 0 THEN 'Meeting Overload' END, CASE WHEN p6 > 0 THEN 'Increasing Workload' END) AS indicators, longest AS overwork_streak
       FROM (SELECT f.user_id, n, longest, CASE WHEN longest >= 3 THEN 25 ELSE 0 END AS p1, CASE WHEN h > 9 THEN least(20.0::DOUBLE, (h - 9) * 10) ELSE 0 END AS p2, CASE WHEN b < 3 THEN 15 ELSE 0 END AS p3, CASE WHEN late > 0.3 THEN 15 ELSE 0 END AS p4,
                    CASE WHEN mp > 40 THEN 10 ELSE 0 END AS p5, CASE WHEN weeks >= 3 AND earlier > 0 AND (recent - earlier) / earlier > 0.2 THEN 15 ELSE 0 END AS p6
             FROM (SELECT user_id, count(*) AS n, avg(total_hours) AS h, avg(break_count) AS b, count(*) FILTER (end_hour > 21) / count(*) AS late, avg(CASE WHEN total_hours > 0 THEN meeting_hours / total_hours * 100 ELSE 0 END) AS mp FROM facts GROUP BY 1) f
             JOIN runs USING (user_id)
             JOIN (SELECT user_id, count(*) AS weeks, arg_max(hours, week) AS recent, avg(hours) FILTER (NOT last) AS earlier
                   FROM (SELECT *, week = max(week) OVER (PARTITION BY user_id) AS last FROM (SELECT user_id, date_trunc('week', date) AS week, sum(total_hours) AS hours FROM facts GROUP BY 1, 2)) GROUP BY 1) USING (user_id))""",
    *ALL, runs_sql("total_hours > 10", "runs"))
add("d28_energy_levels", lambda s, d: W.energy_levels(activities(s, d)),
    f"""SELECT user_id, hour, energy, r <= 3 AS is_peak, r > n - 3 AS is_low FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY energy DESC, hour) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (
          SELECT user_id, hour(occurred_at)::BIGINT AS hour, greatest(10, least(100, floor((coalesce(sum(secs) FILTER (type IN {TYPES} AND secs >= 300), 0) / 60 / 60 * 0.7::DOUBLE + (1 - least(sum(switched) / 10, 1.0::DOUBLE)) * 0.3::DOUBLE) * 100)))::BIGINT AS energy
          FROM prepared GROUP BY 1, 2))""", ACTIVITIES, PREPARED)  # fmt: skip
add("d28_stress_index", lambda s, d: W.stress_index(facts(s, d)),
    """SELECT user_id, date, round(least(x, 100.0), 4)::DOUBLE AS stress_index, CASE WHEN x < 25 THEN 'low' WHEN x < 50 THEN 'moderate' WHEN x < 75 THEN 'high' ELSE 'very_high' END AS level,
              CASE greatest(round(a, 1), round(b, 1), round(c, 1), round(e, 1), l, round(m, 1)) WHEN round(a, 1) THEN 'meeting_load' WHEN round(b, 1) THEN 'context_switching' WHEN round(c, 1) THEN 'overwork' WHEN round(e, 1) THEN 'break_deficit' WHEN l THEN 'late_work' ELSE 'communication' END AS dominant_factor
       FROM (SELECT *, a * 0.25::DOUBLE + b * 0.2::DOUBLE + c * 0.2::DOUBLE + e * 0.15::DOUBLE + l * 0.1::DOUBLE + m * 0.1::DOUBLE AS x FROM (
         SELECT user_id, date, least(meeting_hours / greatest(total_hours, 1) / 0.5::DOUBLE * 100, 100.0::DOUBLE) AS a, least(context_switches / 30 * 100, 100.0::DOUBLE) AS b, least(greatest(0.0::DOUBLE, (total_hours - 9) / 3 * 100), 100.0::DOUBLE) AS c,
                greatest(0, 3 - break_count) / 3 * 100 AS e, CASE WHEN end_hour > 21 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS l, CASE WHEN messages_sent > 20 THEN least(messages_sent / 50 * 100, 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS m FROM facts))""", *ALL)  # fmt: skip
add("d28_rest_patterns", lambda s, d: W.rest_patterns(facts(s, d)),
    """SELECT user_id, round(least(100.0, greatest(0.0, least(100.0, a / 15 * 60) + least(40.0, r / greatest(n / 7, 1) * 40) - greatest(0, (longest - 5) * 5))), 4)::DOUBLE AS recovery_score, round(a, 4) AS avg_rest_hours, r AS rest_days, longest AS consecutive_work_days,
              concat_ws(', ', CASE WHEN longest > 6 THEN 'rest day' END, CASE WHEN a < 12 THEN 'end earlier' END, CASE WHEN r = 0 THEN 'day off' END) AS recommendations
       FROM (SELECT user_id, count(*) AS n, avg(24 - greatest(end_hour - start_hour, total_hours)) AS a, count(*) FILTER (total_hours < 1) AS r FROM facts GROUP BY 1) JOIN runs USING (user_id)""", *ALL, runs_sql("total_hours >= 1", "runs"))  # fmt: skip
add("d11_wellness_basic", lambda s, d: (lambda a: W.wellness_basic(a, as_of(a)))(activities(s, d)),
    """SELECT user_id, round(least(100.0, greatest(0.0, bal * 0.3::DOUBLE + var * 0.2::DOUBLE + hs * 0.3::DOUBLE + bs * 0.2::DOUBLE)), 6)::DOUBLE AS overall_score, round(hs * 0.5::DOUBLE + bal * 0.3::DOUBLE + bs * 0.2::DOUBLE, 6) AS balance_score,
              round((brs + CASE WHEN br = 0 THEN ps ELSE 0 END) / greatest(total, 1), 6) AS break_ratio, CASE WHEN l < 3 THEN 'low' WHEN l < 6 THEN 'medium' ELSE 'high' END AS burnout_level, l AS long_sessions,
              br + CASE WHEN br = 0 THEN p ELSE 0 END AS break_count, round((brs + CASE WHEN br = 0 THEN ps ELSE 0 END) / 60, 6) AS break_minutes
       FROM (SELECT *, CASE WHEN br = 0 THEN greatest(40.0::DOUBLE, hs * 0.6::DOUBLE) ELSE least(100.0::DOUBLE, brs / greatest(total, 1) * 500) END AS bs FROM (
         SELECT *, CASE WHEN h BETWEEN 4 AND 8 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100 - abs(h - 6) * 15) END AS hs FROM (
           SELECT user_id, sum(s)::DOUBLE AS total, count(*) FILTER (type IN ('break', 'idle')) AS br, coalesce(sum(s) FILTER (type IN ('break', 'idle')), 0)::DOUBLE AS brs, count(*) FILTER (s > 7200) AS l, least(100.0::DOUBLE, count(*) FILTER (s BETWEEN 600 AND 5400) / count(*) * 120) AS bal,
                  least(100.0::DOUBLE, (count(DISTINCT app) + count(DISTINCT type)) * 10.0::DOUBLE) AS var, sum(s) / 3600 / greatest(count(DISTINCT occurred_at::DATE), 1) AS h, count(*) FILTER (gap BETWEEN 120 AND 3600) AS p, coalesce(sum(gap) FILTER (gap BETWEEN 120 AND 3600), 0)::DOUBLE AS ps
           FROM (SELECT *, epoch_us(occurred_at) / 1e6 - lag(epoch_us(occurred_at) / 1e6 + s) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS gap FROM (SELECT *, coalesce(duration_seconds, 0) AS s FROM activities WHERE occurred_at >= (SELECT max(occurred_at) FROM activities) - INTERVAL 7 DAY)) GROUP BY 1)))""", ACTIVITIES)  # fmt: skip
quoted = lambda t: "'" + t.replace("'", "''") + "'"
SKILL_CASE = "coalesce(CASE app " + " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in W.CAREER_SKILLS.items()) + " END, app)"
STEP_CASE = "CASE g " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in W.NEXT_STEPS.items()) + " END"
add("d10_career_insights", lambda s, d: (lambda a: W.career_insights(a, as_of(a)))(activities(s, d)),
    f"""SELECT user_id, trajectory AS growth_trajectory, phase AS career_phase, array_to_string(gaps, ', ') AS skill_gaps, array_to_string(s3[1:4], '; ') AS next_steps FROM (
         SELECT *, CASE WHEN len(s2) < 2 THEN list_append(s2, {quoted(W.TRACK_STEP)}) ELSE s2 END AS s3 FROM (
           SELECT *, CASE WHEN trajectory IN ('plateau', 'declining') AND len(s1) < 4 THEN list_append(s1, {quoted(W.TIME_STEP)}) ELSE s1 END AS s2 FROM (
             SELECT *, CASE WHEN phase = 'growth' AND len(s0) < 3 THEN list_append(s0, {quoted(W.GROWTH_STEP)}) ELSE s0 END AS s1 FROM (
               SELECT u.user_id, coalesce(gaps, []) AS gaps, list_filter(list_transform(coalesce(gaps, []), lambda g: {STEP_CASE}), lambda x: x IS NOT NULL) AS s0,
                      CASE WHEN c / 3600 < 10 THEN 'exploring' WHEN apps >= 8 AND m >= 5 AND c / 3600 >= 20 THEN 'lead' WHEN apps >= 6 AND dp / 3600 >= 15 THEN 'senior' ELSE 'growth' END AS phase,
                      CASE WHEN p = 0 THEN 'steady' WHEN (c - p) / p >= 0.15 THEN 'accelerating' WHEN (c - p) / p <= -0.15 THEN 'declining' WHEN (c - p) / p BETWEEN -0.05 AND 0.05 THEN 'steady' ELSE 'plateau' END AS trajectory
               FROM (SELECT user_id, count(*) FILTER (now) AS n, coalesce(sum(s) FILTER (now), 0) AS c, coalesce(sum(s) FILTER (NOT now), 0) AS p, coalesce(sum(s) FILTER (now AND type IN ('window_focus', 'app_focus') AND s >= 300), 0) AS dp,
                            count(DISTINCT app) FILTER (now) AS apps, count(*) FILTER (now AND type = 'meeting') AS m FROM two GROUP BY 1) u
               LEFT JOIN (SELECT user_id, array_agg(skill ORDER BY h, skill) FILTER (r <= 3) AS gaps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, skill) AS r FROM (
                            SELECT user_id, {SKILL_CASE} AS skill, sum(s) / 3600 AS h FROM two WHERE now AND app IS NOT NULL GROUP BY 1, 2) WHERE h < 1) GROUP BY 1) g ON u.user_id = g.user_id
               WHERE n > 0))))""", ACTIVITIES,
    "two AS (SELECT *, occurred_at >= m - INTERVAL 7 DAY AS now, coalesce(duration_seconds, 0) AS s FROM activities, (SELECT max(occurred_at) AS m FROM activities) WHERE occurred_at >= m - INTERVAL 14 DAY)")
PAUSES = """
pauses AS (SELECT user_id, occurred_at::DATE AS date, p, CASE WHEN p < 900 THEN 'short' WHEN p < 1800 THEN 'medium' WHEN p < 3600 THEN 'long' ELSE 'extended' END AS size, CASE WHEN p >= 3600 THEN 'forced' WHEN coalesce(app, '') = coalesce(b, '') THEN 'scheduled' ELSE 'natural' END AS kind
  FROM (SELECT *, (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER w) / 1e6 AS p, lag(app) OVER w AS b FROM activities WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id)) WHERE p >= 300)"""
add("e5_break_classification", lambda s, d: S.break_classification(activities(s, d)), "SELECT user_id, date, size, kind, count(*) AS n, round(sum(p) / 60, 4) AS minutes FROM pauses GROUP BY 1, 2, 3, 4", ACTIVITIES, PAUSES)
add("e5_break_balance", lambda s, d: S.break_balance(activities(s, d)),
    """SELECT user_id, round(b, 4) AS break_minutes, round(w, 4) AS work_minutes, round(CASE WHEN w > 0 THEN b / w ELSE 0 END, 4) AS ratio, round(greatest(0.0, 10 - abs(CASE WHEN w > 0 THEN b / w ELSE 0 END - 0.33) * 20), 4)::DOUBLE AS optimal_break_score
       FROM (SELECT user_id, coalesce(sum(p) FILTER (p >= 300), 0)::DOUBLE / 60 AS b, sum(worked) FILTER (p IS NOT NULL)::DOUBLE / 60 AS w FROM (
         SELECT user_id, (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER w) / 1e6 AS p, lag(coalesce(nullif(duration_seconds, 0), 30)) OVER w AS worked FROM activities WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id)) GROUP BY 1) WHERE w IS NOT NULL""", ACTIVITIES)  # fmt: skip
SEGMENTS = """
numbered AS (SELECT user_id, seg, t, app, row_number() OVER (PARTITION BY user_id, seg ORDER BY t, id) AS k, count(*) OVER (PARTITION BY user_id, seg) AS n FROM (
    SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT user_id, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(nullif(app, ''), 'Unknown') AS app,
      CASE WHEN (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY user_id ORDER BY occurred_at, id)) / 1e6 <= 300 THEN 0 ELSE 1 END AS cut FROM activities)))"""
add("e6_focus_periods", lambda s, d: S.focus_periods(activities(s, d)),
    f"""WITH RECURSIVE {ACTIVITIES.strip()}, {SEGMENTS.strip()},
       walk AS (
         SELECT user_id, seg, k, n, t, app AS main, t AS began, 0 AS d, NULL::DOUBLE AS closed, NULL::DOUBLE AS closed_end, NULL::VARCHAR AS closed_app FROM numbered WHERE k = 1
         UNION ALL
         SELECT w.user_id, w.seg, x.k, x.n, x.t, CASE WHEN x.app <> w.main AND w.d >= 2 THEN x.app ELSE w.main END, CASE WHEN x.app <> w.main AND w.d >= 2 THEN x.t ELSE w.began END, CASE WHEN x.app = w.main THEN w.d WHEN w.d >= 2 THEN 0 ELSE w.d + 1 END,
                CASE WHEN x.app <> w.main AND w.d >= 2 THEN w.began END, CASE WHEN x.app <> w.main AND w.d >= 2 THEN w.t END, CASE WHEN x.app <> w.main AND w.d >= 2 THEN w.main END
         FROM walk w JOIN numbered x ON x.user_id = w.user_id AND x.seg = w.seg AND x.k = w.k + 1)
       SELECT user_id, floor(s)::BIGINT AS started, round((e - s) / 60, 4) AS minutes, app, d::BIGINT AS distractions, depth,
              greatest(0, CASE depth WHEN 'flow_state' THEN 100 WHEN 'deep_work' THEN 85 WHEN 'focused' THEN 70 WHEN 'moderate' THEN 50 ELSE 25 END - 5 * d)::BIGINT AS quality_score
       FROM (SELECT *, CASE WHEN e - s >= 2700 THEN 'flow_state' WHEN e - s >= 1500 THEN 'deep_work' WHEN e - s >= 900 THEN 'focused' WHEN e - s >= 300 THEN 'moderate' ELSE 'shallow' END AS depth FROM (
         SELECT user_id, closed AS s, closed_end AS e, closed_app AS app, 0 AS d FROM walk WHERE closed IS NOT NULL UNION ALL SELECT user_id, began, t, main, d FROM walk WHERE k = n) WHERE e - s >= 60)""")  # fmt: skip
dates_as_text("date", "d28_stress_index", "e5_break_classification")
