"""Queries on productivity (A, B, D, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import APP_CATEGORIES, COMM_APPS, COMM_DOMAINS, COMM_WORDS, DOMAIN_CATEGORIES, MEETING_DOMAINS, PRODUCTIVE_TYPES, contains_any
from ..functions.scalars import categorize_app, categorize_domain, category_weight, matches_filters
from ..operators import productivity as P
from ..operators import sessions as S
from ..sources.tables import ACTIVITIES, activities
from .registry import add, dates_as_text

SOCIAL = ["youtube.com", "reddit.com", "twitter.com"]


def as_of(acts: DataFrame, column: str = "occurred_at") -> Column:
    """The newest time as a literal, in place of now."""
    return F.lit(acts.agg(F.max(column)).first()[0])


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_category(name: str, categories: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(trim({name})), '{contains_any(w)}') THEN '{c}'" for c, w in categories.items())
    return f"CASE {cases} ELSE '{default}' END"


TYPES = sql_in(PRODUCTIVE_TYPES)
KEY = "coalesce(nullif(app, ''), nullif(domain, ''), type)"
PREPARED = f"""
prepared AS (
  SELECT *, CASE WHEN key <> lag(key) OVER (PARTITION BY user_id, day ORDER BY occurred_at, id) THEN 1 ELSE 0 END AS switched
  FROM (SELECT *, occurred_at::DATE AS day, least(coalesce(duration_seconds, 0), 7200) AS secs, {KEY} AS key FROM activities)
)"""
DAILY = f"""
daily AS (
  SELECT d.user_id, d.day AS date, d.n AS activity_count, d.total AS total_seconds,
         round(least(100.0, (d.focused + coalesce(w.focused, 0)) / greatest(d.total, 1) * 100), 9) AS focus_score,
         round(least(100.0, d.productive / greatest(d.total, 1) * 100), 9) AS productivity_score,
         (d.deep_n + coalesce(w.deep_n, 0))::BIGINT AS deep_work_sessions, round((d.deep + coalesce(w.deep, 0)) / 3600, 9) AS deep_work_hours,
         round(d.meeting / 3600, 9) AS meeting_load_hours, d.switched AS context_switches
  FROM (SELECT user_id, day, count(*) AS n, least(sum(secs), 86400)::BIGINT AS total, sum(switched)::BIGINT AS switched,
               coalesce(sum(secs) FILTER (type IN {TYPES}), 0) AS productive,
               coalesce(sum(secs) FILTER (type = 'meeting' OR regexp_matches(coalesce(domain, ''), '{contains_any(MEETING_DOMAINS)}')), 0) AS meeting,
               coalesce(sum(secs) FILTER (type IN {TYPES} AND type <> 'web_visit' AND secs >= 300), 0) AS deep,
               count(*) FILTER (type IN {TYPES} AND type <> 'web_visit' AND secs >= 300) AS deep_n,
               coalesce(sum(secs) FILTER (type IN {TYPES} AND type <> 'web_visit' AND secs >= 120), 0) AS focused
        FROM prepared GROUP BY 1, 2) d
  LEFT JOIN (SELECT user_id, day, sum(s) FILTER (s >= 300) AS deep, count(*) FILTER (s >= 300) AS deep_n, sum(s) FILTER (s >= 120) AS focused
             FROM (SELECT user_id, day, coalesce(domain, 'unknown') AS domain, sum(secs) AS s FROM prepared WHERE type = 'web_visit' GROUP BY 1, 2, 3) GROUP BY 1, 2) w
  USING (user_id, day)
)"""
V = (ACTIVITIES, PREPARED, DAILY)

add("d3_daily_productivity", lambda s, d: P.daily_productivity(activities(s, d)), "SELECT * FROM daily", *V)
add("d2_focus_score", lambda s, d: P.daily_productivity(activities(s, d)).select("user_id", "date", "focus_score"), "SELECT user_id, date, focus_score FROM daily", *V)


def _d4(s, d):
    a = activities(s, d)
    return P.daily_range(a, as_of(a))


add(
    "d4_daily_range", _d4,
    f"""SELECT c.user_id, c.date, coalesce(n, 0) AS activity_count, coalesce(t, 0) AS total_seconds, coalesce(dn, 0) AS deep_work_sessions,
               coalesce(round(dh / 3600, 4), 0) AS deep_work_hours, coalesce(sw, 0) AS context_switches
        FROM (SELECT DISTINCT user_id, (m.m - k::INTEGER)::DATE AS date FROM activities, (SELECT max(occurred_at)::DATE AS m FROM activities) m, range(30) r(k)) c
        LEFT JOIN (SELECT user_id, day, count(*) AS n, least(sum(secs), 86400)::BIGINT AS t, count(*) FILTER (type IN {TYPES} AND secs >= 300) AS dn,
                          coalesce(sum(secs) FILTER (type IN {TYPES} AND secs >= 300), 0) AS dh, sum(switched)::BIGINT AS sw FROM prepared GROUP BY 1, 2) x
        ON c.user_id = x.user_id AND c.date = x.day""", ACTIVITIES, PREPARED,
)
add(
    "d5_weekly_productivity", lambda s, d: P.weekly_productivity(activities(s, d)),
    """SELECT user_id, date_trunc('week', date)::DATE AS week_start, round(avg(focus_score), 4) AS avg_focus_score, round(avg(productivity_score), 4) AS avg_productivity_score,
              round(sum(deep_work_hours), 4) AS total_deep_work_hours, round(sum(meeting_load_hours), 4) AS total_meeting_hours, sum(activity_count)::BIGINT AS total_activities
       FROM daily GROUP BY 1, 2""", *V,
)


def _d6(s, d):
    a = activities(s, d)
    return P.period_productivity(a, as_of(a))


add(
    "d6_period_productivity", _d6,
    f"""SELECT user_id, round(t1, 4) AS total_hours, round(p1, 4) AS productive_hours, round(p1 / greatest(t1, 0.01), 4) AS productivity_ratio, round(d1, 4) AS deep_work_hours,
               round(f1, 4) AS focus_score, s1 AS context_switches, CASE WHEN n0 > 0 THEN round(t1 - t0, 4) END AS total_hours_change, CASE WHEN n0 > 0 THEN round(d1 - d0, 4) END AS deep_work_hours_change,
               CASE WHEN n0 > 0 THEN round(f1 - f0, 4) END AS focus_score_change, CASE WHEN n0 > 0 THEN s1 - s0 END AS context_switches_change
        FROM (SELECT user_id, count(*) FILTER (now) AS n1, count(*) FILTER (NOT now) AS n0,
                     least(coalesce(sum(secs) FILTER (now), 0), 604800) / 3600 AS t1, least(coalesce(sum(secs) FILTER (NOT now), 0), 604800) / 3600 AS t0,
                     coalesce(sum(secs) FILTER (now AND p), 0) / 3600 AS p1, coalesce(sum(secs) FILTER (now AND p AND secs >= 300), 0) / 3600 AS d1,
                     coalesce(sum(secs) FILTER (NOT now AND p AND secs >= 300), 0) / 3600 AS d0,
                     least(100.0, coalesce(sum(secs) FILTER (now AND p AND secs >= 300), 0) / greatest(least(coalesce(sum(secs) FILTER (now), 0), 604800), 1) * 100) AS f1,
                     least(100.0, coalesce(sum(secs) FILTER (NOT now AND p AND secs >= 300), 0) / greatest(least(coalesce(sum(secs) FILTER (NOT now), 0), 604800), 1) * 100) AS f0,
                     coalesce(sum(sw) FILTER (now), 0)::BIGINT AS s1, coalesce(sum(sw) FILTER (NOT now), 0)::BIGINT AS s0
              FROM (SELECT *, type IN {TYPES} AS p, CASE WHEN key <> lag(key) OVER (PARTITION BY user_id, now ORDER BY occurred_at, id) THEN 1 ELSE 0 END AS sw
                    FROM (SELECT *, occurred_at >= m - INTERVAL 7 DAY AS now, least(coalesce(duration_seconds, 0), 7200) AS secs, {KEY} AS key
                          FROM activities, (SELECT max(occurred_at) AS m FROM activities) WHERE occurred_at >= m - INTERVAL 14 DAY AND occurred_at < m))
              GROUP BY 1) WHERE n1 > 0""", ACTIVITIES,
)
COMM = f"(app IN {sql_in(COMM_APPS)} OR regexp_matches(coalesce(domain, ''), '{contains_any(COMM_DOMAINS)}') OR type = 'meeting' OR regexp_matches(lower(coalesce(app, '')), '{contains_any(COMM_WORDS)}'))"
add(
    "d8_collaboration", lambda s, d: P.collaboration(activities(s, d)),
    f"""SELECT user_id, CASE WHEN v > 0 THEN least(100.0, greatest(10.0, v * 4.0)) ELSE 0.0 END AS collaboration_score, m AS meetings_count, v AS communication_volume,
               coalesce(u, 0) AS unique_collaborators, greatest(a, coalesce(u, 0), m) AS network_size, round(h / 3600, 4) AS meeting_hours
        FROM (SELECT user_id, count(*) FILTER (type = 'meeting') AS m, count(*) FILTER ({COMM}) AS v, count(DISTINCT app) FILTER ({COMM}) AS a,
                     coalesce(sum(duration_seconds) FILTER (type = 'meeting'), 0) AS h FROM activities GROUP BY 1)
        LEFT JOIN (SELECT user_id, count(DISTINCT n) AS u FROM (SELECT user_id, unnest(list_append(CAST(json_extract(data, '$.participants') AS VARCHAR[]), json_extract_string(data, '$.organizer'))) AS n
                   FROM activities WHERE type = 'meeting') GROUP BY 1) USING (user_id)""", ACTIVITIES,
)
add(
    "f1_top_k_by_sum", lambda s, d: P.top_keys(activities(s, d)),
    f"""SELECT * FROM (SELECT user_id, key, s AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, key) AS rank
        FROM (SELECT user_id, {KEY} AS key, sum(least(coalesce(duration_seconds, 0), 7200))::BIGINT AS s FROM activities GROUP BY 1, 2)) WHERE rank <= 10""", ACTIVITIES,
)


def _d1(s, d):
    c = activities(s, d).select("id", categorize_app(F.coalesce("app", F.lit(""))).alias("app_category"), categorize_domain(F.coalesce("domain", F.lit(""))).alias("domain_category"))
    return c.withColumn("weight", category_weight(F.col("app_category")))


APP = sql_category("coalesce(app, '')", APP_CATEGORIES, "unknown")
add("d1_categories", _d1, f"""SELECT *, CASE app_category WHEN 'productive' THEN 1.0 WHEN 'distractive' THEN -0.5 ELSE 0.0 END::DOUBLE AS weight
    FROM (SELECT id, {APP} AS app_category, {sql_category("coalesce(domain, '')", DOMAIN_CATEGORIES, "neutral")} AS domain_category FROM activities)""", ACTIVITIES)  # fmt: skip

CATEGORY_DAY = f"""
category_day AS (
  SELECT user_id, date, round(t / 3600, 9) AS total_hours, round(CASE WHEN t > 0 THEN m / t * 100 ELSE 0 END, 9) AS meeting_load_pct,
         round(CASE WHEN f > 0 THEN least(100.0, x / f * 100) WHEN x > 0 THEN 100 ELSE 0 END, 9) AS distraction_index, t, m, f, x
  FROM (SELECT user_id, date, sum(s) AS t, coalesce(sum(s) FILTER (c = 'meetings'), 0) AS m, coalesce(sum(s) FILTER (c IN ('productive', 'neutral')), 0) AS f, coalesce(sum(s) FILTER (c = 'distractive'), 0) AS x
        FROM (SELECT user_id, occurred_at::DATE AS date, {APP} AS c, coalesce(duration_seconds, 0) AS s FROM activities) GROUP BY 1, 2)
)"""
add("d17_d18_category_day", lambda s, d: P.category_day_metrics(activities(s, d)), "SELECT user_id, date, total_hours, meeting_load_pct, distraction_index FROM category_day", ACTIVITIES, CATEGORY_DAY)
STRICT = f"""
strict AS (
  SELECT user_id, date, round(coalesce(sum(s) FILTER (s >= 1800), 0) / 3600, 9) AS deep_work_hours, count(*) FILTER (s >= 1800) AS deep_work_sessions
  FROM (SELECT user_id, date, g, sum(secs) AS s FROM (
          SELECT *, sum(new) OVER (PARTITION BY user_id, date ORDER BY occurred_at, id) AS g FROM (
            SELECT *, CASE WHEN t - lag(t + secs) OVER (PARTITION BY user_id, date ORDER BY occurred_at, id) <= 300 THEN 0 ELSE 1 END AS new FROM (
              SELECT user_id, occurred_at::DATE AS date, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(duration_seconds, 0) AS secs FROM activities WHERE {APP} = 'productive')))
        GROUP BY 1, 2, 3) GROUP BY 1, 2
)"""
add("e1a_deep_work_sessions_strict", lambda s, d: S.strict_deep_work(activities(s, d)), "SELECT * FROM strict", ACTIVITIES, STRICT)
add("d15_metric_deep_work", lambda s, d: S.strict_deep_work(activities(s, d)).select("user_id", "date", "deep_work_hours"), "SELECT user_id, date, deep_work_hours FROM strict", ACTIVITIES, STRICT)
BREAKS = """
gaps AS (
  SELECT *, lead(t) OVER (PARTITION BY user_id, date ORDER BY occurred_at, id) - t - secs AS gap
  FROM (SELECT user_id, occurred_at::DATE AS date, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(duration_seconds, 0) AS secs FROM activities)
),
breaks AS (
  SELECT user_id, date, b AS breaks, round(CASE WHEN n <= 1 THEN 5 WHEN b = 0 THEN 3
         ELSE least(10.0, 4 * good / b + 4 * CASE WHEN h > 0 THEN least(b / (h / 2), 1.0) ELSE 0 END + greatest(0.0, 2 - 0.5 * long)) END, 9) AS break_quality
  FROM (SELECT user_id, date, count(*) AS n, sum(secs) / 3600 AS h, count(*) FILTER (gap >= 300) AS b, count(*) FILTER (gap >= 300 AND gap <= 3600) AS good, count(*) FILTER (gap > 3600) AS long FROM gaps GROUP BY 1, 2)
)"""
add("d19_metric_break_quality", lambda s, d: S.break_quality(activities(s, d)), "SELECT * FROM breaks", ACTIVITIES, BREAKS)
COOLDOWN = """
changes AS (
  SELECT user_id, date, t, row_number() OVER (PARTITION BY user_id, date ORDER BY t) AS k FROM (
    SELECT *, lag(app) OVER (PARTITION BY user_id, date ORDER BY occurred_at, id) AS before FROM (
      SELECT user_id, occurred_at::DATE AS date, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(app, '') AS app FROM activities)) WHERE app <> before
),
counted AS (
  SELECT user_id, date, t, 1::BIGINT AS n, k FROM changes WHERE k = 1
  UNION ALL
  SELECT c.user_id, c.date, CASE WHEN b.t - c.t >= 600 THEN b.t ELSE c.t END, CASE WHEN b.t - c.t >= 600 THEN c.n + 1 ELSE c.n END, b.k
  FROM counted c JOIN changes b ON b.user_id = c.user_id AND b.date = c.date AND b.k = c.k + 1
),
cooldown AS (SELECT a.user_id, a.date, coalesce(max(n), 0) AS context_switches FROM (SELECT DISTINCT user_id, occurred_at::DATE AS date FROM activities) a LEFT JOIN counted USING (user_id, date) GROUP BY 1, 2)"""
add("e3_switch_cooldown", lambda s, d: S.switch_cooldown(activities(s, d)), "SELECT * FROM cooldown", ACTIVITIES.replace("activities AS", "RECURSIVE activities AS", 1), COOLDOWN)


def daily_metrics(acts: DataFrame) -> DataFrame:
    """The six category-based metrics of each user and day in one row."""
    x = P.category_day_metrics(acts).join(S.strict_deep_work(acts), ["user_id", "date"], "left").join(S.switch_cooldown(acts), ["user_id", "date"], "left").join(S.break_quality(acts), ["user_id", "date"], "left").fillna(0, ["deep_work_hours", "context_switches", "deep_work_sessions"])
    score = P.focus_score_10(F.col("deep_work_hours"), F.col("total_hours"), F.col("context_switches"), F.col("meeting_load_pct"), F.col("break_quality"))
    return x.select("user_id", "date", "total_hours", "deep_work_hours", "context_switches", "meeting_load_pct", "distraction_index", "break_quality", F.round(score, 9).alias("focus_score"))


METRICS = """
metrics AS (
  SELECT *, round(least(10.0, greatest(0.0, 10 * (0.5 * CASE WHEN total_hours > 0 THEN least(deep_work_hours / total_hours, 1.0) ELSE 0 END + 0.2 * greatest(0.0, 1 - context_switches / 40)
               + 0.15 * greatest(0.0, 1 - meeting_load_pct / 60) + 0.15 * break_quality / 10))), 9) AS focus_score
  FROM (SELECT c.user_id, c.date, c.total_hours, coalesce(s.deep_work_hours, 0) AS deep_work_hours, coalesce(w.context_switches, 0) AS context_switches, c.meeting_load_pct, c.distraction_index, b.break_quality
        FROM category_day c LEFT JOIN strict s USING (user_id, date) LEFT JOIN cooldown w USING (user_id, date) LEFT JOIN breaks b USING (user_id, date))
)"""
ALL = (ACTIVITIES.replace("activities AS", "RECURSIVE activities AS", 1), CATEGORY_DAY, STRICT, BREAKS, COOLDOWN, METRICS)
add("d21_daily_metrics", lambda s, d: daily_metrics(activities(s, d)), "SELECT * FROM metrics", *ALL)
add("d20_metric_focus_score", lambda s, d: daily_metrics(activities(s, d)).select("user_id", "date", "focus_score"), "SELECT user_id, date, focus_score FROM metrics", *ALL)
add("d16_metric_context_switches", lambda s, d: daily_metrics(activities(s, d)).select("user_id", "date", "context_switches"), "SELECT user_id, date, context_switches FROM metrics", *ALL)
add(
    "d22_weekly_aggregate", lambda s, d: P.weekly_aggregate(daily_metrics(activities(s, d))),
    """SELECT user_id, week_start, round(avg(nullif(focus_score, 0)), 4) AS avg_focus_score, round(avg(nullif(meeting_load_pct, 0)), 4) AS avg_meeting_load_pct, round(avg(nullif(distraction_index, 0)), 4) AS avg_distraction_index,
              round(avg(nullif(break_quality, 0)), 4) AS avg_break_quality, round(sum(deep_work_hours), 4) AS total_deep_work_hours, sum(context_switches)::BIGINT AS total_context_switches,
              max(date) FILTER (b = 1) AS best_day, max(date) FILTER (w = 1) AS worst_day
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week_start ORDER BY focus_score DESC, date) AS b, row_number() OVER (PARTITION BY user_id, week_start ORDER BY focus_score, date) AS w
             FROM (SELECT *, date_trunc('week', date)::DATE AS week_start FROM metrics)) GROUP BY 1, 2""", *ALL,
)
add(
    "d24_comparative", lambda s, d: P.comparative(daily_metrics(activities(s, d))),
    """SELECT user_id, week_start, metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(pct, 6) + 0.0 AS change_pct,
              CASE WHEN pct * sign > 3 THEN 'improving' WHEN pct * sign < -3 THEN 'declining' ELSE 'stable' END AS direction
       FROM (SELECT *, CASE WHEN baseline <> 0 THEN (value - baseline) / abs(baseline) * 100 ELSE 0 END AS pct,
                    CASE WHEN metric IN ('context_switches', 'meeting_load_pct', 'distraction_index') THEN -1 ELSE 1 END AS sign
             FROM (SELECT *, avg(value) OVER (PARTITION BY user_id, metric ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline
                   FROM (UNPIVOT (SELECT user_id, date_trunc('week', date)::DATE AS week_start, avg(focus_score) AS focus_score, avg(deep_work_hours) AS deep_work_hours, avg(break_quality) AS break_quality,
                                         avg(context_switches) AS context_switches, avg(meeting_load_pct) AS meeting_load_pct, avg(distraction_index) AS distraction_index FROM metrics GROUP BY 1, 2)
                         ON focus_score, deep_work_hours, break_quality, context_switches, meeting_load_pct, distraction_index INTO NAME metric VALUE value)) WHERE baseline IS NOT NULL)""", *ALL,
)
add(
    "d23_time_allocation", lambda s, d: P.time_allocation(activities(s, d)),
    """SELECT user_id, project, round(s / 3600, 4) AS hours, round(s / nullif(sum(s) OVER (PARTITION BY user_id), 0) * 100, 4) AS percent, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, project) AS rank FROM (
           SELECT user_id, coalesce(title, 'untitled') AS project, sum(coalesce(duration_seconds, 0))::BIGINT AS s FROM activities GROUP BY 1, 2)) QUALIFY rank <= 20""", ACTIVITIES,
)
add(
    "d25_meeting_summary", lambda s, d: P.meeting_summary(activities(s, d)),
    """SELECT *, CASE WHEN l < 15 THEN 'light' WHEN l < 30 THEN 'moderate' WHEN l < 50 THEN 'heavy' ELSE 'overloaded' END AS load, round(l, 4) AS load_pct FROM (
         SELECT user_id, json_extract_string(data, '$.platform') AS platform, count(*) AS meetings, sum(duration_seconds)::BIGINT AS total_seconds, round(avg(duration_seconds), 4) AS avg_seconds,
                min(duration_seconds)::BIGINT AS min_seconds, max(duration_seconds)::BIGINT AS max_seconds, count(DISTINCT occurred_at::DATE) AS days, sum(duration_seconds) / (count(DISTINCT occurred_at::DATE) * 8 * 3600) * 100 AS l
         FROM activities WHERE type = 'meeting' GROUP BY 1, 2)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (l), CASE"), ACTIVITIES,
)
add(
    "d26_social_summary", lambda s, d: P.social_summary(activities(s, d), SOCIAL),
    f"""SELECT *, round(seconds / nullif(sum(seconds) OVER (PARTITION BY user_id), 0) * 100, 4) AS percent FROM (
          SELECT user_id, domain, count(*) AS visits, sum(duration_seconds)::BIGINT AS seconds, count(DISTINCT occurred_at::DATE) AS days FROM activities WHERE domain IN {sql_in(SOCIAL)} GROUP BY 1, 2)""", ACTIVITIES,
)
add(
    "d27_hourly_histogram", lambda s, d: P.hourly_histogram(activities(s, d)),
    """SELECT u.user_id, h::BIGINT AS hour, coalesce(n, 0) AS activities, coalesce(s, 0)::BIGINT AS seconds FROM (SELECT DISTINCT user_id FROM activities) u CROSS JOIN range(24) r(h)
       LEFT JOIN (SELECT user_id, hour(occurred_at) AS h, count(*) AS n, sum(least(duration_seconds, 7200)) AS s FROM activities GROUP BY 1, 2) x USING (user_id, h)""", ACTIVITIES,
)
add(
    "d41_temporal_patterns", lambda s, d: P.temporal_patterns(activities(s, d)),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, weekday, hour) AS rank FROM (
         SELECT user_id, (isodow(occurred_at) - 1)::BIGINT AS weekday, hour(occurred_at)::BIGINT AS hour, count(*) AS n FROM activities GROUP BY 1, 2, 3 HAVING count(*) >= 3)) WHERE rank <= 10""", ACTIVITIES,
)
SCORES = """
scores AS (SELECT user_id, date, n AS activities, round(h, 9) AS hours, least(n / 200, 1.0) * 50 + least(h / 8, 1.0) * 50 AS score
           FROM (SELECT user_id, occurred_at::DATE AS date, count(*) AS n, sum(coalesce(duration_seconds, 0)) / 3600 AS h FROM activities GROUP BY 1, 2))"""
add("d35_daily_scores", lambda s, d: P.daily_scores(activities(s, d)).withColumn("score", F.round("score", 9)), "SELECT user_id, date, activities, hours, round(score, 9) AS score FROM scores", ACTIVITIES, SCORES)
add(
    "d35_forecast", lambda s, d: P.forecast(P.daily_scores(activities(s, d))),
    """SELECT user_id, date, round(least(100.0, greatest(0.0, 0.4 * (base + slope * (n + i)) + 0.4 * coalesce(usual, mean) + 0.2 * recent)), 4) AS predicted_score,
              round(greatest(0.3, 1 - 0.04 * i), 4) AS confidence, CASE WHEN slope > 0.3 THEN 'improving' WHEN slope < -0.3 THEN 'declining' ELSE 'stable' END AS trend
       FROM (SELECT f.*, i, (last + i::INTEGER)::DATE AS date FROM (
               SELECT user_id, count(*) AS n, regr_slope(score, x) AS slope, regr_intercept(score, x) AS base, avg(score) FILTER (back <= 14) AS recent, avg(score) AS mean, max(date) AS last
               FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS x, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS back FROM scores) GROUP BY 1 HAVING count(*) >= 7) f, range(1, 15) r(i)) a
       LEFT JOIN (SELECT user_id, isodow(date) AS wd, avg(score) AS usual FROM scores GROUP BY 1, 2) u ON a.user_id = u.user_id AND isodow(a.date) = u.wd""".replace("SELECT user_id, date, round(least", "SELECT a.user_id, date, round(least"),
    ACTIVITIES, SCORES,
)


add("b4_payload_filter", lambda s, d: activities(s, d).filter(matches_filters({"type": ["meeting", "app_focus"], "source": "browser", "duration_seconds": {"gte": 600, "lt": 3600}})).select("id", "user_id", "type", "duration_seconds"),
    "SELECT id, user_id, type, duration_seconds FROM activities WHERE type IN ('meeting', 'app_focus') AND source = 'browser' AND duration_seconds >= 600 AND duration_seconds < 3600", ACTIVITIES)

dates_as_text(
    "date", "d3_daily_productivity", "d2_focus_score", "d4_daily_range", "d17_d18_category_day", "e1a_deep_work_sessions_strict", "d15_metric_deep_work", "d19_metric_break_quality", "e3_switch_cooldown", "d21_daily_metrics",
    "d20_metric_focus_score", "d16_metric_context_switches", "d35_daily_scores", "d35_forecast",
)
dates_as_text("week_start", "d5_weekly_productivity", "d24_comparative")
dates_as_text("week_start best_day worst_day", "d22_weekly_aggregate")
