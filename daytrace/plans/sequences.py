"""Queries on sessions, switches, breaks, streaks, rows by rank and sets (E, F, G, I6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import productivity as P
from ..operators import sessions as S
from ..sources.tables import ACTIVITIES, WEARABLE, activities, request_log, wearable_data
from .productivity import DAILY, KEY, PREPARED, SCORES, TYPES, as_of
from .registry import add, dates_as_text


def sessions_sql(where: str, secs: str, extra: str = "") -> str:
    return f"""SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS g FROM (
          SELECT *, CASE WHEN t - lag(t + secs) OVER (PARTITION BY user_id ORDER BY occurred_at, id) <= 300 THEN 0 ELSE 1 END AS new FROM (
            SELECT user_id, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, {secs} AS secs, {KEY} AS key FROM activities WHERE {where}))"""


def deep_sql(where: str) -> str:
    return f"""SELECT user_id, floor(min(a))::BIGINT AS started, round(max(z) - min(a), 2) AS span_seconds, sum(s)::BIGINT AS seconds, sum(n)::BIGINT AS activities, arg_min(key, (-s, key)) AS main_app
      FROM (SELECT user_id, g, key, min(t) AS a, max(t + secs) AS z, sum(secs) AS s, count(*) AS n FROM ({sessions_sql(where, "least(coalesce(duration_seconds, 0), 7200)")}) GROUP BY 1, 2, 3)
      GROUP BY user_id, g HAVING sum(s) >= 300"""


LONG = "least(coalesce(duration_seconds, 0), 7200) >= 60"
add("e1b_deep_work_sessions", lambda s, d: S.deep_work_sessions(activities(s, d)), deep_sql(f"type IN {TYPES} AND {LONG}"), ACTIVITIES)
add("e1c_all_sessions", lambda s, d: S.deep_work_sessions(activities(s, d), types=None), deep_sql(LONG), ACTIVITIES)
add(
    "e1d_activity_sessions", lambda s, d: S.start_gap_sessions(activities(s, d), 14400),
    """SELECT user_id, floor(min(t))::BIGINT AS started, floor(max(t))::BIGINT AS last_start, count(*) AS activities, sum(s)::BIGINT AS seconds FROM (
         SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS g FROM (
           SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY occurred_at, id) <= 14400 THEN 0 ELSE 1 END AS new FROM (
             SELECT user_id, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(duration_seconds, 0) AS s FROM activities))) GROUP BY user_id, g""", ACTIVITIES,
)
SWITCHES = f"""
switches AS (SELECT * FROM (SELECT user_id, occurred_at, id, {KEY} AS to_key, lag({KEY}) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS from_key FROM activities) WHERE to_key <> from_key)"""
add("e2_context_switch_timeline", lambda s, d: S.switch_timeline(activities(s, d)), "SELECT user_id, strftime(occurred_at, '%Y-%m-%d %H') AS hour, count(*) AS switches FROM switches GROUP BY 1, 2", ACTIVITIES, SWITCHES)
add(
    "e2_context_switch_patterns", lambda s, d: S.switch_patterns(activities(s, d)),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, pattern) AS rank FROM (SELECT user_id, from_key || ' -> ' || to_key AS pattern, count(*) AS n FROM switches GROUP BY 1, 2)) WHERE rank <= 10", ACTIVITIES, SWITCHES,
)
GAPS = """
gaps AS (SELECT *, lead(t) OVER (PARTITION BY user_id, date ORDER BY occurred_at, id) - t - secs AS gap
         FROM (SELECT user_id, occurred_at::DATE AS date, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, coalesce(duration_seconds, 0) AS secs FROM activities))"""
add("e4_break_gaps", lambda s, d: S.break_patterns(activities(s, d)), "SELECT user_id, date, count(*) AS breaks, round(avg(gap) / 60, 3) AS avg_minutes, round(max(gap) / 60, 3) AS longest_minutes FROM gaps WHERE gap BETWEEN 300 AND 7200 GROUP BY 1, 2", ACTIVITIES, GAPS)

def islands_sql(test: str, name: str) -> str:
    return f"""SELECT u.user_id, coalesce(max(n), 0)::BIGINT AS {name} FROM (SELECT DISTINCT user_id FROM daily) u LEFT JOIN (
        SELECT user_id, count(*) AS n FROM (SELECT user_id, date - row_number() OVER (PARTITION BY user_id ORDER BY date)::INTEGER AS i FROM daily WHERE {test}) GROUP BY user_id, i) USING (user_id) GROUP BY 1"""


V = (ACTIVITIES, PREPARED, DAILY)
add("e7a_overwork_streak", lambda s, d: S.longest_run(P.daily_productivity(activities(s, d)), F.col("total_seconds") > 7200, "overwork_days"), islands_sql("total_seconds > 7200", "overwork_days"), *V)
add("e7b_work_day_run", lambda s, d: S.longest_run(P.daily_productivity(activities(s, d)), F.col("total_seconds") >= 3600, "work_days"), islands_sql("total_seconds >= 3600", "work_days"), *V)


def _e7c(s, d):
    a = activities(s, d)
    return S.current_streak(P.daily_productivity(a), F.col("focus_score") >= 20, as_of(a))


add(
    "e7c_focus_streak", _e7c,
    """SELECT u.user_id, coalesce(n, 0) AS streak FROM (SELECT DISTINCT user_id FROM daily) u LEFT JOIN (SELECT user_id, count(*) AS n FROM (
         SELECT user_id, b, row_number() OVER (PARTITION BY user_id ORDER BY b) - 1 AS r FROM (SELECT user_id, date_diff('day', date, (SELECT max(occurred_at)::DATE FROM activities)) AS b FROM daily WHERE focus_score >= 20) WHERE b < 14) WHERE r = b GROUP BY 1) USING (user_id)""", *V,
)
add(
    "e7d_trailing_streak", lambda s, d: S.trailing_streak(P.daily_productivity(activities(s, d)), F.col("activity_count") >= 2),
    "SELECT user_id, count(*) FILTER (f IS NULL OR date > f) AS streak FROM (SELECT *, max(date) FILTER (activity_count < 2) OVER (PARTITION BY user_id) AS f FROM daily) GROUP BY 1", *V,
)
add(
    "e7e_iso_week_streak", lambda s, d: S.week_streaks(activities(s, d).filter("type = 'meeting'").select("user_id", F.to_date("occurred_at").alias("date"))),
    """SELECT user_id, max(n) AS best_weeks, arg_max(n, last) AS last_weeks FROM (SELECT user_id, w - r AS i, count(*) AS n, max(w) AS last FROM (
         SELECT user_id, w, row_number() OVER (PARTITION BY user_id ORDER BY w) AS r FROM (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-05', date_trunc('week', occurred_at)::DATE) // 7 AS w FROM activities WHERE type = 'meeting')) GROUP BY 1, 2) GROUP BY 1""", ACTIVITIES,
)
add(
    "e8_latest_per_group", lambda s, d: S.latest_per_group(wearable_data(s, d), ["user_id", "metric_type"], ["recorded_at", "id"]).select("user_id", "metric_type", "metric_value", "provider", "id"),
    "SELECT user_id, metric_type, metric_value, provider, id FROM wearable_data QUALIFY row_number() OVER (PARTITION BY user_id, metric_type ORDER BY recorded_at DESC, id DESC) = 1", WEARABLE,
)


def _e9(s, d):
    weeks = P.weekly_productivity(activities(s, d))
    return weeks.select("user_id", "week_start", "avg_focus_score", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("avg_focus_score"))).cast("long").alias("rank"))


WEEKLY = "weekly AS (SELECT user_id, date_trunc('week', date)::DATE AS week_start, round(avg(focus_score), 4) AS avg_focus_score FROM daily GROUP BY 1, 2)"
add("e9_period_rank", _e9, "SELECT *, rank() OVER (PARTITION BY user_id ORDER BY avg_focus_score DESC) AS rank FROM weekly", *V, WEEKLY)
add(
    "e14_week_over_week", lambda s, d: S.week_over_week(P.daily_productivity(activities(s, d)), "focus_score"),
    """SELECT user_id, week_start, round(v, 4) AS value, round(p, 4) AS change_pct, CASE WHEN p > 5 THEN 'up' WHEN p < -5 THEN 'down' ELSE 'flat' END AS direction FROM (
         SELECT *, CASE WHEN b <> 0 THEN (v - b) / b * 100 END AS p FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY week_start) AS b FROM (SELECT user_id, date_trunc('week', date)::DATE AS week_start, avg(focus_score) AS v FROM daily GROUP BY 1, 2)))""", *V,
)
add(
    "e15_history_baseline", lambda s, d: S.history_baseline(P.daily_scores(activities(s, d)).withColumn("score", F.round("score", 9)), "score"),
    """SELECT user_id, date, score, round(avg(score) OVER p, 4) AS mean_before, round(stddev_pop(score) OVER p, 4) AS deviation_before,
              count(*) FILTER (score > 10) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS high_days
       FROM (SELECT * REPLACE (round(score, 9) AS score) FROM scores) WINDOW p AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ACTIVITIES, SCORES,
)
add(
    "e12_meeting_free_blocks", lambda s, d: S.meeting_free_hours(activities(s, d)),
    """SELECT user_id, date, min(h)::BIGINT AS from_hour, (max(h) + 1)::BIGINT AS to_hour FROM (
         SELECT user_id, date, h, h - row_number() OVER (PARTITION BY user_id, date ORDER BY h) AS i FROM (SELECT DISTINCT user_id, occurred_at::DATE AS date FROM activities WHERE type = 'meeting') CROSS JOIN range(9, 17) r(h)
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id AS u, occurred_at::DATE AS d, hour(occurred_at) AS a, hour(make_timestamp(((epoch_us(occurred_at) // 1000000) + greatest(duration_seconds - 1, 0)) * 1000000)) AS z FROM activities WHERE type = 'meeting')
                           WHERE u = user_id AND d = date AND h BETWEEN a AND greatest(a, z))) GROUP BY user_id, date, i""", ACTIVITIES,
)
add(
    "e13_implicit_breaks", lambda s, d: S.gaps(activities(s, d)).join(activities(s, d).filter("type = 'break'").select("user_id", F.to_date("occurred_at").alias("day")).distinct(), ["user_id", "day"], "left_anti").filter("gap between 120 and 3600").groupBy("user_id").agg(F.count(F.lit(1)).alias("breaks"), F.round(F.sum("gap") / 60, 3).alias("minutes")),
    "SELECT user_id, count(*) AS breaks, round(sum(gap) / 60, 3) AS minutes FROM gaps g WHERE gap BETWEEN 120 AND 3600 AND NOT EXISTS (SELECT 1 FROM activities a WHERE a.type = 'break' AND a.user_id = g.user_id AND a.occurred_at::DATE = g.date) GROUP BY 1", ACTIVITIES, GAPS,
)
QUOTA = {"minute": (3600, 2), "hour": (14400, 3), "day": (86400, 5)}
add(
    "i6_sliding_window_quota", lambda s, d: S.sliding_quota(request_log(s, d), QUOTA).select("id", "user_id", "endpoint", "n_minute", "n_hour", "n_day", "violated"),
    """SELECT id, user_id, endpoint, n_minute, n_hour, n_day, CASE WHEN n_minute > 2 THEN 'minute' WHEN n_hour > 3 THEN 'hour' WHEN n_day > 5 THEN 'day' END AS violated FROM (
         SELECT event_id AS id, user_id, event_type AS endpoint, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_minute,
                count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 14399999999 PRECEDING AND CURRENT ROW) AS n_hour, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n_day FROM events)""",
)


def _f3(s, d):
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("id")))
    return activities(s, d).withColumn("rank", newest.cast("long")).filter("rank <= 20").select("user_id", "rank", "id")


add("f3_newest_n", _f3, "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS rank, id FROM activities QUALIFY rank <= 20", ACTIVITIES)
add("f2_page", lambda s, d: activities(s, d).orderBy(F.desc("occurred_at"), F.desc("id")).offset(40).limit(20).select("id", "user_id", "type"), "SELECT id, user_id, type FROM activities ORDER BY occurred_at DESC, id DESC LIMIT 20 OFFSET 40", ACTIVITIES)


def _f4(s, d):
    x = activities(s, d).groupBy("user_id", F.hour("occurred_at").cast("long").alias("hour")).agg(F.sum("duration_seconds").alias("seconds"))
    return x.groupBy("user_id").agg(F.min(F.struct((-F.col("seconds")).alias("s"), "hour"))["hour"].alias("peak_hour"), F.max("seconds").alias("peak_seconds"))


add("f4_arg_extreme", _f4, "SELECT user_id, arg_min(hour, (-s, hour)) AS peak_hour, max(s) AS peak_seconds FROM (SELECT user_id, hour(occurred_at)::BIGINT AS hour, sum(duration_seconds)::BIGINT AS s FROM activities GROUP BY 1, 2) GROUP BY 1", ACTIVITIES)


def _g1(s, d):
    sets = activities(s, d).filter("app is not null").groupBy("user_id").agg(F.collect_set("app").alias("apps"), F.collect_set(F.when(F.col("type") == "meeting", F.col("app"))).alias("met"))
    return sets.select("user_id", F.size(F.array_intersect("apps", "met")).cast("long").alias("shared"), F.size(F.array_except("apps", "met")).cast("long").alias("other"), F.size(F.array_union("apps", "met")).cast("long").alias("either"))


add("g1_row_sets", _g1, "SELECT user_id, count(DISTINCT app) FILTER (m) AS shared, count(DISTINCT app) - count(DISTINCT app) FILTER (m) AS other, count(DISTINCT app) AS either FROM (SELECT user_id, app, type = 'meeting' AS m FROM activities WHERE app IS NOT NULL) GROUP BY 1", ACTIVITIES)
add(
    "g2_union_tagged", lambda s, d: P.top_keys(activities(s, d).filter("type = 'web_visit'"), 3).withColumn("list", F.lit("web")).unionByName(P.top_keys(activities(s, d).filter("type = 'app_focus'"), 3).withColumn("list", F.lit("app"))),
    f"""SELECT user_id, key, s AS seconds, rank, list FROM (SELECT *, row_number() OVER (PARTITION BY list, user_id ORDER BY s DESC, key) AS rank FROM (
          SELECT CASE type WHEN 'web_visit' THEN 'web' ELSE 'app' END AS list, user_id, {KEY} AS key, sum(least(coalesce(duration_seconds, 0), 7200))::BIGINT AS s FROM activities WHERE type IN ('web_visit', 'app_focus') GROUP BY 1, 2, 3)) WHERE rank <= 3""", ACTIVITIES,
)
add("g3_distinct_first", lambda s, d: S.latest_per_group(activities(s, d).withColumn("back", -F.col("id")), ["user_id", "title"], ["back"]).select("user_id", "title", "id"), "SELECT user_id, title, min(id) AS id FROM activities GROUP BY 1, 2", ACTIVITIES)
add("d52_wearable_series", lambda s, d: wearable_data(s, d).filter("provider = 'fitbit' and metric_type = 'steps'").orderBy(F.desc("recorded_at"), F.desc("id")).limit(1000).select("id", "user_id", "metric_value"), "SELECT id, user_id, metric_value FROM wearable_data WHERE provider = 'fitbit' AND metric_type = 'steps' ORDER BY recorded_at DESC, id DESC LIMIT 1000", WEARABLE)

dates_as_text("date", "e4_break_gaps", "e15_history_baseline", "e12_meeting_free_blocks")
dates_as_text("week_start", "e9_period_rank", "e14_week_over_week")
