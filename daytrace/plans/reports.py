"""Queries on summaries, insights, skills and recommendations, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dictionaries import SKILL_APPS, SKILL_COMPLEMENTS, TOOL_SUGGESTIONS
from ..functions.dims import APP_CATEGORIES
from ..operators import enrich as N
from ..operators import people as O
from ..operators import productivity as P
from ..operators import reports as R
from ..operators import wellbeing as W
from ..sources.tables import ACTIVITIES, ENTITIES, GOALS, activities, entities, goals
from . import sequences  # noqa: F401  # its queries are used below
from .names import quoted, values
from .productivity import PREPARED, as_of, sql_category, sql_in
from .records import HOURS, SK, skill_table
from .registry import QUERIES, SQL, add, dates_as_text
from .wellbeing import FACTS, facts

NOW = "now AS (SELECT max(occurred_at) AS m FROM activities)"
S = "coalesce(duration_seconds, 0)"
FOCUS = "type IN ('window_focus', 'app_focus')"
USEFUL = sql_in(R.PRODUCTIVE)


def dated(f):
    """An operator that takes the newest time for the present."""

    def run(s, d):
        a = activities(s, d)
        return f(a, as_of(a))

    return run


def top(source: str, keys: str, k: int) -> str:
    """SQL twin of the list of largest keys."""
    return f"(SELECT {keys}, string_agg(key, ', ' ORDER BY s DESC, key) AS top FROM (SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY s DESC, key) <= {k}) GROUP BY {keys})"


add("d7_overview", dated(R.overview),
    f"""SELECT t.user_id, t.n AS total_activities, u.total_hours, u.deep_work_hours, u.meetings_count, u.breaks_count, u.recent, a.top AS top_apps, k.activity_types
        FROM (SELECT user_id, count(*) AS n FROM month GROUP BY 1) t
        JOIN (SELECT user_id, round(sum({S}) / 3600, 4) AS total_hours, round(coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 300), 0) / 3600, 4) AS deep_work_hours, count(*) FILTER (type = 'meeting') AS meetings_count, count(*) FILTER (type = 'break') AS breaks_count,
                     string_agg(coalesce(title, app, type), ' | ' ORDER BY r) FILTER (r <= 10) AS recent FROM latest GROUP BY 1) u USING (user_id)
        LEFT JOIN {top(f"SELECT user_id, app AS key, sum({S}) AS s FROM latest WHERE app IS NOT NULL GROUP BY 1, 2", "user_id", 5)} a USING (user_id)
        JOIN (SELECT user_id, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS activity_types FROM (SELECT user_id, type, count(*) AS n FROM latest GROUP BY 1, 2) GROUP BY 1) k USING (user_id)""",
    ACTIVITIES, NOW, "month AS (SELECT a.* FROM activities a, now WHERE occurred_at >= m - INTERVAL 30 DAY)", "latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS r FROM month QUALIFY r <= 200)")
add("d12_weekly_summary", lambda s, d: R.weekly_summary(activities(s, d)),
    f"""SELECT user_id, week_start, n AS total_activities, round(t / 3600, 4) AS total_hours, round(least(100.0, p / greatest(t, 1) * 100), 4)::DOUBLE AS productivity_score, round(least(10.0, (m + c) / greatest(n * 0.1, 1)), 4)::DOUBLE AS collaboration_index, top AS top_activities, round(d / 3600, 4) AS deep_work_hours,
               concat_ws('; ', 'Tracked ' || n || ' activities', CASE WHEN dn > 0 THEN 'Completed ' || dn || ' deep work sessions' END, CASE WHEN m > 0 THEN 'Attended ' || m || ' meetings' END, 'Most productive app: ' || split_part(top, ', ', 1)) AS achievements
        FROM (SELECT user_id, week_start, count(*) AS n, sum(c2) AS t, coalesce(sum(c2) FILTER (type IN {USEFUL}), 0) AS p, count(*) FILTER (type = 'meeting') AS m, count(*) FILTER (app IN {sql_in(R.MEETING_WEEK_APPS)}) AS c, count(*) FILTER ({FOCUS} AND {S} >= 300) AS dn, coalesce(sum(c2) FILTER ({FOCUS} AND {S} >= 300), 0) AS d FROM w GROUP BY 1, 2)
        JOIN {top("SELECT user_id, week_start, coalesce(nullif(app, ''), type) AS key, sum(c2) AS s FROM w GROUP BY 1, 2, 3", "user_id, week_start", 5)} USING (user_id, week_start)""",
    ACTIVITIES, f"w AS (SELECT *, date_trunc('week', occurred_at)::DATE AS week_start, least({S}, 7200) AS c2 FROM activities)")
add("d13_period_report", dated(R.period_report),
    f"""SELECT user_id, n AS total_activities, round(t / 3600, 4) AS total_hours, dd AS active_days, sw AS context_switches, br AS breaks, round(ab, 4) AS avg_break_minutes, top AS top_keys, round(most / greatest(t, 1) * 100, 4) AS first_share, coalesce(ds, 0) AS deep_sessions, coalesce(dh, 0.0) AS deep_hours
        FROM (SELECT user_id, count(*) AS n, sum(s)::DOUBLE AS t, count(DISTINCT occurred_at::DATE) AS dd, count(*) FILTER (key <> before) AS sw, count(*) FILTER (pause BETWEEN 5 AND 120) AS br, coalesce(avg(pause) FILTER (pause BETWEEN 5 AND 120), 0) AS ab
              FROM (SELECT *, lag(key) OVER w AS before, (t - lag(t + s) OVER w) / 60 AS pause FROM x WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id)) GROUP BY 1)
        JOIN {top("SELECT user_id, coalesce(key, 'Unknown') AS key, sum(s) AS s FROM x GROUP BY 1, 2", "user_id", 10)} USING (user_id)
        JOIN (SELECT user_id, max(s) AS most FROM (SELECT user_id, sum(s) AS s FROM x GROUP BY user_id, coalesce(key, 'Unknown')) GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS ds, round(sum(s) / 3600, 4) AS dh FROM (SELECT user_id, g, sum(s) AS s FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS g FROM (
              SELECT *, CASE WHEN t - lag(t + s) OVER (PARTITION BY user_id ORDER BY occurred_at, id) <= 300 THEN 0 ELSE 1 END AS cut FROM x WHERE s >= 60)) GROUP BY 1, 2 HAVING sum(s) >= 300) GROUP BY 1) USING (user_id)""",
    ACTIVITIES, NOW, f"x AS (SELECT user_id, occurred_at, id, epoch_us(occurred_at) / 1e6 AS t, {S} AS s, coalesce(nullif(app, ''), nullif(domain, '')) AS key FROM activities, now WHERE occurred_at >= m - INTERVAL 7 DAY)")
WEEK = f"wk AS (SELECT activities.*, {S} AS s, least({S}, 7200) AS c2, occurred_at >= date_trunc('day', m) AS today FROM activities, now WHERE occurred_at >= m - INTERVAL 7 DAY)"
add("d14_chat_focus_score", dated(R.chat_focus_score),
    f"""SELECT user_id, round(score, 4) AS score, round(f1 / 3600, 4) AS deep_work_hours, CASE WHEN score - b > 0.2 THEN 'up' WHEN score - b < -0.2 THEN 'down' ELSE 'stable' END AS trend, round(score - b, 4) AS change
        FROM (SELECT *, CASE WHEN t0 > 0 THEN least(10.0::DOUBLE, f0 / t0 * 10) ELSE score END AS b FROM (SELECT *, least(10.0::DOUBLE, f1 / greatest(t1, 1) * 10) AS score FROM (
          SELECT user_id, coalesce(sum(s) FILTER (today), 0) AS t1, coalesce(sum(s) FILTER (today AND {FOCUS} AND s >= 600), 0) AS f1, coalesce(sum(s) FILTER (NOT today), 0) AS t0, coalesce(sum(s) FILTER (NOT today AND {FOCUS} AND s >= 600), 0) AS f0 FROM wk GROUP BY 1)))""", ACTIVITIES, NOW, WEEK)  # fmt: skip
add("d14_chat_weekly_report", dated(R.chat_weekly_report),
    f"""SELECT user_id, round(t / 3600, 4) AS total_hours, days_active, round(least(10.0, p / greatest(t, 1) * 10), 4)::DOUBLE AS avg_focus_score, round((d + coalesce(w, 0)) / 3600, 4) AS deep_work, round(mt / 3600, 4) AS meetings, round((t - d - coalesce(w, 0) - mt) / 3600, 4) AS other
        FROM (SELECT user_id, sum(c2) AS t, count(DISTINCT occurred_at::DATE) AS days_active, coalesce(sum(c2) FILTER (type IN {USEFUL}), 0) AS p, coalesce(sum(c2) FILTER ({FOCUS} AND c2 >= 300), 0) AS d, coalesce(sum(c2) FILTER (type = 'meeting'), 0) AS mt FROM wk GROUP BY 1)
        LEFT JOIN (SELECT user_id, sum(s) AS w FROM (SELECT user_id, sum(c2) AS s FROM wk WHERE type = 'web_visit' GROUP BY user_id, coalesce(nullif(domain, ''), 'unknown') HAVING sum(c2) >= 300) GROUP BY 1) USING (user_id)""", ACTIVITIES, NOW, WEEK)  # fmt: skip
add("d14_user_context", dated(R.user_context),
    f"""SELECT user_id, n AS total_activities, round(t / 3600, 4) AS total_hours, dd AS days_active, round(least(10.0, f / greatest(t, 1) * 10), 4)::DOUBLE AS focus_score, round(d / 3600, 4) AS deep_work_hours, top AS top_apps, peak_hour
        FROM (SELECT user_id, count(*) AS n, sum(s) AS t, count(DISTINCT occurred_at::DATE) AS dd, coalesce(sum(s) FILTER ({FOCUS} AND s >= 600), 0) AS f, coalesce(sum(s) FILTER ({FOCUS} AND s >= 1500), 0) AS d FROM l GROUP BY 1)
        JOIN (SELECT user_id, arg_min(h, (-s, h)) AS peak_hour FROM (SELECT user_id, hour(occurred_at)::BIGINT AS h, sum(s) AS s FROM l GROUP BY 1, 2) GROUP BY 1) USING (user_id)
        LEFT JOIN {top("SELECT user_id, app AS key, sum(s) AS s FROM l WHERE app IS NOT NULL GROUP BY 1, 2", "user_id", 6)} USING (user_id)""",
    ACTIVITIES, NOW, WEEK, "l AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) <= 300)")
DAYS = f"""
days AS (SELECT user_id, occurred_at::DATE AS date, sum({S}) / 3600 AS total_hours, coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 600), 0) / 3600 AS deep_work_hours, least(10.0::DOUBLE, coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 600), 0) / greatest(sum({S}), 1) * 10) AS focus_score,
    coalesce(sum({S}) FILTER (type = 'meeting'), 0) / 3600 AS meeting_hours, count(*) FILTER (type = 'meeting') AS meeting_count, coalesce(sum({S}) FILTER (hour(occurred_at) >= 22), 0) / 3600 AS late_night_hours, count(DISTINCT app) AS skills_used FROM activities GROUP BY 1, 2)"""
add("d14_insight_daily_buckets", lambda s, d: (lambda x: x.select("user_id", "date", *[F.round(c, 6).alias(c) for c in x.columns[2:] if c not in ("meeting_count", "skills_used")], "meeting_count", "skills_used"))(R.insight_days(activities(s, d))),
    "SELECT user_id, date, round(total_hours, 6) AS total_hours, round(deep_work_hours, 6) AS deep_work_hours, round(focus_score, 6) AS focus_score, round(meeting_hours, 6) AS meeting_hours, round(late_night_hours, 6) AS late_night_hours, meeting_count, skills_used FROM days", ACTIVITIES, DAYS)
RULES = [
    ("n = 0 AND focus_score >= 8", "'Excellent focus today'", "focus", 0.6), ("n > 0 AND focus_score > mf * 1.3::DOUBLE AND focus_score >= 7", "'Focus above average'", "focus", 0.7), ("n > 0 AND streak >= 3", "streak || '-day focus streak!'", "achievement", 0.85),
    ("n >= 5 AND sd > 0 AND total_hours > mh + 1.5::DOUBLE * sd", "'Unusually long work day'", "wellness", 0.8), ("n > 0 AND deep_work_hours > md * 1.5::DOUBLE AND deep_work_hours >= 3", "'Deep work breakthrough'", "productivity", 0.7), ("n >= 5 AND long >= 3", "'Extended work pattern detected'", "wellness", 0.9),
    ("late_night_hours > 2", "'Late-night work detected'", "wellness", 0.7), *[(f"career >= {m} AND career - total_hours < {m}", f"'{m}h milestone reached!'", "achievement", 0.9) for m in R.CAREER_HOURS],
    ("skills_used >= 5", "'Diverse skill day'", "learning", 0.5), ("meeting_hours > 4", "'Meeting-heavy day'", "collaboration", 0.6), ("meeting_count = 0 AND total_hours > 4", "'Uninterrupted focus day'", "focus", 0.4),
]
INSIGHTS = f"""
scored AS (SELECT *, place - 1 - coalesce(low, 0) AS streak FROM (SELECT *, count(*) OVER p AS n, avg(focus_score) OVER p AS mf, avg(total_hours) OVER p AS mh, avg(deep_work_hours) OVER p AS md, stddev_pop(total_hours) OVER p AS sd,
      coalesce(sum((total_hours > 10)::INT) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS long, sum(total_hours) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS career, max(CASE WHEN focus_score < 7 THEN place END) OVER p AS low
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date) AS place FROM days) WINDOW p AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
insights AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT user_id, date, {t} AS title, '{c}' AS category, {p}::DOUBLE AS priority FROM scored WHERE {w}" for w, t, c, p in RULES)}) QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY priority DESC, title) <= 5)"""
add("d37_daily_insights", lambda s, d: R.daily_insights(R.insight_days(activities(s, d))), "SELECT * FROM insights", ACTIVITIES, DAYS, INSIGHTS)
add("d37_insight_dedup", lambda s, d: N.without_recent(R.daily_insights(R.insight_days(activities(s, d)))), "SELECT * FROM insights QUALIFY lag(date) OVER (PARTITION BY user_id, title ORDER BY date) IS NULL OR date_diff('day', lag(date) OVER (PARTITION BY user_id, title ORDER BY date), date) * 24 > 48", ACTIVITIES, DAYS, INSIGHTS)
add("d37_insight_stats", lambda s, d: R.insight_stats(R.daily_insights(R.insight_days(activities(s, d)))), "SELECT user_id, category, count(*) AS n, round(avg(priority), 4) AS mean_priority FROM insights GROUP BY 1, 2", ACTIVITIES, DAYS, INSIGHTS)
add("d37_weekly_insights", lambda s, d: R.weekly_insights(R.insight_days(activities(s, d))),
    """SELECT user_id, week_start, round(h, 4) AS total_hours, round(f, 4) AS mean_focus, best_day::VARCHAR AS best_day, round(coalesce(f - lag(f) OVER (PARTITION BY user_id ORDER BY week_start), 0.0), 4) AS focus_change
       FROM (SELECT user_id, date_trunc('week', date)::DATE AS week_start, sum(total_hours) AS h, avg(focus_score) AS f, arg_min(date, (-focus_score, date)) AS best_day FROM days GROUP BY 1, 2)""", ACTIVITIES, DAYS)  # fmt: skip
SKILLS = f"""
skills AS (SELECT user_id, coalesce(k.skill, a.app) AS skill, coalesce(k.category, 'Other') AS category, sum({S}) / 3600 AS hours, max(occurred_at) AS last FROM activities a CROSS JOIN now LEFT JOIN (SELECT lower(app) AS app, arg_max(skill, i) AS skill, arg_max(category, i) AS category FROM apps GROUP BY 1) k ON lower(a.app) = k.app
    WHERE a.app <> '' AND occurred_at >= m - INTERVAL 90 DAY GROUP BY 1, 2, 3),
metrics AS (SELECT *, round(least(100.0::DOUBLE, hours / CASE WHEN sum(hours) OVER (PARTITION BY user_id) > 0 THEN sum(hours) OVER (PARTITION BY user_id) ELSE 1 END * 100), 4) AS mastery FROM skills)"""
APPS = values("apps", "app, skill, category", SKILL_APPS)
add("d9_skill_metrics", dated(R.skill_metrics), "SELECT user_id, skill, category, round(hours, 4) AS hours, mastery, round(hours / 7, 4) AS growth_rate, strftime(last, '%Y-%m-%d') AS last_used FROM metrics", ACTIVITIES, NOW, APPS, SKILLS)
add("d9_skill_summary", dated(lambda a, t: R.skill_summary(R.skill_metrics(a, t))),
    """SELECT u.user_id, total_skills, advanced_skills, round(least(100.0, k / 8 * 100), 4)::DOUBLE AS skill_diversity, round(total_skills / 4, 4) AS learning_velocity, coalesce(recommended, '') AS recommended
       FROM (SELECT user_id, count(*) AS total_skills, count(*) FILTER (mastery > 70) AS advanced_skills, count(DISTINCT category) AS k FROM metrics GROUP BY 1) u
       LEFT JOIN (SELECT user_id, string_agg(pick, ', ' ORDER BY r) AS recommended FROM (SELECT user_id, pick, min(r) AS r, row_number() OVER (PARTITION BY user_id ORDER BY min(r)) AS q FROM (
           SELECT c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.h DESC, c.category) AS r, (SELECT arg_min(o.skill, o.i) FROM options o WHERE o.category = c.known AND NOT EXISTS (SELECT 1 FROM metrics x WHERE x.user_id = c.user_id AND x.skill = o.skill)) AS pick
           FROM (SELECT user_id, category, CASE WHEN category IN (SELECT category FROM options) THEN category ELSE 'Other' END AS known, sum(round(hours, 4)) AS h FROM metrics GROUP BY 1, 2, 3) c) WHERE pick IS NOT NULL GROUP BY 1, 2) WHERE q <= 4 GROUP BY 1) v ON u.user_id = v.user_id""",
    ACTIVITIES, NOW, APPS, SKILLS, values("options", "category, skill", [(k, r[0]) for k, rows in SKILL_COMPLEMENTS.items() for r in rows]))

CATEGORY = sql_category("coalesce(app, '')", APP_CATEGORIES, "unknown")
KPIS = f"""
kpis AS (SELECT user_id, round(least(10.0::DOUBLE, CASE WHEN t > 0 THEN (d / t * 0.5::DOUBLE + (1 - least(sw / 40, 1.0::DOUBLE)) * 0.25 + (1 - least(mt / t / 0.5::DOUBLE, 1.0::DOUBLE)) * 0.25) * 10 ELSE 0 END), 4) AS focus_score, round(d, 4) AS deep_work_hours, round(t, 4) AS total_hours, sw AS context_switches, round(mt, 4) AS meeting_hours
  FROM (SELECT user_id, sum(s) / 3600 AS t, coalesce(sum(s) FILTER (category = 'meetings' OR type = 'meeting'), 0) / 3600 AS mt, coalesce(sum(s) FILTER (category = 'productive' AND type <> 'meeting'), 0) / 3600 AS d, count(*) FILTER (before <> '' AND coalesce(app, '') <> before) AS sw
        FROM (SELECT *, {S} AS s, {CATEGORY} AS category, lag(coalesce(app, '')) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS before FROM activities) GROUP BY 1))"""
add("d39_dashboard_kpis", lambda s, d: R.dashboard_kpis(activities(s, d)), "SELECT * FROM kpis", ACTIVITIES, KPIS)


def goal_counts(s, d):
    g = goals(s, d)
    late = (F.col("status") == "active") & (F.col("deadline") < F.to_date(as_of(g, "started")))
    return g.groupBy((F.col("user_id") % 50).alias("user_id")).agg(F.count(F.when(F.col("status") == "active", 1)).alias("active"), F.count(F.when(late, 1)).alias("overdue"), F.count(F.when(F.col("status") == "completed", 1)).alias("completed"))


COUNTS = "counts AS (SELECT user_id % 50 AS user_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND deadline < (SELECT max(started) FROM goals)) AS overdue, count(*) FILTER (status = 'completed') AS completed FROM goals GROUP BY 1)"
add("d39_quick_actions", lambda s, d: R.quick_actions(R.dashboard_kpis(activities(s, d)), W.burnout_risk(facts(s, d)), goal_counts(s, d)),
    """SELECT user_id, coalesce(nullif(concat_ws(', ', CASE WHEN focus_score < 5 THEN 'productivity' END, CASE WHEN risk_level IN ('high', 'critical') THEN 'wellness' END, CASE WHEN coalesce(overdue, 0) > 0 THEN 'overdue ' || overdue END, CASE WHEN coalesce(active, 0) = 0 THEN 'set a goal' END), ''), 'on track') AS actions
       FROM kpis LEFT JOIN burnout USING (user_id) LEFT JOIN counts USING (user_id)""", f"burnout AS ({SQL['d28_burnout_risk']})", ACTIVITIES, KPIS, GOALS, COUNTS)  # fmt: skip
add("d39_expertise_distribution", lambda s, d: R.expertise_distribution(O.skill_hours(activities(s, d), skill_table(s))),
    "SELECT user_id, count(*) FILTER (h < 20) AS beginner, count(*) FILTER (h >= 20 AND h < 50) AS intermediate, count(*) FILTER (h >= 50 AND h < 100) AS advanced, count(*) FILTER (h >= 100 AND h < 200) AS expert, count(*) FILTER (h >= 200) AS master FROM (SELECT user_id, round(hours, 6) AS h FROM hours) GROUP BY 1", ACTIVITIES, SK, HOURS)
add("d39_weekly_digest", lambda s, d: R.weekly_digest(activities(s, d), W.work_life_balance(facts(s, d)), goal_counts(s, d)),
    f"""SELECT user_id, week_start, round(h, 4) AS total_hours, round(CASE WHEN h > 0 THEN least(p / h * 100, 100.0) ELSE 0 END, 4)::DOUBLE AS productivity_score,
               coalesce(nullif(concat_ws(', ', CASE WHEN h > 0 THEN 'tracked' END, CASE WHEN coalesce(completed, 0) > 0 THEN 'goals completed' END, CASE WHEN level IN ('excellent', 'good') THEN 'balance ' || level END), ''), 'no data') AS highlights,
               coalesce(nullif(concat_ws(', ', CASE WHEN h > 45 THEN 'reduce hours' WHEN h < 20 AND h > 0 THEN 'low hours' END, CASE WHEN coalesce(active, 0) = 0 THEN 'set a goal' END), ''), 'keep going') AS suggestions
        FROM (SELECT user_id, date_trunc('week', occurred_at)::DATE AS week_start, sum({S}) / 3600 AS h, coalesce(sum({S}) FILTER ({CATEGORY} = 'productive'), 0) / 3600 AS p FROM activities GROUP BY 1, 2) LEFT JOIN balance USING (user_id) LEFT JOIN counts USING (user_id)""",
    f"balance AS ({SQL['d28_work_life_balance']})", ACTIVITIES, GOALS, COUNTS)

# what a user does, as skills by their usual names, so that the suggestions have cases
TOOL_SKILLS = {"vscode": "python", "pycharm": "python", "jupyter": "data_science", "terminal": "devops", "Notion": "writing", "chrome": "javascript"}


def _own_skills(s, d):
    names = F.create_map(*[F.lit(v) for kv in TOOL_SKILLS.items() for v in kv])
    return activities(s, d).withColumn("skill", F.element_at(names, F.col("app"))).filter("skill is not null").groupBy("user_id", "skill").agg((F.sum(F.coalesce("duration_seconds", F.lit(0))) / 3600).alias("hours"))


OWN = f"own AS (SELECT user_id, CASE app {' '.join(f'WHEN {quoted(a)} THEN {quoted(k)}' for a, k in TOOL_SKILLS.items())} END AS skill, sum({S}) / 3600 AS hours FROM activities WHERE app IN {sql_in(list(TOOL_SKILLS))} GROUP BY 1, 2)"
add("d40_recommend_tools", lambda s, d: R.recommend_tools(_own_skills(s, d), activities(s, d).filter("app is not null").select("user_id", "app")),
    """SELECT user_id, skill, tool, CASE WHEN hours > 10 THEN 0.9 WHEN hours > 5 THEN 0.8 ELSE 0.7 END::DOUBLE AS relevance, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN hours > 10 THEN 0.9 WHEN hours > 5 THEN 0.8 ELSE 0.7 END DESC, skill, tool) AS rank
       FROM own JOIN tools USING (skill) WHERE NOT EXISTS (SELECT 1 FROM activities a WHERE a.user_id = own.user_id AND lower(a.app) = lower(tool)) QUALIFY rank <= 10""", ACTIVITIES, OWN, values("tools", "skill, tool", [(k, t) for k, ts in TOOL_SUGGESTIONS.items() for t in ts]))  # fmt: skip


def _work_facts(s, d):
    a = activities(s, d).withColumn("s", F.coalesce("duration_seconds", F.lit(0)))
    focus = F.col("type").isin(*R.FOCUS) & (F.col("s") >= 600)
    share = lambda test: F.coalesce(F.sum(F.when(test & focus, F.col("s"))), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.when(test, F.col("s"))), F.lit(0)), F.lit(1)) * 10
    early = F.hour("occurred_at") < 12
    u = a.groupBy("user_id").agg(share(F.lit(True)).alias("avg_focus_score"), share(early).alias("morning_focus_score"), (F.avg("s") / 60).alias("avg_session_min"), (F.max("s") / 60).alias("longest_session_min"), (F.sum("s") / 3600).alias("total_hours"), (F.coalesce(F.sum(F.when(focus, F.col("s"))), F.lit(0)) / 3600).alias("deep_work_hours"), (F.coalesce(F.sum(F.when(F.col("type") == "meeting", F.col("s"))), F.lit(0)) / 3600).alias("meeting_hours"), F.count(F.when(F.col("type") == "break", 1)).alias("break_count"))
    return u.join(facts(s, d).groupBy("user_id").agg(F.avg("context_switches").alias("context_switches")), "user_id").withColumn("peak_hours", F.lit("9:00"))


WORK = f"""
work AS (SELECT user_id, least(1e9, coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 600), 0) / greatest(sum({S}), 1) * 10) AS f, coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 600 AND hour(occurred_at) < 12), 0) / greatest(coalesce(sum({S}) FILTER (hour(occurred_at) < 12), 0), 1) * 10 AS mf, avg({S}) / 60 AS a, max({S}) / 60 AS longest,
    sum({S}) / 3600 AS t, coalesce(sum({S}) FILTER ({FOCUS} AND {S} >= 600), 0) / 3600 AS d, coalesce(sum({S}) FILTER (type = 'meeting'), 0) / 3600 AS m, count(*) FILTER (type = 'break') AS b FROM activities GROUP BY 1),
sw AS (SELECT user_id, avg(context_switches) AS c FROM facts GROUP BY 1)"""
add("d40_recommend_workflows", lambda s, d: R.recommend_workflows(_work_facts(s, d)),
    """SELECT user_id, name, round(relevance, 2) AS relevance FROM (SELECT user_id, 'Pomodoro Technique' AS name, least(0.9::DOUBLE, 1 - f / 10) AS relevance FROM work WHERE f < 6 UNION ALL SELECT user_id, 'Task Batching', least(0.85::DOUBLE, c / 30) FROM sw WHERE c > 15
       UNION ALL SELECT user_id, 'Time Blocking', CASE WHEN a < 25 THEN least(0.8::DOUBLE, 1 - a / 60) ELSE 0.75 END FROM work WHERE a < 25 OR (t > 0 AND d / t < 0.3) UNION ALL SELECT user_id, 'Eat the Frog', 0.65 FROM work WHERE mf < f * 0.8::DOUBLE)""", ACTIVITIES, PREPARED, FACTS, WORK)  # fmt: skip
add("d40_recommend_time_management", lambda s, d: R.recommend_time_management(_work_facts(s, d)),
    """SELECT user_id, title, round(relevance, 2)::DOUBLE AS relevance FROM (SELECT user_id, 'Take regular breaks' AS title, 0.9 AS relevance FROM work WHERE b = 0 AND t > 4 UNION ALL SELECT user_id, 'Break up long sessions', 0.8 FROM work WHERE longest > 120
       UNION ALL SELECT user_id, 'Leverage your peak hours', 0.65 FROM work UNION ALL SELECT user_id, 'Optimize meeting time', least(0.85, m / t) FROM work WHERE m > 4)""", ACTIVITIES, PREPARED, FACTS, WORK)  # fmt: skip
add("d40_recommend_collaborators", lambda s, d: R.recommend_collaborators(_own_skills(s, d).filter("hours > 0.2"), activities(s, d).filter("type = 'meeting'").select("user_id", (F.col("user_id") + 1).alias("other"))),
    """SELECT a.user_id, b.user_id AS other, round(least(1.0, len(list_filter(b.k, lambda x: NOT list_contains(a.k, x))) / len(b.k) * 0.7 + len(list_intersect(b.k, a.k)) / len(a.k) * 0.3), 4)::DOUBLE AS relevance,
              row_number() OVER (PARTITION BY a.user_id ORDER BY round(least(1.0, len(list_filter(b.k, lambda x: NOT list_contains(a.k, x))) / len(b.k) * 0.7 + len(list_intersect(b.k, a.k)) / len(a.k) * 0.3), 9) DESC, b.user_id) AS rank
       FROM (SELECT user_id, list(skill) AS k FROM own WHERE hours > 0.2 GROUP BY 1) a, (SELECT user_id, list(skill) AS k FROM own WHERE hours > 0.2 GROUP BY 1) b
       WHERE a.user_id <> b.user_id AND NOT EXISTS (SELECT 1 FROM activities m WHERE m.type = 'meeting' AND m.user_id = a.user_id AND a.user_id + 1 = b.user_id) QUALIFY rank <= 10""", ACTIVITIES, OWN)  # fmt: skip
GOAL_SKILLS, TRENDS = ["python", "rust", "writing"], ["devops", "go"]
add("d40_recommend_learning", lambda s, d: R.recommend_learning(_own_skills(s, d).select("user_id", "skill", F.least(F.lit(100.0), F.round(F.col("hours") * 20, 4)).alias("score")), GOAL_SKILLS, TRENDS),
    f"""SELECT user_id, skill, relevance, source, row_number() OVER (PARTITION BY user_id ORDER BY relevance DESC, skill) AS rank FROM (
          SELECT * FROM (
            SELECT u.user_id, g.skill, CASE WHEN o.skill IS NULL THEN 0.95 ELSE 0.85 END::DOUBLE AS relevance, 'goal' AS source, 0 AS pos FROM (SELECT DISTINCT user_id FROM scored) u, (VALUES {', '.join(f"('{g}')" for g in GOAL_SKILLS)}) g(skill) LEFT JOIN scored o ON o.user_id = u.user_id AND o.skill = g.skill WHERE o.skill IS NULL OR o.score < 50
            UNION ALL SELECT u.user_id, g.skill, 0.7, 'trend', 1 FROM (SELECT DISTINCT user_id FROM scored) u, (VALUES {', '.join(f"('{g}')" for g in TRENDS)}) g(skill) WHERE NOT EXISTS (SELECT 1 FROM scored o WHERE o.user_id = u.user_id AND o.skill = g.skill)
            UNION ALL SELECT user_id, skill, round(0.4 + (30 - score) / 100, 2), 'weak', 2 FROM scored WHERE score < 30)
          QUALIFY row_number() OVER (PARTITION BY user_id, skill ORDER BY pos) = 1) QUALIFY rank <= 10""", ACTIVITIES, OWN, "scored AS (SELECT user_id, skill, least(100.0::DOUBLE, round(hours * 20, 4)) AS score FROM own)")  # fmt: skip
add("d51_productivity_by_score", lambda s, d: R.productivity_by_score(activities(s, d)),
    f"""SELECT user_id, round(t / 3600, 4) AS total_hours, round(p / 3600, 4) AS productive_hours, round(n / 3600, 4) AS neutral_hours, round((t - p - n) / 3600, 4) AS unproductive_hours, round(p / 3600 / greatest(t / 3600, 0.01::DOUBLE) * 100, 4) AS productivity_score, top AS top_applications, coalesce(mc, 0) AS meetings_count, coalesce(tc, 0) AS total_collaborators, round(coalesce(mh, 0.0), 4)::DOUBLE AS meeting_hours
        FROM (SELECT user_id, sum(s) AS t, coalesce(sum(s) FILTER (score > 0.6), 0) AS p, coalesce(sum(s) FILTER (score BETWEEN 0.3 AND 0.6), 0) AS n FROM (SELECT user_id, {S} AS s, CASE {CATEGORY} WHEN 'productive' THEN 1.0 WHEN 'distractive' THEN 0.25 ELSE 0.5 END AS score FROM activities) GROUP BY 1)
        JOIN {top(f"SELECT user_id, coalesce(app, '') AS key, sum({S}) AS s FROM activities GROUP BY 1, 2", "user_id", 5)} USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS mc, sum({S}) / 3600 AS mh FROM activities WHERE type = 'meeting' GROUP BY 1) USING (user_id)
        LEFT JOIN (SELECT user_id, count(DISTINCT p) AS tc FROM (SELECT user_id, unnest(CAST(json_extract(data, '$.participants') AS VARCHAR[])) AS p FROM activities WHERE type = 'meeting') GROUP BY 1) USING (user_id)""", ACTIVITIES)  # fmt: skip

STEPS = [(k, t) for k, ts in O.MILESTONES.items() for t in ts]
add("d34_milestones", lambda s, d: O.milestones(activities(s, d), entities(s, d), QUERIES["e7c_focus_streak"](s, d)),
    f"""SELECT user_id, metric, threshold::BIGINT AS threshold, value >= threshold AS reached, round(least(100.0, value / threshold * 100), 6)::DOUBLE AS progress FROM (
          UNPIVOT (SELECT user_id, n::DOUBLE AS activity_count, coalesce(e, 0)::DOUBLE AS entity_count, h::DOUBLE AS hours_tracked, coalesce(streak, 0)::DOUBLE AS focus_streak, k::DOUBLE AS unique_apps FROM (SELECT user_id, count(*) AS n, sum({S}) / 3600 AS h, count(DISTINCT app) AS k FROM activities GROUP BY 1)
                   LEFT JOIN (SELECT user_id, count(*) AS e FROM entities GROUP BY 1) USING (user_id) LEFT JOIN streaks USING (user_id)) ON activity_count, entity_count, hours_tracked, focus_streak, unique_apps INTO NAME metric VALUE value)
        JOIN steps USING (metric)""", f"streaks AS ({SQL['e7c_focus_streak']})", ACTIVITIES, ENTITIES, values("steps", "metric, threshold", STEPS))  # fmt: skip


def _decay(s, d):
    e = entities(s, d)
    return P.knowledge_decay(e, as_of(e, "last_seen"))


DECAY = """
decay AS (SELECT id, user_id, entity_type, round(s, 6) AS freshness, round(raw, 6) AS decay_rate, days AS days_since, CASE WHEN s >= 0.7 THEN 'fresh' WHEN s >= 0.4 THEN 'fading' WHEN s >= 0.15 THEN 'stale' ELSE 'forgotten' END AS status
  FROM (SELECT *, exp(-greatest(0.005, raw) * days) AS s FROM (SELECT *, 0.015 / (1 + 0.1 * (occurrence_count - 1)) AS raw, greatest(date_diff('day', last_seen, (SELECT max(last_seen) FROM entities)), 0)::BIGINT AS days FROM entities)))"""
add("d36_knowledge_decay", _decay, "SELECT * FROM decay", ENTITIES, DECAY)
add("d36_decay_health", lambda s, d: R.decay_health(_decay(s, d)),
    """SELECT *, CASE WHEN average_freshness >= 0.6 THEN 'healthy' WHEN average_freshness >= 0.3 THEN 'needs_attention' ELSE 'deteriorating' END AS overall_health FROM (
       SELECT user_id, count(*) AS total, round(avg(freshness), 4) AS average_freshness, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'fading') AS fading, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'forgotten') AS forgotten FROM decay GROUP BY 1)""", ENTITIES, DECAY)  # fmt: skip
add("d36_at_risk", lambda s, d: R.decay_at_risk(_decay(s, d)),
    "SELECT id, user_id, freshness, CASE WHEN freshness < 0.15 THEN 'high' ELSE 'medium' END AS urgency, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY freshness, id) <= 10 THEN 'Revisit after ' || days_since || ' days' END AS suggestion FROM decay WHERE freshness < 0.4", ENTITIES, DECAY)
dates_as_text("week_start", "d12_weekly_summary", "d37_weekly_insights", "d39_weekly_digest")
dates_as_text("date", "d37_daily_insights", "d37_insight_dedup", "d14_insight_daily_buckets")
