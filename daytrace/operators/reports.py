"""Summaries by user, week and day, and the recommendations and insights that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import SKILL_APPS, SKILL_COMPLEMENTS, TOOL_SUGGESTIONS
from ..functions.scalars import capped, categorize_app, category_weight
from ..session import bounded

PRODUCTIVE = ("window_focus", "app_focus", "page_view", "web_visit")
FOCUS = ("window_focus", "app_focus")
MEETING_WEEK_APPS = ("Slack", "Teams", "Discord", "Zoom", "Google Meet")


def _sum(test: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, value)), F.lit(0))


def _seconds() -> Column:
    return F.coalesce("duration_seconds", F.lit(0))


def _top(rows: DataFrame, keys: list[str], k: int, name: str = "key", value: str = "seconds") -> DataFrame:
    """The ``k`` largest of each group as one text of names, by size and then name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), name))
    best = rows.withColumn("r", rank).filter(F.col("r") <= k)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", name))), lambda x: x[name]), ", ").alias("top"))


def overview(acts: DataFrame, as_of: Column, days: int = 30, latest: int = 200, k: int = 5) -> DataFrame:
    """The number of rows of the last ``days`` days, and over the ``latest`` ones hours, deep work (300 s), meetings, breaks,
    top applications, types and the ten newest titles."""
    recent = acts.filter(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    total = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_activities"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("id")))
    x = recent.withColumn("r", rank).filter(F.col("r") <= latest).withColumn("s", _seconds())
    kind = F.col("type")
    u = x.groupBy("user_id").agg(
        F.round(F.sum("s") / 3600, 4).alias("total_hours"), F.round(_sum(kind.isin(*FOCUS) & (F.col("s") >= 300), F.col("s")) / 3600, 4).alias("deep_work_hours"), F.count(F.when(kind == "meeting", 1)).alias("meetings_count"), F.count(F.when(kind == "break", 1)).alias("breaks_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 10, F.struct("r", F.coalesce("title", "app", "type").alias("t"))))), lambda v: v["t"]), " | ").alias("recent"),
    )
    apps = x.filter("app is not null").groupBy("user_id", F.col("app").alias("key")).agg(F.sum("s").alias("seconds"))
    types = x.groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "n"))), ",").alias("activity_types"))
    return total.join(u, "user_id").join(_top(apps, ["user_id"], k).withColumnRenamed("top", "top_apps"), "user_id", "left").join(types, "user_id")


def weekly_summary(acts: DataFrame) -> DataFrame:
    """Of each user and week: rows, hours, productivity, collaboration index, the five keys with most time and
    achievements. Rows are cut at two hours."""
    s = capped(F.col("duration_seconds"))
    x = acts.select("user_id", F.date_trunc("week", "occurred_at").cast("date").alias("week_start"), "type", "app", F.coalesce(F.nullif("app", F.lit("")), "type").alias("key"), s.alias("s"), _seconds().alias("raw"))
    deep = F.col("type").isin(*FOCUS) & (F.col("raw") >= 300)
    w = x.groupBy("user_id", "week_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), _sum(F.col("type").isin(*PRODUCTIVE), F.col("s")).alias("productive"), F.count(F.when(F.col("type") == "meeting", 1)).alias("meetings"),
        F.count(F.when(F.col("app").isin(*MEETING_WEEK_APPS), 1)).alias("messages"), F.count(F.when(deep, 1)).alias("deep_n"), _sum(deep, F.col("s")).alias("deep"),
    )
    keys = x.groupBy("user_id", "week_start", "key").agg(F.sum("s").alias("seconds"))
    y = w.join(_top(keys, ["user_id", "week_start"], 5), ["user_id", "week_start"])
    best = F.split(F.col("top"), ", ")[0]
    achieved = F.array_compact(F.array(
        F.concat(F.lit("Tracked "), F.col("n").cast("string"), F.lit(" activities")), F.when(F.col("deep_n") > 0, F.concat(F.lit("Completed "), F.col("deep_n").cast("string"), F.lit(" deep work sessions"))),
        F.when(F.col("meetings") > 0, F.concat(F.lit("Attended "), F.col("meetings").cast("string"), F.lit(" meetings"))), F.concat(F.lit("Most productive app: "), best),
    ))
    return y.select(
        "user_id", "week_start", F.col("n").alias("total_activities"), F.round(F.col("total") / 3600, 4).alias("total_hours"), F.round(F.least(F.lit(100.0), F.col("productive") / F.greatest(F.col("total"), F.lit(1)) * 100), 4).alias("productivity_score"),
        F.round(F.least(F.lit(10.0), (F.col("meetings") + F.col("messages")) / F.greatest(F.col("n") * 0.1, F.lit(1.0))), 4).alias("collaboration_index"), F.col("top").alias("top_activities"), F.round(F.col("deep") / 3600, 4).alias("deep_work_hours"), F.array_join(achieved, "; ").alias("achievements"),
    )


def period_report(acts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Of the last ``days`` days: totals, active days, the ten keys with most time and the first one's share, sessions
    without a gap above 300 s of at least 300 s, switches between known keys, and breaks of 5 to 120 minutes."""
    x = acts.filter(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    w = Window.partitionBy("user_id").orderBy("occurred_at", "id")
    t, s = F.unix_micros("occurred_at") / 1e6, _seconds()
    key = F.coalesce(F.nullif("app", F.lit("")), F.nullif("domain", F.lit("")))
    x = x.select("user_id", "occurred_at", "id", t.alias("t"), s.alias("s"), key.alias("key"))
    x = x.withColumns({"before": F.lag("key").over(w), "pause": (F.col("t") - F.lag(F.col("t") + F.col("s")).over(w)) / 60})
    keys = x.groupBy("user_id", F.coalesce("key", F.lit("Unknown")).alias("key")).agg(F.sum("s").alias("seconds"))
    real = F.col("pause").between(5, 120)
    u = x.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_activities"), F.sum("s").alias("total"), F.count_distinct(F.to_date("occurred_at")).alias("active_days"), F.count(F.when(F.col("key") != F.col("before"), 1)).alias("context_switches"),
        F.count(F.when(real, 1)).alias("breaks"), F.coalesce(F.avg(F.when(real, F.col("pause"))), F.lit(0.0)).alias("avg_break"),
    )
    long = x.filter("s >= 60")
    new = F.coalesce((F.col("t") - F.lag(F.col("t") + F.col("s")).over(w) > 300).cast("int"), F.lit(1))
    sessions = long.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.sum("s").alias("s")).filter("s >= 300")
    deep = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("deep_sessions"), F.round(F.sum("s") / 3600, 4).alias("deep_hours"))
    first = keys.groupBy("user_id").agg(F.max("seconds").alias("most"))
    out = u.join(_top(keys, ["user_id"], 10), "user_id").join(first, "user_id").join(deep, "user_id", "left")
    return out.select("user_id", "total_activities", F.round(F.col("total") / 3600, 4).alias("total_hours"), "active_days", "context_switches", "breaks", F.round("avg_break", 4).alias("avg_break_minutes"), F.col("top").alias("top_keys"), F.round(F.col("most") / F.greatest(F.col("total"), F.lit(1)) * 100, 4).alias("first_share"), F.coalesce("deep_sessions", F.lit(0)).alias("deep_sessions"), F.coalesce("deep_hours", F.lit(0.0)).alias("deep_hours"))


def chat_focus_score(acts: DataFrame, as_of: Column) -> DataFrame:
    """0 to 10 for the share of rows of focus of 600 s or more today, against the seven days before: up, down or stable
    at 0.2."""
    day = F.date_trunc("day", as_of)
    x = acts.filter(F.col("occurred_at") >= as_of - F.expr("INTERVAL '7' DAY")).withColumn("today", F.col("occurred_at") >= day).withColumn("s", _seconds())
    focused = F.col("type").isin(*FOCUS) & (F.col("s") >= 600)
    u = x.groupBy("user_id").agg(_sum(F.col("today"), F.col("s")).alias("t1"), _sum(F.col("today") & focused, F.col("s")).alias("f1"), _sum(~F.col("today"), F.col("s")).alias("t0"), _sum(~F.col("today") & focused, F.col("s")).alias("f0"))
    score = F.least(F.lit(10.0), F.col("f1") / F.greatest(F.col("t1"), F.lit(1)) * 10)
    before = F.when(F.col("t0") > 0, F.least(F.lit(10.0), F.col("f0") / F.greatest(F.col("t0"), F.lit(1)) * 10)).otherwise(score)
    change = score - before
    return u.select("user_id", F.round(score, 4).alias("score"), F.round(F.col("f1") / 3600, 4).alias("deep_work_hours"), F.when(change > 0.2, "up").when(change < -0.2, "down").otherwise("stable").alias("trend"), F.round(change, 4).alias("change"))


def chat_weekly_report(acts: DataFrame, as_of: Column) -> DataFrame:
    """The last seven days' hours, active days, focus of 0 to 10, and the split in deep work (300 s, web visits added up
    by domain), meetings and the rest."""
    x = acts.filter(F.col("occurred_at") >= as_of - F.expr("INTERVAL '7' DAY")).withColumn("s", capped(F.col("duration_seconds")))
    site = F.when(F.col("type") == "web_visit", F.coalesce(F.nullif("domain", F.lit("")), F.lit("unknown"))).otherwise("")
    p = x.groupBy("user_id", site.alias("site")).agg(F.sum("s").alias("s"), _sum(F.col("type").isin(*PRODUCTIVE), F.col("s")).alias("p"), _sum(F.col("type") == "meeting", F.col("s")).alias("m"), _sum(F.col("type").isin(*FOCUS) & (F.col("s") >= 300), F.col("s")).alias("d"))
    u = p.groupBy("user_id").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("m").alias("m"), F.sum(F.col("d") + F.when((F.col("site") != "") & (F.col("s") >= 300), F.col("s")).otherwise(0)).alias("d"))
    days = x.groupBy("user_id").agg(F.count_distinct(F.to_date("occurred_at")).alias("days_active"))
    return u.join(days, "user_id").select("user_id", F.round(F.col("s") / 3600, 4).alias("total_hours"), "days_active", F.round(F.least(F.lit(10.0), F.col("p") / F.greatest(F.col("s"), F.lit(1)) * 10), 4).alias("avg_focus_score"), F.round(F.col("d") / 3600, 4).alias("deep_work"), F.round(F.col("m") / 3600, 4).alias("meetings"), F.round((F.col("s") - F.col("d") - F.col("m")) / 3600, 4).alias("other"))


def user_context(acts: DataFrame, as_of: Column, latest: int = 300) -> DataFrame:
    """Of the ``latest`` rows of the last seven days: hours, active days, focus (600 s), deep work (1,500 s), six top
    applications and the hour with most time, the first of equal ones."""
    x = acts.filter(F.col("occurred_at") >= as_of - F.expr("INTERVAL '7' DAY")).withColumn("s", _seconds())
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), F.desc("id")))).filter(F.col("r") <= latest)
    focus = F.col("type").isin(*FOCUS)
    u = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_activities"), F.sum("s").alias("t"), F.count_distinct(F.to_date("occurred_at")).alias("days_active"), _sum(focus & (F.col("s") >= 600), F.col("s")).alias("f"), _sum(focus & (F.col("s") >= 1500), F.col("s")).alias("d"))
    hours = x.groupBy("user_id", F.hour("occurred_at").cast("long").alias("hour")).agg(F.sum("s").alias("s")).groupBy("user_id").agg(F.max_by("hour", F.struct("s", -F.col("hour"))).alias("peak_hour"))
    apps = x.filter("app is not null").groupBy("user_id", F.col("app").alias("key")).agg(F.sum("s").alias("seconds"))
    out = u.join(hours, "user_id").join(_top(apps, ["user_id"], 6), "user_id", "left")
    return out.select("user_id", "total_activities", F.round(F.col("t") / 3600, 4).alias("total_hours"), "days_active", F.round(F.least(F.lit(10.0), F.col("f") / F.greatest(F.col("t"), F.lit(1)) * 10), 4).alias("focus_score"), F.round(F.col("d") / 3600, 4).alias("deep_work_hours"), F.col("top").alias("top_apps"), "peak_hour")


def insight_days(acts: DataFrame) -> DataFrame:
    """What the insights read of each user and day: hours, deep work and focus (600 s), meetings, and hours from 22 on."""
    s = _seconds()
    x = acts.withColumn("s", s).groupBy("user_id", F.to_date("occurred_at").alias("date")).agg(
        F.sum("s").alias("t"), _sum(F.col("type").isin(*FOCUS) & (F.col("s") >= 600), F.col("s")).alias("f"), _sum(F.col("type") == "meeting", F.col("s")).alias("m"), F.count(F.when(F.col("type") == "meeting", 1)).alias("meeting_count"), _sum(F.hour("occurred_at") >= 22, F.col("s")).alias("l"), F.count_distinct("app").alias("skills_used"),
    )
    return x.select("user_id", "date", (F.col("t") / 3600).alias("total_hours"), (F.col("f") / 3600).alias("deep_work_hours"), F.least(F.lit(10.0), F.col("f") / F.greatest(F.col("t"), F.lit(1)) * 10).alias("focus_score"), (F.col("m") / 3600).alias("meeting_hours"), "meeting_count", (F.col("l") / 3600).alias("late_night_hours"), "skills_used")


# Hours in total that are a milestone.
CAREER_HOURS = (100, 250, 500, 1000, 2500, 5000)


def daily_insights(days: DataFrame, most: int = 5) -> DataFrame:
    """The insights of each user and day against all days before, the ``most`` with the highest priority, by title
    among equals.

    Focus 8 without history, or 7 and 1.3 times the mean; a run of days with focus 7 up to the day before, three or more;
    hours above the mean by 1.5 deviations with five days before; deep work of 3 h and 1.5 times the mean; three of the five
    days before above 10 h; two hours after 22; a milestone of hours in total; five applications; four hours of meetings; and
    none on a day of four hours.
    """
    w = Window.partitionBy("user_id").orderBy("date")
    past, five = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-5, -1)
    x = days.withColumns({
        "n": F.count(F.lit(1)).over(past), "mf": F.avg("focus_score").over(past), "mh": F.avg("total_hours").over(past), "md": F.avg("deep_work_hours").over(past), "sd": F.stddev_pop("total_hours").over(past),
        "long": F.coalesce(F.sum((F.col("total_hours") > 10).cast("int")).over(five), F.lit(0)), "career": F.sum("total_hours").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "last_low": F.max(F.when(F.col("focus_score") < 7, F.col("date"))).over(past), "place": F.row_number().over(w),
    })
    low = F.max(F.when(F.col("focus_score") < 7, F.col("place"))).over(past)
    x = x.withColumn("streak", F.col("place") - 1 - F.coalesce(low, F.lit(0)))
    focus, hours, deep = F.col("focus_score"), F.col("total_hours"), F.col("deep_work_hours")
    before = F.col("n") > 0
    one = lambda test, title, category, priority: F.when(test, F.struct((title if isinstance(title, Column) else F.lit(title)).alias("title"), F.lit(category).alias("category"), F.lit(priority).alias("priority")))
    rules = [
        one(~before & (focus >= 8), "Excellent focus today", "focus", 0.6),
        one(before & (focus > F.col("mf") * 1.3) & (focus >= 7), "Focus above average", "focus", 0.7),
        one(before & (F.col("streak") >= 3), F.concat(F.col("streak").cast("string"), F.lit("-day focus streak!")), "achievement", 0.85),
        one((F.col("n") >= 5) & (F.col("sd") > 0) & (hours > F.col("mh") + 1.5 * F.col("sd")), "Unusually long work day", "wellness", 0.8),
        one(before & (deep > F.col("md") * 1.5) & (deep >= 3), "Deep work breakthrough", "productivity", 0.7),
        one((F.col("n") >= 5) & (F.col("long") >= 3), "Extended work pattern detected", "wellness", 0.9),
        one(F.col("late_night_hours") > 2, "Late-night work detected", "wellness", 0.7),
        *[one((F.col("career") >= m) & (F.col("career") - hours < m), f"{m}h milestone reached!", "achievement", 0.9) for m in CAREER_HOURS],
        one(F.col("skills_used") >= 5, "Diverse skill day", "learning", 0.5),
        one(F.col("meeting_hours") > 4, "Meeting-heavy day", "collaboration", 0.6),
        one((F.col("meeting_count") == 0) & (hours > 4), "Uninterrupted focus day", "focus", 0.4),
    ]
    found = F.sort_array(F.transform(F.array_compact(F.array(*rules)), lambda r: F.struct((-r["priority"]).alias("p"), r["title"].alias("title"), r["category"].alias("category"))))
    return x.select("user_id", "date", F.explode(F.slice(found, 1, most)).alias("x")).select("user_id", "date", "x.title", "x.category", (-F.col("x.p")).alias("priority"))


def insight_stats(found: DataFrame) -> DataFrame:
    """Number and mean priority of the insights of each user and category."""
    return found.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("priority"), 4).alias("mean_priority"))


def weekly_insights(days: DataFrame) -> DataFrame:
    """Of each user and week the best day by focus, hours, and the change of mean focus against the week before."""
    w = days.groupBy("user_id", F.date_trunc("week", "date").cast("date").alias("week_start")).agg(F.sum("total_hours").alias("h"), F.avg("focus_score").alias("f"), F.max_by("date", F.struct("focus_score", -F.unix_date("date"))).alias("best_day"))
    before = F.lag("f").over(Window.partitionBy("user_id").orderBy("week_start"))
    return w.withColumn("b", before).select("user_id", "week_start", F.round("h", 4).alias("total_hours"), F.round("f", 4).alias("mean_focus"), F.col("best_day").cast("string").alias("best_day"), F.round(F.coalesce(F.col("f") - F.col("b"), F.lit(0.0)), 4).alias("focus_change"))


def skill_metrics(acts: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Of the last ``days`` days, each user's skills by application (by name, then in any case; others are their own skill
    of category Other): hours, mastery as share of all hours, last use and hours a day of a week."""
    x = acts.filter((F.col("occurred_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("app") != ""))
    names: dict[str, tuple[str, str]] = {}
    for app, skill, category in SKILL_APPS:
        names[app.lower()] = (skill, category)
    table = lambda k: F.create_map(*[F.lit(v) for a, t in names.items() for v in (a, t[k])])
    low = F.lower("app")
    g = x.groupBy("user_id", F.coalesce(F.element_at(table(0), low), F.col("app")).alias("skill"), F.coalesce(F.element_at(table(1), low), F.lit("Other")).alias("category")).agg((F.sum(_seconds()) / 3600).alias("hours"), F.max("occurred_at").alias("last"))
    total = F.sum("hours").over(Window.partitionBy("user_id"))
    return g.select("user_id", "skill", "category", F.round("hours", 4).alias("hours"), F.round(F.least(F.lit(100.0), F.col("hours") / F.when(total > 0, total).otherwise(1.0) * 100), 4).alias("mastery"), F.round(F.col("hours") / 7, 4).alias("growth_rate"), F.date_format("last", "yyyy-MM-dd").alias("last_used"))


def skill_summary(skills: DataFrame, most: int = 4) -> DataFrame:
    """Number of skills and of those above 70, diversity (categories of eight), velocity (a quarter of the skills), and
    for the categories by hours the first complement that the user lacks, ``most`` at most."""
    u = skills.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_skills"), F.count(F.when(F.col("mastery") > 70, 1)).alias("advanced_skills"), F.count_distinct("category").alias("k"), F.collect_set("skill").alias("own"))
    cats = skills.groupBy("user_id", "category").agg(F.sum("hours").alias("h"))
    ranked = cats.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("h")).alias("h"), "category"))), lambda c: c["category"]).alias("cats"))
    options = F.create_map(*[v for k, rows in SKILL_COMPLEMENTS.items() for v in (F.lit(k), F.array(*[F.lit(r[0]) for r in rows]))])
    x = u.join(ranked, "user_id")
    pick = F.transform("cats", lambda c: F.get(F.filter(F.coalesce(F.element_at(options, c), F.element_at(options, F.lit("Other"))), lambda s: ~F.array_contains("own", s)), 0))
    return x.select("user_id", "total_skills", "advanced_skills", F.round(F.least(F.lit(100.0), F.col("k") / 8 * 100), 4).alias("skill_diversity"), F.round(F.col("total_skills") / 4, 4).alias("learning_velocity"), F.array_join(F.slice(F.array_distinct(F.array_compact(pick)), 1, most), ", ").alias("recommended"))


def dashboard_kpis(acts: DataFrame) -> DataFrame:
    """Hours, deep work and meetings by category, switches between applications, and focus of 0 to 10: the deep share
    .5, few switches (40) .25 and few meetings (half the time) .25."""
    before = F.lag(F.coalesce("app", F.lit(""))).over(Window.partitionBy("user_id").orderBy("occurred_at", "id"))
    x = acts.withColumn("before", before).withColumn("s", _seconds()).withColumn("category", categorize_app(F.coalesce("app", F.lit(""))))
    u = x.groupBy("user_id").agg(F.sum("s").alias("t"), _sum((F.col("category") == "meetings") | (F.col("type") == "meeting"), F.col("s")).alias("m"), _sum((F.col("category") == "productive") & (F.col("type") != "meeting"), F.col("s")).alias("d"), F.count(F.when((F.col("before") != "") & (F.coalesce("app", F.lit("")) != F.col("before")), 1)).alias("context_switches"))
    t, m, d = F.col("t") / 3600, F.col("m") / 3600, F.col("d") / 3600
    focus = F.when(t > 0, (d / t * 0.5 + (1 - F.least(F.col("context_switches") / 40, F.lit(1.0))) * 0.25 + (1 - F.least(m / t / 0.5, F.lit(1.0))) * 0.25) * 10).otherwise(0.0)
    return u.select("user_id", F.round(F.least(focus, F.lit(10.0)), 4).alias("focus_score"), F.round(d, 4).alias("deep_work_hours"), F.round(t, 4).alias("total_hours"), "context_switches", F.round(m, 4).alias("meeting_hours"))


def quick_actions(kpis: DataFrame, burnout: DataFrame, goals: DataFrame) -> DataFrame:
    """What to do next from focus below 5, high burnout risk, overdue goals and no active goal."""
    x = kpis.join(burnout.select("user_id", "risk_level"), "user_id", "left").join(goals.select("user_id", "active", "overdue"), "user_id", "left")
    overdue, active = F.coalesce("overdue", F.lit(0)), F.coalesce("active", F.lit(0))
    found = F.array_compact(F.array(F.when(F.col("focus_score") < 5, "productivity"), F.when(F.col("risk_level").isin("high", "critical"), "wellness"), F.when(overdue > 0, F.concat(F.lit("overdue "), overdue.cast("string"))), F.when(active == 0, "set a goal")))
    return x.select("user_id", F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("on track").alias("actions"))


def expertise_distribution(hours: DataFrame) -> DataFrame:
    """Each user's skills by level: 20, 50, 100 and 200 hours."""
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    h = F.col("hours")
    return hours.groupBy("user_id").agg(n(h < 20, "beginner"), n((h >= 20) & (h < 50), "intermediate"), n((h >= 50) & (h < 100), "advanced"), n((h >= 100) & (h < 200), "expert"), n(h >= 200, "master"))


def weekly_digest(acts: DataFrame, balance: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each user and week: hours, productivity as the productive share, and highlights and suggestions from hours,
    goals and balance."""
    x = acts.withColumn("s", _seconds()).withColumn("category", categorize_app(F.coalesce("app", F.lit(""))))
    w = x.groupBy("user_id", F.date_trunc("week", "occurred_at").cast("date").alias("week_start")).agg((F.sum("s") / 3600).alias("h"), (_sum(F.col("category") == "productive", F.col("s")) / 3600).alias("p"))
    y = w.join(balance.select("user_id", "level"), "user_id", "left").join(goals.select("user_id", "active", "completed"), "user_id", "left")
    active, done, h = F.coalesce("active", F.lit(0)), F.coalesce("completed", F.lit(0)), F.col("h")
    high = F.array_compact(F.array(F.when(h > 0, "tracked"), F.when(done > 0, "goals completed"), F.when(F.col("level").isin("excellent", "good"), F.concat(F.lit("balance "), F.col("level")))))
    hints = F.array_compact(F.array(F.when(h > 45, "reduce hours").when((h < 20) & (h > 0), "low hours"), F.when(active == 0, "set a goal")))
    return y.select("user_id", "week_start", F.round(h, 4).alias("total_hours"), F.round(F.when(h > 0, F.least(F.col("p") / h * 100, F.lit(100.0))).otherwise(0.0), 4).alias("productivity_score"), F.when(F.size(high) > 0, F.array_join(high, ", ")).otherwise("no data").alias("highlights"), F.when(F.size(hints) > 0, F.array_join(hints, ", ")).otherwise("keep going").alias("suggestions"))


def recommend_tools(skills: DataFrame, used: DataFrame, most: int = 10) -> DataFrame:
    """Tools that go with a user's skills (``user_id, skill, hours``) and that the user lacks (``user_id, app``):
    relevance .7, .8 above five hours, .9 above ten; the ``most`` best, by name among equals."""
    table = F.create_map(*[v for k, ts in TOOL_SUGGESTIONS.items() for v in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])
    x = skills.select("user_id", "skill", "hours", F.explode(F.element_at(table, F.lower("skill"))).alias("tool"))
    own = used.select("user_id", F.lower("app").alias("low")).distinct()
    x = x.withColumn("low", F.lower("tool")).join(own, ["user_id", "low"], "left_anti")
    relevance = F.when(F.col("hours") > 10, 0.9).when(F.col("hours") > 5, 0.8).otherwise(0.7)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("relevance"), "skill", "tool"))
    return x.withColumn("relevance", relevance).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("user_id", "skill", "tool", "relevance", "rank")


def recommend_workflows(facts: DataFrame) -> DataFrame:
    """From ``avg_focus_score, context_switches, avg_session_min, morning_focus_score, deep_work_hours, total_hours`` of each
    user: pomodoro below focus 6, batching above 15 switches, time blocking for sessions below 25 minutes or less than .3 deep
    work, eat the frog where mornings have less than .8 of the mean focus."""
    f, c, s = F.col("avg_focus_score"), F.col("context_switches"), F.col("avg_session_min")
    one = lambda test, name, relevance: F.when(test, F.struct(F.lit(name).alias("name"), F.round(relevance, 2).alias("relevance")))
    rows = F.array_compact(F.array(
        one(f < 6, "Pomodoro Technique", F.least(F.lit(0.9), 1 - f / 10)), one(c > 15, "Task Batching", F.least(F.lit(0.85), c / 30)), one(s < 25, "Time Blocking", F.least(F.lit(0.8), 1 - s / 60)),
        one(F.col("morning_focus_score") < f * 0.8, "Eat the Frog", F.lit(0.65)), one((F.col("total_hours") > 0) & (F.col("deep_work_hours") / F.col("total_hours") < 0.3) & ~(s < 25), "Time Blocking", F.lit(0.75)),
    ))
    return facts.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.name", "x.relevance")


def recommend_time_management(facts: DataFrame) -> DataFrame:
    """From ``total_hours, meeting_hours, break_count, longest_session_min, peak_hours`` (text) of each user: breaks where
    there is none in more than four hours, splits of sessions above 120 minutes, peak hours, and meetings above four hours."""
    t, m = F.col("total_hours"), F.col("meeting_hours")
    one = lambda test, name, relevance: F.when(test, F.struct(F.lit(name).alias("title"), F.round(relevance, 2).alias("relevance")))
    rows = F.array_compact(F.array(one((F.col("break_count") == 0) & (t > 4), "Take regular breaks", F.lit(0.9)), one(F.col("longest_session_min") > 120, "Break up long sessions", F.lit(0.8)), one(F.col("peak_hours") != "", "Leverage your peak hours", F.lit(0.65)), one((m > 4) & (t > 0), "Optimize meeting time", F.least(F.lit(0.85), m / t))))
    return facts.select("user_id", F.explode(rows).alias("x")).select("user_id", "x.title", "x.relevance")


def recommend_collaborators(skills: DataFrame, met: DataFrame, most: int = 10) -> DataFrame:
    """For each user the others whose skills add to (.7 of theirs) or are shared with (.3 of the user's) its own,
    without those met (``user_id, other``): the ``most`` best, by identifier among equals.

    Users that share no skill score by the sizes alone, so users with equal sets of skills are one profile: profiles meet,
    not users. Their number is checked for the broadcast. Of each profile in order of relevance a user meets only as many
    members as it may need, so no user meets all others.
    """
    own = skills.select("user_id", "skill").distinct().groupBy("user_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    profiles = own.select("skills").distinct()
    a, b = profiles.withColumnRenamed("skills", "mine"), profiles.withColumnRenamed("skills", "theirs")
    score = F.size(F.array_except("theirs", "mine")) / F.size("theirs") * 0.7 + F.size(F.array_intersect("theirs", "mine")) / F.size("mine") * 0.3
    met = met.select("user_id", "other").distinct()
    sizes = own.groupBy("skills").agg(F.count(F.lit(1)).alias("n"))
    pairs = a.crossJoin(bounded(b)).withColumn("relevance", F.least(F.lit(1.0), score)).join(sizes.withColumnRenamed("skills", "theirs"), "theirs")
    # a user needs as many members of better profiles as it has places, people met, and itself
    up_to = Window.partitionBy("mine").orderBy(F.desc("relevance")).rangeBetween(Window.unboundedPreceding, 0)
    better = F.sum("n").over(up_to) - F.sum("n").over(Window.partitionBy("mine", "relevance"))
    pairs = pairs.withColumn("better", better)
    needs = own.join(met.groupBy("user_id").agg(F.count(F.lit(1)).alias("known")), "user_id", "left").select("user_id", F.col("skills").alias("mine"), (F.coalesce("known", F.lit(0)) + most + 1).alias("needs"))
    members = own.withColumn("r", F.row_number().over(Window.partitionBy("skills").orderBy("user_id")))
    # each place is looked up, so that a user meets no member beyond those it needs
    x = needs.join(pairs, "mine").filter(F.col("better") < F.col("needs")).withColumn("r", F.explode(F.sequence(F.lit(1).cast("long"), F.least("needs", "n"))))
    x = x.join(members.select(F.col("user_id").alias("other"), F.col("skills").alias("theirs"), F.col("r").cast("long").alias("r")), ["theirs", "r"]).filter(F.col("user_id") != F.col("other"))
    x = x.join(met, ["user_id", "other"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("relevance"), "other"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("user_id", "other", F.round("relevance", 4).alias("relevance"), "rank")


def recommend_learning(skills: DataFrame, goals: list[str], trending: list[str], most: int = 10) -> DataFrame:
    """From ``user_id, skill, score`` (0 to 100): goals that a user lacks (.95) or has below 50 (.85), trends that it lacks
    (.7), and skills below 30 (.4 and more the lower); each skill once, the ``most`` best. Two digits are rounded as the binary
    number has them: 57.499... hundredths are .57, though it is written .575."""
    u = skills.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("skill").alias("k"), F.col("score").alias("v")))).alias("own"))
    pick = lambda names, rule: F.filter(F.transform(F.lit(names) if names else F.array().cast("array<string>"), rule), lambda r: r["relevance"].isNotNull())
    row = lambda skill, relevance, order: F.struct(F.lower(skill).alias("skill"), relevance.alias("relevance"), F.lit(order).alias("source"))
    has = lambda s: F.map_contains_key("own", F.lower(s))
    found = F.concat(
        pick(goals, lambda s: row(s, F.when(~has(s), 0.95).when(F.element_at("own", F.lower(s)) < 50, 0.85), "goal")),
        pick(trending, lambda s: row(s, F.when(~has(s), 0.7), "trend")),
        F.filter(F.transform(F.map_entries("own"), lambda e: row(e["key"], F.when(e["value"] < 30, F.round((0.4 + (30 - e["value"]) / 100) * 100) / 100), "weak")), lambda r: r["relevance"].isNotNull()),
    )
    x = u.select("user_id", F.posexplode(found).alias("pos", "x")).select("user_id", "pos", "x.*")
    first = F.row_number().over(Window.partitionBy("user_id", "skill").orderBy("pos"))
    x = x.withColumn("k", first).filter("k = 1")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("relevance"), "skill"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).select("user_id", "skill", "relevance", "source", "rank")


def productivity_by_score(acts: DataFrame, k: int = 5) -> DataFrame:
    """Hours of rows with a score above .6, from .3 to .6, and below; the productive share, top applications, and the
    different participants and hours of meetings. A row's score is (1 + its category's weight) / 2."""
    score = (1 + category_weight(categorize_app(F.coalesce("app", F.lit(""))))) / 2
    x = acts.withColumn("s", _seconds()).withColumn("score", score)
    u = x.groupBy("user_id").agg(F.sum("s").alias("t"), _sum(F.col("score") > 0.6, F.col("s")).alias("p"), _sum(F.col("score").between(0.3, 0.6), F.col("s")).alias("n"))
    apps = x.groupBy("user_id", F.coalesce("app", F.lit("")).alias("key")).agg(F.sum("s").alias("seconds"))
    people = x.filter("type = 'meeting'").select("user_id", "s", F.from_json("data", "participants array<string>")["participants"].alias("ps"))
    met = people.groupBy("user_id").agg(F.count(F.lit(1)).alias("meetings_count"), (F.sum("s") / 3600).alias("mh")).join(people.select("user_id", F.explode("ps").alias("p")).groupBy("user_id").agg(F.count_distinct("p").alias("total_collaborators")), "user_id", "left")
    y = u.join(_top(apps, ["user_id"], k), "user_id").join(met, "user_id", "left")
    return y.select(
        "user_id", F.round(F.col("t") / 3600, 4).alias("total_hours"), F.round(F.col("p") / 3600, 4).alias("productive_hours"), F.round(F.col("n") / 3600, 4).alias("neutral_hours"), F.round((F.col("t") - F.col("p") - F.col("n")) / 3600, 4).alias("unproductive_hours"),
        F.round(F.col("p") / 3600 / F.greatest(F.col("t") / 3600, F.lit(0.01)) * 100, 4).alias("productivity_score"), F.col("top").alias("top_applications"), F.coalesce("meetings_count", F.lit(0)).alias("meetings_count"), F.coalesce("total_collaborators", F.lit(0)).alias("total_collaborators"), F.round(F.coalesce("mh", F.lit(0.0)), 4).alias("meeting_hours"),
    )


def decay_health(decay: DataFrame) -> DataFrame:
    """Of each user, number, mean freshness, counts by status, and health: healthy from .6, needs_attention from .3."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    x = decay.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("freshness"), 4).alias("average_freshness"), n("fresh"), n("fading"), n("stale"), n("forgotten"))
    a = F.col("average_freshness")
    return x.withColumn("overall_health", F.when(a >= 0.6, "healthy").when(a >= 0.3, "needs_attention").otherwise("deteriorating"))


def decay_at_risk(decay: DataFrame, threshold: float = 0.4, most: int = 10) -> DataFrame:
    """Entities with freshness below ``threshold``; the ``most`` least fresh of each user get a suggestion."""
    x = decay.filter(F.col("freshness") < threshold)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("freshness", "id"))
    return x.withColumn("r", rank).select("id", "user_id", "freshness", F.when(F.col("freshness") < 0.15, "high").otherwise("medium").alias("urgency"), F.when(F.col("r") <= most, F.concat(F.lit("Revisit after "), F.col("days_since").cast("string"), F.lit(" days"))).alias("suggestion"))
