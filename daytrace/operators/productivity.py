"""Daily, weekly and period productivity: type-based scores of 0 to 100 and category-based scores of 0 to 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import COMM_APPS, COMM_DOMAINS, COMM_WORDS, MEETING_DOMAINS, PRODUCTIVE_TYPES, contains_any
from ..functions.scalars import activity_key, capped, categorize_app

BY_TIME = ["occurred_at", "id"]


def _prepared(acts: DataFrame) -> DataFrame:
    """Activities with day, capped seconds, key, and whether the key differs from the user's one before on that day."""
    day = acts.withColumn("day", F.to_date("occurred_at")).withColumn("secs", capped(F.col("duration_seconds"))).withColumn("key", activity_key(F.col("app"), F.col("domain"), F.col("type")))
    before = F.lag("key").over(Window.partitionBy("user_id", "day").orderBy(*BY_TIME))
    return day.withColumn("switched", F.coalesce((F.col("key") != before).cast("int"), F.lit(0)))


def _sum_if(test: Column, value: Column | str = "secs") -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(value) if isinstance(value, str) else value)), F.lit(0))


def _percent(part: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), part / F.greatest(total, F.lit(1)) * 100)


def daily_productivity(acts: DataFrame, deep_seconds: int = 300, focus_seconds: int = 120) -> DataFrame:
    """One row per user and day with data.

    Web visits are added up by domain before the thresholds, as many short visits are one stay; other productive rows
    count one by one. Two aggregations on the keys (user, day): one by domain of web visits, one over both.
    """
    rows = _prepared(acts)
    web = F.col("type") == "web_visit"
    productive = F.col("type").isin(PRODUCTIVE_TYPES)
    meeting = (F.col("type") == "meeting") | F.coalesce(F.col("domain").rlike(contains_any(MEETING_DOMAINS)), F.lit(False))
    unit = F.when(web, F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("unknown"))).otherwise(F.lit(""))
    one = productive & ~web
    parts = rows.groupBy("user_id", "day", unit.alias("unit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("secs").alias("secs"), _sum_if(productive).alias("productive"), _sum_if(meeting).alias("meeting"), F.sum("switched").alias("switched"),
        _sum_if(one & (F.col("secs") >= deep_seconds)).alias("deep"), F.count(F.when(one & (F.col("secs") >= deep_seconds), 1)).alias("deep_n"), _sum_if(one & (F.col("secs") >= focus_seconds)).alias("focused"),
    )
    site = F.col("unit") != ""
    deep, deep_n = F.when(site & (F.col("secs") >= deep_seconds), F.col("secs")), F.when(site & (F.col("secs") >= deep_seconds), 1)
    focused = F.when(site & (F.col("secs") >= focus_seconds), F.col("secs"))
    day = parts.groupBy("user_id", "day").agg(
        F.sum("n").alias("activity_count"), F.least(F.sum("secs"), F.lit(86400)).alias("total_seconds"), F.sum("productive").alias("productive"), F.sum("meeting").alias("meeting"), F.sum("switched").alias("context_switches"),
        F.sum(F.col("deep") + F.coalesce(deep, F.lit(0))).alias("deep"), F.sum(F.col("deep_n") + F.coalesce(deep_n, F.lit(0))).alias("deep_work_sessions"), F.sum(F.col("focused") + F.coalesce(focused, F.lit(0))).alias("focused"),
    )
    total = F.col("total_seconds")
    return day.select(
        "user_id", F.col("day").alias("date"), "activity_count", "total_seconds", F.round(_percent(F.col("focused"), total), 9).alias("focus_score"), F.round(_percent(F.col("productive"), total), 9).alias("productivity_score"),
        "deep_work_sessions", F.round(F.col("deep") / 3600, 9).alias("deep_work_hours"), F.round(F.col("meeting") / 3600, 9).alias("meeting_load_hours"), "context_switches",
    )


def daily_range(acts: DataFrame, as_of: Column, days: int = 30, deep_seconds: int = 300) -> DataFrame:
    """The ``days`` days up to ``as_of`` for each user, days without data as zeros; deep work row by row, web included."""
    rows = _prepared(acts).filter((F.col("day") > F.date_sub(F.to_date(as_of), days)) & (F.col("day") <= F.to_date(as_of)))
    deep = F.col("type").isin(PRODUCTIVE_TYPES) & (F.col("secs") >= deep_seconds)
    got = rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("activity_count"), F.least(F.sum("secs"), F.lit(86400)).alias("total_seconds"), F.count(F.when(deep, 1)).alias("deep_work_sessions"), F.round(_sum_if(deep) / 3600, 4).alias("deep_work_hours"), F.sum("switched").alias("context_switches"))
    calendar = acts.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(F.to_date(as_of), days - 1), F.to_date(as_of))))
    return calendar.join(got, ["user_id", "day"], "left").fillna(0).withColumnRenamed("day", "date")


def weekly_productivity(acts: DataFrame) -> DataFrame:
    """Weeks from Monday; averages over days with data, sums over all."""
    week = daily_productivity(acts).groupBy("user_id", F.date_trunc("week", "date").cast("date").alias("week_start"))
    return week.agg(F.round(F.avg("focus_score"), 4).alias("avg_focus_score"), F.round(F.avg("productivity_score"), 4).alias("avg_productivity_score"), F.round(F.sum("deep_work_hours"), 4).alias("total_deep_work_hours"), F.round(F.sum("meeting_load_hours"), 4).alias("total_meeting_hours"), F.sum("activity_count").alias("total_activities"))


def period_productivity(acts: DataFrame, as_of: Column, days: int = 7, deep_seconds: int = 300) -> DataFrame:
    """Figures of the ``days`` days before ``as_of`` and their change against as many days before, in one pass."""
    stop, start = as_of, as_of - F.expr(f"INTERVAL '{days}' DAY")
    rows = acts.filter((F.col("occurred_at") >= start - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("occurred_at") < stop))
    rows = rows.withColumn("now", F.col("occurred_at") >= start).withColumn("secs", capped(F.col("duration_seconds"))).withColumn("key", activity_key(F.col("app"), F.col("domain"), F.col("type")))
    before = F.lag("key").over(Window.partitionBy("user_id", "now").orderBy(*BY_TIME))
    rows = rows.withColumn("switched", F.coalesce((F.col("key") != before).cast("int"), F.lit(0)))
    productive = F.col("type").isin(PRODUCTIVE_TYPES)
    figures = {}
    for name, own in (("now", F.col("now")), ("prev", ~F.col("now"))):
        total = F.least(_sum_if(own), F.lit(86400 * days))
        deep = _sum_if(own & productive & (F.col("secs") >= deep_seconds))
        figures |= {f"{name}_n": F.count(F.when(own, 1)), f"{name}_total": total / 3600, f"{name}_productive": _sum_if(own & productive) / 3600, f"{name}_deep": deep / 3600, f"{name}_focus": _percent(deep, total), f"{name}_switches": _sum_if(own, "switched")}
    x = rows.groupBy("user_id").agg(*[c.alias(n) for n, c in figures.items()]).filter("now_n > 0")
    change = lambda a: F.when(F.col("prev_n") > 0, F.round(F.col(f"now_{a}") - F.col(f"prev_{a}"), 4))
    return x.select("user_id", F.round("now_total", 4).alias("total_hours"), F.round("now_productive", 4).alias("productive_hours"), F.round(F.col("now_productive") / F.greatest(F.col("now_total"), F.lit(0.01)), 4).alias("productivity_ratio"), F.round("now_deep", 4).alias("deep_work_hours"), F.round("now_focus", 4).alias("focus_score"), F.col("now_switches").alias("context_switches"), change("total").alias("total_hours_change"), change("deep").alias("deep_work_hours_change"), change("focus").alias("focus_score_change"), F.when(F.col("prev_n") > 0, F.col("now_switches") - F.col("prev_switches")).alias("context_switches_change"))


def collaboration(acts: DataFrame) -> DataFrame:
    """Meetings, communication volume, people met and a score of 0 to 100, for each user."""
    names = F.from_json("data", "participants array<string>, organizer string")
    rows = acts.withColumn("d", names)
    meeting = F.col("type") == "meeting"
    comm = F.coalesce(F.col("app").isin(COMM_APPS), F.lit(False)) | F.coalesce(F.col("domain").rlike(contains_any(COMM_DOMAINS)), F.lit(False)) | meeting | F.coalesce(F.lower("app").rlike(contains_any(COMM_WORDS)), F.lit(False))
    totals = rows.groupBy("user_id").agg(F.count(F.when(meeting, 1)).alias("meetings_count"), F.count(F.when(comm, 1)).alias("communication_volume"), F.count_distinct(F.when(comm, F.col("app"))).alias("apps"), F.round(_sum_if(meeting, "duration_seconds") / 3600, 4).alias("meeting_hours"))
    people = rows.filter(meeting).select("user_id", F.explode(F.array_distinct(F.concat(F.coalesce("d.participants", F.array()), F.array("d.organizer")))).alias("name")).filter("name <> ''")
    met = people.groupBy("user_id").agg(F.count_distinct("name").alias("unique_collaborators"))
    out = totals.join(met, "user_id", "left").fillna(0, ["unique_collaborators"])
    n = F.col("communication_volume")
    score = F.when(n > 0, F.least(F.lit(100.0), F.greatest(F.lit(10.0), n * 4.0))).otherwise(0.0)
    return out.select("user_id", score.alias("collaboration_score"), "meetings_count", "communication_volume", "unique_collaborators", F.greatest("apps", "unique_collaborators", "meetings_count").alias("network_size"), "meeting_hours")


def top_keys(acts: DataFrame, k: int = 10, group: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """the ``k`` keys with most seconds in each group; equal sums in order of the key."""
    sums = acts.groupBy(*group, activity_key(F.col("app"), F.col("domain"), F.col("type")).alias("key")).agg(F.sum(capped(F.col("duration_seconds"))).alias("seconds"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("seconds"), "key"))
    return sums.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def category_day_metrics(acts: DataFrame) -> DataFrame:
    """Meeting load and distraction index by user and day, from application categories."""
    c, secs = categorize_app(F.coalesce("app", F.lit(""))), F.coalesce("duration_seconds", F.lit(0))
    rows = acts.select("user_id", F.to_date("occurred_at").alias("date"), c.alias("c"), secs.alias("s"))
    of = lambda *names: _sum_if(F.col("c").isin(*names), "s")
    x = rows.groupBy("user_id", "date").agg(F.sum("s").alias("total"), of("meetings").alias("meetings"), of("productive", "neutral").alias("focus"), of("distractive").alias("distractive"))
    load = F.when(F.col("total") > 0, F.col("meetings") / F.col("total") * 100).otherwise(0.0)
    index = F.when(F.col("focus") > 0, F.least(F.lit(100.0), F.col("distractive") / F.col("focus") * 100)).otherwise(F.when(F.col("distractive") > 0, 100.0).otherwise(0.0))
    return x.select("user_id", "date", F.round(F.col("total") / 3600, 9).alias("total_hours"), F.round(load, 9).alias("meeting_load_pct"), F.round(index, 9).alias("distraction_index"))


def focus_score_10(deep: Column, total: Column, switches: Column, meetings: Column, breaks: Column) -> Column:
    """0 to 10 from deep work share, context switches, meeting load and break quality."""
    share = F.when(total > 0, F.least(deep / total, F.lit(1.0))).otherwise(0.0)
    calm = F.greatest(F.lit(0.0), 1 - switches / 40)
    free = F.greatest(F.lit(0.0), 1 - meetings / 60)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), 10 * (0.5 * share + 0.2 * calm + 0.15 * free + 0.15 * breaks / 10)))


def weekly_aggregate(daily: DataFrame) -> DataFrame:
    """Averages that leave out zeros, sums, and the best and worst day (the earlier of equal ones), by user and week."""
    some = lambda c: F.round(F.avg(F.when(F.col(c) != 0, F.col(c))), 4)
    rank = lambda order: F.row_number().over(Window.partitionBy("user_id", "week_start").orderBy(order, "date"))
    rows = daily.withColumn("week_start", F.date_trunc("week", "date").cast("date")).withColumn("best", rank(F.desc("focus_score"))).withColumn("worst", rank(F.asc("focus_score")))
    return rows.groupBy("user_id", "week_start").agg(some("focus_score").alias("avg_focus_score"), some("meeting_load_pct").alias("avg_meeting_load_pct"), some("distraction_index").alias("avg_distraction_index"), some("break_quality").alias("avg_break_quality"), F.round(F.sum("deep_work_hours"), 4).alias("total_deep_work_hours"), F.sum("context_switches").alias("total_context_switches"), F.max(F.when(F.col("best") == 1, F.col("date"))).alias("best_day"), F.max(F.when(F.col("worst") == 1, F.col("date"))).alias("worst_day"))


def time_allocation(acts: DataFrame, k: int = 20) -> DataFrame:
    """Hours and share of each application category by user, and the ``k`` largest titles."""
    rows = acts.select("user_id", F.coalesce("title", F.lit("untitled")).alias("project"), F.coalesce("duration_seconds", F.lit(0)).alias("s"))
    sums = rows.groupBy("user_id", "project").agg(F.sum("s").alias("s"))
    share = F.round(F.col("s") / F.nullif(F.sum("s").over(Window.partitionBy("user_id")), F.lit(0)) * 100, 4)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "project"))
    return sums.select("user_id", "project", F.round(F.col("s") / 3600, 4).alias("hours"), share.alias("percent"), rank.cast("long").alias("rank")).filter(F.col("rank") <= k)


def comparative(daily: DataFrame) -> DataFrame:
    """Each week's metrics against the mean of the weeks before: change in percent and direction, with a dead band of
    3 % and lower being better for switches, meetings and distraction."""
    week = daily.groupBy("user_id", F.date_trunc("week", "date").cast("date").alias("week_start")).agg(*[F.avg(c).alias(c) for c in ("focus_score", "deep_work_hours", "break_quality", "context_switches", "meeting_load_pct", "distraction_index")])
    long = week.unpivot(["user_id", "week_start"], ["focus_score", "deep_work_hours", "break_quality", "context_switches", "meeting_load_pct", "distraction_index"], "metric", "value")
    w = Window.partitionBy("user_id", "metric").orderBy("week_start")
    base = F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("baseline", base).filter("baseline is not null")
    pct = F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.abs("baseline") * 100).otherwise(0.0)
    sign = F.when(F.col("metric").isin("context_switches", "meeting_load_pct", "distraction_index"), -1).otherwise(1)
    good = F.col("pct") * sign
    return long.withColumn("pct", pct).select("user_id", "week_start", "metric", F.round("value", 6).alias("value"), F.round("baseline", 6).alias("baseline"), (F.round("pct", 6) + 0.0).alias("change_pct"), F.when(good > 3, "improving").when(good < -3, "declining").otherwise("stable").alias("direction"))


def meeting_summary(acts: DataFrame, working_hours: float = 8.0) -> DataFrame:
    """Meetings by user and platform, the load of the days' working hours, and its label."""
    rows = acts.filter("type = 'meeting'").withColumn("platform", F.coalesce(F.get_json_object("data", "$.platform"), F.lit("unknown"))).withColumn("s", F.coalesce("duration_seconds", F.lit(0)))
    days = F.count_distinct(F.to_date("occurred_at"))
    x = rows.groupBy("user_id", "platform").agg(F.count(F.lit(1)).alias("meetings"), F.sum("s").alias("total_seconds"), F.round(F.avg("s"), 4).alias("avg_seconds"), F.min("s").cast("long").alias("min_seconds"), F.max("s").cast("long").alias("max_seconds"), days.alias("days"))
    load = F.col("total_seconds") / (F.col("days") * working_hours * 3600) * 100
    return x.withColumn("load_pct", F.round(load, 4)).withColumn("load", F.when(load < 15, "light").when(load < 30, "moderate").when(load < 50, "heavy").otherwise("overloaded"))


def social_summary(acts: DataFrame, domains: list[str]) -> DataFrame:
    """Time on the given domains by user and domain, with the share of the user's total."""
    rows = acts.filter(F.col("domain").isin(domains)).withColumn("s", F.coalesce("duration_seconds", F.lit(0)))
    x = rows.groupBy("user_id", "domain").agg(F.count(F.lit(1)).alias("visits"), F.sum("s").alias("seconds"), F.count_distinct(F.to_date("occurred_at")).alias("days"))
    return x.withColumn("percent", F.round(F.col("seconds") / F.nullif(F.sum("seconds").over(Window.partitionBy("user_id")), F.lit(0)) * 100, 4))


def hourly_histogram(acts: DataFrame) -> DataFrame:
    """Seconds and activities in each of the 24 hours of the day for each user, empty hours as zeros."""
    got = acts.groupBy("user_id", F.hour("occurred_at").alias("hour")).agg(F.count(F.lit(1)).alias("activities"), F.sum(capped(F.col("duration_seconds"))).alias("seconds"))
    grid = acts.select("user_id").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(got, ["user_id", "hour"], "left").fillna(0).withColumn("hour", F.col("hour").cast("long"))


def temporal_patterns(acts: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    """Recurring (weekday, hour) slots: those with at least ``least`` activities, the ``k`` largest for each user."""
    x = acts.groupBy("user_id", F.weekday("occurred_at").cast("long").alias("weekday"), F.hour("occurred_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "weekday", "hour"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def daily_scores(acts: DataFrame) -> DataFrame:
    """A score of 0 to 100 for each user's active day from the number of activities and the hours."""
    x = acts.groupBy("user_id", F.to_date("occurred_at").alias("date")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.coalesce("duration_seconds", F.lit(0))) / 3600).alias("hours"))
    score = F.least(F.col("n") / 200, F.lit(1.0)) * 50 + F.least(F.col("hours") / 8, F.lit(1.0)) * 50
    return x.select("user_id", "date", F.col("n").alias("activities"), F.round("hours", 9).alias("hours"), score.alias("score"))


def forecast(daily: DataFrame, horizon: int = 14, least_days: int = 7) -> DataFrame:
    """The next ``horizon`` days of each user: 0.4 trend (least squares over active days), 0.4 mean of the weekday,
    0.2 mean of the last 14 days; confidence falls by 0.04 a day to 0.3 at least. Users with fewer active days have none."""
    w = Window.partitionBy("user_id").orderBy("date")
    rows = daily.withColumn("x", F.row_number().over(w)).withColumn("back", F.row_number().over(w.orderBy(F.desc("date"))))
    fit = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("score", "x").alias("slope"), F.regr_intercept("score", "x").alias("base"), F.avg(F.when(F.col("back") <= 14, F.col("score"))).alias("recent"), F.avg("score").alias("mean"), F.max("date").alias("last")).filter(F.col("n") >= least_days)
    by_day = rows.groupBy("user_id", F.weekday("date").alias("weekday")).agg(F.avg("score").alias("usual"))
    ahead = fit.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add("last", F.col("i"))).withColumn("weekday", F.weekday("date"))
    x = ahead.join(by_day, ["user_id", "weekday"], "left")
    value = 0.4 * (F.col("base") + F.col("slope") * (F.col("n") + F.col("i"))) + 0.4 * F.coalesce("usual", "mean") + 0.2 * F.col("recent")
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))
    trend = F.when(F.col("slope") > 0.3, "improving").when(F.col("slope") < -0.3, "declining").otherwise("stable")
    return x.select("user_id", "date", F.round(bounded, 4).alias("predicted_score"), F.round(F.greatest(F.lit(0.3), 1 - 0.04 * F.col("i")), 4).alias("confidence"), trend.alias("trend"))


def knowledge_decay(facts: DataFrame, as_of: Column) -> DataFrame:
    """Freshness exp(-rate * days since last seen); each repetition lowers the rate, to 0.005 at least. Status: fresh
    from .7, fading from .4, stale from .15, else forgotten."""
    n, days = F.greatest(F.col("occurrence_count"), F.lit(1)), F.greatest(F.datediff(F.to_date(as_of), F.col("last_seen")), F.lit(0))
    raw = 0.015 / (1 + 0.1 * (n - 1))
    strength = F.exp(-F.greatest(F.lit(0.005), raw) * days)
    status = F.when(F.col("freshness") >= 0.7, "fresh").when(F.col("freshness") >= 0.4, "fading").when(F.col("freshness") >= 0.15, "stale").otherwise("forgotten")
    return facts.select("id", "user_id", "entity_type", strength.alias("freshness"), F.round(raw, 6).alias("decay_rate"), days.cast("long").alias("days_since")).withColumn("status", status).withColumn("freshness", F.round("freshness", 6))
