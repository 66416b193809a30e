"""Wellness, skills, goals, entity and platform figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded

# Mastery levels by hours, milestones by metric, and roles with their skills.
LEVELS = [(0, "beginner"), (20, "intermediate"), (50, "advanced"), (100, "expert"), (200, "master")]
MILESTONES = {"activity_count": [100, 500, 1000], "entity_count": [10, 25, 50, 100], "hours_tracked": [100, 500, 1000], "focus_streak": [3, 7, 14], "unique_apps": [5, 10]}


def hours_of_skills(acts: DataFrame, skills: DataFrame) -> DataFrame:
    """``user_id, skill, category, hours``, not rounded: hours of each skill by user; see ``skill_hours``."""
    x = acts.filter("app is not null").join(skills, "app", "left")
    return x.groupBy("user_id", F.coalesce("skill", "app").alias("skill"), F.coalesce("skill_category", F.lit("Other")).alias("category")).agg((F.sum(F.coalesce("duration_seconds", F.lit(0))) / 3600).alias("hours"))


def skill_hours(acts: DataFrame, skills: DataFrame) -> DataFrame:
    """D9, D30, C11g: hours of each skill by user, its share, mastery level and progress to the next level.

    ``skills``: ``app, skill, skill_category``, a small dimension; an application that it doesn't have is its own skill.
    """
    h = hours_of_skills(acts, skills)
    level, progress = F.lit("beginner"), F.lit(0.0)
    for k, (least, name) in enumerate(LEVELS):
        upper = LEVELS[k + 1][0] if k + 1 < len(LEVELS) else None
        level = F.when(F.col("hours") >= least, name).otherwise(level)
        progress = F.when(F.col("hours") >= least, (F.col("hours") - least) / (upper - least) * 100 if upper else F.lit(100.0)).otherwise(progress)
    share = F.col("hours") / F.nullif(F.sum("hours").over(Window.partitionBy("user_id")), F.lit(0.0))
    return h.select("user_id", "skill", "category", F.round("hours", 6).alias("hours"), F.round(share, 6).alias("share"), level.alias("level"), F.round(progress, 4).alias("progress"))


def skill_growth(acts: DataFrame, as_of: Column, weeks: int = 4) -> DataFrame:
    """Hours of the last seven days of each application against the mean of the ``weeks`` weeks before; trend at 10 %."""
    back = F.datediff(F.to_date(as_of), F.to_date("occurred_at"))
    x = acts.filter("app is not null").withColumn("back", back).filter(F.col("back") < 7 * (weeks + 1))
    hours = F.coalesce("duration_seconds", F.lit(0)) / 3600
    g = x.groupBy("user_id", "app").agg(F.coalesce(F.sum(F.when(F.col("back") < 7, hours)), F.lit(0.0)).alias("now"), (F.coalesce(F.sum(F.when(F.col("back") >= 7, hours)), F.lit(0.0)) / weeks).alias("before"))
    pct = F.when(F.col("before") > 0, (F.col("now") - F.col("before")) / F.col("before") * 100).when(F.col("now") > 0, 100.0).otherwise(0.0)
    return g.select("user_id", "app", F.round("now", 6).alias("hours_now"), F.round("before", 6).alias("hours_before"), F.round(pct, 4).alias("growth_pct"), F.when(pct > 10, "increasing").when(pct < -10, "decreasing").otherwise("stable").alias("trend"))


def category_entropy(skills: DataFrame) -> DataFrame:
    """Shannon entropy of each user's hours over categories, against its most."""
    c = skills.groupBy("user_id", "category").agg(F.sum("hours").alias("h")).filter("h > 0")
    p = F.col("h") / F.sum("h").over(Window.partitionBy("user_id"))
    x = c.withColumn("p", p).groupBy("user_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.count(F.lit(1)).alias("categories"))
    return x.select("user_id", "categories", F.round("entropy", 6).alias("entropy"), F.round(F.when(F.col("categories") > 1, F.col("entropy") / F.log2("categories")).otherwise(0.0), 6).alias("evenness"))


def milestones(acts: DataFrame, entities: DataFrame, streaks: DataFrame) -> DataFrame:
    """Each user's rows, entities, hours, run of days of focus (``user_id, streak``) and applications against the
    thresholds: reached or not, and progress in percent."""
    x = acts.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("activity_count"), (F.sum(F.coalesce("duration_seconds", F.lit(0))) / 3600).alias("hours_tracked"), F.count_distinct("app").cast("double").alias("unique_apps"))
    x = x.join(entities.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("entity_count")), "user_id", "left").join(streaks.select("user_id", F.col("streak").cast("double").alias("focus_streak")), "user_id", "left").fillna(0.0)
    long = x.unpivot("user_id", list(MILESTONES), "metric", "value")
    steps = F.create_map(*[v for k, ts in MILESTONES.items() for v in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])
    y = long.withColumn("threshold", F.explode(F.element_at(steps, F.col("metric"))))
    return y.select("user_id", "metric", F.col("threshold").cast("long").alias("threshold"), (F.col("value") >= F.col("threshold")).alias("reached"), F.round(F.least(F.lit(100.0), F.col("value") / F.col("threshold") * 100), 6).alias("progress"))


def goal_stats(goals: DataFrame) -> DataFrame:
    """Counts by status, completion rate and mean progress of each user's goals."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    progress = F.least(F.lit(100.0), F.col("current_value") / F.nullif(F.col("target_value"), F.lit(0.0)) * 100)
    return goals.groupBy("user_id").agg(F.count(F.lit(1)).alias("goals"), n("completed").alias("completed"), n("active").alias("active"), n("paused").alias("paused"), F.round(n("completed") / F.count(F.lit(1)) * 100, 4).alias("completion_rate"), F.round(F.avg(progress), 4).alias("mean_progress"))


def deadlines(goals: DataFrame, as_of: Column) -> DataFrame:
    """Active goals by days to the deadline: overdue, critical (3), soon (7), upcoming (30) or later."""
    days = F.datediff("deadline", F.to_date(as_of))
    urgency = F.when(days < 0, "overdue").when(days <= 3, "critical").when(days <= 7, "soon").when(days <= 30, "upcoming").otherwise("later")
    return goals.filter("status = 'active'").select("id", "user_id", days.cast("long").alias("days_left"), urgency.alias("urgency"))


def goal_milestones(goals: DataFrame) -> DataFrame:
    """Quarters of the target that each goal has passed."""
    pct = F.col("current_value") / F.nullif(F.col("target_value"), F.lit(0.0)) * 100
    return goals.select("id", F.explode(F.array(*[F.lit(t) for t in (25, 50, 75, 100)])).alias("threshold"), pct.alias("pct")).filter("pct >= threshold").select("id", F.col("threshold").cast("long").alias("threshold"))


def latency_histogram(samples: DataFrame, value: str, keys: list[str], bounds: list[float], cells: int = 4096) -> DataFrame:
    """Cumulative counts by upper bound, sum, mean and exact percentiles (the value at int(n * q)) of each group.

    Values are first counted in ``cells`` of equal width between a group's least and largest; only the cells that hold a
    percentile are looked into, by counts of their different values, so no task sorts a whole group.
    """
    buckets = [F.count(F.when(F.col(value) <= b, 1)).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    n, low, high = F.count(F.lit(1)), F.min(value), F.max(value)
    stats = samples.groupBy(*keys).agg(n.alias("count"), F.round(F.sum(value), 4).alias("sum"), F.round(F.avg(value), 6).alias("mean"), *buckets, low.alias("low"), high.alias("high"))
    x = samples.select(*keys, F.col(value).alias("v")).join(bounded(stats.select(*keys, "low", "high")), keys)
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    x = x.withColumn("cell", cell)
    up_to = lambda by, order: F.sum("n").over(Window.partitionBy(*by).orderBy(order))
    counts = x.groupBy(*keys, "cell").agg(n.alias("n")).withColumn("upto", up_to(keys, "cell"))
    wanted = stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(int(q * 100)).alias("q"), F.least(F.floor(F.col("count") * q), F.col("count") - 1).alias("r")) for q in (0.5, 0.95, 0.99)])).alias("w")).select(*keys, "w.*")
    at = wanted.join(counts, keys).filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))).select(*keys, "cell", "q", (F.col("r") - F.col("upto") + F.col("n")).alias("r"))
    inner = x.join(bounded(at.select(*keys, "cell").distinct()), [*keys, "cell"], "left_semi").groupBy(*keys, "cell", "v").agg(n.alias("n")).withColumn("upto", up_to([*keys, "cell"], "v"))
    hit = at.join(inner, [*keys, "cell"]).filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
    found = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{q}") for q in (50, 95, 99)])
    return stats.drop("low", "high").join(found, keys)


def platform_overview(acts: DataFrame, as_of: Column) -> DataFrame:
    """Users, activities, and users active in the last seven days: one row."""
    recent = F.col("occurred_at") >= as_of - F.expr("INTERVAL '7' DAY")
    return acts.agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("activities"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users"))


def usage_quota(acts: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """This month's activities of each user against a limit; warning above 70 %."""
    month = acts.filter(F.date_trunc("month", "occurred_at") == F.date_trunc("month", as_of))
    n = month.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    pct = F.col("used") / limit * 100
    return n.select("user_id", "used", F.round(pct, 4).alias("percent"), F.when(pct >= 100, "exceeded").when(pct > 70, "warning").otherwise("ok").alias("state"))


def conversation_stats(messages: DataFrame) -> DataFrame:
    """Messages, turns by role and characters of each conversation."""
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), n("user").alias("from_user"), n("assistant").alias("from_assistant"), F.sum(F.length("text")).alias("characters"))


def memory_window(messages: DataFrame, n: int = 4) -> DataFrame:
    """The last ``n`` messages of each conversation, a digest of the users' earlier ones (the first five, 100
    characters each), and a title from the first sentence of the first user message, 50 characters at most."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    x = messages.withColumn("back", back)
    user = (F.col("role") == "user") & F.col("text").isNotNull()
    lists = x.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("back") <= n, F.struct("turn", "role", "text")))).alias("recent"),
        F.slice(F.sort_array(F.collect_list(F.when((F.col("back") > n) & user, F.struct("turn", F.substring("text", 1, 100).alias("text"))))), 1, 5).alias("older"),
        F.min(F.when(user, F.struct("turn", "text")))["text"].alias("first"),
    )
    return lists.select("conv_id", F.size("recent").cast("long").alias("recent_messages"), F.array_join(F.transform("older", lambda m: m["text"]), " | ").alias("digest"), F.substring(F.split("first", r"[.!?\n]", -1)[0], 1, 50).alias("title"))


def export_markdown(messages: DataFrame) -> DataFrame:
    """Each conversation as one text, in order of its turns."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("**"), F.initcap(m["role"]), F.lit("**: "), F.coalesce(m["text"], F.lit(""))))
    return messages.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("markdown"))
