"""Balance, burnout, energy, stress, rest and careers of each user, from facts by day and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import COMM_APPS, PRODUCTIVE_TYPES
from .productivity import _prepared

# Thresholds of healthy work.
MAX_HEALTHY_HOURS, IDEAL_HOURS, LEAST_BREAKS, MAX_MEETING_PCT, LATE_HOUR, EARLY_HOUR, OVERWORK_DAYS, OVERWORK_HOURS = 9.0, 7.5, 3, 0.4, 21, 7, 3, 10
# The skill that an application stands for, and the next step for a weak skill.
CAREER_SKILLS = {"VS Code": "Programming", "Terminal": "DevOps", "Chrome": "Research", "Figma": "Design", "Slack": "Communication", "Notion": "Documentation", "Zoom": "Meetings", "Google Meet": "Meetings"}
NEXT_STEPS = {
    "Research": "Spend 30 min/day reading docs or articles in your domain",
    "Documentation": "Write a short README or decision log for your current project",
    "Communication": "Schedule a sync with a collaborator you haven't spoken to this week",
    "Design": "Review UI patterns for 20 min to improve product intuition",
    "DevOps": "Automate one manual step in your dev workflow this week",
    "Testing": "Add tests for the last feature you shipped",
    "Meetings": "Block focus time to counterbalance your meeting load",
    "Programming": "Pick one algorithmic problem to solve this week for sharpness",
}
GROWTH_STEP = "Deepen one core skill to advanced mastery (>70%) this month"
TIME_STEP = "Review your weekly time allocation and cut low-value activities"
TRACK_STEP = "Track your work daily — more data means better insights"


def _if(test: Column, value: object) -> Column:
    return F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(F.lit(0.0))


def day_facts(acts: DataFrame) -> DataFrame:
    """What the scores read: hours, first and last hour with a start, breaks, meetings, switches and messages of each user
    and day."""
    return _prepared(acts).groupBy("user_id", F.col("day").alias("date")).agg(
        (F.sum("secs") / 3600).alias("total_hours"), F.min(F.hour("occurred_at")).alias("start_hour"), F.max(F.hour("occurred_at")).alias("end_hour"), F.count(F.when(F.col("type") == "break", 1)).alias("break_count"),
        (F.coalesce(F.sum(F.when(F.col("type") == "meeting", F.col("secs"))), F.lit(0)) / 3600).alias("meeting_hours"), F.sum("switched").alias("context_switches"), F.count(F.when(F.col("app").isin(COMM_APPS), 1)).alias("messages_sent"),
    ).withColumn("is_weekend", F.weekday("date") >= 5)


def work_life_balance(days: DataFrame) -> DataFrame:
    """Hours near the ideal .35, work within bounds .25, free weekends .20 and breaks .20; levels at 80, 60 and 40."""
    x = days.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days_analyzed"), F.avg("total_hours").alias("avg_hours"), F.avg("break_count").alias("avg_breaks"),
        F.sum((F.col("start_hour") < EARLY_HOUR).cast("int") + (F.col("end_hour") > LATE_HOUR).cast("int")).alias("violations"),
        F.count(F.when(F.col("is_weekend") & (F.col("total_hours") > 1), 1)).alias("weekend_work_days"),
    )
    zero = F.lit(0.0)
    parts = {
        "hours_score": F.greatest(zero, 100 - F.abs(F.col("avg_hours") - IDEAL_HOURS) * 15),
        "boundary_score": F.greatest(zero, 100 - F.col("violations") / F.col("days_analyzed") * 200),
        "weekend_score": F.greatest(zero, 100.0 - F.col("weekend_work_days") * 30),
        "break_score": F.least(F.lit(100.0), F.col("avg_breaks") / LEAST_BREAKS * 100),
    }
    x = x.withColumns(parts)
    score = F.col("hours_score") * 0.35 + F.col("boundary_score") * 0.25 + F.col("weekend_score") * 0.20 + F.col("break_score") * 0.20
    level = F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")
    return x.select("user_id", "days_analyzed", F.round(score, 4).alias("score"), level.alias("level"), *[F.round(p, 4).alias(p) for p in parts], "violations", "weekend_work_days")


def _longest(days: DataFrame, test: Column, name: str) -> DataFrame:
    """The longest run of a user's rows, in order of date, that pass ``test``."""
    w = Window.partitionBy("user_id").orderBy("date")
    breaks = F.sum(F.when(test, 0).otherwise(1)).over(w)
    runs = days.withColumn("run", breaks).groupBy("user_id", "run").agg(F.count(F.when(test, 1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias(name))


def burnout_risk(days: DataFrame) -> DataFrame:
    """Points for a streak of overwork, long days, few breaks, late work, meetings and a rising week; levels at 30, 60
    and 80."""
    x = days.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days_analyzed"), F.avg("total_hours").alias("avg_hours"), F.avg("break_count").alias("avg_breaks"), (F.count(F.when(F.col("end_hour") > LATE_HOUR, 1)) / F.count(F.lit(1))).alias("late_share"),
        F.avg(F.coalesce(F.col("meeting_hours") / F.nullif(F.col("total_hours"), F.lit(0.0)), F.lit(0.0)) * 100).alias("meeting_pct"),
    )
    weeks = days.groupBy("user_id", F.date_trunc("week", "date").alias("week")).agg(F.sum("total_hours").alias("hours"))
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("week"))) == 1
    trend = weeks.withColumn("last", last).groupBy("user_id").agg(F.count(F.lit(1)).alias("weeks"), F.max(F.when(F.col("last"), F.col("hours"))).alias("recent"), F.avg(F.when(~F.col("last"), F.col("hours"))).alias("earlier"))
    x = x.join(_longest(days, F.col("total_hours") > OVERWORK_HOURS, "streak"), "user_id").join(trend, "user_id")
    found = {
        "Overwork Streak": (F.col("streak") >= OVERWORK_DAYS, F.lit(25.0)),
        "High Average Hours": (F.col("avg_hours") > MAX_HEALTHY_HOURS, F.least(F.lit(20.0), (F.col("avg_hours") - MAX_HEALTHY_HOURS) * 10)),
        "Insufficient Breaks": (F.col("avg_breaks") < LEAST_BREAKS, F.lit(15.0)),
        "Frequent Late Work": (F.col("late_share") > 0.3, F.lit(15.0)),
        "Meeting Overload": (F.col("meeting_pct") > MAX_MEETING_PCT * 100, F.lit(10.0)),
        "Increasing Workload": ((F.col("weeks") >= 3) & (F.col("earlier") > 0) & ((F.col("recent") - F.col("earlier")) / F.col("earlier") > 0.2), F.lit(15.0)),
    }
    risk = F.least(F.lit(100.0), sum((_if(t, v) for t, v in found.values()), F.lit(0.0)))
    level = F.when(risk <= 30, "low").when(risk <= 60, "moderate").when(risk <= 80, "high").otherwise("critical")
    names = F.array_join(F.array_compact(F.array(*[F.when(t, n) for n, (t, _) in found.items()])), ", ")
    return x.select("user_id", "days_analyzed", F.round(risk, 4).alias("risk_score"), level.alias("risk_level"), names.alias("indicators"), F.col("streak").alias("overwork_streak"))


def energy_levels(acts: DataFrame) -> DataFrame:
    """Energy of each hour with activity: .7 for deep work, .3 for few switches, 10 to 100; the three hours with most
    and the three with least, by hour among equals."""
    rows = _prepared(acts).groupBy("user_id", F.hour("occurred_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(F.when(F.col("type").isin(PRODUCTIVE_TYPES) & (F.col("secs") >= 300), F.col("secs"))), F.lit(0)) / 60).alias("deep"), F.sum("switched").alias("switches"))
    raw = F.floor((F.col("deep") / 60 * 0.7 + (1 - F.least(F.col("switches") / 10, F.lit(1.0))) * 0.3) * 100)
    x = rows.select("user_id", "hour", F.greatest(F.lit(10), F.least(F.lit(100), raw)).cast("long").alias("energy"))
    w = Window.partitionBy("user_id").orderBy(F.desc("energy"), "hour")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    x = x.withColumn("r", F.row_number().over(w)).withColumn("n", n)
    return x.select("user_id", "hour", "energy", (F.col("r") <= 3).alias("is_peak"), (F.col("r") > F.col("n") - 3).alias("is_low"))


def stress_index(days: DataFrame) -> DataFrame:
    """Of each day, meetings .25, switches .20, overwork .20, missing breaks .15, late work .10 and messages .10;
    levels at 25, 50 and 75; and the largest factor, the first of equal ones."""
    hundred, zero = F.lit(100.0), F.lit(0.0)
    parts = {
        "meeting_load": F.least(F.col("meeting_hours") / F.greatest(F.col("total_hours"), F.lit(1.0)) / 0.5 * 100, hundred),
        "context_switching": F.least(F.col("context_switches") / 30 * 100, hundred),
        "overwork": F.least(F.greatest(zero, (F.col("total_hours") - MAX_HEALTHY_HOURS) / 3 * 100), hundred),
        "break_deficit": F.greatest(F.lit(0), LEAST_BREAKS - F.col("break_count")) / LEAST_BREAKS * 100,
        "late_work": F.when(F.col("end_hour") > LATE_HOUR, 30.0).otherwise(0.0),
        "communication": F.when(F.col("messages_sent") > 20, F.least(F.col("messages_sent") / 50 * 100, hundred)).otherwise(0.0),
    }
    total = sum((p * w for p, w in zip(parts.values(), (0.25, 0.20, 0.20, 0.15, 0.10, 0.10))), F.lit(0.0))
    most = F.greatest(*[F.round(p, 1) for p in parts.values()])
    factor = F.coalesce(*[F.when(F.round(p, 1) == most, n) for n, p in parts.items()])
    level = F.when(total < 25, "low").when(total < 50, "moderate").when(total < 75, "high").otherwise("very_high")
    return days.select("user_id", "date", F.round(F.least(total, hundred), 4).alias("stress_index"), level.alias("level"), factor.alias("dominant_factor"))


def rest_patterns(days: DataFrame) -> DataFrame:
    """Rest between days, days off and the longest run of work days; recovery of 0 to 100."""
    rest = 24 - F.greatest((F.col("end_hour") - F.col("start_hour")).cast("double"), F.col("total_hours"))
    x = days.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg(rest).alias("avg_rest"), F.count(F.when(F.col("total_hours") < 1, 1)).alias("rest_days")).join(_longest(days, F.col("total_hours") >= 1, "run"), "user_id")
    score = F.least(F.lit(100.0), F.col("avg_rest") / 15 * 60) + F.least(F.lit(40.0), F.col("rest_days") / F.greatest(F.col("n") / 7, F.lit(1.0)) * 40) - F.greatest(F.lit(0), (F.col("run") - 5) * 5)
    advice = F.array_join(F.array_compact(F.array(F.when(F.col("run") > 6, "rest day"), F.when(F.col("avg_rest") < 12, "end earlier"), F.when(F.col("rest_days") == 0, "day off"))), ", ")
    return x.select("user_id", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 4).alias("recovery_score"), F.round("avg_rest", 4).alias("avg_rest_hours"), "rest_days", F.col("run").alias("consecutive_work_days"), advice.alias("recommendations"))


def wellness_basic(acts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Session balance .3, variety .2, hours .3 and breaks .2 over the last ``days`` days; burnout by the number of
    rows above two hours; gaps of 2 to 60 minutes are breaks only for a user without break rows."""
    recent = acts.filter(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL '{days}' DAY"))
    s, w = F.coalesce("duration_seconds", F.lit(0)), Window.partitionBy("user_id").orderBy("occurred_at", "id")
    start = F.unix_micros("occurred_at") / 1e6
    gap = start - F.lag(start + s).over(w)
    pause = F.when((F.col("gap") >= 120) & (F.col("gap") <= 3600), F.col("gap"))
    x = recent.withColumn("s", s).withColumn("gap", gap).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("total"), F.count(F.when(F.col("type").isin("break", "idle"), 1)).alias("breaks"), F.coalesce(F.sum(F.when(F.col("type").isin("break", "idle"), F.col("s"))), F.lit(0)).alias("break_s"),
        F.count(F.when(F.col("s") > 7200, 1)).alias("long_sessions"), F.count(F.when(F.col("s").between(600, 5400), 1)).alias("moderate"), F.count_distinct("app").alias("apps"), F.count_distinct("type").alias("types"),
        F.count_distinct(F.to_date("occurred_at")).alias("days"), F.count(pause).alias("pauses"), F.coalesce(F.sum(pause), F.lit(0.0)).alias("pause_s"),
    )
    hundred, none = F.lit(100.0), F.col("breaks") == 0
    hours = F.col("total") / 3600 / F.greatest(F.col("days"), F.lit(1))
    x = x.withColumns({
        "balance": F.least(hundred, F.col("moderate") / F.col("n") * 120), "variety": F.least(hundred, (F.col("apps") + F.col("types")) * 10.0),
        "hours_score": F.when((hours >= 4) & (hours <= 8), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.abs(hours - 6) * 15)),
    })
    x = x.withColumn("break_score", F.when(none, F.greatest(F.lit(40.0), F.col("hours_score") * 0.6)).otherwise(F.least(hundred, F.col("break_s") / F.greatest(F.col("total"), F.lit(1)) * 500)))
    overall = F.col("balance") * 0.3 + F.col("variety") * 0.2 + F.col("hours_score") * 0.3 + F.col("break_score") * 0.2
    life = F.col("hours_score") * 0.5 + F.col("balance") * 0.3 + F.col("break_score") * 0.2
    pauses, pause_s = F.when(none, F.col("pauses")).otherwise(F.lit(0)), F.when(none, F.col("pause_s")).otherwise(F.lit(0.0))
    return x.select(
        "user_id", F.round(F.least(hundred, F.greatest(F.lit(0.0), overall)), 6).alias("overall_score"), F.round(life, 6).alias("balance_score"), F.round((F.col("break_s") + pause_s) / F.greatest(F.col("total"), F.lit(1)), 6).alias("break_ratio"),
        F.when(F.col("long_sessions") < 3, "low").when(F.col("long_sessions") < 6, "medium").otherwise("high").alias("burnout_level"), "long_sessions", (F.col("breaks") + pauses).alias("break_count"), F.round((F.col("break_s") + pause_s) / 60, 6).alias("break_minutes"),
    )


def career_insights(acts: DataFrame, as_of: Column) -> DataFrame:
    """Phase from the last seven days' hours, applications and meetings; trajectory from the change against the seven
    days before (15 and 5 %); the three skills with the least time below an hour; and next steps, four at most."""
    back = as_of - F.expr("INTERVAL '7' DAY")
    x = acts.filter(F.col("occurred_at") >= as_of - F.expr("INTERVAL '14' DAY")).withColumn("now", F.col("occurred_at") >= back).withColumn("s", F.coalesce("duration_seconds", F.lit(0)))
    now = F.col("now")
    u = x.groupBy("user_id").agg(
        F.count(F.when(now, 1)).alias("n"), F.coalesce(F.sum(F.when(now, F.col("s"))), F.lit(0)).alias("curr"), F.coalesce(F.sum(F.when(~now, F.col("s"))), F.lit(0)).alias("prev"),
        F.coalesce(F.sum(F.when(now & F.col("type").isin("window_focus", "app_focus") & (F.col("s") >= 300), F.col("s"))), F.lit(0)).alias("deep"), F.count_distinct(F.when(now, F.col("app"))).alias("apps"), F.count(F.when(now & (F.col("type") == "meeting"), 1)).alias("meetings"),
    ).filter("n > 0")
    names = F.create_map(*[F.lit(v) for kv in CAREER_SKILLS.items() for v in kv])
    hours = x.filter("now and app is not null").groupBy("user_id", F.coalesce(F.element_at(names, F.col("app")), F.col("app")).alias("skill")).agg((F.sum("s") / 3600).alias("h")).filter("h < 1")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("h", "skill"))
    weak = hours.withColumn("r", rank).filter("r <= 3").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "skill"))), lambda g: g["skill"]).alias("gaps"))
    h, change = F.col("curr") / 3600, (F.col("curr") - F.col("prev")) / F.col("prev")
    phase = F.when(h < 10, "exploring").when((F.col("apps") >= 8) & (F.col("meetings") >= 5) & (h >= 20), "lead").when((F.col("apps") >= 6) & (F.col("deep") / 3600 >= 15), "senior").otherwise("growth")
    trajectory = F.when(F.col("prev") == 0, "steady").when(change >= 0.15, "accelerating").when(change <= -0.15, "declining").when(change.between(-0.05, 0.05), "steady").otherwise("plateau")
    steps = F.create_map(*[F.lit(v) for kv in NEXT_STEPS.items() for v in kv])
    y = u.join(weak, "user_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>"))).withColumn("phase", phase).withColumn("trajectory", trajectory)
    one = F.array_compact(F.transform("gaps", lambda g: F.element_at(steps, g)))
    add = lambda a, test, step: F.when(test(a), F.array_append(a, F.lit(step))).otherwise(a)
    y = y.withColumn("steps", one)
    y = y.withColumn("steps", add(F.col("steps"), lambda a: (F.col("phase") == "growth") & (F.size(a) < 3), GROWTH_STEP))
    y = y.withColumn("steps", add(F.col("steps"), lambda a: F.col("trajectory").isin("plateau", "declining") & (F.size(a) < 4), TIME_STEP))
    y = y.withColumn("steps", add(F.col("steps"), lambda a: F.size(a) < 2, TRACK_STEP))
    return y.select("user_id", F.col("trajectory").alias("growth_trajectory"), F.col("phase").alias("career_phase"), F.array_join("gaps", ", ").alias("skill_gaps"), F.array_join(F.slice("steps", 1, 4), "; ").alias("next_steps"))


# Priority by kind of notification; every other kind is medium.
PRIORITY = {
    "daily_summary": "low", "weekly_digest": "low", "deadline_reminder": "high", "focus_reminder": "medium", "break_suggestion": "medium", "wellness_alert": "high",
    "ai_insight": "low", "sync_error": "high", "goal_progress": "medium", "achievement": "medium", "system": "critical",
}


def send_decisions(notices: DataFrame, preferences: DataFrame) -> DataFrame:
    """``id, send, reason`` for each notice (``id, user_id, kind, channel, priority, at``), in order of time, by its user's
    preferences: ``user_id, channels_off, kinds_off`` (arrays)``, dnd, start_hour, end_hour, override_critical, max_per_hour,
    max_per_day, digest``.

    Checks go in the order channel, kind, quiet hours (which may wrap midnight; critical notices pass if allowed to), digest
    (low and medium wait for it), hourly and daily cap. Only what is sent counts. Of the notices that reach the caps the
    first of each hour up to its cap come to the daily one, and the first of these in a day up to its cap are sent. Windows
    are by user and day, so a user with very many notices is spread over days.
    """
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    x = notices.join(preferences, "user_id").withColumn("rank", F.coalesce("priority", table[F.col("kind")], F.lit("medium")))
    h, s, e = F.hour("at"), F.col("start_hour"), F.col("end_hour")
    quiet = F.col("dnd") & F.when(s > e, (h >= s) | (h < e)).otherwise((h >= s) & (h < e))
    x = x.withColumn("reason", F.when(F.array_contains("channels_off", F.col("channel")), F.concat(F.lit("channel_"), "channel", F.lit("_disabled"))).when(F.array_contains("kinds_off", F.col("kind")), F.concat(F.lit("type_"), "kind", F.lit("_disabled")))
                     .when(quiet & ~((F.col("rank") == "critical") & F.col("override_critical")), "dnd_active").when(F.col("digest") & F.col("rank").isin("low", "medium"), "digest_mode_active"))
    open_ = F.col("reason").isNull()
    day = ["user_id", F.to_date("at")]
    by_hour, by_day = Window.partitionBy(*day, F.hour("at")).orderBy("at", "id"), Window.partitionBy(*day).orderBy("at", "id")
    up_to_now = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("nth", F.sum(open_.cast("int")).over(up_to_now(by_hour)))
    x = x.withColumn("in_hour", open_ & (F.col("nth") <= F.col("max_per_hour")))
    x = x.withColumn("sent", F.col("in_hour") & (F.sum(F.col("in_hour").cast("int")).over(up_to_now(by_day)) <= F.col("max_per_day")))
    x = x.withColumn("sent_in_hour", F.coalesce(F.sum(F.col("sent").cast("int")).over(by_hour.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    why = F.coalesce("reason", F.when(F.col("sent"), "approved").when(F.col("sent_in_hour") >= F.col("max_per_hour"), "hourly_cap_reached").otherwise("daily_cap_reached"))
    return x.select("id", F.col("sent").alias("send"), why.alias("reason"))
