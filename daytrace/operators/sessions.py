"""Sequences in time: sessions, context switches, breaks, focus periods, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import PRODUCTIVE_TYPES
from ..functions.scalars import activity_key, capped, categorize_app

BY_TIME = ["occurred_at", "id"]


def _seconds(at: str | Column) -> Column:
    """Seconds since 1970, with fractions; exact to the microsecond."""
    return F.unix_micros(F.col(at) if isinstance(at, str) else at) / 1e6


def _islands(rows: DataFrame, gap: float, day: bool) -> DataFrame:
    """Number the sessions of each user: a new one starts where the start is more than ``gap`` seconds after the end
    of the row before. Needs ``start`` and ``secs``; one shuffle by user."""
    keys = ["user_id", "day"] if day else ["user_id"]
    w = Window.partitionBy(*keys).orderBy(*BY_TIME)
    new = F.coalesce((F.col("start") - F.lag(F.col("start") + F.col("secs")).over(w) > gap).cast("int"), F.lit(1))
    return rows.withColumn("new", new).withColumn("session", F.sum("new").over(w))


def strict_deep_work(acts: DataFrame, gap: int = 300, least: int = 1800) -> DataFrame:
    """Hours of deep work by user and day: runs of productive applications of ``least`` seconds or more."""
    rows = acts.filter(categorize_app(F.coalesce("app", F.lit(""))) == "productive")
    rows = rows.select("user_id", F.to_date("occurred_at").alias("day"), *BY_TIME, _seconds("occurred_at").alias("start"), F.coalesce("duration_seconds", F.lit(0)).alias("secs"))
    runs = _islands(rows, gap, True).groupBy("user_id", "day", "session").agg(F.sum("secs").alias("s"))
    x = runs.groupBy("user_id", F.col("day").alias("date")).agg(F.coalesce(F.sum(F.when(F.col("s") >= least, F.col("s"))), F.lit(0)).alias("s"), F.count(F.when(F.col("s") >= least, 1)).alias("deep_work_sessions"))
    return x.select("user_id", "date", F.round(F.col("s") / 3600, 9).alias("deep_work_hours"), "deep_work_sessions")


def deep_work_sessions(acts: DataFrame, gap: int = 300, shortest: int = 60, least: int = 300, types: list[str] | None = PRODUCTIVE_TYPES) -> DataFrame:
    """Sessions of activities of at least ``shortest`` seconds (of the given types, or of all), with the key
    that has most seconds; the smaller key of equal ones."""
    rows = acts if types is None else acts.filter(F.col("type").isin(types))
    rows = rows.withColumn("secs", capped(F.col("duration_seconds"))).filter(F.col("secs") >= shortest)
    rows = rows.select("user_id", *BY_TIME, "secs", _seconds("occurred_at").alias("start"), activity_key(F.col("app"), F.col("domain"), F.col("type")).alias("key"))
    parts = _islands(rows, gap, False).groupBy("user_id", "session", "key").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("secs")).alias("end"), F.sum("secs").alias("secs"), F.count(F.lit(1)).alias("n"))
    x = parts.groupBy("user_id", "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("secs").alias("seconds"), F.sum("n").alias("activities"), F.min(F.struct((-F.col("secs")).alias("s"), "key"))["key"].alias("main_app")).filter(F.col("seconds") >= least)
    return x.select("user_id", F.floor("start").alias("started"), F.round(F.col("end") - F.col("start"), 2).alias("span_seconds"), "seconds", "activities", "main_app")


def start_gap_sessions(acts: DataFrame, gap: int = 1800) -> DataFrame:
    """E1d: sessions by the time between starts."""
    rows = acts.select("user_id", *BY_TIME, _seconds("occurred_at").alias("start"), F.lit(0).alias("secs"), "duration_seconds")
    x = _islands(rows, gap, False).groupBy("user_id", "session").agg(F.floor(F.min("start")).alias("started"), F.floor(F.max("start")).alias("last_start"), F.count(F.lit(1)).alias("activities"), F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("seconds"))
    return x.drop("session")


def context_switches(acts: DataFrame) -> DataFrame:
    """Each change of key against the user's row before: when, from and to."""
    key = activity_key(F.col("app"), F.col("domain"), F.col("type"))
    w = Window.partitionBy("user_id").orderBy(*BY_TIME)
    rows = acts.select("user_id", *BY_TIME, key.alias("to_key")).withColumn("from_key", F.lag("to_key").over(w))
    return rows.filter(F.col("to_key") != F.col("from_key"))


def switch_timeline(acts: DataFrame) -> DataFrame:
    """Switches by user and hour."""
    return context_switches(acts).groupBy("user_id", F.date_format("occurred_at", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("switches"))


def switch_patterns(acts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent pairs "A -> B" of each user; equal counts in order of the pair."""
    x = context_switches(acts).groupBy("user_id", F.concat_ws(" -> ", "from_key", "to_key").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "pattern"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def switch_cooldown(acts: DataFrame, cooldown: int = 600) -> DataFrame:
    """Changes of application by user and day, at most one in ``cooldown`` seconds since the last one counted.

    Which changes count depends on the ones before, so the day's changes, in order, are folded; a fold's array is one
    user-day.
    """
    w = Window.partitionBy("user_id", "day").orderBy(*BY_TIME)
    rows = acts.select("user_id", F.to_date("occurred_at").alias("day"), *BY_TIME, F.coalesce("app", F.lit("")).alias("app"), _seconds("occurred_at").alias("t")).withColumn("before", F.lag("app").over(w))
    changed = F.when(F.col("app") != F.col("before"), F.col("t"))
    times = rows.groupBy("user_id", F.col("day").alias("date")).agg(F.sort_array(F.collect_list(changed)).alias("ts"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))
    step = lambda s, t: F.when(s["last"].isNull() | (t - s["last"] >= cooldown), F.struct((s["n"] + 1).alias("n"), t.alias("last"))).otherwise(s)
    return times.select("user_id", "date", F.aggregate("ts", start, step, lambda s: s["n"]).alias("context_switches"))


def gaps(acts: DataFrame) -> DataFrame:
    """Seconds from the end of each activity to the next start of the same user and day."""
    w = Window.partitionBy("user_id", "day").orderBy(*BY_TIME)
    rows = acts.select("user_id", F.to_date("occurred_at").alias("day"), *BY_TIME, _seconds("occurred_at").alias("start"), F.coalesce("duration_seconds", F.lit(0)).alias("secs"))
    return rows.withColumn("gap", F.lead("start").over(w) - F.col("start") - F.col("secs"))


def break_quality(acts: DataFrame, least: int = 300) -> DataFrame:
    """0 to 10 by user and day: 4 for the share of breaks of 5 to 60 minutes, 4 for one break in two hours of
    work, 2 less 0.5 for each longer break. One activity gives 5, none with a break 3."""
    g = F.when(F.col("gap") >= least, F.col("gap"))
    x = gaps(acts).groupBy("user_id", F.col("day").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("secs").alias("work"), F.count(g).alias("breaks"), F.count(F.when(g <= 3600, 1)).alias("good"), F.count(F.when(g > 3600, 1)).alias("long"))
    hours = F.col("work") / 3600
    rate = F.when(hours > 0, F.least(F.col("breaks") / (hours / 2), F.lit(1.0))).otherwise(0.0)
    score = 4 * F.col("good") / F.col("breaks") + 4 * rate + F.greatest(F.lit(0.0), 2 - 0.5 * F.col("long"))
    out = F.when(F.col("n") <= 1, 5.0).when(F.col("breaks") == 0, 3.0).otherwise(F.least(F.lit(10.0), score))
    return x.select("user_id", "date", "breaks", F.round(out, 9).alias("break_quality"))


def break_patterns(acts: DataFrame, least: int = 300, most: int = 7200) -> DataFrame:
    """Breaks of 5 to 120 minutes by user and day: number, mean minutes, longest."""
    x = gaps(acts).filter((F.col("gap") >= least) & (F.col("gap") <= most)).groupBy("user_id", F.col("day").alias("date"))
    return x.agg(F.count(F.lit(1)).alias("breaks"), F.round(F.avg("gap") / 60, 3).alias("avg_minutes"), F.round(F.max("gap") / 60, 3).alias("longest_minutes"))


def _pauses(acts: DataFrame) -> DataFrame:
    """Seconds from the start before to each start of a user, what was worked then (30 s if untold), and both applications."""
    w = Window.partitionBy("user_id").orderBy(*BY_TIME)
    rows = acts.select("user_id", *BY_TIME, _seconds("occurred_at").alias("t"), F.coalesce(F.nullif("duration_seconds", F.lit(0)), F.lit(30)).alias("secs"), F.coalesce("app", F.lit("")).alias("app"))
    return rows.withColumns({"pause": F.col("t") - F.lag("t").over(w), "worked": F.lag("secs").over(w), "before": F.lag("app").over(w)}).filter("pause is not null")


def break_classification(acts: DataFrame, least: int = 300) -> DataFrame:
    """E5: pauses from start to start of ``least`` seconds or more, by day, size (15, 30 and 60 minutes) and kind: forced from
    60 minutes, scheduled if the application is the same after it, else natural."""
    rows, p = _pauses(acts).filter(F.col("pause") >= least), F.col("pause")
    size = F.when(p < 300, "micro").when(p < 900, "short").when(p < 1800, "medium").when(p < 3600, "long").otherwise("extended")
    kind = F.when(p >= 3600, "forced").when(F.col("before") == F.col("app"), "scheduled").otherwise("natural")
    return rows.groupBy("user_id", F.to_date("occurred_at").alias("date"), size.alias("size"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pause") / 60, 4).alias("minutes"))


def break_balance(acts: DataFrame, least: int = 300, ideal: float = 0.33) -> DataFrame:
    """E5: minutes of breaks against minutes of work of each user, and 10 less 20 for each unit away from the ideal ratio."""
    x = _pauses(acts).groupBy("user_id").agg((F.coalesce(F.sum(F.when(F.col("pause") >= least, F.col("pause"))), F.lit(0.0)) / 60).alias("b"), (F.sum("worked") / 60).alias("w"))
    ratio = F.when(F.col("w") > 0, F.col("b") / F.col("w")).otherwise(0.0)
    return x.select("user_id", F.round("b", 4).alias("break_minutes"), F.round("w", 4).alias("work_minutes"), F.round(ratio, 4).alias("ratio"), F.round(F.greatest(F.lit(0.0), 10 - F.abs(ratio - ideal) * 20), 4).alias("optimal_break_score"))


def focus_periods(acts: DataFrame, gap: int = 300, distractions: int = 3, least: int = 60) -> DataFrame:
    """Periods of each user that end at a gap between starts of more than ``gap`` seconds, or at the third row with
    another application than the period's own; then that row's is the next period's.

    A period lasts from its first to its last start, ``least`` seconds or more. Depth: flow_state from 45 minutes, deep_work
    from 25, focused from 15, moderate from 5, else shallow; quality is 100, 85, 70, 50 or 25 by depth, less 5 for each other
    row; a period that ended at the third counts three less, so none. The rows between two gaps are folded in order, so an
    array is as long as work without a gap.
    """
    w = Window.partitionBy("user_id").orderBy(*BY_TIME)
    rows = acts.select("user_id", *BY_TIME, _seconds("occurred_at").alias("t"), F.coalesce(F.nullif("app", F.lit("")), F.lit("Unknown")).alias("app"))
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1))
    rows = rows.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("user_id", "segment").agg(F.sort_array(F.collect_list(F.struct("t", "id", "app"))).alias("rs"))
    period = "struct<start:double,end:double,app:string,other:int>"
    start = F.struct(F.array().cast(f"array<{period}>").alias("done"), F.lit(None).cast(period).alias("now"))
    made = lambda a, b, app, n: F.struct(a.alias("start"), b.alias("end"), app.alias("app"), n.cast("int").alias("other"))

    def step(s, r):
        now, other = s["now"], s["now"]["other"] + (r["app"] != s["now"]["app"]).cast("int")
        ends = (r["app"] != now["app"]) & (other >= distractions)
        done = F.when(now.isNotNull() & ends, F.array_append(s["done"], made(now["start"], now["end"], now["app"], other - distractions))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(now.isNull() | ends, made(r["t"], r["t"], r["app"], F.lit(0))).otherwise(made(now["start"], r["t"], now["app"], other)).alias("now"))

    found = runs.select("user_id", F.explode(F.aggregate("rs", start, step, lambda s: F.array_append(s["done"], s["now"]))).alias("p"))
    secs = F.col("p.end") - F.col("p.start")
    depth = F.when(secs >= 2700, "flow_state").when(secs >= 1500, "deep_work").when(secs >= 900, "focused").when(secs >= 300, "moderate").otherwise("shallow")
    base = F.when(secs >= 2700, 100).when(secs >= 1500, 85).when(secs >= 900, 70).when(secs >= 300, 50).otherwise(25)
    return found.filter(secs >= least).select("user_id", F.floor("p.start").alias("started"), F.round(secs / 60, 4).alias("minutes"), F.col("p.app").alias("app"), F.col("p.other").cast("long").alias("distractions"), depth.alias("depth"), F.greatest(F.lit(0), base - 5 * F.col("p.other")).cast("long").alias("quality_score"))


def longest_run(days: DataFrame, test: Column, name: str) -> DataFrame:
    """The longest run of consecutive dates with ``test`` for each user; users without one get 0."""
    users = days.select("user_id").distinct()
    w = Window.partitionBy("user_id").orderBy("date")
    hits = days.filter(test).select("user_id", "date").distinct().withColumn("island", F.expr("date_sub(date, 1)")).withColumn("island", F.date_sub("date", F.row_number().over(w)))
    runs = hits.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias(name))
    return users.join(runs, "user_id", "left").fillna(0)


def current_streak(days: DataFrame, test: Column, as_of: Column, most: int = 14) -> DataFrame:
    """Days back from ``as_of``, at most ``most``, that all have data and pass ``test``."""
    users = days.select("user_id").distinct()
    back = F.datediff(F.to_date(as_of), F.col("date"))
    hits = days.filter(test & (back >= 0) & (back < most)).select("user_id", back.alias("back")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("back")) - 1
    n = hits.withColumn("rank", rank).filter(F.col("rank") == F.col("back")).groupBy("user_id").agg(F.count(F.lit(1)).alias("streak"))
    return users.join(n, "user_id", "left").fillna(0)


def trailing_streak(days: DataFrame, test: Column) -> DataFrame:
    """E7d: rows after each user's last row that fails ``test``, in order of date."""
    last_fail = F.max(F.when(~test, F.col("date")))
    x = days.groupBy("user_id").agg(last_fail.alias("fail"))
    return days.join(x, "user_id").groupBy("user_id").agg(F.count(F.when(F.col("fail").isNull() | (F.col("date") > F.col("fail")), 1)).alias("streak"))


def week_streaks(done: DataFrame) -> DataFrame:
    """E7e: the longest and the last run of consecutive weeks with a completion (``user_id, date``)."""
    week = F.floor(F.datediff(F.date_trunc("week", "date").cast("date"), F.lit("1970-01-05").cast("date")) / 7)
    weeks = done.select("user_id", week.alias("w")).distinct()
    island = F.col("w") - F.row_number().over(Window.partitionBy("user_id").orderBy("w"))
    runs = weeks.withColumn("island", island).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("last"))
    return runs.groupBy("user_id").agg(F.max("n").alias("best_weeks"), F.max(F.struct("last", "n"))["n"].alias("last_weeks"))


def latest_per_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rank_in_group", rank).filter("rank_in_group = 1").drop("rank_in_group")


def history_baseline(daily: DataFrame, metric: str) -> DataFrame:
    """Mean and population deviation of all earlier days, and days among the five before with a value above 10."""
    w = Window.partitionBy("user_id").orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    recent = F.count(F.when(F.col(metric) > 10, 1)).over(w.rowsBetween(-5, -1))
    return daily.select("user_id", "date", F.col(metric), F.round(F.avg(metric).over(past), 4).alias("mean_before"), F.round(F.stddev_pop(metric).over(past), 4).alias("deviation_before"), recent.alias("high_days"))


def week_over_week(daily: DataFrame, metric: str) -> DataFrame:
    """The weekly mean of a metric and its change in percent against the user's week before."""
    weeks = daily.groupBy("user_id", F.date_trunc("week", "date").cast("date").alias("week_start")).agg(F.avg(metric).alias("value"))
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("week_start"))
    pct = F.when(before != 0, (F.col("value") - before) / before * 100)
    x = weeks.withColumn("pct", pct)
    return x.select("user_id", "week_start", F.round("value", 4).alias("value"), F.round("pct", 4).alias("change_pct"), F.when(F.col("pct") > 5, "up").when(F.col("pct") < -5, "down").otherwise("flat").alias("direction"))


def meeting_free_hours(acts: DataFrame, first: int = 9, last: int = 17) -> DataFrame:
    """Runs of working hours without a meeting on days with meetings, by user and day."""
    m = acts.filter("type = 'meeting'").select("user_id", F.to_date("occurred_at").alias("date"), F.hour("occurred_at").alias("a"), F.hour(F.timestamp_seconds(F.unix_timestamp("occurred_at") + F.greatest(F.coalesce("duration_seconds", F.lit(0)) - 1, F.lit(0)))).alias("z"))
    busy = m.select("user_id", "date", F.explode(F.sequence("a", F.greatest("a", "z"))).alias("hour")).distinct()
    grid = m.select("user_id", "date").distinct().withColumn("hour", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    free = grid.join(busy, ["user_id", "date", "hour"], "left_anti")
    island = F.col("hour") - F.row_number().over(Window.partitionBy("user_id", "date").orderBy("hour"))
    return free.withColumn("island", island).groupBy("user_id", "date", "island").agg(F.min("hour").cast("long").alias("from_hour"), (F.max("hour") + 1).cast("long").alias("to_hour")).drop("island")


def sliding_quota(log: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Requests whose number in a sliding window, itself included, is above the limit; the first limit that breaks.

    ``windows``: name to (seconds, limit), checked in order. One shuffle by user and endpoint.
    """
    t = F.unix_micros("ts")
    out, first = log.withColumn("t", t), None
    for name, (seconds, limit) in windows.items():
        w = Window.partitionBy("user_id", "endpoint").orderBy("t").rangeBetween(-seconds * 1_000_000 + 1, 0)
        out = out.withColumn(f"n_{name}", F.count(F.lit(1)).over(w))
        hit = F.col(f"n_{name}") > limit
        first = F.when(hit, name) if first is None else first.when(hit, name)
    return out.drop("t").withColumn("violated", first)
