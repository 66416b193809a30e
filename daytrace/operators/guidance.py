"""Careers, retrieval context, digests of notices and the health of integrations, for all users at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded


@dataclass(frozen=True)
class Role:
    """What a role asks for: skills, further ones that help, and hours."""

    title: str
    required: tuple[str, ...]
    helpful: tuple[str, ...]
    hours: int


# Roles with their skills.
ROLES = {
    "fullstack_developer": Role("Full-Stack Developer", ("javascript", "typescript", "python", "html", "css", "react", "nodejs", "sql", "git", "docker"), ("kubernetes", "aws", "graphql", "redis", "testing"), 500),
    "ml_engineer": Role("ML Engineer", ("python", "machine_learning", "deep_learning", "pytorch", "numpy", "pandas", "sql", "statistics", "git"), ("mlops", "docker", "kubernetes", "spark", "tensorflow"), 600),
    "data_scientist": Role("Data Scientist", ("python", "statistics", "machine_learning", "sql", "pandas", "numpy", "data_visualization", "r"), ("deep_learning", "spark", "tableau", "a_b_testing"), 500),
    "devops_engineer": Role("DevOps Engineer", ("linux", "docker", "kubernetes", "ci_cd", "terraform", "aws", "python", "bash", "monitoring", "git"), ("ansible", "helm", "prometheus", "grafana", "security"), 500),
    "tech_lead": Role("Tech Lead", ("system_design", "code_review", "mentoring", "architecture", "project_management", "communication", "python", "git"), ("agile", "documentation", "hiring", "strategy"), 1000),
}
# Weights of required skills, hours and helpful skills, and from which readiness on a level holds.
REQUIRED, HOURS, HELPFUL = 0.5, 0.3, 0.2
LEVELS = {"ready": 0.85, "almost_ready": 0.6, "developing": 0.3}
REQUIRED_HOURS, HELPFUL_HOURS = 50, 30


def roles(spark: SparkSession) -> DataFrame:
    rows = [(k, r.title, list(r.required), list(r.helpful), r.hours) for k, r in ROLES.items()]
    return spark.createDataFrame(rows, "role string, title string, required array<string>, helpful array<string>, target_hours int")


def _own(skills: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each user with each role: skills in lower case, and all hours."""
    own = skills.groupBy("user_id").agg(F.collect_set(F.lower("skill")).alias("own"), F.sum("hours").alias("total_hours"))
    return own.select("*", F.lit(1).alias("one")).join(bounded(wanted.withColumn("one", F.lit(1)), 1_000), "one").drop("one")


def role_readiness(skills: DataFrame, wanted: DataFrame) -> DataFrame:
    """Readiness of each user (``user_id, skill, hours``) for each role, 0 to 100, with its level, coverage and gaps.

    Half is the share of required skills, .3 the hours against the role's, 1 at most, .2 the share of helpful skills. Gaps are
    the missing required skills in order of their names, then the helpful ones, with the hours each takes. ``best`` marks
    the role with the highest readiness, of equal ones the first by name.
    """
    x = _own(skills, wanted)
    share = lambda c: F.size(F.array_intersect("own", c)) / F.greatest(F.size(c), F.lit(1))
    ready = share("required") * REQUIRED + F.least(F.col("total_hours") / F.greatest("target_hours", F.lit(1)), F.lit(1.0)) * HOURS + share("helpful") * HELPFUL
    level = F.lit("early")
    for name, least in sorted(LEVELS.items(), key=lambda e: e[1]):
        level = F.when(F.col("ready") >= least, name).otherwise(level)
    gap = lambda c, kind: F.transform(F.array_sort(F.array_except(c, "own")), lambda s: F.concat(s, F.lit(f":{kind}")))
    x = x.withColumn("ready", ready)
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ready"), "role")) == 1
    missing, more = F.size(F.array_except("required", "own")), F.size(F.array_except("helpful", "own"))
    return x.select("user_id", "role", F.round(F.col("ready") * 100, 1).alias("readiness"), level.alias("level"), F.size(F.array_intersect("own", "required")).alias("required_covered"), F.round(share("required") * 100, 1).alias("required_pct"),
                    F.size(F.array_intersect("own", "helpful")).alias("helpful_covered"), F.array_join(F.concat(gap("required", "required"), gap("helpful", "recommended")), ",").alias("gaps"), (missing * REQUIRED_HOURS + more * HELPFUL_HOURS).alias("gap_hours"), best.alias("best"))


def skill_gaps(skills: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """For each user the ``most`` required skills that it lacks and that most roles ask for: ``user_id, skill, required_by,
    roles, rank``; of equal ones by name."""
    x = _own(skills, wanted).select("user_id", "title", F.explode(F.array_except("required", "own")).alias("skill"))
    x = x.groupBy("user_id", "skill").agg(F.array_join(F.array_sort(F.collect_set("title")), ",").alias("required_by"), F.count_distinct("title").alias("roles"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("roles"), "skill"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def growth_velocity(skill_weeks: DataFrame) -> DataFrame:
    """From ``user_id, week, skill, hours``: a week's velocity is its hours times 1 + .1 for each skill; the trend compares
    the mean of the last two weeks with that of the first two, from four weeks on."""
    rows = skill_weeks.groupBy("user_id", "week", "skill").agg(F.sum("hours").alias("hours"))
    first = F.min("week").over(Window.partitionBy("user_id", "skill"))
    w = rows.withColumn("new", (F.col("week") == first).cast("int")).groupBy("user_id", "week").agg(F.sum("hours").alias("hours"), F.count_distinct("skill").alias("skills"), F.sum("new").alias("new"))
    w = w.withColumn("v", F.col("hours") * (1 + 0.1 * F.col("skills")))
    by = Window.partitionBy("user_id").orderBy("week")
    w = w.withColumns({"k": F.row_number().over(by), "back": F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("week")))})
    two = lambda c: F.sum(F.when(F.col(c) <= 2, F.col("v"))) / 2
    x = w.groupBy("user_id").agg(F.count(F.lit(1)).alias("weeks"), F.sum("v").alias("sum"), F.max(F.when(F.col("back") == 1, F.col("v"))).alias("current"), two("back").alias("recent"), two("k").alias("earlier"), F.sum("hours").alias("hours"), F.sum("new").alias("new_skills"))
    change = (F.col("recent") - F.col("earlier")) / F.nullif("earlier", F.lit(0.0))
    trend = F.when(F.col("weeks") < 4, "insufficient_data").when(~(F.col("earlier") > 0), "starting").when(change > 0.1, "accelerating").when(change < -0.1, "decelerating").otherwise("steady")
    return x.select("user_id", F.round("current", 2).alias("current_velocity"), F.round(F.col("sum") / F.col("weeks"), 2).alias("avg_velocity"), trend.alias("trend"), "weeks", F.round("hours", 1).alias("total_hours"), "new_skills")


def build_context(hits: DataFrame, docs: DataFrame, max_tokens: int = 2000, snippet: int = 300, cited: int = 150) -> DataFrame:
    """Citations and context of each query from its ranked hits (``query_id, id, rank, score``) among ``docs(id, title, text,
    kind)``: ``query_id, source, id, title, kind, relevance, citation, context``.

    Sources are taken in order of rank as long as their snippets, ``snippet`` characters and dots where more would follow, fit
    into four characters a token; the first that doesn't ends the context. A window by query over its hits, never by source.
    """
    text = F.coalesce("text", F.lit(""))
    x = hits.join(docs, "id").withColumn("snippet", F.concat(F.left(text, F.lit(snippet)), F.when(F.length(text) > snippet, "...").otherwise("")))
    used = F.sum(F.length("snippet")).over(Window.partitionBy("query_id").orderBy("rank"))
    x = x.withColumn("used", used).filter(F.col("used") <= max_tokens * 4)
    title = F.coalesce("title", F.concat(F.lit("Source "), F.col("rank").cast("string")))
    return x.select("query_id", F.col("rank").alias("source"), "id", title.alias("title"), "kind", "score", F.left("snippet", F.lit(cited)).alias("citation"), F.format_string("[Source %d: %s]\n%s\n", "rank", title, "snippet").alias("context"))


def prompts(context: DataFrame, queries: DataFrame) -> DataFrame:
    """The text that a model is asked with, for each query (``query_id, query``), from its context."""
    parts = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "context"))), lambda c: c["context"]), "\n").alias("context"), F.count(F.lit(1)).alias("num_sources"))
    head = F.lit("Use the following context to answer the user's question. Cite sources using [1], [2], etc. when referencing information.\n\nContext:\n")
    x = queries.join(parts, "query_id", "left")
    return x.select("query_id", F.concat(head, F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "query").alias("prompt"), F.coalesce("num_sources", F.lit(0)).alias("num_sources"))


def notice_digest(notices: DataFrame, as_of: Column, days: int = 1, most: int = 50) -> DataFrame:
    """Of each user's notices (``id, user_id, kind, priority, read, at``) in the ``days`` up to ``as_of``: how many, how many
    unread, by kind and by priority (a missing one is medium), and the first ``most`` identifiers in order of time."""
    x = notices.filter((F.col("at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("at") <= as_of)).withColumn("priority", F.coalesce("priority", F.lit("medium")))
    base = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_count"), F.count(F.when(~F.coalesce("read", F.lit(False)), 1)).alias("unread_count"))

    def counted(column: str, name: str) -> DataFrame:
        n = x.groupBy("user_id", column).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", column, "n"))), ",").alias(name))

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "id"))
    items = x.withColumn("p", place).filter(F.col("p") <= most).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "id"))), lambda e: e["id"].cast("string")), ",").alias("items"))
    return base.join(counted("kind", "by_type"), "user_id").join(counted("priority", "by_priority"), "user_id").join(items, "user_id")


# Seconds after which an integration is due, by frequency; any other is daily, and manual ones never are.
INTERVALS = {"realtime": 300, "hourly": 3_600, "daily": 86_400, "weekly": 604_800}


def integration_health(connections: DataFrame, syncs: DataFrame, as_of: Column) -> DataFrame:
    """Health of each connection (``user_id, provider, status, enabled, frequency, token_expires_at``) at ``as_of`` from its log
    of ``syncs(user_id, provider, at, id, success)``.

    ``sync_errors`` are the failures since the last success, ``recent_failures`` those of the last five; an expired token makes
    the status so. Healthy: connected, token not expired, fewer than three errors. ``needs_sync``: connected, enabled, not
    manual, and never synchronised or last so long ago that it's due. ``advice`` has the letters of what to do: token,
    failures, error state, disabled.
    """
    keys = ["user_id", "provider"]
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("id")))
    log = syncs.filter(F.col("at") <= as_of).withColumn("back", back).groupBy(*keys).agg(
        F.count(F.when((F.col("back") <= 5) & ~F.col("success"), 1)).alias("recent_failures"), (F.coalesce(F.min(F.when(F.col("success"), F.col("back"))), F.count(F.lit(1)) + 1) - 1).alias("sync_errors"),
        F.max(F.when(F.col("success"), F.col("at"))).alias("last_sync"),
    )
    x = connections.join(log, keys, "left").fillna(0, ["recent_failures", "sync_errors"])
    expired = F.coalesce(as_of >= F.col("token_expires_at"), F.lit(False))
    status = F.when(expired, "expired").otherwise(F.col("status"))
    table = F.create_map(*[F.lit(v) for kv in INTERVALS.items() for v in kv])
    due = F.unix_timestamp(as_of) - F.unix_timestamp("last_sync") >= F.coalesce(table[F.col("frequency")], F.lit(INTERVALS["daily"]))
    needs = (status == "connected") & F.col("enabled") & (F.col("frequency") != "manual") & F.coalesce(due, F.lit(True))
    advice = [F.when(expired, "token"), F.when(F.col("recent_failures") >= 3, "failures"), F.when(F.col("sync_errors") >= 3, "errors"), F.when(~F.col("enabled"), "disabled")]
    return x.select(*keys, status.alias("status"), ((status == "connected") & (F.col("sync_errors") < 3)).alias("healthy"), expired.alias("token_expired"), "sync_errors", "recent_failures", needs.alias("needs_sync"), F.concat_ws(",", *advice).alias("advice"))
