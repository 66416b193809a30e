"""Enrichment of activities: tags, mentions, normalised names, events, upserts of entities and edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once

# Type names of older clients; acronyms.
OLD_TYPES = {"page_view": "web_visit", "tab_focus": "web_visit", "window_focus": "app_focus"}
ACRONYMS = ["api", "sql", "aws", "gcp", "ml", "ai", "nlp", "ui", "ux"]


def normalise_ingest(events: DataFrame, ip: Column) -> DataFrame:
    """A1: current type names, fields of the context as columns, and the client's address as 16 hex digits."""
    table = F.create_map(*[F.lit(x) for kv in OLD_TYPES.items() for x in kv])
    kind = F.coalesce(F.element_at(table, F.col("type")), F.col("type"))
    return events.withColumn("type", kind).withColumn("ip_hash", F.substring(F.sha2(ip, 256), 1, 16))


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes or edges (``name, seen, first_seen``) after a merge: the newest name that isn't null, and the
    earliest and latest times; of equal times the new row's."""
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("name").isNotNull(), F.struct("seen", "side", "name")))["name"].alias("name"), F.min("first_seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def normal_name(name: Column) -> Column:
    """H8: blanks put right, possessive cut off, first letters in capitals; known acronyms in capitals throughout."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, r"[ \t\n\r]+", " ")), r"'s$", "")
    return F.when(F.lower(clean).isin(ACRONYMS), F.upper(clean)).otherwise(F.initcap(clean))


def event_records(acts: DataFrame) -> DataFrame:
    """``activity.created`` records as flat maps of text, as a sink takes them."""
    payload = F.create_map(F.lit("activity_id"), F.col("id").cast("string"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("type"), F.col("type"))
    return acts.select(F.lit("activity.created").alias("event"), F.to_json(payload).alias("payload"), F.col("id").alias("sequence"))


def in_quiet_hours(at: Column, start: int, stop: int) -> Column:
    """Whether an hour is in quiet hours, which may go over midnight."""
    h = F.hour(at)
    return (h >= start) & (h < stop) if start <= stop else (h >= start) | (h < stop)


def hash_vector(text: Column, size: int = 384) -> Column:
    """A vector that stands in for an embedding: each character of the text adds its share at (code * place) mod size."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    places = F.transform(chars, lambda c, i: F.pmod(F.ascii(c) * (i + 1), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))


def snippet(text: Column, term: str, width: int = 80) -> Column:
    """``width`` characters around the first occurrence of a term, from the start if it has none."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - width // 2, F.lit(1))
    return F.substr(text, start, F.lit(width))


def detect_language(text: Column, profiles: Mapping[str, list[str]], default: str = "en") -> Column:
    """The language with most of its common words in the text; the first in order of name of equal ones, the
    default without any or for a text under 10 characters."""
    every = sorted({w for common in profiles.values() for w in common})
    known = F.filter(F.split(F.lower(text), r"[^a-zà-ÿß]+"), lambda w: w.isin(every))

    def named(words: Column) -> Column:
        votes_for = lambda common: F.size(F.filter(words, lambda w: w.isin(common)))
        votes = F.array(*[F.struct((-votes_for(common)).alias("n"), F.lit(name).alias("name")) for name, common in sorted(profiles.items())])
        return once(F.array_min(votes), lambda best: F.when(best["n"] == 0, default).otherwise(best["name"]))

    return F.when((F.length(text) < 10) | text.isNull(), default).otherwise(once(known, named))


def session_pairs(links: DataFrame, minutes: int = 30, least: int = 2) -> DataFrame:
    """Ordered pairs of different items of one user whose activities start at most ``minutes`` apart: how often, when
    last, and a confidence of .55 + .05 for each, .85 at most.

    ``links``: ``user_id, t (seconds), seq, item``. A range join: times are dealt into buckets of the window's width and
    each row meets its own bucket and the next one.
    """
    width = minutes * 60
    rows = links.withColumn("slot", F.floor(F.col("t") / width))
    a = rows.select("user_id", F.col("item").alias("from_item"), F.col("t").alias("ta"), F.col("seq").alias("sa"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    b = rows.select("user_id", F.col("item").alias("to_item"), F.col("t").alias("tb"), F.col("seq").alias("sb"), "slot")
    later = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("sb") > F.col("sa")))
    hits = a.join(b, ["user_id", "slot"]).filter(later & (F.col("tb") - F.col("ta") <= width) & (F.col("from_item") != F.col("to_item")))
    x = hits.groupBy("user_id", "from_item", "to_item").agg(F.count(F.lit(1)).alias("n"), F.max("ta").alias("last")).filter(F.col("n") >= least)
    return x.withColumn("confidence", F.least(F.lit(0.85), 0.55 + F.col("n") * 0.05))


def prerequisites(pairs: DataFrame, topics: DataFrame, least: float = 0.3) -> DataFrame:
    """Of a strong pair, the topic seen first comes before the other; without dates, the more frequent one."""
    t = topics.select("id", "first_seen", "occurrence_count")
    x = pairs.filter(F.col("strength") >= least).join(t.withColumnsRenamed({"id": "src", "first_seen": "fa", "occurrence_count": "na"}), "src").join(t.withColumnsRenamed({"id": "dst", "first_seen": "fb", "occurrence_count": "nb"}), "dst")
    dated = F.col("fa").isNotNull() & F.col("fb").isNotNull()
    first = F.when(dated, F.col("fa") < F.col("fb")).otherwise(F.col("na") >= F.col("nb"))
    confidence = F.least(F.lit(1.0), F.col("strength") * (1 + F.log1p("weight") * 0.1))
    return x.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("prerequisite"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("advanced"), F.col("weight").alias("n"), F.round("strength", 6).alias("strength"), F.round(confidence, 6).alias("confidence"), F.when(dated, "temporal").otherwise("frequency").alias("basis"))


def valid_edges(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges with ``valid`` set if their (type, from type, to type) is allowed."""
    ok = allowed.select("rel_type", "from_type", "to_type").distinct().withColumn("valid", F.lit(True))
    return edges.join(ok, ["rel_type", "from_type", "to_type"], "left").fillna(False, ["valid"])


def strength_fold(links: DataFrame) -> DataFrame:
    """I8: strength of each pair over its activities in order: .9, .7 or .5 by mean relevance at first, then the mean of
    the old and the new one; with count."""
    level = lambda r: F.when(r >= 0.95, 0.9).when(r >= 0.9, 0.7).otherwise(0.5)
    a, b = links.select("activity_id", F.col("entity_id").alias("a"), F.col("relevance_score").alias("ra")), links.select("activity_id", F.col("entity_id").alias("b"), F.col("relevance_score").alias("rb"))
    rows = a.join(b, "activity_id").filter("a < b").select("a", "b", F.struct("activity_id", level((F.col("ra") + F.col("rb")) / 2).alias("s")).alias("x"))
    g = rows.groupBy("a", "b").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    fold = F.aggregate("xs", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x["s"]).otherwise((s + x["s"]) / 2))
    return g.select("a", "b", fold.alias("strength"), F.size("xs").cast("long").alias("n"))


def cumulative_new(first_seen: DataFrame, days: int = 30) -> DataFrame:
    """New items by user and bucket of ``days`` since the user's first, and their running number."""
    start = F.min("first_seen").over(Window.partitionBy("user_id"))
    x = first_seen.withColumn("bucket", F.floor(F.datediff("first_seen", start) / days)).groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("new"))
    return x.withColumn("total", F.sum("new").over(Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))


def expertise(entities: DataFrame) -> DataFrame:
    """log1p of the count against the user's most, with a level."""
    raw = F.log1p("occurrence_count")
    score = raw / F.max(raw).over(Window.partitionBy("user_id")) * 100
    x = entities.withColumn("score", score)
    return x.select("id", "user_id", F.round("score", 6).alias("score"), F.when(F.col("score") >= 80, "expert").when(F.col("score") >= 50, "advanced").when(F.col("score") >= 25, "intermediate").otherwise("beginner").alias("level"))


def without_recent(found: DataFrame, hours: int = 48) -> DataFrame:
    """Insights whose title the user didn't get in the ``hours`` before."""
    before = F.lag("date").over(Window.partitionBy("user_id", "title").orderBy("date"))
    return found.withColumn("before", before).filter(F.col("before").isNull() | (F.datediff("date", "before") * 24 > hours)).drop("before")


def sync_health(log: DataFrame, last: int = 5, limit: int = 3) -> DataFrame:
    """Of each integration's last ``last`` syncs the failures, the failures since the last success, and its state."""
    rank = F.row_number().over(Window.partitionBy("integration").orderBy(F.desc("ts"), F.desc("id")))
    x = log.withColumn("r", rank)
    g = x.groupBy("integration").agg(F.count(F.when((F.col("r") <= last) & ~F.col("ok"), 1)).alias("recent_failures"), (F.coalesce(F.min(F.when(F.col("ok"), F.col("r"))), F.count(F.lit(1)) + 1) - 1).alias("consecutive_errors"))
    return g.withColumn("state", F.when(F.col("consecutive_errors") >= limit, "error").when(F.col("recent_failures") > 0, "degraded").otherwise("healthy"))


def uptime(samples: DataFrame) -> DataFrame:
    """Share of samples in each state, by component."""
    of = lambda s: F.round(F.avg((F.col("state") == s).cast("double")) * 100, 4)
    return samples.groupBy("component").agg(F.count(F.lit(1)).alias("samples"), of("healthy").alias("healthy_pct"), of("degraded").alias("degraded_pct"), of("unhealthy").alias("unhealthy_pct"))


def audit_summary(log: DataFrame) -> DataFrame:
    """Entries by user and action, with the last one's number."""
    return log.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("ts", "id")).alias("last_id"))
