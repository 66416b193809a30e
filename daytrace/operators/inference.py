"""Relationships inferred from what occurs together, and reports on the communities of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded, cut_lineage, join_groups
from .graph import both_ways, by_pair, sized_pairs

# Which relationships a pair of kinds can have, from the first to the second, and how each is inferred.
PAIRS = [
    ("PERSON", "PERSON", "COLLABORATES_WITH", "co_occurrence"),
    ("PERSON", "PAPER", "AUTHORED", "co_occurrence"), ("PERSON", "PAPER", "WORKS_ON", "co_occurrence"),
    ("PERSON", "TOPIC", "WORKS_ON", "co_occurrence"),
    ("PERSON", "PROJECT", "WORKS_ON", "co_occurrence"), ("PERSON", "PROJECT", "CONTRIBUTES_TO", "co_occurrence"),
    ("PERSON", "ORGANIZATION", "AFFILIATED_WITH", "co_occurrence"), ("PERSON", "ORGANIZATION", "WORKS_ON", "co_occurrence"),
    ("PROJECT", "ORGANIZATION", "USES", "mention"), ("PROJECT", "ORGANIZATION", "AFFILIATED_WITH", "co_occurrence"),
    ("TOPIC", "ORGANIZATION", "RELATED_TO", "co_occurrence"),
    ("INSTITUTION", "ORGANIZATION", "RELATED_TO", "co_occurrence"),
    ("TOOL", "ORGANIZATION", "AFFILIATED_WITH", "mention"),
    ("PAPER", "PAPER", "CITES", "citation"), ("PAPER", "PAPER", "RELATED_TO", "co_occurrence"),
    ("PAPER", "TOPIC", "ON_TOPIC", "co_occurrence"),
    ("PAPER", "DATASET", "USES", "mention"), ("PAPER", "TOOL", "USES", "mention"),
    ("PAPER", "VENUE", "PUBLISHED_AT", "co_occurrence"),
    ("PROJECT", "TOPIC", "ON_TOPIC", "co_occurrence"),
    ("PROJECT", "DATASET", "USES", "mention"), ("PROJECT", "TOOL", "USES", "mention"),
    ("TOPIC", "TOPIC", "RELATED_TO", "co_occurrence"),
    ("TOOL", "TOOL", "DEPENDS_ON", "mention"),
    ("PERSON", "INSTITUTION", "AFFILIATED_WITH", "co_occurrence"),
    ("PROJECT", "INSTITUTION", "AFFILIATED_WITH", "mention"),
    ("TOPIC", "INSTITUTION", "RELATED_TO", "co_occurrence"),
    ("TOOL", "INSTITUTION", "AFFILIATED_WITH", "mention"),
    ("PAPER", "INSTITUTION", "AFFILIATED_WITH", "co_occurrence"),
]
# Strength of an activity by its type, confidence by method and boosts, decay, and the range of weights.
STRENGTH = {"reading_analytics": 1.2, "code_edit": 1.3, "document_edit": 1.2, "app_focus": 1.0, "video_watching": 0.9, "social_media": 0.7, "search_query": 1.1}
BASE = {"co_occurrence": 0.6, "citation": 0.8, "mention": 0.7}
KNOWN_BOOST, VERIFIED_BOOST, USER_BOOST, DECAY, LEAST_WEIGHT, MOST_WEIGHT = 0.1, 0.15, 0.1, 0.693, 0.1, 5.0


def pair_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "from_type string, to_type string, rel_type string, method string")


def _mapped(values: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key], F.lit(other))


def inferred_relations(links: DataFrame, activities: DataFrame, entities: DataFrame, table: DataFrame, as_of: Column, lookback_days: int = 90, least_count: int = 2, least_confidence: float = 0.5, half_life: int = 365, verified: bool = False) -> DataFrame:
    """``from_id, to_id, rel_type, method, n, weight, confidence`` from entities that occur in one activity.

    Only activities (``activity_id, type, importance, at``) of the last ``lookback_days`` count. A pair that occurs ``least_count``
    times has a weight, (1 + the logarithm of the count) times the decay since the last time times the mean strength of its
    activities, .1 to 5, and one relationship for each entry of ``table`` for its kinds (``entities``: ``id, kind, known``) in
    either direction. Confidence: by method, a twentieth of the weight, .2 at most, .1 if both are known, .15 if verified,
    .1 as a user acted; those below ``least_confidence`` are left out. An activity with very many entities is spread over
    tasks; the table of kinds is a checked broadcast.
    """
    recent = activities.filter(F.col("at") > as_of - F.make_dt_interval(F.lit(lookback_days)))
    strength = _mapped(STRENGTH, F.coalesce("type", F.lit("app_focus")), 1.0) * F.coalesce("importance", F.lit(1.0))
    used = links.select("activity_id", "entity_id").distinct().join(recent.select("activity_id"), "activity_id", "left_semi")
    met, parts = sized_pairs(used.select(F.col("activity_id").alias("u"), F.col("entity_id").alias("i")))
    met = by_pair(met.join(recent.select(F.col("activity_id").alias("u"), "at", strength.alias("s")), "u").select("src", "dst", "at", "s"), parts, "src", "dst")
    pairs = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.avg("s").alias("s")).filter(F.col("n") >= least_count)
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last")) / 86_400_000_000)
    weight = F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), (1 + F.log10("n")) * F.exp(-DECAY * age / half_life) * F.col("s")))
    pairs = cut_lineage(pairs.select("src", "dst", "n", weight.alias("weight")))
    kinds = entities.select("id", F.upper("kind").alias("kind"), F.coalesce("known", F.lit(False)).alias("known"))
    side = lambda k: kinds.select(F.col("id").alias(k), F.col("kind").alias(k + "_type"), F.col("known").alias(k + "_known"))
    x = pairs.withColumnsRenamed({"src": "from", "dst": "to"}).unionByName(pairs.withColumnsRenamed({"src": "to", "dst": "from"}))
    x = x.join(side("from"), "from").join(side("to"), "to").join(bounded(table, 1_000), ["from_type", "to_type"])
    confidence = _mapped(BASE, F.col("method"), 0.5) + F.least(F.lit(0.2), F.col("weight") * 0.05) + F.when(F.col("from_known") & F.col("to_known"), KNOWN_BOOST).otherwise(0.0) + (VERIFIED_BOOST if verified else 0.0) + USER_BOOST
    x = x.withColumn("confidence", F.least(F.lit(1.0), confidence)).filter(F.col("confidence") >= least_confidence)
    return x.select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "rel_type", "method", "n", "weight", "confidence")


def community_report(edges: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """K9: one row per community of ``labels(id, label)``: ``label, size, density, dominant_type, types, modularity``.

    ``edges`` have each pair once. Density is the weight inside over the number of pairs; the dominant kind is the most
    frequent one, of equal ones that of the smallest member; ``modularity`` is the community's part, and all add up to the
    partition's. An edge knows both communities by two joins, and all else are sums by community; a community or a vertex
    with a third of all rows is met by a broadcast of the few such.
    """
    labels = cut_lineage(labels)
    e = cut_lineage(both_ways(edges))
    total = e.agg(F.sum("weight").alias("m2"))
    sizes = cut_lineage(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("degree")).join(labels, "id"))
    held = join_groups(e, sizes.select(F.col("id").alias("src"), "n", F.col("label").alias("a")), ["src"], "n", e.count())
    near = join_groups(held.drop("n"), sizes.select(F.col("id").alias("dst"), "n", F.col("label").alias("b")), ["dst"], "n", e.count())
    inside = near.filter("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("inside"))
    members = labels.join(entities.select("id", F.col("kind")), "id", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    kinds = members.groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    kinds = kinds.groupBy("label").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "first", "kind"))["kind"].alias("dominant_type"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("types"))
    degrees = sizes.groupBy("label").agg(F.sum("degree").alias("degree"))
    x = kinds.join(inside, "label", "left").join(degrees, "label", "left").fillna(0, ["inside", "degree"]).crossJoin(F.broadcast(total))  # one row
    possible = F.col("size") * (F.col("size") - 1) / 2
    density = F.when(possible > 0, F.round(F.col("inside") / 2 / possible, 3)).otherwise(0.0)
    part = F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2))
    return x.select("label", "size", density.alias("density"), "dominant_type", "types", part.alias("modularity"))
