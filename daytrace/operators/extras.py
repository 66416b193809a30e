"""Bundles of a user's rows, ranking with recency, resolution by alias, recommended paths and gaps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded
from .search import top_k


def bundle(tables: Mapping[str, DataFrame], users: list[int] | None = None) -> DataFrame:
    """Rows of the given users, or of all, from each table as JSON, with the table's name; one scan of each table."""
    parts = [(t if users is None else t.filter(F.col("user_id").isin(users))).select(F.lit(name).alias("table"), "user_id", F.to_json(F.struct(*t.columns)).alias("row")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def smart_rank(hits: DataFrame, phrase: str, k: int = 10) -> DataFrame:
    """Score plus up to 0.1 for recent documents and 0.15 for the phrase in the title; 1 at most."""
    recent = F.greatest(F.lit(0.0), 0.1 * (1 - F.col("days_old") / 365))
    title = F.when(F.contains(F.lower("title"), F.lit(phrase.lower())), 0.15).otherwise(0.0)
    return top_k(hits.withColumn("score", F.least(F.lit(1.0), F.col("score") + recent + title)), k)


def resolve_by_alias(entities: DataFrame) -> DataFrame:
    """M4: pairs of entities of a user and type that share a name (score 1) or a name with its words turned round (.9)."""
    name = F.lower("name")
    rows = entities.select("id", "user_id", "entity_type", name.alias("n"), F.explode(F.array_distinct(F.array(name, F.array_join(F.reverse(F.split(name, " ")), " ")))).alias("alias"))
    a, b = rows.withColumnsRenamed({"id": "a", "n": "na"}), rows.withColumnsRenamed({"id": "b", "n": "nb"})
    pairs = a.join(b, ["user_id", "entity_type", "alias"]).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.max(F.when(F.col("na") == F.col("nb"), 1.0).otherwise(0.9)).alias("score"))


def recommend_paths(edges: DataFrame, sources: DataFrame, known: DataFrame, depth: int = 5, k: int = 5) -> DataFrame:
    """For each source the ``k`` best targets that aren't known, by 1 / length + .1 for each known vertex on the way
    + .5 times the share of new ones; the way is the shortest, the smallest of equal ones.

    One join in each round; of the ways to a vertex only the best is carried on.
    """
    e = edges.select("src", "dst").distinct()
    best = front = sources.select(F.col("id").alias("source"), "id", F.array("id").alias("path"))
    for _ in range(depth):
        step = front.join(e, front.id == e.src).filter(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = step.groupBy("source", "id").agg(F.min("path").alias("path")).join(best.select("source", "id"), ["source", "id"], "left_anti")
        best = best.unionByName(front)
    steps = best.filter("id <> source").join(known.select("id"), "id", "left_anti").select("source", F.col("id").alias("target"), "path", F.explode("path").alias("v"))
    have = steps.join(known.select(F.col("id").alias("v"), F.lit(1).alias("has")), "v", "left").groupBy("source", "target").agg(F.count(F.lit(1)).alias("steps"), F.count("has").alias("known"))
    n, own = F.col("steps"), F.col("known")
    x = have.withColumn("score", 1 / n + 0.1 * own + 0.5 * (n - own) / n)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "target"))
    return x.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("source", "target", (n - 1).alias("hops"), F.round("score", 6).alias("score"), "rank")


def learning_gaps(acts: DataFrame, skills: DataFrame, weak_hours: float = 1.0) -> DataFrame:
    """Skills of the dimension that a user doesn't have, or has for less than ``weak_hours``."""
    from .people import skill_hours

    have = skill_hours(acts, skills).select("user_id", "skill", "hours")
    grid = acts.select("user_id").distinct().crossJoin(bounded(skills.select("skill").distinct()))
    x = grid.join(have, ["user_id", "skill"], "left").filter(F.col("hours").isNull() | (F.col("hours") < weak_hours))
    return x.select("user_id", "skill", F.when(F.col("hours").isNull(), "missing").otherwise("weak").alias("gap"), F.when(F.col("hours").isNull(), 1).otherwise(2).cast("long").alias("priority"))
