"""Expertise of entities and users, and sampled betweenness with a bound on its error."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .graph import dependencies

# Weights of frequency, confidence and centrality, and from which score on a level holds.
FREQUENCY, CONFIDENCE, CENTRALITY = 0.4, 0.3, 0.3
LEVELS = {"expert": 2.0, "proficient": 1.0, "intermediate": 0.5}
WEAK = 30


def expertise_rank(entities: DataFrame, centrality: DataFrame) -> DataFrame:
    """``id, user_id, expertise_score, level`` of entities (``id, user_id, frequency, confidence``): .4 of the logarithm of 1 +
    frequency, .3 of the confidence (.5 if missing), .3 of the centrality (``id, centrality``; 0 if missing)."""
    x = entities.join(centrality, "id", "left")
    score = F.log1p(F.coalesce("frequency", F.lit(1))) * FREQUENCY + F.coalesce("confidence", F.lit(0.5)) * CONFIDENCE + F.coalesce("centrality", F.lit(0.0)) * CENTRALITY
    x = x.withColumn("score", score)
    level = F.lit("beginner")
    for name, least in sorted(LEVELS.items(), key=lambda e: e[1]):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return x.select("id", "user_id", F.round("score", 3).alias("expertise_score"), level.alias("level"))


def profile_gaps(skills: DataFrame, target: DataFrame) -> DataFrame:
    """Each user's skills (``user_id, skill, score``) against a target profile (``skill, required``): one row a user, with the
    missing, weak (more than 30 below), matched and strong skills in order of their gaps, and the share that is met."""
    wanted = target.select(F.collect_list(F.struct(F.lower("skill").alias("skill"), F.col("required").cast("double").alias("required"))).alias("wanted"))
    own = skills.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("skill"), F.col("score")))).alias("own"))
    x = own.crossJoin(F.broadcast(wanted))  # one row
    gaps = F.transform("wanted", lambda w: F.struct((w["required"] - F.coalesce(F.try_element_at("own", w["skill"]), F.lit(0.0))).alias("gap"), w["skill"].alias("skill"), F.try_element_at("own", w["skill"]).isNull().alias("none")))
    x = x.withColumn("gaps", gaps)
    kind = {"missing": lambda g: g["none"], "weak": lambda g: ~g["none"] & (g["gap"] > WEAK), "matched": lambda g: ~g["none"] & (g["gap"] > 0) & (g["gap"] <= WEAK), "strong": lambda g: ~g["none"] & (g["gap"] <= 0)}
    of = {k: F.filter("gaps", f) for k, f in kind.items()}
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda g: F.struct((-g["gap"]).alias("g"), g["skill"].alias("skill")))), lambda g: g["skill"]), ",")
    met = F.size(of["matched"]) + F.size(of["strong"])
    return x.select("user_id", *[ordered(c).alias(k) for k, c in of.items()], F.round(met / F.greatest(F.size("wanted"), F.lit(1)) * 100, 1).alias("readiness"))


def sampled_betweenness(edges: DataFrame, error: float = 0.05, confidence: float = 0.95, step: int = 64, most: int | None = None, block: int = 4096) -> DataFrame:
    """K3: ``id, betweenness, bound, sources``: betweenness from as many sources as the wanted error asks for.

    Betweenness here is the sum over sources of the share of their shortest paths through a vertex, over all vertices' pairs,
    0 to 1. Sources come in order of a hash, ``step`` at first and twice as many each time, but no more than ``block`` at once; after each time the empirical
    Bernstein bound on the mean of a vertex's shares, at the given confidence for all vertices and times together, is
    compared with ``error``, and the sampling ends when no vertex's bound is above it. When all vertices were sources the
    result is exact and the bound 0. Sums and squares are kept by vertex; each time adds its own.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    ids = cut_lineage(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    n = ids.count()
    if n < 3:
        return ids.select("id", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("bound"), F.lit(n).cast("long").alias("sources"))
    share = 1 / (n - 2)
    times = max(1, math.ceil(math.log2(n / step)) + 1) + n // block
    log = math.log(3 * n * times / (1 - confidence))
    placed = cut_lineage(ids.withColumn("place", F.xxhash64("id", F.lit(11))))
    sums, done, taken, low = None, 0, step, None
    while True:
        cut = placed.orderBy("place").limit(min(taken, n)).agg(F.max("place")).first()[0]
        batch = placed.filter((F.col("place") <= cut) & (F.lit(True) if low is None else F.col("place") > low))
        got = batch.count()
        rows = dependencies(e, batch, None).select("id", (F.col("dep") * share).alias("x"))
        part = rows.groupBy("id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        sums = written(part if sums is None else sums.union(part).groupBy("id").agg(F.sum("s").alias("s"), F.sum("q").alias("q")), "sums")
        done, low = done + got, cut
        mean = F.coalesce(F.col("s") / done, F.lit(0.0))
        variance = F.greatest(F.coalesce(F.col("q") / done, F.lit(0.0)) - mean * mean, F.lit(0.0))
        exact = done >= n
        bound = F.lit(0.0) if exact else F.sqrt(2 * variance * log / done) + 3 * log / done
        out = ids.join(sums, "id", "left").select("id", mean.alias("betweenness"), bound.alias("bound"), F.lit(done).cast("long").alias("sources"))
        if exact or (most is not None and done >= most) or out.agg(F.max("bound")).first()[0] <= error:
            return out
        taken = min(done * 2, done + block)
