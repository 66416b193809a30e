"""Skip-gram vectors of a graph's vertices with negative sampling, trained over blocks of parameters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

PARAMETERS = "side int, bucket int, id long, vector array<float>, seen float"


def context_pairs(walks: DataFrame, window: int = 5) -> DataFrame:
    """``v, c, n``: how often vertex ``c`` is within ``window`` steps of ``v`` on the walks."""
    at = walks.select(F.posexplode("path").alias("i", "v"), "path")
    near = F.concat(F.slice("path", F.greatest(F.col("i") - window + 1, F.lit(1)), F.least(F.col("i"), F.lit(window))), F.slice("path", F.col("i") + 2, window))
    return at.select("v", F.explode(near).alias("c")).groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))


def _train(negatives: int, rate: float, batch: int, seed: int):
    """One pass over the pairs of a block: rows of both sides of parameters come in and go out changed."""

    def sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        where, starts = np.unique(rows[order], return_index=True)
        return where, np.add.reduceat(values[order], starts, axis=0)

    def task(key, parameters: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        parameters = parameters.sort_values(["side", "id"], kind="stable").reset_index(drop=True)
        sides = parameters["side"].to_numpy()
        vectors = np.stack(parameters["vector"].to_numpy()).astype(np.float32)
        seen = parameters["seen"].to_numpy().astype(np.float32)
        places = [np.flatnonzero(sides == k) for k in (0, 1)]
        loss = 0.0
        if len(pairs):
            pairs = pairs.sort_values(["v", "c"], kind="stable")
            ids = parameters["id"].to_numpy()
            u, c = (places[k][np.searchsorted(ids[places[k]], pairs[name].to_numpy())] for k, name in ((0, "v"), (1, "c")))
            weight = pairs["w"].to_numpy().astype(np.float32)
            often = np.bincount(np.searchsorted(places[1], c), weights=pairs["n"].to_numpy(), minlength=len(places[1])) ** 0.75
            draw = np.random.default_rng([seed, *(int(k) for k in key)])
            for part in np.array_split(draw.permutation(len(pairs)), math.ceil(len(pairs) / batch)):
                a, b, w = u[part], c[part], weight[part]
                no = places[1][draw.choice(len(places[1]), 64, p=often / often.sum())]
                x, y, z = vectors[a], vectors[b], vectors[no]
                hit, miss = 1 / (1 + np.exp(-(x * y).sum(axis=1))), 1 / (1 + np.exp(-(x @ z.T)))
                share = negatives / len(no)
                loss += float(-(w * np.log(hit + 1e-9)).sum() - share * (w[:, None] * np.log(1 - miss + 1e-9)).sum())
                pull, push = (w * (1 - hit))[:, None], w[:, None] * miss * share
                rows, gradient = sums(np.concatenate([a, b, no]), np.concatenate([pull * y - push @ z, pull * x, -(push.T @ x)]))
                seen[rows] += (gradient * gradient).mean(axis=1)
                vectors[rows] += rate * gradient / np.sqrt(seen[rows] + 1e-8)[:, None]
        out = parameters[["side", "bucket", "id"]].assign(vector=list(vectors), seen=seen)
        report = pd.DataFrame({"side": [2], "bucket": [int(key[0])], "id": [len(pairs)], "vector": [np.array([loss], np.float32)], "seen": [np.float32(0)]})
        return pd.concat([out, report])

    return task


def skip_gram(pairs: DataFrame, size: int = 128, epochs: int = 5, negatives: int = 5, rate: float = 0.1, block: int = 4096, block_pairs: int = 2_000_000, batch: int = 4096, seed: int = 7) -> tuple[DataFrame, list[float]]:
    """``id, vector`` (of unit length) from context pairs ``v, c, n``, and the loss of each epoch.

    Vertices are dealt into buckets by a hash. A pair belongs to the block of its vertex's and its context's bucket; in each
    round every task holds one bucket of vertices, another one of contexts and the pairs of that block alone, and no two
    tasks share a parameter. With k buckets an epoch has k rounds, each one job that reads the parameters' table and writes
    the next one, so neither the vocabulary nor the vectors are ever in one place. Buckets are as many as keep a bucket to
    about ``block`` vertices and a block to about ``block_pairs`` pairs.

    A pass goes over each pair once, weighted by its count over the mean, with ``negatives`` negative samples that a batch
    shares, drawn from the block's contexts by their counts to the power of .75, and row-wise adaptive steps. Draws depend on
    seed, round and bucket only. The driver sees one number a round.
    """
    pairs = written(pairs.select(F.col("v").cast("long").alias("v"), F.col("c").cast("long").alias("c"), F.col("n").cast("double").alias("n")), "pairs")
    ids = written(pairs.select(F.col("v").alias("id")).union(pairs.select("c")).distinct(), "vertices")
    stats = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    if not stats.n:
        return pairs.sparkSession.createDataFrame([], "id long, vector array<double>"), []
    k = max(1, math.ceil(ids.count() / block), math.ceil(math.sqrt(stats.n / block_pairs)))
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(k)).cast("int")
    dealt = written(pairs.select("v", "c", "n", (F.col("n") / stats.mean).alias("w"), bucket("v").alias("bv"), bucket("c").alias("bc")), "pairs")
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1_000_003)) / 1_000_003 - 0.5) / size).cast("float"))
    own = ids.select(F.lit(0).alias("side"), bucket("id").alias("bucket"), "id", start.alias("vector"), F.lit(0).cast("float").alias("seen"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    parameters = written(own.union(ids.select(F.lit(1), bucket("id"), "id", zero, F.lit(0).cast("float"))), "parameters")
    losses = []
    for epoch in range(epochs):
        loss = 0.0
        for shift in range(k):
            place = F.when(F.col("side") == 0, F.col("bucket")).otherwise(F.pmod(F.col("bucket") - shift, F.lit(k))).cast("int")
            left = parameters.withColumn("place", place)
            right = dealt.filter(F.pmod(F.col("bc") - F.col("bv"), F.lit(k)) == shift).select(F.col("bv").alias("place"), "v", "c", "n", "w")
            step = left.groupBy("place").cogroup(right.groupBy("place")).applyInPandas(_train(negatives, rate, batch, seed + 1000 * epoch + shift), PARAMETERS)
            out = written(step, "parameters")
            loss += out.filter("side = 2").agg(F.sum(F.col("vector")[0])).first()[0]
            parameters = out.filter("side < 2")
        losses.append(loss)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return parameters.filter("side = 0").select("id", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("double")).alias("vector")), losses
