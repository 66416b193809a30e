"""Importance resampling of documents towards a target distribution of hashed word n-grams."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, new_folder, rows_of

#: Every byte outside 0-9, a-z and UTF-8's own becomes a space, and A-Z lower-case, in one pass.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def features(text: bytes | None, n_gram: int, buckets: int) -> np.ndarray:
    """The bucket of each feature: runs of 1 to ``n_gram`` words, joined by a space, by crc32 modulo ``buckets``."""
    words = (text or b"").translate(_WORD_BYTES).split()
    crc = zlib.crc32
    found = [np.fromiter(map(crc, words), np.int64, len(words))]
    for n in range(2, n_gram + 1):
        runs = max(len(words) - n + 1, 0)
        found.append(np.fromiter((crc(b" ".join(words[i : i + n])) for i in range(runs)), np.int64, runs))
    return np.concatenate(found) % buckets


def bucket_counts(rows: DataFrame, text_col: str, n_gram: int, buckets: int) -> DataFrame:
    """``(bucket, n)``: features of all texts in each bucket; each task sends its own sums only."""

    def task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for (texts,) in rows_of(batch, ["text"]):
                for text in texts:
                    found = features(text, n_gram, buckets)
                    for k in range(0, len(found), 1 << 16):
                        total += np.bincount(found[k : k + (1 << 16)], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    texts = rows.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    return texts.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", n_gram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log ratio of both smoothed shares, floored.

    The driver gets one number per bucket and table, ``buckets`` at most.
    """
    counts = []
    for rows in (docs, target):
        own = np.zeros(buckets, np.int64)
        for r in bucket_counts(rows, text_col, n_gram, buckets).collect():
            own[r.bucket] = r.n
        counts.append(own)
    (s, t), (all_s, all_t) = counts, [int(c.sum()) for c in counts]
    return np.array([math.floor(1000 * math.log(((int(b) + 1) * (all_s + buckets)) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, seed: str, id_col: str = "doc_id", text_col: str = "text", n_gram: int = 1) -> DataFrame:
    """``(doc_id, tx, n_words, n_features, weight, score)`` of each row; ``tx`` is a hash of the text.

    A text's weight is the sum of an array's elements at its features' buckets. The score adds noise that depends on seed
    and identifier only; a null identifier counts as the empty string there.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def task(batches):
        for batch in batches:
            for ids, hashes, texts in rows_of(batch, ["doc_id", "tx", "text"]):
                words, sizes, weights = [], [], []
                for text in texts:
                    found = features(text, n_gram, buckets)
                    n = len(found)
                    # A text of w words has w + (w-1) + ... features; its words are the first.
                    words.append(n if n_gram == 1 else len((text or b"").translate(_WORD_BYTES).split()))
                    sizes.append(n)
                    weights.append(int(shared.value[found].sum()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(x, pa.int64()) for x in (words, sizes, weights))], ["doc_id", "tx", "n_words", "n_features", "weight"])

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tx"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    weighed = chosen.mapInArrow(task, "doc_id long, tx long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def bisect_cutoff(rows: DataFrame, value: Column, most: int) -> int | None:
    """The largest whole number v such that at least ``most`` rows have ``value`` >= v; None if there are fewer rows.

    Each step is one job that counts, exactly, over all rows; only counts come to the driver.
    """
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if ends.n < most or most < 1:
        return None
    lo, hi = ends.lo, ends.hi
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if rows.filter(value >= middle).count() >= most:
            lo = middle
        else:
            hi = middle - 1
    return lo


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: str = "2024", n_gram: int = 1, buckets: int = 10_000) -> DataFrame:
    """Draw the ``percent`` of the documents with at least ``min_words`` words that score highest.

    Weights are sums over an array of gains, one per bucket. Scores are written to the shared folder once; numeric
    bisection over them, an exact counting job each, finds the score at which the draw ends, and among the rows tied at
    that score the identifier at which it ends. Drawn rows are partitioned by ranges of score and identifier, and each
    partition numbers its own, from the sum of the partitions before it.

    Returns ``doc_id, n_features, weight, score, rank``, one row per document; rank is null for those not drawn. Ties go to
    the smaller identifier, nulls last, then to a hash of the text; wholly repeated rows are interchangeable. A null or
    empty text has no features and a weight of 0. Very long texts count whole. An empty table gives no rows, and an empty
    target is a uniform one. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    gain = gains(docs, target, n_gram=n_gram, buckets=buckets)
    folder = new_folder(spark, "importance-scores")
    scores(docs, gain, seed, n_gram=n_gram).write.parquet(folder)
    scored = spark.read.parquet(folder)
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    cutoff = bisect_cutoff(fit, F.col("score"), drawn)
    chosen = F.lit(False)
    if cutoff is not None:
        left = drawn - fit.filter(F.col("score") > cutoff).count()
        tied = fit.filter(F.col("score") == cutoff)
        # Of the tied rows the smallest identifiers are drawn, so the same search runs over their negatives.
        last = bisect_cutoff(tied, -F.col("doc_id"), left)
        upto = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= -last, F.lit(False))
        chosen = (F.col("n_words") >= min_words) & ((F.col("score") > cutoff) | ((F.col("score") == cutoff) & upto))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tx"]
    # Rows alike in all three are spread at random, which changes no result.
    ranged = scored.filter(chosen).withColumn("spread", F.rand(7)).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "part long, before long")
    ranks = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + row + 1)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranks.select(*columns).unionByName(rest.select(*columns))
