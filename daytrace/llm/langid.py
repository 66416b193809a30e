"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of

UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once for each worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTER[0]


def features(text: str, bits: int, size: int = 1 << 18):
    """Hashed 1- to 3-grams of the lower-cased letters, with one space for each run of others, in arrays of a bounded
    length; an n-gram is whole even across two of them. Nothing for a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    mul, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    for start in range(0, len(points) - 2, size):
        p = points[start : start + size + 2]
        one, two = p[:-2], p[:-2] | (p[1:-1] << np.uint64(21))
        three = two | (p[2:] << np.uint64(42))
        yield np.concatenate([((x + np.uint64(n)) * mul) >> shift for n, x in ((1, one), (2, two), (3, three))]).astype(np.int64)


def train(labelled: DataFrame, label_col: str = "lang", text_col: str = "text", bits: int = 15, alpha: float = 0.1, max_labels: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels in order, the matrix of log probabilities (2**bits rows by labels) and the log prior of each label.

    Each task adds up a matrix of counts for each label; the sums come to the driver, 2**bits rows for each of the
    ``max_labels`` most frequent labels (of equal counts the first) at most, so a dirty label column doesn't make the
    model grow. The prior is a label's share of the documents that have a letter. Rows without a label or a letter give
    nothing. Without any row, there are no labels.
    """
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).filter("label is not null and text is not null")
    frequent = [r.label for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()]

    def task(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for labels, texts in rows_of(batch, ["label", "text"]):
                for label, text in zip(labels, texts):
                    for n, f in enumerate(features(text or "", bits)):
                        if label not in sums:
                            sums[label] = np.zeros(1 << bits, np.int64)
                        sums[label] += np.bincount(f, minlength=1 << bits)
                        docs[label] = docs.get(label, 0) + (n == 0)
        for label, c in sums.items():
            at = np.flatnonzero(c)
            k, n = np.append(at, -1), np.append(c[at], docs[label])
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(k)), pa.array(k), pa.array(n)], ["label", "k", "c"])

    counted = rows.filter(F.col("label").isin(frequent)) if frequent else rows.limit(0)
    got = counted.mapInArrow(task, "label string, k long, c long").groupBy("label", "k").agg(F.sum("c").alias("c")).toPandas()
    labels = sorted(got["label"].unique())
    counts, docs = np.full((1 << bits, len(labels)), alpha), np.zeros(len(labels))
    for i, label in enumerate(labels):
        own = got[(got["label"] == label) & (got["k"] >= 0)]
        counts[own["k"].to_numpy(np.int64), i] += own["c"].to_numpy(np.float64)
        docs[i] = got[(got["label"] == label) & (got["k"] < 0)]["c"].sum()
    return labels, np.log(counts / counts.sum(axis=0)) if labels else counts, np.log(docs / docs.sum()) if labels else docs


def scores(texts: list[str | None], matrix: np.ndarray, prior: np.ndarray, bits: int, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Log joint probabilities of each text with each label, and whether the text has a letter.

    Texts and their n-grams form a sparse matrix of counts in compressed rows (the n-gram numbers of all texts one after
    the other, and where each text starts); its product with the model is taken for about ``size`` n-grams at a time.
    """
    total, known = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool)
    columns: list[np.ndarray] = []
    rows: list[int] = []
    held = 0

    def add() -> None:
        starts = np.cumsum([0, *map(len, columns[:-1])])
        np.add.at(total, rows, np.add.reduceat(matrix[np.concatenate(columns)], starts, axis=0))
        columns.clear()
        rows.clear()

    for i, text in enumerate(texts):
        for f in features(text or "", bits):
            known[i] = True
            columns.append(f)
            rows.append(i)
            held += len(f)
            if held >= size:
                add()
                held = 0
    if columns:
        add()
    return total, known


def predictor(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray], bits: int = 15):
    """A column function from text to ``struct<lang_pred, score>``: the likeliest label and its posterior probability.

    The matrix of log probabilities, 2**bits rows by 256 labels at most whatever the corpus' size, is broadcast; texts are
    scored in batches by a sparse product in numpy. A null text, one without a letter, and any text when there are no
    labels are "und" with score 0. Of equal scores the first label wins.
    """
    labels = model[0]
    shared = spark.sparkContext.broadcast(model[1:])

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        if not labels:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)})
        best, score = [], []
        for start in range(0, len(texts), 256):
            total, known = scores(list(texts[start : start + 256]), *shared.value, bits)
            k = total.argmax(axis=1)
            posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            best += [labels[i] if ok else UNKNOWN for i, ok in zip(k, known)]
            score += np.where(known, posterior, 0.0).tolist()
        return pd.DataFrame({"lang_pred": best, "score": score})

    return guess


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = 15) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; repeated rows get equal results, other columns are not looked at."""
    guess = predictor(docs.sparkSession, model, bits)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), guess(F.col(text_col)).alias("x")).select("doc_id", "x.lang_pred", "x.score")


def held_out(id_col: str = "doc_id"):
    """True for the third of documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def share_bound(rows: int, most: int) -> int | None:
    """The bound below which a 63-bit hash is chosen so that about ``most`` of ``rows`` rows are; None where all are."""
    return None if rows <= most else max(1, (most << 63) // rows)


def training_rows(docs: DataFrame, max_train_docs: int = 30_000) -> DataFrame:
    """About ``max_train_docs`` labelled rows at most that aren't held out, chosen by a hash of identifier and text.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; rows with a null text or label are not chosen, a null identifier is as
    good as any, repeated rows are chosen together, very long texts are used whole. An empty table gives no rows. Other
    columns stay and are not looked at. The bound of 63 bits holds for any number of rows; labelled rows of which none
    is chosen are an error.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    bound = share_bound(rows.count(), max_train_docs)
    if bound is None:
        return rows
    chosen = rows.filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) < bound)
    if chosen.isEmpty():
        raise ValueError("no labelled row was chosen for training; raise max_train_docs")
    return chosen


def identify(docs: DataFrame, max_train_docs: int = 30_000) -> DataFrame:
    """Train on labelled documents that aren't held out and predict every document: ``doc_id, held_out, lang_pred, score``.

    One row per input row; repeated rows get equal results. A null text, an empty one or one without a letter is "und"
    with score 0, as is every text where no document has a label. A null identifier is not held out. Of labels with equal
    scores the first in order wins. Very long texts count whole, in pieces of bounded size. An empty table gives no rows.
    Columns other than ``doc_id``, ``text`` and ``lang`` are not looked at, whatever their names.
    """
    model = train(training_rows(docs, max_train_docs))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
