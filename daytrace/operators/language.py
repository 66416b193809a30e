"""Language of texts by ranked profiles of character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import bounded, cut_lineage

FALLBACK, SHORT = "en", 10  # fixed values: texts under ten characters are English
_WORD = re.compile(r"[^\W\d_]+")
_BITS, _STEP = 21, 1 << 18  # bits of a code point, and how many characters are taken apart at a time
WORDS = 100_000  # distinct words that a task counts before it takes them apart
PROFILED = 100_000  # rows of profiles that are sent to every task; more are joined


def grams(words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of 1 to 3 characters within ``words``, with a blank at both ends of a word, and how often each occurs if the words
    do once or ``times``. A run is a number, its code points plus one in 21 bits each from the left, so that numbers have the
    order of the strings.

    The characters get places in the alphabet of these words, blank first, and a run the number that its places make. What
    runs over the two blanks between words is counted too and left out at the end.
    """
    text = f" {'  '.join(words)} "
    chars, alphabet = (np.frombuffer(x.encode("utf-32-le"), np.int32) for x in (text, "".join(sorted({*text}))))
    weights = None if times is None else np.repeat(times, np.fromiter(map(len, words), np.int64, len(words)) + 2)
    base = len(alphabet) + 1
    dense = base**3 <= 64 * len(chars)
    found, sums = [], np.zeros(base**3 if dense else 0, np.int64)
    for start in range(0, len(chars), _STEP):
        at = np.searchsorted(alphabet, chars[start : start + _STEP + 2]) + 1
        here = min(_STEP, len(at))
        one = at[:here] * base**2
        two = one[: len(at) - 1] + at[1 : here + 1] * base
        three = two[: len(at) - 2] + at[2 : here + 2]
        runs = np.concatenate([one, two, three])
        n = None if weights is None else np.concatenate([weights[start : start + len(x)] for x in (one, two, three)])
        if dense:
            sums += np.bincount(runs, n, len(sums)).astype(np.int64)
        else:
            runs, back = np.unique(runs, return_inverse=True)
            found.append((runs, np.bincount(back, n).astype(np.int64)))
    if dense:
        runs = np.flatnonzero(sums)
        sums = sums[runs]
    else:
        runs, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)
    a, b, c = runs // base**2, runs // base % base, runs % base
    within = ~((a == 1) & (b <= 1) | (b == 1) & (c == 1))
    point = np.concatenate([[0], alphabet.astype(np.int64) + 1])
    return (point[a] << 2 * _BITS | point[b] << _BITS | point[c])[within], sums[within]


def _text(code: int) -> str:
    found = (code >> 2 * _BITS, code >> _BITS & (1 << _BITS) - 1, code & (1 << _BITS) - 1)
    return "".join(chr(c - 1) for c in found if c)


def _code(gram: str) -> int:
    return sum(ord(c) + 1 << _BITS * (2 - i) for i, c in enumerate(gram))


def _first(text: str, most: int) -> np.ndarray:
    """The ``most`` most frequent runs of a text; equal counts in order of the run."""
    codes, n = grams(_WORD.findall(text.lower()))
    if len(n) > most:
        near = n >= np.partition(n, -most)[-most]
        codes, n = codes[near], n[near]
    return codes[np.argsort(-n, kind="stable")[:most]]


def language_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 300) -> DataFrame:
    """``lang, gram, rank``: the ``most`` most frequent n-grams of all texts of each language; ties in order of the n-gram.

    Each task counts its texts' words by language, takes each distinct word apart once, and sums the n-grams before anything
    is shuffled. Null texts and languages don't count.
    """

    def task(batches):
        words: dict[str, Counter] = {}

        def taken_apart():
            for lang, counts in words.items():
                codes, n = grams(list(counts), np.fromiter(counts.values(), np.int64, len(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(map(_text, codes.tolist()), pa.string()), pa.array(n)], ["lang", "gram", "n"])
            words.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
                if sum(map(len, words.values())) > WORDS:
                    yield from taken_apart()
        yield from taken_apart()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    sums = rows.mapInArrow(task, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "gram", "rank")


def detect_language(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 300, sharpness: float = 30.0) -> DataFrame:
    """``doc_id, language, probability`` of each whole text.

    A text's ``most`` most frequent n-grams are compared with each profile: an n-gram counts ``most`` less the distance of its
    two ranks, nothing if the profile hasn't got it. The language with the largest sum wins, the first by name of equal ones;
    the probabilities are those of a softmax over the sums' shares of the best possible one. Texts under ten characters,
    without letters, without an n-gram of any profile, and null ones are English with 1. Repeated rows each have a row.

    Profiles of up to ``PROFILED`` rows are sent to every task, which names its texts' languages, so nothing is shuffled;
    more are joined to the texts' n-grams.
    """
    known = cut_lineage(profiles.select("lang", "gram", "rank"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = known.limit(PROFILED + 1).collect()
    out = _named(rows, sent, most, sharpness) if len(sent) <= PROFILED else _joined(rows, known, most, sharpness)
    return out.select("doc_id", F.coalesce("language", F.lit(FALLBACK)).alias("language"), F.coalesce(F.round("probability", 3), F.lit(1.0)).alias("probability"))


def _named(rows: DataFrame, profiles: list, most: int, sharpness: float) -> DataFrame:
    """``doc_id, language, probability``, null where nothing is met; each task looks its texts' n-grams up in ``profiles``."""
    names = sorted({r.lang for r in profiles})
    place = {lang: i for i, lang in enumerate(names)}
    entries = sorted((_code(r.gram), place[r.lang], r["rank"]) for r in profiles)
    shared = rows.sparkSession.sparkContext.broadcast((names, *np.array(entries, np.int64).reshape(-1, 3).T.copy()))

    def language(text: str | None) -> tuple[str | None, float | None]:
        names, codes, langs, ranks = shared.value
        own = _first(text, most) if text is not None and len(text) >= SHORT else np.zeros(0, np.int64)
        low = np.searchsorted(codes, own)
        n = np.searchsorted(codes, own, "right") - low
        if not n.any():
            return None, None
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        counts = most - np.abs(np.repeat(np.arange(1, len(own) + 1), n) - ranks[at])
        met = np.bincount(langs[at], minlength=len(names)) > 0
        share = np.bincount(langs[at], counts, len(names)) / (len(own) * most)
        share[~met] = -np.inf
        best = int(np.argmax(share))
        return names[best], float(np.exp(share[best] * sharpness) / np.exp(share * sharpness).sum())

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [language(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "language", "probability"])

    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("language", StringType()), StructField("probability", DoubleType())])
    return rows.mapInArrow(task, schema)


def _joined(rows: DataFrame, profiles: DataFrame, most: int, sharpness: float) -> DataFrame:
    """The same by joins, for profiles that are too many to be sent."""

    def task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keys, found, ranks, sizes = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = _first(text, most).tolist()
                    keys += [key] * len(own)
                    found += map(_text, own)
                    ranks += range(1, len(own) + 1)
                    sizes += [len(own)] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array(ranks, pa.int32()), pa.array(sizes, pa.int32())], ["key", "gram", "r", "size"])

    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    own = rows.filter(F.length("text") >= SHORT).select("key", "text").mapInArrow(task, "key long, gram string, r int, size int")
    sums = own.join(bounded(profiles, PROFILED), "gram").groupBy("key", "lang").agg(F.sum(most - F.abs(F.col("r") - F.col("rank"))).alias("s"), F.max("size").alias("size"), F.countDistinct("gram").alias("grams"), F.count(F.lit(1)).alias("n"))
    # wholly repeated rows share a key, so their sums are that many times larger
    share = F.col("s") / (F.col("n") / F.col("grams")) / (F.col("size") * most)
    scored = sums.select("key", "lang", share.alias("share"))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("share")).alias("s"), "lang")).alias("best"), F.sum(F.exp(F.col("share") * sharpness)).alias("all"))
    named = best.select("key", F.col("best.lang").alias("language"), (F.exp(-F.col("best.s") * sharpness) / F.col("all")).alias("probability"))
    return rows.select("doc_id", "key").join(named, "key", "left").select("doc_id", "language", "probability")
