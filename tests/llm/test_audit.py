"""Decontamination, filter audit and importance resampling against plain loops, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from daytrace.llm import filter_audit, importance, positional_index
from daytrace.llm.queries import QUERIES, SQL
from helpers import same

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = [(1, "One two three four FIVE six"), (2, "word " * 12), (None, "six five"), (3, None), (4, "..."), (5, "nowhere to be found at all"), (1, "One two three four FIVE six"), (6, "line line")]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def slow_contamination(text, items, window=10):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        own = words_of(item_text)
        n = min(len(own), window)
        for s in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[s : s + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("doc", "item", "words", "term", "n")}).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, 1), (7, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op11_decontaminate", "op12_filter_audit", "op13_importance_resampling"])
def test_same_rows_as_sql(spark, sf, duck, name):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


def test_contamination_of_odd_rows(odd, items):
    got = [tuple(r) for r in positional_index.contamination(odd, items).collect() if r.doc_id != 5]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(((i, *slow_contamination(t, ITEMS)) for i, t in rows if i != 5), key=str)
    long = positional_index.contamination(odd, items).filter("doc_id = 5").first()
    assert (long.n_words, long.n_hit, long.n_items, long.contaminated) == (60_000, 60_000, 1, True)


def test_contamination_of_empty_tables(odd, none, items):
    assert positional_index.contamination(none, items).count() == 0
    clean = positional_index.contamination(odd, items.filter("item_id = -1"))
    assert clean.count() == odd.count() and clean.filter("contaminated or n_hit > 0 or n_items > 0").isEmpty()


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_contamination_of_few_different_words(spark, depth):
    """Frequent words, overlapping runs, and copies, at any number of intersected lists."""
    draw = random.Random(depth)
    text = lambda n: " ".join(draw.choice("abc") for _ in range(n))
    docs = [(i, text(draw.randrange(40))) for i in range(40)] + [(100 + i, "a b a b a b c c") for i in range(30)]
    wanted = [(i, text(draw.randrange(1, 9))) for i in range(12)]
    found = positional_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(wanted, "item_id long, text string"), window=5, depth=depth)
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, *slow_contamination(t, wanted, 5)) for i, t in docs)


def test_places_of_matches(spark):
    docs = spark.createDataFrame([(1, "... X a B c y a b"), (2, "a b c")], "doc_id long, text string")
    found = positional_index.phrase_matches(docs, spark.createDataFrame([(7, "A b C")], "item_id long, text string"), window=2)
    assert {r.doc_id: sorted(tuple(m) for m in r.matches) for r in found.collect()} == {1: [("7", 1, 2), ("7", 2, 2), ("7", 5, 2)], 2: [("7", 0, 2), ("7", 1, 2)]}


def test_index_holds_all_words_without_a_bound(odd):
    terms = positional_index.postings(odd).select("term").distinct()
    limited = positional_index.build_index(odd, terms=terms.limit(1))
    assert limited.select("term").distinct().count() == 1
    assert positional_index.build_index(odd, terms=terms.limit(1), most_terms=0).count() == sum(len(words_of(r.text)) for r in odd.select("text").collect())


def test_proximity_against_a_loop(spark):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(60)))) for i in range(25)]
    wanted = [(1, "a b c"), (2, "h"), (3, "c z"), (4, "d e d e")]
    within = 5
    found = positional_index.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(wanted, "item_id long, text string"), n_terms=3, within=within)
    want = set()
    for i, text in docs:
        words = words_of(text)
        at = {w: [p for p, x in enumerate(words) if x == w] for w in set(words)}
        for item, t in wanted:
            first, *others = dict.fromkeys(words_of(t))
            spans = {(p, p) for p in at.get(first, [])}
            for w in others:
                spans = {(min(lo, p), max(hi, p)) for lo, hi in spans for p in at.get(w, [])}
            want |= {(i, str(item), lo, hi) for lo, hi in spans if hi - lo < within}
    assert {tuple(r) for r in found.collect()} == want


def slow_audit(docs, labels):
    """Rows of (doc_id, part, text) through every order, one document at a time."""
    def fails(k, i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
            i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs),
        ][k]

    out, removals = {}, {}
    for part in {p or "" for _, p, _ in docs}:
        rows = [(i, [fails(k, i, t or "") for k in range(5)]) for i, p, t in docs if (p or "") == part]
        for order in permutations(range(5)):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [r for r in left if r[1][k]]
                lost = [sum(any(lab[0] == i and i is not None and lab[c] == 1 for lab in labels) for i, _ in gone) for c in (1, 2)]
                redundant = sum(r[1][k] for r in rows) - len(gone)
                left = [r for r in left if not r[1][k]]
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), redundant, sum(sum(r[1]) == 1 and r[1][k] for r in rows), *lost]
                removals[part, k] = removals.get((part, k), 0) + len(gone)
    return {(*key, *v, removals[key[0], "ABCDE".index(key[1][key[2] - 1])]) for key, v in out.items()}


def test_audit_against_a_loop(odd, labels, none, spark):
    docs = [tuple(r) for r in odd.select("doc_id", "lang", "text").collect()]
    got = [tuple(r) for r in filter_audit.audit(odd, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_audit(docs, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit(none, labels).count() == 0
    rows = [(k % 50 if k % 3 else None, "same text" if k % 2 else f"text {k % 7}", "xx") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {tuple(r) for r in filter_audit.audit(frame, labels.filter("doc_id = -1")).collect()}
    assert got == slow_audit([(i, p, t) for i, t, p in rows], [])


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_earlier_copies_in_blocks(spark, block):
    rows = [(k, "hot" if k % 3 else f"t{k % 10}") for k in range(300)] + [(k, None) for k in range(5)] + [(400, ""), (None, "hot"), (2, "hot"), (1, "hot")]
    found = filter_audit.earlier_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    want = [r for r in rows if r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == (r[1] or "") for o in rows)]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_copies_are_told_apart_without_their_texts(spark, monkeypatch):
    given, find = [], filter_audit.earlier_copies
    monkeypatch.setattr(filter_audit, "earlier_copies", lambda rows, *a, **k: given.append(rows) or find(rows, *a, **k))
    rows = [(1, "word " * 5_000, "en"), (2, "word " * 5_000, "en"), (3, "word " * 4_999 + "words", "en"), (4, None, "en"), (5, "", "en")]
    got = {r.doc_id: r.bits & 16 for r in filter_audit.failure_sets(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {1: 0, 2: 16, 3: 0, 4: 0, 5: 16}
    assert max(len(r.text) for r in given[0].collect()) < 120


def slow_resample(docs, target, percent=10, min_words=20):
    buckets = lambda t: [zlib.crc32(w.encode()) % 10_000 for w in words_of(t)]
    s, t = {}, {}
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets(text):
                side[b] = side.get(b, 0) + 1
    n, m = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        own = buckets(text)
        weight = sum(math.floor(1000 * math.log((t.get(b, 0) + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = percent * len(fit) // 100
    return sorted([(*r, k) for k, r in enumerate(fit[:drawn], 1)] + [(*r, None) for r in fit[drawn:]] + [(*r, None) for r in rows if r[1] < min_words], key=str)


@pytest.mark.parametrize("percent,least", [(10, 20), (100, 1), (50, 0), (0, 0)])
def test_resampling_against_a_loop(odd, none, items, percent, least):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = importance.resample(odd, items, percent, least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_resample(docs, [t for _, t in ITEMS], percent, least)
    assert importance.resample(none, items).count() == 0


def test_resampling_of_ties(spark, items):
    """A third of the rows are one row repeated, so that the cut falls among them."""
    docs = [(5, "a b c " * 9)] * 40 + [(k, "d e f " * 9) for k in range(80)] + [(None, "a b c " * 9)] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for percent in (3, 20, 45, 80):
        got = sorted((tuple(r) for r in importance.resample(frame, items, percent).collect()), key=str)
        assert got == slow_resample(docs, [t for _, t in ITEMS], percent)


def test_cutoff_by_bisection(spark):
    rows = spark.createDataFrame([(v,) for v in (-7, -7, -7, 0, 3, 3, 90)], "v long")
    found = [importance.bisect_cutoff(rows, F.col("v"), k) for k in range(9)]
    assert found == [None, 90, 3, 3, 0, -7, -7, -7, None]


def test_features_of_longer_runs():
    crc = lambda t: zlib.crc32(t.encode()) % 100
    assert importance.features("Ab c\x00É".encode(), 2, 100).tolist() == [crc("ab"), crc("c"), crc("É"), crc("ab c"), crc("c É")]
    assert importance.features(None, 3, 100).tolist() == []
