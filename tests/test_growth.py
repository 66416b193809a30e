"""Work and shuffles that must not grow faster than the input."""

import difflib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daytrace.functions import text as T
from daytrace.operators import duplicates as D
from daytrace.operators import enrich as E
from daytrace.operators import graph as G
from daytrace.operators import search as S
from daytrace.plans import catalog


def shuffled(spark, run):
    """Rows written to shuffles while ``run`` goes on."""

    def total():
        jvm = spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_triangles_of_ranges(spark):
    draw = random.Random(3)
    edges = {(draw.randrange(60), draw.randrange(60)) for _ in range(500)} | {(0, k) for k in range(1, 60)} | {(5, 5)}
    both = {frozenset(e) for e in edges if e[0] != e[1]}
    want = {t for t in itertools.combinations(range(60), 3) if all(frozenset(e) in both for e in itertools.combinations(t, 2))}
    frame = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, weight long")
    for block in (40, 1_000_000):
        found = [tuple(sorted((r.a, r.b, r.c))) for r in G.triangles(frame, block=block).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        counts = {}
        for r in G.triangles(frame, counted=True, block=block).collect():
            counts[r.id] = counts.get(r.id, 0) + r.n
        assert counts == {v: n for v in range(60) if (n := sum(v in t for t in want))}


def test_triangles_shuffle_no_path_of_two_edges(spark):
    n = 120
    frame = spark.createDataFrame([(a, b, 1) for a, b in itertools.combinations(range(n), 2)], "src long, dst long, weight long")
    rows = []
    paths = n * (n - 1) * (n - 2) // 6
    assert shuffled(spark, lambda: rows.extend(G.clustering(frame).collect())) < paths / 3
    assert {(r.degree, r.triangles, r.coefficient) for r in rows} == {(n - 1, (n - 1) * (n - 2) // 2, 1.0)}


def test_near_vectors_are_not_dealt_to_pairs_of_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x[500:] = x[0] * rng.uniform(0.5, 2, size=(100, 1))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    found = []
    # each vector is dealt once; each pair of alike ones, from all pairs, is found once
    assert shuffled(spark, lambda: found.extend(S.eps_pairs(rows, block=50).collect())) < 600 + 2 * 5050 + 600
    alike = [0, *range(500, 600)]
    assert sorted((r.a, r.b) for r in found) == list(itertools.combinations(alike, 2))
    chain = S.eps_pairs(rows, block=50, chained=True)
    assert chain.count() < 1500
    assert {r.id: r.cluster for r in S.dbscan(rows, chain).collect()} == {i: 0 if i in alike else -1 for i in range(600)}


def test_longest_common_subsequences():
    draw = random.Random(8)
    names = ["".join(draw.choice("abcde ") for _ in range(draw.choice([0, 1, 5, 40, 63, 64, 65, 128, 150]))) for _ in range(60)]
    codes = D.coded(names)
    for i in range(0, 60, 3):
        got = D.common_subsequences(codes[i, : len(names[i])], codes)
        for name, n in zip(names, got):
            row = [0] * (len(name) + 1)
            for c in names[i]:
                row = [0, *itertools.accumulate(zip(name, row, row[1:]), lambda left, x: max(left, x[2], x[1] + 1 if x[0] == c else 0), initial=0)][1:]
            assert n == row[-1]


def test_few_names_are_compared_by_themselves(spark, monkeypatch):
    draw = random.Random(9)
    words = ["almond", "antique", "azure", "beige", "bisque", "blanched", "burlywood", "chartreuse", "chiffon", "cornflower"]
    names = sorted({" ".join(draw.sample(words, 5)) for _ in range(150)})
    rows = pa.record_batch([pa.array([0] * len(names)), pa.array([0] * len(names)), pa.array([0] * len(names)), pa.array([0] * len(names)), pa.array(range(len(names))), pa.array(names)], ["grp", "lo", "hi", "own", "rep", "norm"])
    compared = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            compared.append(1)
            return super().ratio()

    monkeypatch.setattr(D, "SequenceMatcher", Counted)
    (found,) = D.compare_names(0.7)([rows])
    want = {(a, b) for a, b in itertools.combinations(range(len(names)), 2) if difflib.SequenceMatcher(None, names[a], names[b]).ratio() >= 0.7}
    once = len(compared)
    assert len(found) == len(next(D.compare_names(0.7)([rows]))) and len(compared) == once
    assert set(zip(*list(found.to_pydict().values())[:2])) == want and len(compared) < len(names) * (len(names) - 1) / 2 / 3


def test_texts_are_put_in_lower_case_once(spark):
    frame = spark.createDataFrame([(None,), ("Docker and Kubernetes",), ("",)], "text string")
    out = frame.select(T.topic(F.col("text")).alias("t"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(text") == 1
    assert [r.t.topic for r in out.collect()] == ["general", "DevOps and infrastructure", "general"]


def test_texts_are_split_once_for_all_languages(spark):
    frame = spark.createDataFrame([(None,), ("the cat and the dog",), ("der Hund und die Katze",), ("zzzz zzzz zzzz",), ("und",)], "text string")
    out = frame.select(E.detect_language(F.col("text"), {"de": ["der", "und"], "en": ["the", "and"]}).alias("l"))
    assert out._jdf.queryExecution().analyzed().toString().count("split(lower(text") == 1
    assert [r.l for r in out.collect()] == ["en", "en", "de", "en", "en"]


def test_sets_that_share_too_little_are_no_pairs(spark):
    draw = random.Random(4)
    sets = [(draw.randrange(2), k, draw.sample("abcdefgh", draw.randint(1, 4))) for k in range(90)] + [(0, 90, [])]
    rows = spark.createDataFrame(sets, "grp long, rep long, s array<string>")
    for share, subset in ((0.7, True), (0.4, True), (0.7, False)):
        want = set()
        for (g, a, x), (h, b, y) in itertools.combinations(sets, 2):
            k = len(set(x) & set(y))
            if g == h and x and y and (k >= share * max(len(x), len(y)) or subset and k == min(len(x), len(y))):
                want.add((a, b))
        for block in (3, 1024):
            got = [(r.a, r.b) for r in D.set_pairs(rows, share, subset, block).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD", 20)
    draw = random.Random(6)
    rows = sorted({(draw.randrange(12), draw.randrange(30)) for _ in range(150)})
    frame = spark.createDataFrame(rows, "activity_id long, entity_id long")
    met, parts = G.sized_pairs(frame.selectExpr("activity_id as u", "entity_id as i", "activity_id * entity_id as x"), 15, ("x",))
    want = {(u, a, b, u * a, u * b) for (u, a), (v, b) in itertools.combinations(rows, 2) if u == v}
    assert {(r.u, r.src, r.dst, r.x_src, r.x_dst) for r in met.collect()} == want and parts == len(want) // 20 + 1
    assert G.by_pair(met, parts, "src", "dst").rdd.getNumPartitions() == parts > 4
    counts = {}
    for _, a, b, *_ in want:
        counts[a, b] = counts.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.weight for r in G.co_occurrence(frame).collect()} == counts


def test_memory_of_a_vector_search_does_not_follow_from_the_queries():
    import tracemalloc
    from types import SimpleNamespace

    rng = np.random.default_rng(3)
    rows, n, k = rng.normal(size=(1100, 4)).round(1), 3000, 5
    shared = SimpleNamespace(value=(np.arange(n), S._unit(np.resize(rows, (n, 4)))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1100)), pa.array(rows.tolist())], ["id", "vector"])
    tracemalloc.start()
    (out,) = S._best(shared, k, 0.0)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    unit, got = S._unit(rows), {}
    for q, i, x in zip(*(c.to_pylist() for c in out.columns)):
        got.setdefault(q, []).append((-round(x, 9), i))
    for q in range(0, n, 97):
        scores = np.round(unit @ shared.value[1][q], 9)
        assert sorted(got.get(q, [])) == sorted((-s, i) for i, s in enumerate(scores.tolist()) if s >= 0 and i != q)[:k]


@pytest.mark.parametrize("query", ["c15_community_bridges", "k18_ego_stats"])
def test_co_occurrences_are_counted_once(spark, sf, monkeypatch, query):
    count, calls = G.co_occurrence, []
    monkeypatch.setattr(G, "co_occurrence", lambda links: calls.append(1) or count(links))
    assert catalog.QUERIES[query](spark, sf) is not None and len(calls) == 1


def test_inner_edges_of_sets_of_vertices(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 3, 1), (3, 4, 1), (4, 5, 1)], "src long, dst long, weight long")
    sets = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2), (5, 5, 0), (4, 3, 1), (4, 4, 0)], "source long, id long, depth int")
    assert {(r.source, r.vertices, r.edges, r.eccentricity) for r in G.subgraph_stats(edges, sets).collect()} == {(1, 3, 2, 2), (5, 1, 0, 0), (4, 2, 1, 1)}


@pytest.mark.parametrize("run", [lambda e: G.eigenvector(e, 3), lambda e: G.pagerank(e, 3)])
def test_scores_are_sent_in_parts(spark, monkeypatch, run):
    draw = random.Random(2)
    edges = [(a, b, draw.randint(1, 3)) for a, b in itertools.combinations(range(60), 2) if draw.random() < 0.8]
    frame = G.both_ways(spark.createDataFrame(edges, "src long, dst long, weight long"))
    want = {r.id: r.score for r in run(frame).collect()}
    monkeypatch.setattr(G, "SENT", 16)
    found = {}
    # the edges are dealt out by their ends once, and by no round again
    assert shuffled(spark, lambda: found.update({r.id: r.score for r in run(frame).collect()})) < 4 * 2 * len(edges)
    assert found == pytest.approx(want, abs=1e-12)
