"""Inferred relationships, reports of communities and collaborators, by hand and against loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daytrace.operators import graph as G
from daytrace.operators import inference as I
from daytrace.operators import reports as P
from daytrace.streaming import activities as A

NOW = datetime(2026, 2, 9, 12)


def test_relations_by_hand(spark):
    links = spark.createDataFrame([(a, e) for a in (1, 2) for e in (10, 20, 30)] + [(3, 10), (3, 20), (4, 10), (4, 40), (5, 10), (5, 40), (2, 20)], "activity_id long, entity_id long")
    acts = spark.createDataFrame([(1, "code_edit", None, NOW - timedelta(days=2)), (2, None, 2.0, NOW - timedelta(days=1, hours=1)), (3, "social_media", 1.0, NOW - timedelta(days=91)), (4, "odd", 1.0, NOW), (5, "odd", 1.0, NOW)], "activity_id long, type string, importance double, at timestamp")
    kinds = spark.createDataFrame([(10, "person", True), (20, "paper", True), (30, "topic", None), (40, "tool", True)], "id long, kind string, known boolean")
    got = {(r.from_id, r.to_id, r.rel_type): (r.n, r.weight, r.confidence) for r in I.inferred_relations(links, acts, kinds, I.pair_table(spark), F.lit(NOW)).collect()}
    weight = (1 + math.log10(2)) * math.exp(-0.693 / 365) * (1.3 + 2.0) / 2
    assert set(got) == {(10, 20, "AUTHORED"), (10, 20, "WORKS_ON"), (10, 30, "WORKS_ON"), (20, 30, "ON_TOPIC")}
    for key, known in (((10, 20, "AUTHORED"), 0.1), ((10, 30, "WORKS_ON"), 0.0)):
        n, w, c = got[key]
        assert n == 2 and abs(w - weight) < 1e-12 and abs(c - (0.6 + weight * 0.05 + known + 0.1)) < 1e-12
    assert I.inferred_relations(links, acts, kinds, I.pair_table(spark), F.lit(NOW), least_confidence=0.85).count() == 2


def test_report_of_two_cliques(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, 3, 1), (2, 3, 1), (4, 5, 2), (3, 4, 1)], "src long, dst long, weight long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, label long")
    kinds = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "id long, kind string")
    got = {r.label: r for r in I.community_report(edges, labels, kinds).collect()}
    assert (got[1].size, got[1].density, got[1].dominant_type, got[1].types) == (3, round(5 / 3, 3), "a", "a:2,b:1")
    assert (got[4].size, got[4].density, got[4].dominant_type, got[4].types) == (2, 2.0, "b", "b:1,unknown:1")
    whole = G.modularity(edges, labels).first()[0]
    assert abs(sum(r.modularity for r in got.values()) - whole) < 1e-12 and abs(got[1].modularity - (10 / 16 - (11 / 16) ** 2)) < 1e-12


def test_collaborators_against_all_pairs(spark):
    draw = random.Random(4)
    skills = {u: set(draw.sample("abcd", draw.randrange(1, 4))) for u in range(60)}
    met = {(u, o) for u in range(60) for o in draw.sample(range(60), draw.choice([0, 3, 30])) if u != o}
    got = {}
    rows = spark.createDataFrame([(u, s) for u, own in skills.items() for s in own], "user_id long, skill string")
    for r in P.recommend_collaborators(rows, spark.createDataFrame(sorted(met), "user_id long, other long"), 5).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.other, r.relevance))
    for u, own in skills.items():
        score = lambda o: min(1.0, len(skills[o] - own) / len(skills[o]) * 0.7 + len(skills[o] & own) / len(own) * 0.3)  # noqa: B023, E731
        want = sorted(((-score(o), o) for o in skills if o != u and (u, o) not in met))[:5]
        assert got[u] == [(o, round(-s, 4)) for s, o in want]


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_state_in_blocks(spark, block):
    draw = random.Random(block)
    rows = [(k, k % 3, NOW + timedelta(seconds=k), draw.choice(["error", "error", "view"]), k * 0.5) for k in range(120)]
    want = {}
    for _, u, _, kind, value in rows:
        v, t, a = want.get(u, (0, 0, 0))
        want[u] = (v + 1, t + int(value * 60), max(0, a - 1) if kind == "error" else a + 1)
    got = A.replay_state(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double"), block)
    assert {r.user_id: (r.version, r.total_seconds, r.active) for r in got.collect()} == want


def test_collaborators_are_looked_up_by_place(spark):
    skills = spark.createDataFrame([(u, k) for u in range(200) for k in ("a", "b")[: 1 + u % 2]], "user_id long, skill string")
    found = P.recommend_collaborators(skills, spark.createDataFrame([(0, 1), (0, 3)], "user_id long, other long"), 3)
    assert "<= needs" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.other, r.relevance) for r in found.filter("user_id = 0").orderBy("rank").collect()] == [(5, 0.65), (7, 0.65), (9, 0.65)]
