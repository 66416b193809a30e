"""Duplicate entities against all pairs, communities against a sequential loop."""

import itertools
import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from daytrace.operators import duplicates as D
from daytrace.operators import graph as G
from daytrace.operators.components import spanning
from daytrace.plans import graphs
from daytrace.sources.tables import known_entities

SCHEMA = "id long, user_id long, entity_type string, name string, occurrence_count long, aliases array<string>, external_ids map<string,string>"


def norm(s):
    return " ".join(re.sub(r"[^\w\s]", " ", (s or "").lower()).split())


def slow_score(a, b):
    signals = []
    if any(v is not None and (b["external_ids"] or {}).get(k) == v for k, v in (a["external_ids"] or {}).items()):
        signals.append((5.0, 0.99))
    x, y = norm(a["name"]), norm(b["name"])
    ratio = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    if ratio >= 0.6:
        signals.append((2.0, ratio))
    s, t = set(x.split()), set(y.split())
    if s and t:
        token = len(s & t) / max(len(s), len(t))
        token = max(token, 0.9) if s <= t or t <= s else token
        if token >= 0.6:
            signals.append((1.5, token))
    s, t = ({norm(n) for n in e["aliases"] or [] if n} for e in (a, b))
    if s & t:
        signals.append((2.0, len(s & t) / max(len(s), len(t))))
    if not signals:
        return 0.0
    best = max(max(v for _, v in signals), sum(w * v for w, v in signals) / sum(w for w, _ in signals))
    return min(1.0, best + (0.05 if (a["entity_type"] or "unknown") == (b["entity_type"] or "unknown") else 0.0))


def all_pairs(rows, least, same_type=True):
    out = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a["user_id"] == b["user_id"] and (not same_type or (a["entity_type"] or "unknown") == (b["entity_type"] or "unknown")):
                score = slow_score(a, b)
                if score >= least:
                    out[a["id"], b["id"]] = score
    return out


def made_up(n, seed):
    draw = random.Random(seed)
    words = ["data", "base", "code", "cloud", "net", "Flow", "flow-net", "dB", ""]
    rows = []
    for k in range(n):
        name = " ".join(draw.choice(words) for _ in range(draw.randrange(4))) if k % 11 else None
        aliases = None if k % 5 == 0 else [draw.choice(words + ["x1", "x2"]) for _ in range(draw.randrange(3))]
        external = None if k % 4 == 0 else {"orcid": str(draw.randrange(9)), "doi": None} if k % 4 == 1 else {}
        rows.append((k, draw.randrange(2), draw.choice(["tool", "org", None]), name, draw.randrange(5), aliases, external))
    return rows


def expanded(spark, frame, pairs):
    """Pairs of all entities from pairs of classes' first members and copies."""
    members, classes = D.entity_classes(frame)
    rep = {r.id: r.rep for r in members.join(classes.select("class", "rep"), "class").select("id", "rep").collect()}
    groups = defaultdict(list)
    for i, r in rep.items():
        groups[r].append(i)
    out = {}
    for r in pairs.collect():
        left = groups[r.a] if rep[r.a] != rep[r.b] else [r.a, *(i for i in groups[r.a] if i not in (r.a, r.b))]
        right = groups[r.b] if rep[r.a] != rep[r.b] else [r.b]
        for i in left:
            for j in right:
                out[min(i, j), max(i, j)] = r.score
    return out


@pytest.mark.parametrize("least,block", [(0.75, 3), (0.9, 1024), (0.65, 5)])
def test_no_pair_is_lost(spark, least, block):
    rows = made_up(120, int(least * 100))
    frame = spark.createDataFrame(rows, SCHEMA)
    found = D.entity_pairs(frame, least, block=block)
    got, want = expanded(spark, frame, found), all_pairs([r.asDict() for r in frame.collect()], least)
    assert set(got) == set(want)
    assert found.agg(F.sum("n_pairs")).first()[0] == len(want)
    # the ratio depends on the order of the two, which only first members fix
    assert max(abs(got[k] - want[k]) for k in want) < 0.1


def test_recall_over_a_whole_table(spark):
    frame = known_entities(spark, "/root/testdata/sf0.01").cache()
    rows = sorted((r.asDict() for r in frame.collect()), key=lambda r: r["id"])
    got, want = expanded(spark, frame, D.entity_pairs(frame)), all_pairs(rows, 0.75)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    lists = defaultdict(list)
    for (a, b), score in all_pairs(rows, 0.75, same_type=False).items():
        lists[a].append((-round(score, 4), b))
        lists[b].append((-round(score, 4), a))
    found = defaultdict(list)
    for r in D.candidates(frame).orderBy("a", "rank").collect():
        found[r.a].append((-r.confidence, r.b))
    assert found == {a: sorted(x)[:20] for a, x in lists.items()}
    stats = {r.id: (r.duplicates_found, r.auto_merged, r.suggested) for r in D.scan_stats(frame).collect()}
    ten = {a: [-s for s, _ in sorted(x)[:10]] for a, x in lists.items()}
    assert stats == {r["id"]: (len(t := ten.get(r["id"], [])), sum(s >= 0.95 for s in t), sum(0.8 <= s < 0.95 for s in t)) for r in rows}
    frame.unpersist()


def test_clusters_and_candidates_of_copies(spark):
    rows = [(k, 1, "tool", "Same Name", 7 if k == 30 else 1, None, None) for k in range(60)] + [(100, 1, "tool", "same names", 2, None, None), (101, 1, "org", "same-name", 1, None, None), (102, 2, "tool", "same name", 1, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    pairs = D.entity_pairs(frame)
    assert pairs.count() == 60 and pairs.agg(F.sum("n_pairs")).first()[0] == 60 * 59 / 2 + 60
    found = D.entity_clusters(frame, pairs).collect()
    assert len(found) == 61 and {(r.cluster_id, r.canonical_id, r.size, r.max_confidence, r.recommendation) for r in found} == {(0, 30, 61, 1.0, "auto_merge")}
    score = slow_score(*({"name": n, "entity_type": "tool", "aliases": None, "external_ids": None} for n in ("same name", "same names")))
    assert found[0].avg_confidence == round((60 * 59 / 2 + 60 * score) / (60 * 59 / 2 + 60), 4)
    first = [r.b for r in D.candidates(frame).filter("a = 3").orderBy("rank").collect()]
    assert first == [k for k in range(21) if k != 3]


def test_should_merge_and_merge(spark):
    rows = [(1, 1, "org", "Acme", 3, ["ACME Inc"], {"ror": "9", "x": "old"}), (2, 1, "org", "acme inc", 0, None, {"x": "new"}), (3, 1, "org", "Other", 1, None, {"ror": "9"}), (4, 1, "tool", "acme", 1, None, None), (5, 2, "org", "acme", 1, None, None), (6, 1, "org", "ACME", 1, ["acme inc"], {"x": "old", "ror": "9"})]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"first_seen": F.to_date(F.lit("2024-01-01")), "last_seen": F.to_date(F.lit("2024-02-01"))})
    assert {(r.a, r.b) for r in D.should_merge(frame).collect()} == {(1, 2), (1, 3), (1, 6), (2, 6), (3, 6)} - {(2, 6), (3, 6)}
    clusters = spark.createDataFrame([(1, 1), (2, 1), (6, 1)], "id long, canonical_id long")
    links = spark.createDataFrame([(10, 1, 0.5), (10, 2, 0.9), (11, 6, 0.2), (12, 3, 0.4)], "activity_id long, entity_id long, relevance_score double")
    merged, moved = D.merge_entities(frame, links, clusters)
    one = merged.filter("id = 1").first()
    assert (one.occurrence_count, one.aliases, one.external_ids, one.name) == (3 + 1 + 1, ["ACME", "ACME Inc", "acme inc"], {"ror": "9", "x": "old"}, "Acme")
    assert {tuple(r) for r in moved.collect()} == {(10, 1, 0.9), (11, 1, 0.2), (12, 3, 0.4)} and merged.count() == 4


def slow_louvain(graph):
    """The sequential rule: vertices in order move to the best neighbouring community, then communities contract."""
    total, labels = sum(w for near in graph.values() for w in near.values()), {u: u for u in graph}
    while True:
        k = {u: sum(graph[u].values()) for u in graph}
        of, sums, any_moved, moved = {u: u for u in graph}, dict(k), False, True
        while moved:
            moved = False
            for u in sorted(graph):
                near = defaultdict(float)
                for v, w in graph[u].items():
                    if v != u:
                        near[of[v]] += w
                sums[of[u]] -= k[u]
                gains = {c: w - sums[c] * k[u] / total for c, w in near.items()}
                here = gains.get(of[u], -sums[of[u]] * k[u] / total)
                best = max(sorted(gains), key=gains.get, default=of[u])
                if gains.get(best, here) > here + 1e-9:
                    of[u], moved, any_moved = best, True, True
                sums[of[u]] += k[u]
        if not any_moved:
            return labels
        labels = {u: of[c] for u, c in labels.items()}
        smaller = defaultdict(lambda: defaultdict(float))
        for u, near in graph.items():
            for v, w in near.items():
                smaller[of[u]][of[v]] += w
        graph = smaller


def slow_modularity(graph, labels):
    total = sum(w for near in graph.values() for w in near.values())
    inside, degree = defaultdict(float), defaultdict(float)
    for u, near in graph.items():
        for v, w in near.items():
            degree[labels[u]] += w
            inside[labels[u]] += w * (labels[u] == labels[v])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def test_louvain_against_a_sequential_loop(spark, sf):
    edges = graphs.strong(spark, sf).cache()
    graph = defaultdict(dict)
    for r in edges.collect():
        graph[r.src][r.dst] = float(r.weight)
    found = {r.id: r.label for r in G.louvain(edges).collect()}
    assert set(found) == set(graph) and all(found[label] == label <= v for v, label in found.items())
    assert slow_modularity(graph, found) >= slow_modularity(graph, slow_louvain(graph)) - 0.01
    edges.unpersist()


@pytest.mark.parametrize("subset", [False, True])
def test_set_pairs_of_small_and_large_groups(spark, subset):
    draw = random.Random(9)
    rows = [(g, 100 * g + i, draw.sample(range(9), draw.randrange(7))) for g, n in ((1, 3), (2, 40), (3, 12)) for i in range(n)]
    near = lambda x, y: bool(x and y) and (len(x & y) >= 0.4 * max(len(x), len(y)) or (subset and (x <= y or y <= x)))
    want = [(a, b) for (g, a, x), (h, b, y) in itertools.combinations(rows, 2) if g == h and near({*x}, {*y})]
    frame = spark.createDataFrame(rows, "grp long, rep long, s array<int>")
    for small in (0, 10, 64):
        assert sorted((r.a, r.b) for r in D.set_pairs(frame, 0.4, subset, 4, small).collect()) == want


def in_common(n, seed):
    """Entities of several users and types whose names, aliases and identifiers are in common, some wholly alike."""
    draw = random.Random(seed)
    words = ["red gear", "blue gear", "red ring", "old plate", "cold rod", ""]
    names = [f"{w} brand {k}".strip() for w in words for k in (1, 2, 12)]
    return [(k, draw.randrange(4), draw.choice(["tool", "org"]), draw.choice(names), draw.randrange(5), draw.choice([None, [draw.choice(names)]]), draw.choice([None, {"sku": str(draw.randrange(6))}])) for k in range(n)]


@pytest.mark.parametrize("rows", [in_common(160, 1), made_up(140, 2), [(k, 1, "org", "", 1, None, {"x": "1"}) for k in range(3)]])
def test_sums_of_pairs_are_the_pairs(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    pairs, sums = D.entity_pairs(frame), D.pair_sums(frame)
    total = lambda x: x.agg(F.sum("n_pairs"), F.sum(F.col("n_pairs") * F.col("score"))).first()
    assert total(sums) == pytest.approx(total(pairs), abs=1e-4)
    assert sorted(map(str, D.entity_clusters(frame, sums).collect())) == sorted(map(str, D.entity_clusters(frame, pairs).collect()))


@pytest.mark.parametrize("rows,k", [(in_common(160, 3), 3), (in_common(160, 4), 20), (made_up(140, 5), 4)])
def test_candidates_are_the_best_of_all_classes(spark, rows, k):
    frame = spark.createDataFrame(rows, SCHEMA)
    members, classes = D.entity_classes(frame)
    rep = {r.id: r.rep for r in members.join(classes.select("class", "rep"), "class").select("id", "rep").collect()}
    by_id = {r["id"]: r for r in (r.asDict() for r in frame.collect())}
    want = {}
    for a, b in itertools.permutations(by_id, 2):
        if by_id[a]["user_id"] == by_id[b]["user_id"]:
            first, second = sorted((rep[a], rep[b]))
            score = slow_score(by_id[first], by_id[second])
            if score >= 0.75:
                want.setdefault(a, []).append((-round(score, 4), b))
    found = defaultdict(list)
    for r in D.candidates(frame, k=k).orderBy("a", "rank").collect():
        found[r.a].append((-r.confidence, r.b))
    assert found == {a: sorted(x)[:k] for a, x in want.items()}


def test_names_in_common_of_groups_are_compared_once(spark, monkeypatch):
    rows = [(100 * u + k, u, "tool", f"name{chr(97 + k)} of brand {k}", 1, None, None) for u in range(20) for k in range(12)]
    frame, seen, ratio_pairs = spark.createDataFrame(rows, SCHEMA), [], D.ratio_pairs
    monkeypatch.setattr(D, "ratio_pairs", lambda names, *more: seen.append(names.count()) or ratio_pairs(names, *more))
    assert D.entity_pairs(frame).count() == 20 * 12 * 11 / 2 and seen == [12]
    assert D.pair_sums(frame).filter("n_pairs > 0").count() == 20 * 12 * 11 / 2


def test_fewer_edges_connect_the_same(spark):
    draw = random.Random(7)
    edges = [(draw.randrange(200) * 10**12, draw.randrange(200) * 10**12) for _ in range(150)] + [(5, 5)] + [(a, b) for a in range(30) for b in range(a)]
    frame = spark.createDataFrame(edges, "a long, b long").coalesce(2)

    def sets(found):
        root = {v: v for e in edges for v in e}
        for a, b in found:
            old, new = root[a], root[b]
            root = {v: new if r == old else r for v, r in root.items()}
        groups = defaultdict(set)
        for v, r in root.items():
            groups[r].add(v)
        return sorted(map(sorted, groups.values()))

    for held in (4, 1_000_000):
        fewer = [tuple(r) for r in spanning(frame, held).collect()]
        assert sets(fewer) == sets(edges) and len(fewer) < 2 * 200
