"""Paths and clusters against loops."""

import heapq
import random
from collections import defaultdict, deque

import numpy as np
import pytest

from daytrace.operators import graph as G
from daytrace.operators import paths as R
from daytrace.operators import search as S


def made_up(seed, n=14, m=26):
    draw = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = sorted(draw.sample(range(n), 2))
        edges[a, b] = draw.choice([0.5, 1.0, 1.5, 2.0])
    graph = defaultdict(dict)
    for (a, b), w in edges.items():
        graph[a][b] = graph[b][a] = w
    return edges, graph


def slow_routes(graph, source, goal, most_vertices, most):
    """Breadth first with neighbours in order; then by cost."""
    found, queue = [], deque([[source]])
    while queue and len(found) < most:
        path = queue.popleft()
        if path[-1] == goal:
            found.append(path)
            continue
        if len(path) < most_vertices:
            queue.extend([*path, v] for v in sorted(graph[path[-1]]) if v not in path)
    cost = lambda p: round(sum(graph[a][b] for a, b in zip(p, p[1:])), 3)
    return [(p, len(p), cost(p)) for p in sorted(found, key=lambda p: (cost(p), len(p), p))]


def slow_distance(graph, source):
    dist, queue = {}, [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in dist:
            dist[v] = d
            for u, w in graph[v].items():
                heapq.heappush(queue, (d + w, u))
    return dist


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_against_loops(spark, seed):
    edges, graph = made_up(seed)
    frame = G.both_ways(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"))
    asked = [(a, b) for a in (0, 3, 5) for b in range(0, 14, 2)] + [(0, 99), (99, 99)]
    pairs = spark.createDataFrame(asked, "source long, goal long")
    got = defaultdict(list)
    for r in R.all_routes(frame, pairs).orderBy("rank").collect():
        got[r.source, r.goal].append((r.path, r.total_steps, r.total_cost))
        assert r.rank == len(got[r.source, r.goal])
    assert got == {p: w for p in asked if (w := slow_routes(graph, *p, 7, 5))}

    found = {(r.source, r.goal): r for r in R.shortest_routes(frame, pairs).collect()}
    for s in {a for a, _ in asked}:
        dist = slow_distance(graph, s)
        for g in {b for a, b in asked if a == s}:
            assert ((s, g) in found) == (g in dist)
            if g in dist:
                r = found[s, g]
                assert r.path[0] == s and r.path[-1] == g and r.total_steps == len(r.path)
                assert r.total_cost == round(dist[g], 3) == round(sum(graph[a][b] for a, b in zip(r.path, r.path[1:])), 3)
                # of equal ways the smallest vertex, from the goal backwards
                for p, v in zip(r.path, r.path[1:]):
                    assert p == min(u for u in graph[v] if dist.get(u, np.inf) + graph[v][u] == dist[v])
                assert r.difficulty == ("beginner" if len(r.path) <= 2 else "intermediate" if len(r.path) <= 4 else "advanced" if len(r.path) <= 6 else "expert")


def test_hop_routes(spark):
    edges = G.both_ways(spark.createDataFrame([(k, k + 1, 2) for k in range(8)] + [(0, 4, 7)], "src long, dst long, weight long"))
    pairs = spark.createDataFrame([(0, 4), (0, 6), (0, 8), (2, 2), (0, 5)], "source long, goal long")
    got = {(r.source, r.goal): (r.path, r.total_weight) for r in R.hop_routes(edges, pairs, 3).collect()}
    assert got == {(0, 4): ([0, 4], 7), (0, 6): ([0, 4, 5, 6], 11), (2, 2): ([2], 0), (0, 5): ([0, 4, 5], 9)}


@pytest.mark.parametrize("block,pivots", [(1024, 64), (3, 2)])
def test_clusters_and_their_report(spark, block, pivots):
    draw = np.random.default_rng(4)
    rows = []
    for centre in range(4):
        base = draw.normal(size=16)
        rows += [(len(rows) + k, int(draw.integers(3)), [float(x) for x in base * draw.uniform(0.5, 2) + draw.normal(size=16) * 0.25]) for k in range(9)]
    rows += [(100, 1, [float(x) for x in draw.normal(size=16) * 5]), (101, 1, [0.0] * 16)]
    points = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    clusters = S.dbscan(points, S.eps_pairs(points, pivots=pivots, block=block)).cache()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows}
    pairs = {(a, b) for a in unit for b in unit if a < b and 1 - unit[a] @ unit[b] <= 0.35}
    assert {(r.a, r.b) for r in S.eps_pairs(points, pivots=pivots, block=block).collect()} == pairs
    of = {r.id: r.cluster for r in clusters.collect()}
    near = {r.id: r.similarity for r in S.cluster_members(points, clusters).collect()}
    report = {r.cluster: r for r in S.cluster_report(points, clusters).collect()}
    assert set(report) == set(of.values()) and report[-1].size == sum(c == -1 for c in of.values()) >= 2
    by_id = {i: (label, np.array(v)) for i, label, v in rows}
    for c in set(of.values()) - {-1}:
        ids = sorted(i for i, k in of.items() if k == c)
        centre = np.mean([by_id[i][1] for i in ids], axis=0)
        sims = {i: by_id[i][1] @ centre / np.linalg.norm(by_id[i][1]) / np.linalg.norm(centre) for i in ids}
        assert all(abs(near[i] - sims[i]) < 1e-9 for i in ids)
        labels = [by_id[i][0] for i in ids]
        dominant = max(dict.fromkeys(labels), key=labels.count)
        coherence = np.mean([unit[a] @ unit[b] for a in ids for b in ids if a < b])
        best = min(ids, key=lambda i: (-round(sims[i], 3), i))
        r = report[c]
        assert (r.size, r.dominant_type, r.title) == (len(ids), str(dominant), f"{dominant} cluster: {best}") and abs(r.coherence - coherence) < 6e-4
        assert r.types == ",".join(sorted(f"{k}:{labels.count(k)}" for k in set(labels)))
    clusters.unpersist()


def test_pairs_without_a_way_are_not_made(spark):
    edges, graph = made_up(3, 30, 24)
    frame = G.both_ways(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double"))
    sources = spark.createDataFrame([(v, v % 2) for v in range(0, 32)], "source long, k long")
    goals = spark.createDataFrame([(v, v % 2) for v in range(1, 30, 2)] + [(v, 1) for v in range(0, 30, 2)], "goal long, k long")
    want = {(a, b) for a in graph for b in slow_distance(graph, a) if a % 2 == 1}
    for block in (2, 1024):
        got = [(r.source, r.goal) for r in R.pairs_with_a_way(frame, sources, goals, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
