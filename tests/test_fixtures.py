"""Cases with known results: sessions, switches, meetings, breaks, scores."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daytrace.operators import graph as G
from daytrace.operators import productivity as P
from daytrace.operators import search as S
from daytrace.operators import sessions as E
from daytrace.plans import catalog, graphs
from daytrace.sources.tables import entities

T0 = datetime(2026, 2, 9, 9)
SCHEMA = "id long, user_id long, occurred_at timestamp, type string, app string, domain string, title string, duration_seconds int, data string"


def acts(spark, rows):
    """Rows of (application, minutes after nine, seconds)."""
    return spark.createDataFrame([(i, 1, T0 + timedelta(minutes=m), "app_focus", a, None, None, s, None) for i, (a, m, s) in enumerate(rows)], SCHEMA)


def one(df, column):
    rows = df.collect()
    return rows[0][column] if rows else 0


@pytest.mark.parametrize("rows,hours", [
    ([("vscode", 0, 7200)], 2.0),
    ([("pycharm", 0, 1800), ("terminal", 35, 1800), ("jupyter", 75, 2400)], 6000 / 3600),
    ([("vscode", 0, 1500), ("terminal", 30, 600)], 2100 / 3600),
    ([("facebook", 0, 3600), ("youtube", 60, 3600)], 0),
    ([], 0),
    ([("unknown_app_xyz", 0, 3600), ("vscode", 60, 3600)], 1.0),
])
def test_deep_work(spark, rows, hours):
    assert one(E.strict_deep_work(acts(spark, rows)), "deep_work_hours") == pytest.approx(hours, abs=1e-6)


@pytest.mark.parametrize("rows,n", [
    ([("vscode", 0, 60), ("chrome", 15, 60), ("terminal", 30, 60), ("slack", 45, 60)], 3),
    ([("vscode", 0, 60), ("chrome", 2, 60), ("terminal", 4, 60), ("slack", 6, 60), ("notion", 14, 60)], 2),
    ([("vscode", 0, 60), ("vscode", 15, 60), ("vscode", 30, 60)], 0),
    ([("vscode", 0, 60)], 0),
])
def test_switch_cooldown(spark, rows, n):
    assert one(E.switch_cooldown(acts(spark, rows)), "context_switches") == n


@pytest.mark.parametrize("rows,load,index", [
    ([("zoom", 0, 7200), ("vscode", 120, 7200)], 50, 0),
    ([("vscode", 0, 7200), ("youtube", 120, 600)], 0, 600 / 7200 * 100),
    ([("vscode", 0, 3600), ("reddit", 60, 5400)], 0, 100),
    ([("youtube", 0, 60)], 0, 100),
    ([("zoom", 0, 14400), ("teams", 240, 14400)], 100, 0),
])
def test_category_metrics(spark, rows, load, index):
    r = P.category_day_metrics(acts(spark, rows)).first()
    assert (r.meeting_load_pct, r.distraction_index) == (pytest.approx(load), pytest.approx(index))


@pytest.mark.parametrize("rows,score", [
    ([("vscode", 135 * k, 7200) for k in range(4)], 9.0),
    ([("vscode", 0, 28800)], 5.0),
    ([("vscode", 0, 3600), ("vscode", 300, 3600)], 5.5),
])
def test_break_quality(spark, rows, score):
    assert one(E.break_quality(acts(spark, rows)), "break_quality") == pytest.approx(score)


@pytest.mark.parametrize("args,score", [((8.0, 8.0, 0.0, 0.0, 10.0), 10.0), ((0.0, 8.0, 80.0, 80.0, 2.0), 0.3), ((4.0, 8.0, 20.0, 30.0, 6.0), 5.15)])
def test_focus_score(spark, args, score):
    assert spark.range(1).select(P.focus_score_10(*map(F.lit, args))).first()[0] == pytest.approx(score)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def test_graph_shapes(spark):
    ring = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (1, 5)])
    ranks = [r.score for r in G.pagerank(G.both_ways(ring)).collect()]
    assert ranks == pytest.approx([0.2] * 5)
    path = edges(spark, [(1, 2), (2, 3), (3, 4)])
    all_of = path.select(F.col("src").alias("id")).union(path.select("dst")).distinct()
    between = {r.id: r.betweenness for r in G.betweenness(G.both_ways(path), all_of).collect()}
    assert {k: v for k, v in between.items() if v} == {2: 4.0, 3: 4.0}
    close = {r.id: r.closeness for r in G.closeness(G.both_ways(path), all_of).collect()}
    assert close == pytest.approx({1: 0.5, 2: 0.75, 3: 0.75, 4: 0.5})
    got = G.simple_paths(G.both_ways(ring), 1, 3).collect()
    assert [r.path for r in got] == [[1, 2, 3], [1, 5, 4, 3]]


def test_betweenness_of_long_paths(spark):
    path = G.both_ways(edges(spark, [(i, i + 1) for i in range(1, 7)]))
    want = {i: 2.0 * (i - 1) * (7 - i) for i in range(1, 8)}
    assert {r.id: r.betweenness for r in G.betweenness(path, path.select(F.col("src").alias("id")), block=5).collect()} == want


def slow_betweenness(near):
    """Brandes, one source at a time."""
    out = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, Counter({s: 1}), [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            dep[v] = sum(paths[v] / paths[w] * (1 + dep[w]) for w in near[v] if dist[w] == dist[v] + 1)
            out[v] += dep[v] if v != s else 0
    return out


def test_betweenness_query_covers_all_vertices(spark, sf):
    near = {}
    for r in graphs.strong(spark, sf).collect():
        near.setdefault(r.src, set()).add(r.dst)
    got = {r.id: r.betweenness for r in catalog.QUERIES["k3_betweenness"](spark, sf).collect()}
    assert got == pytest.approx(slow_betweenness(near), abs=1e-5)


def test_merge_candidates_cover_all_users(spark, sf):
    users = {r.id: r.user_id for r in entities(spark, sf).select("id", "user_id").collect()}
    pairs = catalog.QUERIES["m3_candidates_for_entity"](spark, sf).collect()
    assert {users[r.a] for r in pairs} - set(range(10)) and all(users[r.a] == users[r.b] for r in pairs)


def test_two_cliques(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)]
    labels = {r.id: r.label for r in G.label_propagation(edges(spark, [*cliques, (3, 10)])).collect()}
    assert len({labels[i] for i in range(4)}) == len({labels[i] for i in range(11, 14)}) == 1
    assert labels[0] != labels[12]


def test_dbscan_marks_noise(spark):
    pts = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert {r.id: r.cluster for r in S.dbscan(pts, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: -1}


def test_sequence_fold_matches_loop(spark, sf):
    from daytrace.sources.tables import activities

    rows = activities(spark, sf).toPandas().sort_values(["user_id", "occurred_at", "id"])
    want = {}
    for (user, day), g in rows.groupby([rows.user_id, rows.occurred_at.dt.date]):
        n, last, prev = 0, None, None
        for r in g.itertuples():
            app = r.app or ""
            if prev is not None and app != prev and (last is None or (r.occurred_at - last).total_seconds() >= 600):
                n, last = n + 1, r.occurred_at
            prev = app
        want[user, day] = n
    got = {(r.user_id, r.date): r.context_switches for r in E.switch_cooldown(activities(spark, sf)).collect()}
    assert got == want


def test_stream_state_equals_replay(spark, sf):
    from daytrace.sources.tables import table
    from daytrace.streaming import activities as A

    events = table(spark, sf, "events")
    stream = A.event_stream(spark, f"{sf}/events.parque[t]", events.schema)
    got = {tuple(r) for r in A.drain(A.user_state(stream), "update").collect()}
    assert got == {tuple(r) for r in A.replay_state(events).select("user_id", "version", "total_seconds", "active").collect()}
