"""Rules of balance, breaks, focus, names, decay, insights, graphs and intake against results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daytrace.operators import graph as G
from daytrace.operators import intake as I
from daytrace.operators import names as N
from daytrace.operators import productivity as P
from daytrace.operators import reports as R
from daytrace.operators import search as S
from daytrace.operators import sessions as E
from daytrace.operators import wellbeing as W

DAYS = "user_id long, date date, total_hours double, start_hour int, end_hour int, break_count long, meeting_hours double, context_switches long, messages_sent long, is_weekend boolean"


def days(spark, *rows):
    first = dt.date(2024, 1, 1)
    return spark.createDataFrame([(1, first + dt.timedelta(i), h, a, b, n, m, c, s, (first + dt.timedelta(i)).weekday() > 4) for i, (h, a, b, n, m, c, s) in enumerate(rows)], DAYS)


def acts(spark, rows):
    """(minutes from the start, application, seconds[, type])"""
    start = dt.datetime(2024, 1, 1, 9)
    full = [(i, 1, start + dt.timedelta(minutes=r[0]), r[3] if len(r) > 3 else "app_focus", r[1], None, None, r[2], None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id long, user_id long, occurred_at timestamp, type string, app string, domain string, title string, duration_seconds int, data string")


def test_balance_by_hand(spark):
    r = W.work_life_balance(days(spark, (7.5, 9, 17, 3, 0.0, 0, 0), (7.5, 6, 22, 3, 0.0, 0, 0))).first()
    # hours 100, two violations in two days 0, no weekend 100, breaks 100
    assert (r.score, r.level, r.violations) == (pytest.approx(75.0), "good", 2)


def test_burnout_by_hand(spark):
    r = W.burnout_risk(days(spark, *[(11.0, 9, 22, 0, 6.0, 0, 0)] * 3)).first()
    # streak 25, two hours above nine 20, no breaks 15, late 15, meetings above 40 % 10
    assert (r.risk_score, r.risk_level, r.overwork_streak) == (85.0, "critical", 3)
    assert r.indicators == "Overwork Streak, High Average Hours, Insufficient Breaks, Frequent Late Work, Meeting Overload"
    assert W.burnout_risk(days(spark, (7.0, 9, 17, 3, 0.0, 0, 0))).first().risk_level == "low"


def test_stress_by_hand(spark):
    r = W.stress_index(days(spark, (9.0, 9, 22, 0, 4.5, 15, 25))).first()
    # 100 * .25 + 50 * .2 + 0 + 100 * .15 + 30 * .1 + 50 * .1
    assert (r.stress_index, r.level, r.dominant_factor) == (58.0, "high", "meeting_load")


def test_rest_by_hand(spark):
    r = W.rest_patterns(days(spark, *[(8.0, 9, 17, 3, 0.0, 0, 0)] * 7)).first()
    # 16 hours of rest give 64, no day off, seven days in a row cost 10
    assert (r.recovery_score, r.avg_rest_hours, r.rest_days, r.consecutive_work_days, r.recommendations) == (54.0, 16.0, 0, 7, "rest day, day off")


def test_energy_by_hand(spark):
    got = {r.hour: r.energy for r in W.energy_levels(acts(spark, [(0, "a", 1800), (60, "a", 60), (61, "b", 60), (62, "a", 60)])).collect()}
    # half an hour of deep work .35 and no switch .3, cut to a whole number; no deep work and two switches .24
    assert got == {9: 64, 10: 24}


def test_wellness_by_hand(spark):
    r = W.wellness_basic(acts(spark, [(0, "a", 3600), (90, "b", 3600)]), F.lit(dt.datetime(2024, 1, 2))).first()
    # balance 100, variety (2 + 1) * 10, two hours a day 40, no break rows so 40; one pause of 30 minutes
    assert (r.overall_score, r.balance_score, r.burnout_level, r.break_count, r.break_minutes) == (pytest.approx(56.0), pytest.approx(58.0), "low", 1, 30.0)


def test_breaks_by_hand(spark):
    rows = acts(spark, [(0, "a", 60), (5, "a", 60), (20, "b", 60), (50, "b", 60), (110, "c", 60)])
    got = {(r["size"], r.kind): (r.n, r.minutes) for r in E.break_classification(rows).collect()}
    assert got == {("short", "scheduled"): (1, 5.0), ("medium", "natural"): (1, 15.0), ("long", "scheduled"): (1, 30.0), ("extended", "forced"): (1, 60.0)}
    r = E.break_balance(rows).first()
    assert (r.break_minutes, r.work_minutes, r.optimal_break_score) == (110.0, 4.0, 0.0)


def test_focus_periods_by_hand(spark):
    rows = acts(spark, [(0, "a", 60), (2, "a", 60), (4, "b", 60), (6, "a", 60), (8, "b", 60), (10, "c", 60), (12, "c", 60), (30, "c", 60), (34, "c", 60)])
    got = [(r.minutes, r.app, r.distractions, r.depth, r.quality_score) for r in E.focus_periods(rows).orderBy("started").collect()]
    # the third other row, c, ends a's period at the row before it and is the next period's own
    assert got == [(8.0, "a", 0, "moderate", 50), (2.0, "c", 0, "shallow", 25), (4.0, "c", 0, "shallow", 25)]


def test_career_by_hand(spark):
    r = W.career_insights(acts(spark, [(0, "Zoom", 600), (30, "Slack", 1200), (60, "x", 4000)]), F.lit(dt.datetime(2024, 1, 2))).first()
    assert (r.growth_trajectory, r.career_phase, r.skill_gaps) == ("steady", "exploring", "Meetings, Communication")
    assert r.next_steps.startswith("Block focus time")


@pytest.mark.parametrize("domain,name,org,industry", [
    ("cs.stanford.edu", "Stanford University", "educational", "education"), ("data.treasury.gov", "Treasury", "government", "government"), ("bbc.co.uk", None, None, None), ("news-site.news", "News Site", "media", "news"),
    ("research-lab.ac.uk", "Research Lab", "educational", "research"), ("mybank.com", "Mybank", "company", "finance"), ("thing.dev", "Thing", "open_source", "tech"), ("plain.net", "Plain", "company", "tech"), ("github.com", "GitHub", "developer_tools", "tech"), ("localhost", None, None, None),
])
def test_organisations(spark, domain, name, org, industry):
    r = spark.createDataFrame([(domain,)], "d string").select(N.domain_entity(F.col("d")).alias("x")).first().x
    assert (r and (r.name, r.org_type, r.industry)) == ((name, org, industry) if name else None)


def test_tags_and_names(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1), "app_focus", "Code - x", "docs.github.com", "PR #12 by Ada Lovelace - notes.py", "https://github.com/team/repo/pull/1", "/home/u/Projects/thing/")]
    x = spark.createDataFrame(rows, "id long, user_id long, occurred_at timestamp, type string, app string, domain string, title string, url string, working_directory string")
    t = N.auto_tag(x).first()
    assert (t.tags, t.primary_category, t.confidence) == ("code_review,development,ide,version_control", "development", 0.95)
    got = {(r.entity_type, r.name): (r.confidence, r.source) for r in N.entities_of(x).collect()}
    assert got[("artifact", "Code - x")] == (0.95, "app") and got[("artifact", "notes.py")] == (0.85, "file") and got[("skill", "Python")] == (0.7, "file_ext")
    assert got[("project", "thing")] == (0.65, "working_dir") and got[("project", "team/repo")] == (0.8, "url") and got[("person", "Ada Lovelace")] == (0.5, "title_name")


def test_entities_are_found_in_one_pass_over_each_column(spark):
    x = spark.createDataFrame([(1, 1, "chrome", "a.b-c.org", "next.js and nextjs in go")], "id long, user_id long, app string, domain string, title string").withColumns({"occurred_at": F.current_timestamp(), "type": F.lit("web_visit")})
    found = N.entities_of(x)
    assert sorted(r.name for r in found.filter("entity_type = 'skill'").collect()) == ["GO", "Next.js", "Nextjs"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("initcap(") == 1 and plan.count("[a-z0-9#+.]+") == 1


def test_learning_by_hand(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, at, "web_visit", "arXiv", "organization", 0.9, "domain", "educational", "research") for i in range(2)] + [(i, 1, at, "app_focus", "t/r", "project", 0.8, "url", None, None) for i in range(3)] + [(9, 1, at, "web_visit", "Acme", "organization", 0.5, "domain", "company", "tech")]
    x = spark.createDataFrame(rows, "id long, user_id long, occurred_at timestamp, type string, name string, entity_type string, confidence double, source string, org_type string, industry string")
    got = {(r.rel_type, r.name): r.confidence for r in N.learning_edges(x).collect()}
    assert got == {("LEARNED_FROM", "arXiv"): 0.68, ("CONTRIBUTED_TO", "t/r"): 0.75, ("WORKS_ON", "t/r"): 0.67}


def test_decay_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, "t", 1, dt.date(2024, 1, 1)), (2, 1, "t", 1, dt.date(2023, 11, 1)), (3, 1, "t", 21, dt.date(2023, 1, 1))], "id long, user_id long, entity_type string, occurrence_count long, last_seen date")
    x = P.knowledge_decay(rows, F.lit(dt.date(2024, 1, 1)))
    assert {r.id: r.status for r in x.collect()} == {1: "fresh", 2: "fading", 3: "stale"}
    assert R.decay_health(x).first().overall_health == "needs_attention" and [r.id for r in R.decay_at_risk(x).orderBy("freshness").collect()] == [3, 2][:1]


def test_insights_by_hand(spark):
    first = dt.date(2024, 1, 1)
    rows = [(1, first + dt.timedelta(i), h, d, f, 0.0, 1, 0.0, 2) for i, (h, d, f) in enumerate([(8.0, 2.0, 8.0), (8.0, 2.0, 8.0), (8.5, 2.0, 8.0), (8.0, 2.0, 8.0), (8.0, 2.0, 8.0), (12.0, 6.0, 9.0)])]
    x = spark.createDataFrame(rows, "user_id long, date date, total_hours double, deep_work_hours double, focus_score double, meeting_hours double, meeting_count long, late_night_hours double, skills_used long")
    last = {r.title for r in R.daily_insights(x).filter(F.col("date") == first + dt.timedelta(5)).collect()}
    assert last == {"5-day focus streak!", "Unusually long work day", "Deep work breakthrough"}
    assert [r.title for r in R.daily_insights(x).filter(F.col("date") == first).collect()] == ["Excellent focus today"]


def ring_pair(spark):
    """Two cliques of five with one edge between them."""
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    return G.both_ways(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"))


def test_communities_of_two_cliques(spark):
    e = ring_pair(spark)
    labels = {r.id: r.label for r in G.louvain(e).collect()}
    assert labels == {v: 0 if v < 10 else 10 for v in [*range(5), *range(10, 15)]}
    q = G.modularity_both(e, G.louvain(e)).first().modularity
    assert q == pytest.approx(2 * (20 / 42 - 0.25))


def test_vectors_of_two_cliques(spark):
    e = ring_pair(spark)
    walks = G.node2vec_walks(e, e.select(F.col("src").alias("id")).distinct(), q=2.0)
    rows = walks.collect()
    near = {(r.src, r.dst) for r in e.collect()}
    assert len(rows) == 300 and all(len(r.path) == 10 and all(p in near for p in zip(r.path, r.path[1:])) for r in rows)
    v = {r.id: r.vector for r in G.walk_vectors(walks).collect()}
    assert all(len(x) == 128 and sum(a * a for a in x) == pytest.approx(1) for x in v.values())
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert min(dot(1, 2), dot(11, 12)) > dot(1, 12) + 0.2


def test_return_parameter_of_walks(spark):
    e = ring_pair(spark)
    back = lambda p: sum(a == c for r in G.node2vec_walks(e, e.select(F.col("src").alias("id")).distinct(), p=p).collect() for a, c in zip(r.path, r.path[2:]))
    assert back(0.05) > 2 * back(20.0)


@pytest.mark.parametrize("block", [2, 1024])
def test_pairs_of_a_hot_unit(spark, block):
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 5), (2, 7), (3, 9)], "u long, i long")
    got = [(r.u, r.src, r.dst) for r in G.pairs_within(rows, block).collect()]
    assert sorted(got) == sorted([(1, a, b) for a in range(30) for b in range(a + 1, 30)] + [(2, 5, 7)])


def test_paths_until_none_changes(spark):
    chain = G.both_ways(spark.createDataFrame([(i, i + 1, 1.0) for i in range(20)] + [(0, 20, 100.0)], "src long, dst long, weight double"))
    start = spark.createDataFrame([(0,)], "id long")
    assert {r.id: r.distance for r in G.shortest_paths(chain, start).collect()} == {i: float(i) for i in range(21)}
    assert {r.id: r.depth for r in G.bfs(chain, start).collect()} == {i: min(i, 21 - i) for i in range(21)}


@pytest.mark.parametrize("pivots,block", [(1, 1024), (7, 16), (64, 4), (1, 8), (3, 5)])
def test_pairs_of_near_vectors_against_all_pairs(spark, pivots, block):
    import numpy as np

    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 8))
    x = np.concatenate([c + 0.5 * rng.normal(size=(20, 8)) for c in centres])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if 1 - u[i] @ u[j] <= 0.35}
    assert {(r.a, r.b) for r in S.eps_pairs(rows, 0.35, pivots, block).collect()} == want and len(want) > 100


def test_search_in_blocks_of_queries(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    q = rows.filter("id % 4 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.id for r in S.cosine_search(rows, q, 3, -1.0, block=4).collect()}
    for k in range(0, 60, 4):
        order = [i for i in np.argsort(-(u @ u[k])) if i != k][:3]
        assert [got[k, n] for n in (1, 2, 3)] == order
    assert "CartesianProduct" not in S.cosine_search(rows, q, 3)._jdf.queryExecution().toString()


def test_citations_by_hand(spark):
    known = spark.createDataFrame([(1, "A long title of six words", ["Ann Ode"], "10.1/x"), (2, "Short", None, None), (3, "Another long title that nobody has", [], None)], "id long, title string, authors array<string>, doi string")
    papers = spark.createDataFrame([(1, "a long title of six words"), (7, "See xA LONG title of six words, by ann ode."), (8, "short 10.1/x"), (9, None)], "id long, content string")
    got = {(r.id, r.cited): (r.signals, r.confidence) for r in I.citations(papers, known).collect()}
    assert got == {(7, 1): ("author,title", 0.85), (8, 1): ("doi", 0.95), (8, 2): ("title", 0.7)}


def test_all_centralities_go_on_after_a_failure(spark):
    e = ring_pair(spark)
    got = I.all_centralities(e, {"degree": lambda x: G.degree(x).withColumn("score", F.col("degree")), "bad": lambda x: x.select("nothing"), "pagerank": lambda x: G.pagerank(x, 3)})
    rows = got.collect()
    assert sorted({r.metric for r in rows if r.error is None}) == ["degree", "pagerank"] and len(rows) == 21
    assert [(r.metric, r.id, r.score) for r in rows if r.error] == [("bad", None, None)]
    assert I.all_centralities(e, {"bad": lambda x: x.select("nothing")}).count() == 1


def test_diversity_against_a_loop(spark):
    import random

    rng = random.Random(2)
    hits = [(q, r, 100 * q + r, rng.choice("aab")) for q in range(6) for r in range(1, rng.randint(2, 14))]
    want = {}
    for q in range(6):
        rest, last, place = sorted((r, i, f) for k, r, i, f in hits if k == q), None, 0
        while rest and place < 5:
            pick = next((x for x in rest if place == 0 or x[2] != last), rest[0])
            rest.remove(pick)
            last, place = pick[2], place + 1
            want[q, place] = pick[1]
    table = spark.createDataFrame(hits, "query_id long, rank long, id long, f string")
    assert {(r.query_id, r["rank"]): r.id for r in S.diversify(table, "f", 5).collect()} == want


def test_percentiles_against_a_sort(spark):
    import random

    from daytrace.operators import people as O

    rng = random.Random(3)
    rows = [(k, float(rng.choice([1, 1, 1, rng.random() * 100]))) for k in ("a", "b") for _ in range(700)] + [("c", 5.0)] * 3
    got = {r.k: r for r in O.latency_histogram(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], [10], cells=16).collect()}
    for k in "abc":
        v = sorted(x for g, x in rows if g == k)
        assert [got[k].p50, got[k].p95, got[k].p99] == [v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.95, 0.99)] and got[k].le_10 == sum(x <= 10 for x in v)


def test_rounds_of_scores_leave_the_edges_where_they_are(spark, monkeypatch):
    edges = G.both_ways(spark.createDataFrame([(k % 17, (k * k + 1) % 17 + 17, 1 + k % 3) for k in range(40)], "src long, dst long, weight long")).cache()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert G.pagerank_engine(edges, 1)._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        scores = lambda: [{r.id: round(r.score, 9) for r in f(edges, 7).collect()} for f in (G.pagerank, G.pagerank_engine, G.eigenvector)]
        sent = scores()
        monkeypatch.setattr(G, "SENT", 0)
        assert scores() == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
