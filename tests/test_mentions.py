"""Mentions against loops: best matches, and clusters in order."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from daytrace.operators import mentions as M
from daytrace.sources.tables import mentions

T0 = datetime(2026, 2, 9, 9)
SCHEMA = "id long, user_id long, label string, text string, platform string, ts timestamp"
NAMES = {
    "PERSON": ["John Smith", "john smith", "J. Smith", "Smith, John", "John S.", "Jon Smith", "Smith", "", "Johnny Smith Jr"],
    "ORG": ["Acme Corp", "acme", "Acme Corp.", "ACME co", "Big Data Group", "BDG", "bigdata group", "Acme Ltd"],
    "TOOL": ["vs-code", "VS Code", "vscode", "v.s.code", "vscodium", "docker", "Dockers"],
    None: ["thing", "things", "Thing"],
}


def slow_aliases(text, label):
    low = text.lower().strip()
    found, parts = {low}, text.split()
    if label == "PERSON" and len(parts) >= 2:
        a, z = parts[0], parts[-1]
        found |= {x.lower() for x in (f"{a[0]}. {z}", f"{a} {z[0]}.", a, z, f"{z}, {a}")}
    elif label == "ORG":
        found |= {low.replace(s, "").strip() for s in M.SUFFIXES if low.endswith(s)}
        initials = "".join(w[0] for w in parts if w[0].isupper())
        if len(parts) >= 2 and len(initials) >= 2:
            found.add(initials.lower())
    elif label == "TOOL":
        found |= {low.replace(c, "") for c in ".- "}
    return found


def slow_fuzzy(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    return min(1.0, len(set(a) & set(b)) / len(set(a) | set(b)) * 0.5 + len(short) / len(long) * 0.5 + 0.15 * (long.startswith(short) or (len(a) == len(b) and a == b)))


def slow_match(x, y):
    """Methods and scores by which y matches x."""
    if x[1] != y[1] or (x[2] or "") != (y[2] or ""):
        return []
    label, a, b = x[2] or "", (x[3] or "").strip(), (y[3] or "").strip()
    if a.lower() == b.lower():
        return [("exact", 1.0)]
    shared = slow_aliases(a, label) & slow_aliases(b, label)
    if shared:
        return [("alias", 0.9 if len(shared) > 1 else 0.85)]
    out, f = [], slow_fuzzy(a, b)
    if x[5] and y[5] and abs(x[5] - y[5]) <= timedelta(hours=1) and f > 0.7:
        out.append(("time_window", 0.75))
    if label in ("PERSON", "ORG") and f >= 0.85:
        out.append(("fuzzy", round(f, 3)))
    return out


def slow_clusters(rows):
    cluster = {}
    for i, x in enumerate(rows):
        if x[0] not in cluster:
            cluster[x[0]] = x[0]
            for y in rows[i + 1 :]:
                if y[0] not in cluster and max((s for _, s in slow_match(x, y)), default=0) >= 0.8:
                    cluster[y[0]] = x[0]
    return cluster


def made_up(seed, n=150):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        label = draw.choice(list(NAMES))
        text = draw.choice(NAMES[label]) if k % 17 else None
        rows.append((k * 3, k % 2, label, f" {text} " if text and k % 5 == 0 else text, draw.choice(["web", "mail", None]), None if k % 7 == 0 else T0 + timedelta(minutes=draw.randrange(400))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_a_loop(spark, seed):
    rows = made_up(seed)
    got = {r.id: r for r in M.resolve_mentions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    order = {"time_window": 0, "fuzzy": 1}
    for x in rows:
        all_ = sorted(((-s, y[0], order.get(m, 2), m, (x[4] or "unknown") != (y[4] or "unknown")) for y in rows if y[0] != x[0] for m, s in slow_match(x, y)))[:5]
        r = got[x[0]]
        assert r.matches == "; ".join(f"{i} {m} {-s:.3f}" for s, i, _, m, _ in all_)
        assert (r.resolved, r.canonical_id, r.method, r.cross_platform, r.n_matches) == ((True, all_[0][1], all_[0][3], all_[0][4], len(all_)) if all_ else (False, x[0], "none", False, 0))


@pytest.mark.parametrize("seed", [3, 4])
def test_clusters_against_a_loop(spark, seed):
    rows = made_up(seed)
    got = M.cluster_mentions(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.id: r.cluster_id for r in got} == slow_clusters(rows)


def test_clusters_of_a_table(spark, sf):
    frame = mentions(spark, sf)
    rows = [tuple(r) for r in frame.orderBy("id").collect()]
    by_user = defaultdict(list)
    for r in rows:
        by_user[r[1]].append(r)
    want = {}
    for own in by_user.values():
        want |= slow_clusters(own)
    got = M.cluster_mentions(frame).collect()
    assert {r.id: r.cluster_id for r in got} == want
    sizes = defaultdict(set)
    for r in rows:
        sizes[want[r[0]]].add(r[4])
    assert all(r.platforms == ",".join(sorted(sizes[r.cluster_id])) and r.cross_platform == (len(sizes[r.cluster_id]) > 1) for r in got)


def test_leaders_of_a_long_chain(spark):
    """Each node hangs on the one before: every second one leads."""
    n = 9
    nodes, links = spark.range(n), spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a long, b long")
    assert {r.id: r.leader for r in M.greedy_leaders(nodes, links).collect()} == {k: k - k % 2 for k in range(n)}


def test_no_mentions(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.resolve_mentions(none).count() == 0 and M.cluster_mentions(none).count() == 0


def test_names_are_taken_apart_once_for_all_users(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        seen.add(1)
        return [text.lower()]

    monkeypatch.setattr(M, "aliases", lambda text, label: counted(text))
    frame = spark.createDataFrame([(3 * u + k, u, "TOOL", name, "web", T0) for u in range(40) for k, name in enumerate(("Zoom", "zoom app", "Zoé"))], SCHEMA)
    rows, classes = M.mention_classes(frame)
    assert rows.count() == classes.count() == 120 and seen.value == 3
    assert {(r.low, tuple(sorted(r.chars))) for r in classes.collect()} == {(x, tuple(sorted(map(ord, {*x})))) for x in ("zoom", "zoom app", "zoé")}
