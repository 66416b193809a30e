"""Exact, near and line deduplication against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daytrace.llm import queries
from daytrace.llm.exact_dedup import combined, exact_duplicates, merged
from daytrace.llm.line_dedup import dedup_lines
from daytrace.llm.simhash import _links_of, fingerprint, near_duplicates, near_links, plan_partitions, representatives
from daytrace.operators.components import connected_components
from helpers import same

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(ALPHABET, ALPHABET.lower())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.SQL[name]).df())


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def slow_fingerprint(text):
    words = (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    """``fps``: identifier to fingerprint."""
    keys = sorted(fps)
    values = np.array([fps[k] for k in keys], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    found = components((keys[i], keys[j]) for i, j in zip(*np.nonzero(near)))
    return {k: found[k] for k in keys}


def test_fingerprints_and_components(docs, texts):
    rng = random.Random(1)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    for k in rng.sample(sorted(texts), 40):
        assert got[k][0] == f"{slow_fingerprint(texts[k]):016x}"
    want = slow_components({k: int(f, 16) for k, (f, _) in got.items()})
    assert {k: c for k, (_, c) in got.items()} == want


def test_whitespace_and_short_texts():
    for t in ["a\x0bb\x0cc\td", "a\xa0b", "A b", "", None, "x", "É é e", "a b c d", "a b c d e", "\x1ca b"]:
        assert fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


@pytest.mark.parametrize("block", [8, 4096])
def test_links_of_large_groups_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, np.uint64)
    near = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 30)]
    fps = sorted({*map(int, base), *near, *(int(x) ^ 7 for x in base[:9]), 0, 2**64 - 1})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    got = connected_components(near_links(spark.createDataFrame(signed, "fp long"), 4, block))
    mine = defaultdict(set)
    for r in got.collect():
        mine[r.root].add(r.v % 2**64)
    want = defaultdict(set)
    for k, c in slow_components({f: f for f in fps}).items():
        want[c].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_plan_covers_every_pair_at_every_size():
    for n in (10, 10**5, 10**7, 10**9, 10**11):
        plan = plan_partitions(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4, 4)
        assert sum(t + 1 for _, t in plan) >= 5
        bits = [b for part, _ in plan for b in part]
        assert len(bits) == len(set(bits))
    assert len({t for n in (10**7, 10**9) for _, t in plan_partitions(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4, 4)}) > 1


def test_links_join_a_chain():
    fps = np.array([0, 15, 255, 4095, 31 << 50], np.uint64)
    a, b = _links_of(fps, 4)
    assert set(components(zip(a.tolist(), b.tolist())).values()) == {0} and 31 << 50 not in a


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == 10 and near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint == by[9].fingerprint == "0" * 16
    assert by[1].component_id == by[6].component_id == 1 and by[2].component_id == 2


def test_one_row_stays_of_each_component(spark, odd, none):
    base = "some words that are the same in all of the texts here " * 12
    rows = [(5, base, "x"), (5, base + "more", "y"), (3, base + "other", "z"), (None, base, "n"), (None, "nothing alike in this other text at all", "m"), (9, "nothing alike in this other text at all", "m"), (7, "", "a"), (7, "", "a"), (8, None, "a")]
    fps = {i: slow_fingerprint(t) for i, (_, t, _) in enumerate(rows)}
    comps = slow_components(fps)
    got = representatives(spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)).collect()
    assert len(got) == len(set(comps.values())) == 3 and sorted(r.doc_id for r in got) == [3, 7, 9]
    assert representatives(odd).columns == odd.columns and representatives(none).count() == 0
    assert representatives(odd).count() == len({r.component_id for r in near_duplicates(odd).collect()})


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_duplicates_of_odd_rows(odd, none, keep):
    got = exact_duplicates(odd, keep=keep, fan_in=2, run_rows=2).collect()
    assert len(got) == 10 and exact_duplicates(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[1].keep_id, by[6].keep_id, by[1].group_size) == ((1, 1, 3) if keep == "min" else (6, 6, 3))
    assert (by[2].keep_id, by[2].group_size) == ((2, 2) if keep == "min" else (3, 2))
    assert by[None].keep_id is None and by[None].kept and by[2].text_sha256 == hashlib.sha256(b"").hexdigest()


def test_multiway_merge_of_runs():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 9):
        runs, want = [], {}
        for r in range(n):
            keys = np.sort(rng.integers(0, 40, rng.integers(1, 60)))
            for i, k in enumerate(keys):
                want.setdefault(int(k), []).append(r * 100 + i)
            raw = np.array([bytes([k]) * 40 + bytes(8) for k in keys.tolist()], "S48")
            runs.append(combined((raw, np.arange(len(keys)) + r * 100, np.ones(len(keys), bool), np.ones(len(keys), np.int64)), "min"))
        keys, ids, known, counts = merged(runs, "min")
        assert [(k[0] if k else 0, i, c) for k, i, c in zip(keys.tolist(), ids.tolist(), counts.tolist())] == [(k, min(v), len(v)) for k, v in sorted(want.items())]


@pytest.mark.parametrize("fan_in,run_rows", [(2, 1 << 18), (4, 10), (8, 1 << 18)])
def test_exact_duplicates_over_many_runs(spark, fan_in, run_rows):
    rows = spark.range(0, 3000, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise((F.col("id") % 500).cast("string")).alias("text"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(rows, fan_in=fan_in, run_rows=run_rows).collect()}
    groups = defaultdict(list)
    for i in range(3000):
        groups["hot" if i % 3 == 0 else str(i % 500)].append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}


def slow_lines(rows):
    """``rows``: list of (id, text) without repeats; new texts."""
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        lines = (text or "").split("\n")
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p : p + 3]), (key, p))
    for key, text in rows:
        lines = (text or "").split("\n")
        gone = {q for p in range(len(lines) - 2) if any(x.strip(" ") for x in lines[p : p + 3]) and seen[tuple(lines[p : p + 3])] != (key, p) for q in range(p, p + 3)}
        out.append((key, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_against_loop(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))) for i in range(120)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == dict(slow_lines(rows))


def test_line_dedup_of_odd_rows(odd, none):
    got = dedup_lines(odd)
    assert got.columns == [*odd.columns, "line_dedup"] and dedup_lines(none).count() == 0
    by = {r.doc_id: r for r in got.collect()}
    assert len(got.collect()) == 10
    assert by[None].text == "line" and by[None].line_dedup.n_removed == 5
    assert by[8].text == "\n\n\n\n\n" and by[2].text is None and by[2].line_dedup.n_lines == 0
