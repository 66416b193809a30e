"""Provider answers, languages, expertise and sampled betweenness."""

import json
import math

import pytest
from pyspark.sql import functions as F

from daytrace.operators import expertise as X
from daytrace.operators import graph as G
from daytrace.operators import language as L
from daytrace.plans import catalog, graphs
from daytrace.sources import wearables as W
from helpers import same

ANSWERS = [
    (1, "fitbit", "activities", {"summary": {"steps": 9, "fairlyActiveMinutes": 2, "veryActiveMinutes": 3}}),
    (2, "fitbit", "activities", {}),
    (3, "fitbit", "heart", {"activities-heart": [{"value": {"restingHeartRate": 61}}]}),
    (4, "fitbit", "heart", {"activities-heart": []}),
    (5, "fitbit", "sleep", {"sleep": [{"minutesAsleep": 400, "efficiency": 91, "levels": {"summary": {"deep": {"minutes": 60}, "light": {}}}}, {"minutesAsleep": 1}]}),
    (6, "fitbit", "sleep", {"sleep": []}),
    (7, "fitbit", "spo2", {"value": {"avg": "high"}}),
    (8, "oura", "sleep", {"data": [{"total_sleep_duration": 600, "deep_sleep_duration": 90, "average_hrv": 0, "day": "2026-01-05"}, {"average_heart_rate": 50.5, "total_sleep_duration": "x"}]}),
    (9, "oura", "daily_readiness", {"data": []}),
    (10, "oura", "daily_spo2", {"data": [{"spo2_percentage": None}, {"spo2_percentage": {"average": 97.5}}]}),
    (11, "other", "sleep", {}),
    (12, "oura", "daily_sleep", '{"data": [{'),
    (13, "oura", "daily_sleep", None),
    (14, "oura", "daily_sleep", {"data": [{"contributors": {"efficiency": 88}}]}),
]


def test_answers_by_hand(spark):
    rows = [(i, 1, p, e, "2026-01-01", b if b is None or isinstance(b, str) else json.dumps(b)) for i, p, e, b in ANSWERS]
    good, aside = W.metric_rows(spark.createDataFrame(rows, "id long, user_id long, provider string, endpoint string, day string, body string"))
    got = {}
    for r in good.collect():
        got.setdefault(r.id, []).append((r.metric_type, r.metric_value, r.recorded_at[-1]))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("active_minutes", 5.0, "1"), ("calories", 0.0, "1"), ("steps", 9.0, "1")], 2: [("active_minutes", 0.0, "1"), ("calories", 0.0, "1"), ("steps", 0.0, "1")], 3: [("heart_rate_resting", 61.0, "1")],
        5: [("sleep_deep", 60.0, "1"), ("sleep_duration", 400.0, "1"), ("sleep_efficiency", 91.0, "1"), ("sleep_light", 0.0, "1")],
        8: [("heart_rate_resting", 50.5, "1"), ("sleep_deep", 0.0, "1"), ("sleep_deep", 1.5, "5"), ("sleep_duration", 10.0, "5"), ("sleep_rem", 0.0, "1"), ("sleep_rem", 0.0, "5")],
        10: [("spo2", 97.5, "1")], 14: [("sleep_efficiency", 88.0, "1")],
    }
    assert {tuple(r) for r in aside.collect()} == {(7, "no number: spo2"), (8, "no number: sleep_duration"), (11, "unknown endpoint"), (12, "not JSON"), (13, "not JSON")}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    profiles = L.language_profiles(docs.filter(~held))
    assert profiles.groupBy("lang").count().filter("count <> 300").isEmpty()
    found = L.detect_language(docs, profiles)
    assert found.count() == docs.count()
    right = found.join(docs.filter(held & (F.length("text") >= 60)), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.95


def test_profiles_and_languages_by_hand(spark):
    rows = [(1, "aab", "x"), (2, "Aa ba", "x"), (3, "zz", "y"), (4, None, "y"), (5, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {(r.lang, r.gram): r["rank"] for r in L.language_profiles(docs, most=3).collect()}
    assert got == {("x", "a"): 1, ("x", " a"): 2, ("x", " aa"): 3, ("y", "z"): 1, ("y", " z"): 2, ("y", " zz"): 3}
    odd = [(1, "a" * 9, "x"), (2, None, "x"), (3, "", "x"), (4, "1234567890 ...", "x"), (5, "zzz zz z zzz", "x"), (5, "zzz zz z zzz", "x"), (None, "aaa aa a aab", "x"), (6, "aa " * 50_000, "x")]
    found = L.detect_language(spark.createDataFrame(odd, "doc_id long, text string, lang string"), L.language_profiles(docs, most=3), most=3).collect()
    assert sorted((r.doc_id or 0, r.language) for r in found) == [(0, "x"), (1, "en"), (2, "en"), (3, "en"), (4, "en"), (5, "y"), (5, "y"), (6, "x")]
    assert all(r.probability == 1.0 for r in found if r.language == "en") and all(0.5 < r.probability <= 1 for r in found)


@pytest.mark.parametrize("error,whole", [(0.3, False), (0.001, True)])
def test_sampled_betweenness_keeps_its_bound(spark, sf, error, whole):
    edges = graphs.strong(spark, sf).cache()
    ids = edges.select(F.col("src").alias("id")).distinct()
    n = ids.count()
    exact = {r.id: r.betweenness / n / (n - 2) for r in G.betweenness(edges, ids).collect()}
    found = X.sampled_betweenness(edges, error, step=32).collect()
    assert len(found) == n and all(r.bound <= error for r in found) and (found[0].sources == n) == whole
    assert all(abs(r.betweenness - exact.get(r.id, 0.0)) <= r.bound + 1e-9 for r in found)
    edges.unpersist()


def test_expertise_by_hand(spark):
    entities = spark.createDataFrame([(1, 1, 10, 0.9), (2, 1, None, None), (3, 1, 200, 1.0)], "id long, user_id long, frequency long, confidence double")
    got = {r.id: (r.expertise_score, r.level) for r in X.expertise_rank(entities, spark.createDataFrame([(1, 0.5)], "id long, centrality double")).collect()}
    assert got == {1: (round(math.log(11) * 0.4 + 0.27 + 0.15, 3), "proficient"), 2: (round(math.log(2) * 0.4 + 0.15, 3), "beginner"), 3: (round(math.log(201) * 0.4 + 0.3, 3), "expert")}
    skills = spark.createDataFrame([(1, "SQL", 60.0), (1, "Git", 10.0), (1, "Rust", 90.0), (2, "x", 1.0)], "user_id long, skill string, score double")
    target = spark.createDataFrame([("sql", 80.0), ("git", 50.0), ("rust", 90.0), ("go", 5.0), ("c", 70.0)], "skill string, required double")
    got = {r.user_id: tuple(r)[1:] for r in X.profile_gaps(skills, target).collect()}
    assert got == {1: ("c,go", "git", "sql", "rust", 40.0), 2: ("rust,sql,c,git,go", "", "", "", 0.0)}


def _events(tmp_path, rows):
    """Tables with the events ``user, k, seconds`` as uses of applications."""
    import duckdb

    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01 08:00:00', {u}, 'click', {(n + 0.5) / 60}, '{{\"k\": {k}}}')" for i, (u, k, n) in enumerate(rows))
    duckdb.connect().execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {values}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    return c


def test_gaps_are_ordered_by_hours_that_are_not_rounded(spark, tmp_path):
    c = _events(tmp_path, [(1, 0, 3606), (1, 6, 6), (2, 0, 3607), (2, 6, 7)])
    got = catalog.QUERIES["d32_skill_gaps"](spark, str(tmp_path)).toPandas()
    assert set(got["matched"]) == {"messaging,coding"}
    same(got, c.execute(catalog.SQL["d32_skill_gaps"]).df())


def test_weak_skill_between_two_hundredths(spark, tmp_path):
    c = _events(tmp_path, [(1, 3, 2250), (2, 3, 2249), (3, 3, 1000)])
    got = catalog.QUERIES["d40_recommend_learning"](spark, str(tmp_path)).toPandas()
    assert got[(got["user_id"] == 1) & (got["source"] == "weak")]["relevance"].tolist() == [0.57]
    same(got, c.execute(catalog.SQL["d40_recommend_learning"]).df())


def test_languages_without_a_shuffle_of_grams(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("ein Hund", "de"), ("el perro y el gato", "es"), ("猫と犬と猫と犬", "ja"), ("Straße ǅ İx " * 3, "de")] * 2)]
    docs = spark.createDataFrame([*rows, (None, "der und der", None), (3, "the the and", "en"), (3, "the the and", "en"), (9, None, "de")], "doc_id long, text string, lang string").repartition(3)
    assert dict(zip(map(L._text, (found := L.grams(["aab", "a"]))[0].tolist()), found[1].tolist())) == {" a": 2, " a ": 1, " aa": 1, "a": 3, "a ": 1, "aa": 1, "aab": 1, "ab": 1, "ab ": 1, "b": 1, "b ": 1}
    profiles = L.language_profiles(docs, most=40)
    out = L.detect_language(docs, profiles, most=30)
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    sent = sorted(map(repr, out.collect()))
    monkeypatch.setattr(L, "PROFILED", 10)
    assert sorted(map(repr, L.detect_language(docs, profiles, most=30).collect())) == sent and len(sent) == len(rows) + 4
    for words, step in ((2, 1 << 18), (100_000, 3)):
        monkeypatch.setattr(L, "WORDS", words)
        monkeypatch.setattr(L, "_STEP", step)
        assert sorted(map(repr, L.language_profiles(docs, most=40).collect())) == sorted(map(repr, profiles.collect()))
