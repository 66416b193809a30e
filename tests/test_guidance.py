"""Careers, contexts, digests and integrations by hand."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from daytrace.operators import guidance as U

NOW = datetime(2026, 2, 9, 12)


def test_readiness_by_hand(spark):
    skills = spark.createDataFrame([(1, "Python", 400.0), (1, "git", 100.0), (1, "SQL", 50.0), (2, "python", 1.0)] + [(3, s, 100.0) for s in U.ROLES["tech_lead"].required + U.ROLES["tech_lead"].helpful], "user_id long, skill string, hours double")
    got = {(r.user_id, r.role): r for r in U.role_readiness(skills, U.roles(spark)).collect()}
    assert len(got) == 15
    r = got[1, "fullstack_developer"]
    assert (r.readiness, r.level, r.required_covered, r.required_pct, r.helpful_covered) == (45.0, "developing", 3, 30.0, 0)  # .3 * .5 + 1 * .3
    assert r.gaps.startswith("css:required,docker:required,") and r.gaps.endswith("redis:recommended,testing:recommended") and r.gap_hours == 7 * 50 + 5 * 30
    lead = got[3, "tech_lead"]
    assert (lead.readiness, lead.level, lead.gaps, lead.best) == (100.0, "ready", "", True)
    assert [k[1] for k, r in got.items() if k[0] == 2 and r.best] == ["data_scientist"]  # 1 of 8, before tech_lead by name
    gaps = {r.skill: (r.required_by, r.roles, r.rank) for r in U.skill_gaps(skills, U.roles(spark)).filter("user_id = 1").collect()}
    assert len(gaps) == 10 and gaps["docker"] == ("DevOps Engineer,Full-Stack Developer", 2, 1) and gaps["machine_learning"][1:] == (2, 2)


def test_velocity_by_hand(spark):
    week = lambda k: date(2026, 1, 5) + timedelta(weeks=k)
    rows = [(1, week(k), "a", 10.0) for k in range(4)] + [(1, week(3), "b", 2.0), (1, week(3), "b", 2.0), (2, week(0), "a", 1.0)] + [(3, week(k), "a", 0.0 if k < 2 else 1.0) for k in range(4)]
    got = {r.user_id: r for r in U.growth_velocity(spark.createDataFrame(rows, "user_id long, week date, skill string, hours double")).collect()}
    one = got[1]
    assert (one.current_velocity, one.avg_velocity, one.weeks, one.total_hours, one.new_skills) == (16.8, round((33 + 16.8) / 4, 2), 4, 44.0, 2)
    assert [got[k].trend for k in (1, 2, 3)] == ["accelerating", "insufficient_data", "starting"]


def test_context_ends_at_the_first_that_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.8), (1, 9, 3, 0.7), (2, 9, 1, 0.5), (3, 99, 1, 0.1)], "query_id long, id long, rank long, score double")
    docs = spark.createDataFrame([(7, "T", "x" * 30, "doc"), (8, None, "y" * 90, "doc"), (9, "short", None, "web")], "id long, title string, text string, kind string")
    got = U.build_context(hits, docs, max_tokens=20, snippet=20, cited=5)
    assert [(r.query_id, r.source, r.id, r.title, r.citation) for r in got.orderBy("query_id", "source").collect()] == [(1, 1, 7, "T", "xxxxx"), (1, 2, 8, "Source 2", "yyyyy"), (1, 3, 9, "short", ""), (2, 1, 9, "short", "")]
    assert got.filter("source = 1 and id = 7").first().context == f"[Source 1: T]\n{'x' * 20}...\n"
    assert [r.id for r in U.build_context(hits, docs, max_tokens=6, snippet=20).filter("query_id = 1").orderBy("source").collect()] == [7]
    asked = spark.createDataFrame([(1, "why?"), (5, "who?")], "query_id long, query string")
    text = {r.query_id: (r.prompt, r.num_sources) for r in U.prompts(got, asked).collect()}
    assert text[1][0].endswith("\n\nQuestion: why?") and text[1][1] == 3 and text[1][0].index("[Source 1") < text[1][0].index("[Source 2") and text[5][1] == 0


def test_digest_by_hand(spark):
    rows = [(1, 1, "a", "high", True, NOW - timedelta(hours=1)), (2, 1, "b", None, None, NOW - timedelta(hours=24)), (3, 1, "b", "low", False, NOW - timedelta(hours=25)), (4, 1, "b", "low", False, NOW + timedelta(hours=1)), (5, 2, "a", "low", False, NOW - timedelta(days=6))]
    frame = spark.createDataFrame(rows, "id long, user_id long, kind string, priority string, read boolean, at timestamp")
    one = U.notice_digest(frame, F.lit(NOW)).collect()
    assert [tuple(r) for r in one] == [(1, 2, 1, "a:1,b:1", "high:1,medium:1", "2,1")]
    assert {(r.user_id, r.total_count) for r in U.notice_digest(frame, F.lit(NOW), 7).collect()} == {(1, 3), (2, 1)}


def test_health_by_hand(spark):
    c = [(1, "x", "connected", True, "hourly", None), (1, "y", "connected", True, "hourly", NOW), (1, "z", "connected", False, "daily", None), (2, "x", "error", True, "daily", None), (2, "y", "connected", True, "manual", None), (2, "z", "connected", True, "odd", NOW + timedelta(days=1))]
    s = [(1, "x", NOW - timedelta(minutes=59), 1, True), (1, "y", NOW - timedelta(minutes=60), 1, True), (2, "x", NOW - timedelta(hours=9), 1, True)] + [(2, "x", NOW - timedelta(hours=k), 9 - k, False) for k in range(3)] + [(2, "z", NOW + timedelta(hours=1), 1, True)]
    got = U.integration_health(spark.createDataFrame(c, "user_id long, provider string, status string, enabled boolean, frequency string, token_expires_at timestamp"), spark.createDataFrame(s, "user_id long, provider string, at timestamp, id long, success boolean"), F.lit(NOW))
    assert {(r.user_id, r.provider): tuple(r)[2:] for r in got.collect()} == {
        (1, "x"): ("connected", True, False, 0, 0, False, ""), (1, "y"): ("expired", False, True, 0, 0, False, "token"), (1, "z"): ("connected", True, False, 0, 0, False, "disabled"),
        (2, "x"): ("error", False, False, 3, 3, False, "failures,errors"), (2, "y"): ("connected", True, False, 0, 0, False, ""), (2, "z"): ("connected", True, False, 0, 0, True, ""),
    }
