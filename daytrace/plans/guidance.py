"""Queries on careers, retrieval context, digests and integrations (D, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guidance as U
from ..sources.tables import ACTIVITIES, activities, table
from .registry import add
from .texts import SV, bm25_hits, docs

#: Which skill an application or host stands for; the hours of these small tables are taken many times over, in
#: parts of 37, so that no rounding ends in a tie.
USES = {"vscode": "Python", "pycharm": "python", "jupyter": "pandas", "terminal": "bash", "Zoom": "mentoring", "Slack": "communication", "Notion": "documentation", "github.com": "git", "stackoverflow.com": "sql", "docs.python.org": "Python", "arxiv.org": "machine_learning"}


def used(s, d):
    uses = s.createDataFrame(list(USES.items()), "place string, skill string")
    a = activities(s, d).select("user_id", F.coalesce("app", "domain").alias("place"), "duration_seconds", "occurred_at")
    return a.join(F.broadcast(uses), "place").select("user_id", F.lower("skill").alias("skill"), (F.col("duration_seconds") / 37).alias("hours"), F.to_date(F.date_trunc("week", "occurred_at")).alias("week"))  # a dimension of eleven rows


USED = "used AS (SELECT user_id, lower(skill) AS skill, duration_seconds / 37 AS hours, date_trunc('week', occurred_at)::DATE AS week FROM activities JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in USES.items()) + ") v(place, skill) ON coalesce(app, domain) = place)"
ROLE = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r.title}', {list(r.required)}, {list(r.helpful)}, {r.hours})" for k, r in U.ROLES.items()) + ") v(role, title, req, help, target))"
OWN = "own AS (SELECT user_id, list(DISTINCT skill) AS own, sum(hours) AS h FROM used GROUP BY 1)"
add("d31_career_readiness", lambda s, d: U.role_readiness(used(s, d), U.roles(s)),
    """, x AS (SELECT user_id, role, len(list_intersect(own, req)) AS a, len(req) AS n, len(list_intersect(own, help)) AS b, len(help) AS m, a / n * 0.5 + least(h / target, 1.0) * 0.3 + b / m * 0.2 AS r,
              list_sort(list_filter(req, lambda s: NOT list_contains(own, s))) AS g, list_sort(list_filter(help, lambda s: NOT list_contains(own, s))) AS k FROM own, roles)
       SELECT user_id, role, round(r * 100, 1) AS readiness, CASE WHEN r >= 0.85 THEN 'ready' WHEN r >= 0.6 THEN 'almost_ready' WHEN r >= 0.3 THEN 'developing' ELSE 'early' END AS level, a::INTEGER AS required_covered, round(a / n * 100, 1) AS required_pct, b::INTEGER AS helpful_covered,
              array_to_string(list_transform(g, lambda s: s || ':required') || list_transform(k, lambda s: s || ':recommended'), ',') AS gaps, (len(g) * 50 + len(k) * 30)::INTEGER AS gap_hours, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, role) = 1 AS best FROM x""", ACTIVITIES, USED, ROLE, OWN)  # fmt: skip
add("d31_skill_gaps", lambda s, d: U.skill_gaps(used(s, d), U.roles(s)),
    """, g AS (SELECT user_id, skill, string_agg(title, ',' ORDER BY title) AS required_by, count(*) AS roles FROM (SELECT user_id, title, unnest(list_filter(req, lambda s: NOT list_contains(own, s))) AS skill FROM own, roles) GROUP BY 1, 2)
       SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY roles DESC, skill) AS rank FROM g QUALIFY rank <= 10""", ACTIVITIES, USED, ROLE, OWN)  # fmt: skip
add("d31_growth_velocity", lambda s, d: U.growth_velocity(used(s, d)),
    """, f AS (SELECT *, week = min(week) OVER (PARTITION BY user_id, skill) AS fresh FROM used),
       w AS (SELECT user_id, week, sum(hours) AS h, count(DISTINCT skill) AS n, count(DISTINCT skill) FILTER (fresh) AS new, h * (1 + 0.1::DOUBLE * n) AS v FROM f GROUP BY 1, 2),
       k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY week) AS k, row_number() OVER (PARTITION BY user_id ORDER BY week DESC) AS back FROM w),
       x AS (SELECT user_id, count(*) AS weeks, sum(v) / count(*) AS a, max(v) FILTER (back = 1) AS c, sum(v) FILTER (back <= 2) / 2 AS r, sum(v) FILTER (k <= 2) / 2 AS e, sum(h) AS h, sum(new)::BIGINT AS new_skills FROM k GROUP BY 1)
       SELECT user_id, round(c, 2) AS current_velocity, round(a, 2) AS avg_velocity, CASE WHEN weeks < 4 THEN 'insufficient_data' WHEN NOT e > 0 THEN 'starting' WHEN (r - e) / e > 0.1 THEN 'accelerating' WHEN (r - e) / e < -0.1 THEN 'decelerating' ELSE 'steady' END AS trend,
              weeks, round(h, 1) AS total_hours, new_skills FROM x""", ACTIVITIES, USED)  # fmt: skip


def _l11(s, d):
    sources = docs(s, d).select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "doc_id").alias("title"), "text", F.col("source").alias("kind"))
    context = U.build_context(bm25_hits(s, d, 10), sources, 500)
    return context.select("query_id", "source", "id", "title", "kind", F.round("score", 6).alias("score"), F.sha2("citation", 256).alias("citation"), F.sha2("context", 256).alias("context"))


add("l11_cited_context", _l11,
    """, x AS (SELECT query_id, rank, id, score, source, source || ' ' || doc_id AS title, coalesce(text, '')[1:300] || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS snippet FROM bm25 JOIN documents ON id = doc_id WHERE rank <= 10),
       u AS (SELECT *, sum(length(snippet)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM x)
       SELECT query_id, rank AS source, id, title, source AS kind, round(score, 6) AS score, sha256(snippet[1:150]) AS citation, sha256('[Source ' || rank || ': ' || title || ']' || chr(10) || snippet || chr(10)) AS context FROM u WHERE used <= 2000""", *SV)  # fmt: skip


def _notices(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    priority = F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("k") % 4 + 1)
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("kind"), F.when(F.col("k") % 5 > 0, priority).alias("priority"), (F.col("k") % 3 == 0).alias("read"), F.col("ts").cast("timestamp").alias("at"))


NOW = "TIMESTAMP '2024-01-15 12:00:00'"
for _name, _days in (("daily", 1), ("weekly", 7)):
    add(f"d46_{_name}_digest", lambda s, d, n=_days: U.notice_digest(_notices(s, d), F.expr(NOW), n),
        f"""WITH n AS (SELECT event_id AS id, user_id, event_type AS kind, CASE WHEN k % 5 > 0 THEN ['low', 'medium', 'high', 'critical'][k % 4 + 1] ELSE 'medium' END AS priority, k % 3 = 0 AS read, ts,
                       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE ts BETWEEN {NOW} - INTERVAL {_days} DAY AND {NOW})),
                 t AS (SELECT user_id, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS by_type FROM (SELECT user_id, kind, count(*) AS n FROM n GROUP BY 1, 2) GROUP BY 1),
                 q AS (SELECT user_id, string_agg(priority || ':' || n, ',' ORDER BY priority || ':' || n) AS by_priority FROM (SELECT user_id, priority, count(*) AS n FROM n GROUP BY 1, 2) GROUP BY 1)
            SELECT user_id, count(*) AS total_count, count(*) FILTER (NOT read) AS unread_count, any_value(by_type) AS by_type, any_value(by_priority) AS by_priority, string_agg(id::VARCHAR, ',' ORDER BY p) FILTER (p <= 50) AS items
            FROM n JOIN t USING (user_id) JOIN q USING (user_id) GROUP BY 1""")  # fmt: skip


def _d47(s, d):
    e = table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    provider = F.element_at(F.array(*[F.lit(x) for x in ("github", "slack", "calendar")]), (F.col("event_id") % 3 + 1).cast("int"))
    syncs = e.select("user_id", provider.alias("provider"), "at", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("success"))
    u, p = F.col("user_id"), F.length("provider")
    frequency = F.element_at(F.array(*[F.lit(x) for x in ("realtime", "hourly", "daily", "weekly", "manual")]), ((u + p) % 5 + 1).cast("int"))
    connections = syncs.select("user_id", "provider").distinct().select("user_id", "provider", F.when(u % 7 == 0, "disconnected").otherwise("connected").alias("status"), (u % 4 > 0).alias("enabled"), frequency.alias("frequency"), F.when(u % 3 == 0, F.expr("TIMESTAMP '2024-01-10 00:00:00'")).when(u % 3 == 1, F.expr("TIMESTAMP '2024-02-10 00:00:00'")).alias("token_expires_at"))
    return U.integration_health(connections, syncs, F.expr(NOW))


add("d47_integration_due", _d47,
    f"""WITH e AS (SELECT user_id AS u, ['github', 'slack', 'calendar'][event_id % 3 + 1] AS provider, ts, event_id, event_type <> 'error' AS ok FROM events),
             b AS (SELECT *, row_number() OVER (PARTITION BY u, provider ORDER BY ts DESC, event_id DESC) AS b FROM e WHERE ts <= {NOW}),
             l AS (SELECT u, provider, count(*) FILTER (b <= 5 AND NOT ok) AS f, coalesce(min(b) FILTER (ok), count(*) + 1) - 1 AS n, max(ts) FILTER (ok) AS last FROM b GROUP BY 1, 2),
             x AS (SELECT u, provider, coalesce(f, 0) AS f, coalesce(n, 0) AS n, last, u % 3 = 0 AS expired, CASE WHEN u % 3 = 0 THEN 'expired' WHEN u % 7 = 0 THEN 'disconnected' ELSE 'connected' END AS status, u % 4 > 0 AS enabled, (u + length(provider)) % 5 AS q FROM (SELECT DISTINCT u, provider FROM e) LEFT JOIN l USING (u, provider))
        SELECT u AS user_id, provider, status, status = 'connected' AND n < 3 AS healthy, expired AS token_expired, n AS sync_errors, f AS recent_failures,
               status = 'connected' AND enabled AND q < 4 AND coalesce(floor(epoch({NOW})) - floor(epoch(last)) >= [300, 3600, 86400, 604800][q + 1], true) AS needs_sync,
               concat_ws(',', CASE WHEN expired THEN 'token' END, CASE WHEN f >= 3 THEN 'failures' END, CASE WHEN n >= 3 THEN 'errors' END, CASE WHEN NOT enabled THEN 'disabled' END) AS advice FROM x""")  # fmt: skip
