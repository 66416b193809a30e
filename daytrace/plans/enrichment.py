"""Queries on enrichment, inference, listings and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import enrich as N
from ..operators import graph as G
from ..operators import productivity as P
from ..operators import search as Q
from ..sources.tables import ACTIVITIES, ENTITIES, LINKS, activities, entities, links, table
from .graphs import BOTH, PAIRS, REC, RV, STRONG, strong
from .productivity import ALL, daily_metrics
from .registry import add, dates_as_text

PROFILES = {"de": ["der", "die", "und", "das", "ist", "den", "von", "mit", "ein"], "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it"], "es": ["de", "la", "que", "el", "los", "las", "una", "por", "su"], "fr": ["le", "les", "des", "et", "est", "un", "pour", "dans", "du"]}
add("a1_ingest_normalise", lambda s, d: N.normalise_ingest(activities(s, d).select("id", "type", "user_id"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).select("id", "type", "ip_hash"),
    "SELECT id, CASE WHEN type IN ('page_view', 'tab_focus') THEN 'web_visit' WHEN type = 'window_focus' THEN 'app_focus' ELSE type END AS type, substr(sha256('10.0.0.' || user_id::VARCHAR), 1, 16) AS ip_hash FROM activities", ACTIVITIES)


def _a7(s, d):
    e = entities(s, d).select("id", "user_id", "name", F.col("last_seen").alias("seen"), "first_seen")
    new = e.filter("id % 2 = 0").select("id", "user_id", F.when(F.col("id") % 4 == 0, F.upper("name")).alias("name"), F.date_add("seen", 1).alias("seen"), F.date_sub("first_seen", F.col("id").cast("int") % 3).alias("first_seen"))
    return N.upsert_nodes(e, new, ["id", "user_id"])


add("a7_upsert_nodes", _a7, """SELECT id, user_id, CASE WHEN id % 4 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN id % 2 = 0 THEN first_seen - (id % 3)::INTEGER ELSE first_seen END::DATE AS first_seen,
    CASE WHEN id % 2 = 0 THEN last_seen + 1 ELSE last_seen END::DATE AS last_seen FROM entities""", ENTITIES)  # fmt: skip
add("a19_publish_events", lambda s, d: N.event_records(activities(s, d)), """SELECT 'activity.created' AS event, '{"activity_id":"' || id || '","user_id":"' || user_id || '","type":"' || type || '"}' AS payload, id AS sequence FROM activities""", ACTIVITIES)
add("b6_activity_filter", lambda s, d: activities(s, d).filter(F.col("type").isin("app_focus", "meeting") & F.col("app").isin("vscode", "Zoom") & (F.col("occurred_at") >= "2024-01-03") & (F.col("duration_seconds") >= 60) & F.contains(F.lower("title"), F.lit("click"))).select("id", "user_id", "app"),
    "SELECT id, user_id, app FROM activities WHERE type IN ('app_focus', 'meeting') AND app IN ('vscode', 'Zoom') AND occurred_at >= '2024-01-03' AND duration_seconds >= 60 AND contains(lower(title), 'click')", ACTIVITIES)
add("b7_entity_filter", lambda s, d: entities(s, d).filter(F.col("entity_type").isin("SMALL", "LARGE") & (F.col("occurrence_count") >= 25) & F.contains(F.lower("name"), F.lit("ring"))).select("id", "name", "occurrence_count"), "SELECT id, name, occurrence_count FROM entities WHERE entity_type IN ('SMALL', 'LARGE') AND occurrence_count >= 25 AND contains(lower(name), 'ring')", ENTITIES)
add("b13_delete_by_ids", lambda s, d: activities(s, d).select("id", "user_id").join(table(s, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 7 = 0"), "id", "left_anti"), "SELECT id, user_id FROM activities WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)", ACTIVITIES)
add("b14_snap_to_monday", lambda s, d: table(s, d, "orders").select("o_orderkey", F.date_trunc("week", "o_orderdate").cast("date").alias("monday"), (F.col("o_totalprice").between(0, 400000)).alias("in_range")), "SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS monday, o_totalprice BETWEEN 0 AND 400000 AS in_range FROM orders")
THRESHOLDS = {"AUTHORED": 0.7, "CITES": 0.6, "COLLABORATES_WITH": 0.65, "USES": 0.6, "WORKS_ON": 0.6, "AFFILIATED_WITH": 0.6, "CONTRIBUTES_TO": 0.55, "ON_TOPIC": 0.55, "RELATED_TO": 0.5, "USED_TOGETHER": 0.55, "LEARNED_FROM": 0.6}
RELS = ["AUTHORED", "CITES", "RELATED_TO", "OTHER"]


def _b15(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*[F.lit(r) for r in RELS]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("rel"), (0.5 + 2 * F.col("l_discount")).alias("confidence"))
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in THRESHOLDS.items() for v in kv]), F.col("rel")), F.lit(0.6))
    return x.filter(F.round("confidence", 6) >= least).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


add("b15_confidence_threshold", _b15, "SELECT rel, count(*) AS n FROM (SELECT ['AUTHORED', 'CITES', 'RELATED_TO', 'OTHER'][l_partkey % 4 + 1] AS rel, round(0.5 + 2 * l_discount, 6) AS c FROM lineitem) WHERE c >= CASE rel WHEN 'AUTHORED' THEN 0.7 WHEN 'CITES' THEN 0.6 WHEN 'RELATED_TO' THEN 0.5 ELSE 0.6 END::DOUBLE GROUP BY 1")
add("b18_pending_work", lambda s, d: activities(s, d).groupBy("user_id").agg(F.max(F.to_date("occurred_at")).alias("last")).withColumn("due", F.datediff(F.lit("2024-01-31").cast("date"), "last") >= F.element_at(F.array(F.lit(1), F.lit(7), F.lit(30)), (F.col("user_id") % 3 + 1).cast("int"))).filter("due").select("user_id"),
    "SELECT user_id FROM (SELECT user_id, max(occurred_at)::DATE AS l FROM activities GROUP BY 1) WHERE date_diff('day', l, DATE '2024-01-31') >= [1, 7, 30][user_id % 3 + 1]", ACTIVITIES)
add("c4_top_users", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_custkey").limit(20), "SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY n DESC, c_custkey LIMIT 20")
add("c5_optional_match", lambda s, d: entities(s, d).select("id").join(G.entity_neighbors(links(s, d), 3), F.col("id") == F.col("entity_id"), "left").groupBy("id").agg(F.count_distinct("neighbor_id").alias("neighbors")),
    "SELECT id, count(DISTINCT dst) AS neighbors FROM entities LEFT JOIN (SELECT src, dst FROM both_ways QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 3) ON id = src GROUP BY 1", LINKS, ENTITIES, PAIRS, BOTH)
add("c6_anti_pattern", lambda s, d: activities(s, d).select("user_id").distinct().crossJoin(F.broadcast(s.createDataFrame([("vscode",), ("Zoom",), ("reddit",)], "app string"))).join(activities(s, d).select("user_id", "app").distinct(), ["user_id", "app"], "left_anti"),
    "SELECT DISTINCT a.user_id, v.app FROM activities a, (VALUES ('vscode'), ('Zoom'), ('reddit')) v(app) WHERE NOT EXISTS (SELECT 1 FROM activities b WHERE b.user_id = a.user_id AND b.app = v.app)", ACTIVITIES)


def _c8(s, d):
    rows = activities(s, d).select("user_id", (F.unix_micros("occurred_at") / 1e6).alias("t"), F.col("id").alias("seq"), F.coalesce("app", "domain").alias("item"))
    return N.session_pairs(rows, 240, 2).select("user_id", "from_item", "to_item", "n", F.round("confidence", 4).alias("confidence"))


add("c8_session_pair_inference", _c8,
    """SELECT a.user_id, a.item AS from_item, b.item AS to_item, count(*) AS n, round(least(0.85, 0.55 + count(*) * 0.05)::DOUBLE, 4) AS confidence
       FROM (SELECT user_id, epoch_us(occurred_at) AS t, id, coalesce(app, domain) AS item FROM activities) a JOIN (SELECT user_id, epoch_us(occurred_at) AS t, id, coalesce(app, domain) AS item FROM activities) b
       ON a.user_id = b.user_id AND a.item <> b.item AND (b.t, b.id) > (a.t, a.id) AND (b.t - a.t) / 1e6 <= 14400 GROUP BY 1, 2, 3 HAVING count(*) >= 2""", ACTIVITIES)  # fmt: skip
add("c13_tool_mention_join", lambda s, d: table(s, d, "documents").select("doc_id", F.lower("text").alias("t")).crossJoin(F.broadcast(s.createDataFrame([("mit",), ("apache",), ("license",)], "tool string"))).filter(F.contains("t", F.col("tool"))).select("doc_id", "tool", F.when(F.regexp_like("t", F.concat(F.lit("(primarily|mainly|using|under the) "), F.col("tool"))), 2.0).otherwise(1.0).alias("weight")),
    "SELECT doc_id, tool, CASE WHEN regexp_matches(lower(text), '(primarily|mainly|using|under the) ' || tool) THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM documents, (VALUES ('mit'), ('apache'), ('license')) v(tool) WHERE contains(lower(text), tool)")


add("d14_peak_hour", lambda s, d: P.hourly_histogram(activities(s, d)).groupBy("user_id").agg(F.max_by("hour", F.struct("seconds", -F.col("hour"))).alias("peak_hour")),
    "SELECT user_id, arg_min(h, (-s, h)) AS peak_hour FROM (SELECT user_id, hour(occurred_at)::BIGINT AS h, sum(least(duration_seconds, 7200)) AS s FROM activities GROUP BY 1, 2) GROUP BY 1", ACTIVITIES)
add("d32_skill_profile", lambda s, d: N.expertise(entities(s, d)),
    "SELECT id, user_id, round(s, 6) AS score, CASE WHEN s >= 80 THEN 'expert' WHEN s >= 50 THEN 'advanced' WHEN s >= 25 THEN 'intermediate' ELSE 'beginner' END AS level FROM (SELECT *, ln(1 + occurrence_count) / max(ln(1 + occurrence_count)) OVER (PARTITION BY user_id) * 100 AS s FROM entities)", ENTITIES)
add("e10_cumulative_skills", lambda s, d: N.cumulative_new(entities(s, d).select("user_id", "first_seen")),
    "SELECT user_id, bucket, n AS new, sum(n) OVER (PARTITION BY user_id ORDER BY bucket)::BIGINT AS total FROM (SELECT user_id, date_diff('day', m, first_seen) // 30 AS bucket, count(*) AS n FROM (SELECT user_id, first_seen, min(first_seen) OVER (PARTITION BY user_id) AS m FROM entities) GROUP BY 1, 2)", ENTITIES)
add("d46_notification_digest", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("view", "click", "error")]), "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")


def log(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts"), "user_id", (F.col("user_id") % 10).alias("integration"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("action"), "value")


add("d47_integration_health", lambda s, d: N.sync_health(log(s, d)),
    """SELECT *, CASE WHEN consecutive_errors >= 3 THEN 'error' WHEN recent_failures > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM (
         SELECT integration, count(*) FILTER (r <= 5 AND NOT ok) AS recent_failures, coalesce(min(r) FILTER (ok), count(*) + 1) - 1 AS consecutive_errors
         FROM (SELECT user_id % 10 AS integration, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY 1)""")  # fmt: skip
add("d48_audit_summary", lambda s, d: N.audit_summary(log(s, d)), "SELECT user_id, event_type AS action, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2")
add("d50_uptime_report", lambda s, d: N.uptime(log(s, d).select(F.col("action").alias("component"), F.when(F.col("value") < 60, "healthy").when(F.col("value") < 120, "degraded").otherwise("unhealthy").alias("state"))),
    "SELECT event_type AS component, count(*) AS samples, round(avg((value < 60)::INT) * 100, 4) AS healthy_pct, round(avg((value >= 60 AND value < 120)::INT) * 100, 4) AS degraded_pct, round(avg((value >= 120)::INT) * 100, 4) AS unhealthy_pct FROM events GROUP BY 1")
add("f5_priority_sort", lambda s, d: table(s, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).cast("long")).filter("rank <= 10").select("o_orderstatus", "o_orderkey", "rank"), "SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 10")
add("f6_most_common", lambda s, d: activities(s, d).groupBy("user_id", F.hour("occurred_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "hour")).cast("long")).filter("rank <= 3"), "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS rank FROM (SELECT user_id, hour(occurred_at)::BIGINT AS hour, count(*) AS n FROM activities GROUP BY 1, 2) QUALIFY rank <= 3", ACTIVITIES)
add("h8_normalize_entity", lambda s, d: entities(s, d).select("id", N.normal_name(F.concat(F.lit("  "), F.regexp_replace("name", " ", "   "), F.lit("'s"))).alias("name")), "SELECT id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS name FROM entities", ENTITIES)
VOTES = ", ".join("{'n': -len(list_filter(ws, lambda w: list_contains([" + ", ".join(f"'{w}'" for w in ws) + f"], w))), 'name': '{k}'" + "}" for k, ws in sorted(PROFILES.items()))
add("h14_detect_language", lambda s, d: table(s, d, "documents").select("doc_id", N.detect_language(F.col("text"), PROFILES).alias("language")),
    f"SELECT doc_id, CASE WHEN length(text) < 10 OR b.n = 0 THEN 'en' ELSE b.name END AS language FROM (SELECT doc_id, text, list_min([{VOTES}]) AS b FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^a-zà-ÿß]+') AS ws FROM documents))")
add("h20_best_snippet", lambda s, d: table(s, d, "documents").select("doc_id", N.snippet(F.col("text"), "license").alias("snippet")), "SELECT doc_id, text[greatest(instr(lower(text), 'license') - 40, 1) : greatest(instr(lower(text), 'license') - 40, 1) + 79] AS snippet FROM documents")
add("h23_char_hash_vector", lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(N.hash_vector(F.col("p_name"), 32)).alias("place", "x")).filter("x > 0").select("p_partkey", F.col("place").cast("long").alias("place"), "x"),
    "SELECT p_partkey, (ascii(p_name[i]) * i % 32)::BIGINT AS place, count(*)::DOUBLE AS x FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) GROUP BY 1, 2")
add("h25_quiet_hours", lambda s, d: activities(s, d).select("id", N.in_quiet_hours(F.col("occurred_at"), 22, 7).alias("quiet")), "SELECT id, hour(occurred_at) >= 22 OR hour(occurred_at) < 7 AS quiet FROM activities", ACTIVITIES)
add("h26_text_summary", lambda s, d: daily_metrics(activities(s, d)).select("user_id", "date", F.format_string("%d switches, focus %s", "context_switches", F.when(F.col("focus_score") >= 7, "high").when(F.col("focus_score") >= 4, "fair").otherwise("low")).alias("summary")), "SELECT user_id, date, context_switches || ' switches, focus ' || CASE WHEN focus_score >= 7 THEN 'high' WHEN focus_score >= 4 THEN 'fair' ELSE 'low' END AS summary FROM metrics", *ALL)
add("i8_co_occurrence_stream", lambda s, d: N.strength_fold(links(s, d)).withColumn("strength", F.round("strength", 9)),
    """, p AS (SELECT a.entity_id AS a, b.entity_id AS b, a.activity_id AS t, CASE WHEN (a.relevance_score + b.relevance_score) / 2 >= 0.95 THEN 0.9 WHEN (a.relevance_score + b.relevance_score) / 2 >= 0.9 THEN 0.7 ELSE 0.5 END::DOUBLE AS s
             FROM links a JOIN links b ON a.activity_id = b.activity_id AND a.entity_id < b.entity_id),
       k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t) AS k FROM p),
       f AS (SELECT a, b, k, s FROM k WHERE k = 1 UNION ALL SELECT k.a, k.b, k.k, (f.s + k.s) / 2 FROM f JOIN k ON k.a = f.a AND k.b = f.b AND k.k = f.k + 1)
       SELECT a, b, round(arg_max(s, k), 9) AS strength, max(k) AS n FROM f GROUP BY 1, 2""", REC)  # fmt: skip
add("i5_log_read", lambda s, d: table(s, d, "events").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")).filter("version > 5 and version <= 15").select("event_id", "user_id", "version"), "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events QUALIFY version > 5 AND version <= 15")
add("k14_prerequisites", lambda s, d: N.prerequisites(G.co_occurrence(links(s, d)), entities(s, d), 0.4),
    """SELECT CASE WHEN x.first_seen < y.first_seen THEN src ELSE dst END AS prerequisite, CASE WHEN x.first_seen < y.first_seen THEN dst ELSE src END AS advanced, weight AS n, round(s, 6) AS strength, round(least(1.0, s * (1 + ln(1 + weight) * 0.1)), 6) AS confidence, 'temporal' AS basis
       FROM (SELECT *, weight / max(weight) OVER () AS s FROM pairs) JOIN entities x ON src = x.id JOIN entities y ON dst = y.id WHERE s >= 0.4""", LINKS, ENTITIES, PAIRS)  # fmt: skip
add("k17_topic_subgraph", lambda s, d: strong(s, d).join(entities(s, d).filter("entity_type = 'SMALL'").select(F.col("id").alias("src")), "src", "left_semi").join(entities(s, d).filter("entity_type = 'SMALL'").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "weight"),
    "SELECT src, dst, weight FROM strong JOIN entities x ON src = x.id AND x.entity_type = 'SMALL' JOIN entities y ON dst = y.id AND y.entity_type = 'SMALL'", LINKS, ENTITIES, PAIRS, BOTH, STRONG)
ALLOWED = [("USES", "SMALL", "LARGE"), ("USES", "LARGE", "SMALL"), ("RELATED_TO", "SMALL", "SMALL")]


def _k20(s, d):
    kind = entities(s, d).select("id", "entity_type")
    e = strong(s, d).join(kind.withColumnsRenamed({"id": "src", "entity_type": "from_type"}), "src").join(kind.withColumnsRenamed({"id": "dst", "entity_type": "to_type"}), "dst")
    e = e.withColumn("rel_type", F.when(F.col("from_type") == F.col("to_type"), "RELATED_TO").otherwise("USES"))
    return N.valid_edges(e, s.createDataFrame(ALLOWED, "rel_type string, from_type string, to_type string")).select("src", "dst", "rel_type", "valid")


add("k20_validate_edges", _k20, "SELECT src, dst, CASE WHEN x.entity_type = y.entity_type THEN 'RELATED_TO' ELSE 'USES' END AS rel_type, (x.entity_type, y.entity_type) IN (('SMALL', 'LARGE'), ('LARGE', 'SMALL'), ('SMALL', 'SMALL')) AS valid FROM strong JOIN entities x ON src = x.id JOIN entities y ON dst = y.id", LINKS, ENTITIES, PAIRS, BOTH, STRONG)
add("k29_similar_nodes", lambda s, d: _similar(s, d), "SELECT query_id, id, round(c, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) WHERE c >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) <= 5")


def _similar(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return Q.cosine_search(v, q, 5, 0.2).select("query_id", "id", F.round("score", 6).alias("score"))


add("k33_delete_node", lambda s, d: strong(s, d).join(table(s, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("src")), "src", "left_anti").join(table(s, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("dst")), "dst", "left_anti").select("src", "dst", "weight"), "SELECT src, dst, weight FROM strong WHERE src % 10 <> 0 AND dst % 10 <> 0", LINKS, PAIRS, BOTH, STRONG)
add("k11_all_paths", lambda s, d: G.simple_paths(strong(s, d), 1, 2, 3, 10).select(F.array_join("path", ">").alias("path"), "hops", "cost"),
    """, r AS (SELECT [src, dst] AS path, dst AS here, weight::DOUBLE AS cost FROM strong WHERE src = 1 UNION ALL SELECT list_append(path, dst), dst, cost + weight FROM r JOIN strong ON here = src WHERE here <> 2 AND NOT list_contains(path, dst) AND len(path) < 4)
       SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops, cost FROM r WHERE here = 2 ORDER BY hops, cost, r.path LIMIT 10""", *RV, STRONG)  # fmt: skip
add("l13_type_search", lambda s, d: activities(s, d).filter(F.contains(F.lower("title"), F.lit("zoom"))).select(F.lit("activity").alias("kind"), "id", F.col("title").alias("name")).unionByName(entities(s, d).filter(F.contains(F.lower("name"), F.lit("red"))).select(F.lit("entity").alias("kind"), "id", "name")),
    "SELECT 'activity' AS kind, id, title AS name FROM activities WHERE contains(lower(title), 'zoom') UNION ALL SELECT 'entity', id, name FROM entities WHERE contains(lower(name), 'red')", ACTIVITIES, ENTITIES)
add("l11_build_context", lambda s, d: table(s, d, "documents").select("doc_id", "source", F.least(F.length("text"), F.lit(500)).alias("n")).withColumn("used", F.sum("n").over(Window.partitionBy("source").orderBy("doc_id"))).filter("used <= 4000").select("source", "doc_id", "used"), "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(least(length(text), 500)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 4000")

dates_as_text("first_seen last_seen", "a7_upsert_nodes")
dates_as_text("monday", "b14_snap_to_monday")
dates_as_text("date", "h26_text_summary")
