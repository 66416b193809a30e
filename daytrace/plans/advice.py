"""Queries on advice, exports, embeddings of graphs and the remaining listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import advice as V
from ..operators import graph as G
from ..operators import people as O
from ..operators import sessions as S
from ..sources.tables import ACTIVITIES, APPS, ENTITIES, LINKS, activities, entities, links, request_log, table
from .graphs import BOTH, PAIRS, STRONG, strong
from .productivity import ALL, daily_metrics
from .records import HOURS, SK, skill_table
from .registry import add, dates_as_text
from .sequences import QUOTA

EXT = "|".join(V.BINARY)
add("a6_ingest_content", lambda s, d: V.ingestible(table(s, d, "pages")).select("page_id", F.sha2("snippet", 256).alias("snippet_sha256"), "tier"),
    f"""SELECT page_id, sha256(html[1:500]) AS snippet_sha256, CASE WHEN length(html) >= 2000 THEN 'high' WHEN length(html) >= 1000 THEN 'medium' ELSE 'low' END AS tier FROM pages
        WHERE NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '^[a-z]+://(localhost|127\\.0\\.0\\.1)([:/]|$)') AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.({EXT})$')""")  # fmt: skip
add("a12_export_analytics", lambda s, d: daily_metrics(activities(s, d)).withColumn("section", F.lit("daily")).unpivot(["section", "user_id", "date"], ["total_hours", "deep_work_hours", "focus_score"], "metric", "value"),
    "SELECT * FROM (UNPIVOT (SELECT 'daily' AS section, user_id, date, total_hours, deep_work_hours, focus_score FROM metrics) ON total_hours, deep_work_hours, focus_score INTO NAME metric VALUE value)", *ALL)


def _d29(s, d):
    m = activities(s, d).filter("type = 'meeting'").select("user_id", F.from_json("data", "platform string, participants array<string>").alias("x"))
    met = m.select("user_id", "x.platform", F.explode("x.participants").alias("p")).groupBy("user_id").agg(F.count_distinct("p").alias("people"), F.count(F.lit(1)).alias("interactions"), F.count_distinct("platform").alias("kinds"))
    return V.collaboration_score(met).select("user_id", "people", "interactions", "kinds", F.round("score", 6).alias("score"))


add("d29_collab_weekly", _d29, """SELECT user_id, people, interactions, kinds, round(least(people / 10, 1.0) * 3 + least(interactions / 25, 1.0) * 4 + least(kinds / 3, 1.0) * 3, 6) AS score FROM (
    SELECT user_id, count(DISTINCT p) AS people, count(*) AS interactions, count(DISTINCT platform) AS kinds FROM (
      SELECT user_id, json_extract_string(data, '$.platform') AS platform, unnest(CAST(json_extract(data, '$.participants') AS VARCHAR[])) AS p FROM activities WHERE type = 'meeting') GROUP BY 1)""", ACTIVITIES)  # fmt: skip
ROLES = {"analyst": ["Data Analysis", "Writing", "Coding"], "engineer": ["Coding", "Shell"], "manager": ["Meetings", "Messaging", "Writing"]}
add("d31_role_readiness", lambda s, d: V.role_readiness(O.skill_hours(activities(s, d), skill_table(s)).filter("hours >= 2"), s.createDataFrame(list(ROLES.items()), "role string, required array<string>")).select("user_id", "role", F.round("readiness", 6).alias("readiness"), F.array_join("missing", ",").alias("missing"), "best_fit"),
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY readiness DESC, role) = 1 AS best_fit FROM (SELECT user_id, role, round(len(list_intersect(own, req)) / len(req), 6) AS readiness, array_to_string(list_sort(list_filter(req, lambda r: NOT list_contains(own, r))), ',') AS missing FROM (SELECT user_id, list(DISTINCT skill) AS own FROM hours WHERE round(hours, 6) >= 2 GROUP BY 1), (VALUES "
    + ", ".join(f"('{r}', [" + ", ".join(f"'{x}'" for x in xs) + "])" for r, xs in ROLES.items()) + ") v(role, req))", ACTIVITIES, SK, HOURS)
add("d38_weekly_trends", lambda s, d: S.week_over_week(daily_metrics(activities(s, d)), "deep_work_hours").select("user_id", "week_start", "direction"),
    "SELECT user_id, week_start, CASE WHEN b <> 0 AND (v - b) / b * 100 > 5 THEN 'up' WHEN b <> 0 AND (v - b) / b * 100 < -5 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY week_start) AS b FROM (SELECT user_id, date_trunc('week', date)::DATE AS week_start, avg(deep_work_hours) AS v FROM metrics GROUP BY 1, 2))", *ALL)
add("d53_quota_usage", lambda s, d: S.sliding_quota(request_log(s, d), QUOTA).groupBy("endpoint").agg(F.count(F.lit(1)).alias("requests"), F.count("violated").alias("blocked"), F.round(F.count("violated") / F.count(F.lit(1)) * 100, 4).alias("blocked_pct"), F.count_distinct("user_id").alias("users")),
    """SELECT endpoint, count(*) AS requests, count(*) FILTER (b) AS blocked, round(count(*) FILTER (b) / count(*) * 100, 4) AS blocked_pct, count(DISTINCT user_id) AS users FROM (
         SELECT event_type AS endpoint, user_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 2 OR count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 14399999999 PRECEDING AND CURRENT ROW) > 3
                OR count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) > 5 AS b FROM events) GROUP BY 1""")  # fmt: skip
add("h9_spelling_correct", lambda s, d: activities(s, d).filter("app is not null").select("id", V.spelling(F.concat("app", F.lit(" pyhton"))).alias("name")), "SELECT id, " + "CASE lower(app) " + " ".join(f"WHEN '{a.lower()}' THEN '{V.CASING[a.lower()]}'" for a in APPS if a.lower() in V.CASING) + " ELSE app END || ' Python' AS name FROM activities WHERE app IS NOT NULL", ACTIVITIES)
add("h16_graph_tags", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(V.content_tags(F.col("source"), F.pmod("doc_id", F.lit(100))), ",").alias("tags")), "SELECT doc_id, CASE WHEN doc_id % 100 >= 70 THEN 'tier:core,' WHEN doc_id % 100 >= 50 THEN 'tier:important,' WHEN doc_id % 100 >= 35 THEN 'tier:useful,' ELSE '' END || 'type:' || source AS tags FROM documents")
add("k27_infer_relation_type", lambda s, d: G.cross_type(links(s, d), entities(s, d), 3, 50).select("a", "b", F.when(F.col("weight") >= 5, "STRONGLY_RELATED").otherwise("RELATED_TO").alias("rel_type")),
    """SELECT a, b, CASE WHEN weight >= 5 THEN 'STRONGLY_RELATED' ELSE 'RELATED_TO' END AS rel_type FROM (SELECT *, row_number() OVER (PARTITION BY ta, tb ORDER BY weight DESC, a, b) AS r FROM (
         SELECT least(x.entity_type, y.entity_type) AS ta, greatest(x.entity_type, y.entity_type) AS tb, CASE WHEN x.entity_type < y.entity_type THEN src ELSE dst END AS a, CASE WHEN x.entity_type < y.entity_type THEN dst ELSE src END AS b, weight
         FROM pairs JOIN entities x ON src = x.id JOIN entities y ON dst = y.id WHERE weight >= 3 AND x.entity_type <> y.entity_type)) WHERE r <= 50""", LINKS, ENTITIES, PAIRS)  # fmt: skip


def _k23(s, d):
    e = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "AUTHORED").otherwise("CITES").alias("rel_type"), F.when(F.col("l_partkey") % 2 == 0, F.create_map(F.lit("position"), F.lit("1"))).otherwise(F.create_map(F.lit("context"), F.lit("x"))).alias("props"))
    return V.missing_props(e, {"AUTHORED": ["position"], "CITES": ["context", "year"]}).groupBy("rel_type", F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


add("k23_required_props", _k23, "SELECT CASE WHEN l_linenumber = 1 THEN 'AUTHORED' ELSE 'CITES' END AS rel_type, CASE WHEN l_linenumber = 1 THEN CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'position' END ELSE CASE WHEN l_partkey % 2 = 0 THEN 'context,year' ELSE 'year' END END AS missing, count(*) AS n FROM lineitem GROUP BY 1, 2")
add("k32_neighbors", lambda s, d: strong(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")).cast("long")).filter("rank <= 100"), "SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM strong QUALIFY rank <= 100", LINKS, PAIRS, BOTH, STRONG)
dates_as_text("date", "a12_export_analytics")
dates_as_text("week_start", "d38_weekly_trends")
