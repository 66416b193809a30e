"""Queries on provider answers, languages, expertise and sampled betweenness (A, D, H, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expertise as X
from ..operators import graph as G
from ..operators import language as L
from ..operators.people import hours_of_skills
from ..sources import wearables as W
from ..sources.tables import ACTIVITIES, ENTITIES, LINKS, activities, entities, links, table
from .graphs import BOTH, PAIRS, edges, strong
from .records import HOURS, SK, skill_table
from .registry import add
from .texts import docs


def answers(s, d):
    """Events as landed answers of two services; every eleventh is cut short, and some numbers are words."""
    e = table(s, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "v": F.floor("value").cast("int"), "w": F.col("event_id") % 8})
    body = (
        F.when(F.col("w") == 0, F.format_string('{"summary":{"steps":%d,"caloriesOut":%d,"fairlyActiveMinutes":%d,"veryActiveMinutes":7}}', F.col("v") * 100, F.col("k") * 20, "k"))
        .when(F.col("w") == 1, F.format_string('{"activities-heart":[{"value":{"restingHeartRate":%d}}]}', F.col("k") % 60))
        .when(F.col("w") == 2, F.when(F.col("k") % 2 == 0, F.format_string('{"sleep":[{"minutesAsleep":%d,"levels":{"summary":{"deep":{"minutes":%d},"rem":{}}}}]}', "k", "v")).otherwise(F.lit('{"sleep":[]}')))
        .when(F.col("w") == 3, F.format_string('{"value":{"avg":%s}}', F.when(F.col("k") % 5 == 0, F.lit('"high"')).otherwise(F.col("v").cast("string"))))
        .when(F.col("w") == 4, F.format_string('{"data":[{"score":%d,"day":"2024-01-0%d"},{"score":%d}]}', "k", F.col("k") % 9 + 1, "v"))
        .when(F.col("w") == 5, F.format_string('{"data":[{"total_sleep_duration":%d,"deep_sleep_duration":%d,"average_hrv":%d}]}', F.col("k") * 60, "v", F.col("k") % 4))
        .otherwise(F.lit('{"data":[]}'))
    )
    provider = F.when(F.col("w") < 4, "fitbit").otherwise("oura")
    endpoint = F.element_at(F.array(*[F.lit(x) for x in ("activities", "heart", "sleep", "spo2", "daily_readiness", "sleep", "daily_spo2", "moods")]), (F.col("w") + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), "user_id", provider.alias("provider"), endpoint.alias("endpoint"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 11 == 0, F.left(body, F.lit(9))).otherwise(body).alias("body"))


E = "e AS (SELECT event_id AS id, user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract(props, '$.k') AS INTEGER) AS k, floor(value)::INTEGER AS v, event_id % 8 AS w FROM events WHERE event_id % 11 > 0)"
add("a4_provider_metrics", lambda s, d: W.metric_rows(answers(s, d))[0].withColumn("metric_value", F.round("metric_value", 6)),
    """SELECT id, user_id, provider, metric_type, round(metric_value::DOUBLE, 6) AS metric_value, metric_unit, recorded_at FROM (
         SELECT id, user_id, 'fitbit' AS provider, 'steps' AS metric_type, v * 100 AS metric_value, 'steps' AS metric_unit, day AS recorded_at FROM e WHERE w = 0
         UNION ALL SELECT id, user_id, 'fitbit', 'calories', k * 20, 'kcal', day FROM e WHERE w = 0 UNION ALL SELECT id, user_id, 'fitbit', 'active_minutes', k + 7, 'minutes', day FROM e WHERE w = 0
         UNION ALL SELECT id, user_id, 'fitbit', 'heart_rate_resting', k % 60, 'bpm', day FROM e WHERE w = 1 AND k % 60 > 0
         UNION ALL SELECT id, user_id, 'fitbit', m, x, u, day FROM (SELECT *, unnest([('sleep_duration', k, 'minutes'), ('sleep_efficiency', 0, 'percent'), ('sleep_deep', v, 'minutes'), ('sleep_rem', 0, 'minutes')]) AS t, t[1] AS m, t[2] AS x, t[3] AS u FROM e WHERE w = 2 AND k % 2 = 0)
         UNION ALL SELECT id, user_id, 'fitbit', 'spo2', v, 'percent', day FROM e WHERE w = 3 AND k % 5 > 0 AND v <> 0
         UNION ALL SELECT id, user_id, 'oura', 'readiness_score', k, 'score', '2024-01-0' || (k % 9 + 1) FROM e WHERE w = 4 UNION ALL SELECT id, user_id, 'oura', 'readiness_score', v, 'score', day FROM e WHERE w = 4
         UNION ALL SELECT id, user_id, 'oura', m, x, u, day FROM (SELECT *, unnest([('sleep_duration', k::DOUBLE, 'minutes'), ('sleep_deep', v / 60, 'minutes'), ('sleep_rem', 0.0::DOUBLE, 'minutes')]) AS t, t[1] AS m, t[2] AS x, t[3] AS u FROM e WHERE w = 5)
         UNION ALL SELECT id, user_id, 'oura', 'hrv', k % 4, 'ms', day FROM e WHERE w = 5 AND k % 4 > 0)""", E)  # fmt: skip
add("a4_set_aside", lambda s, d: W.metric_rows(answers(s, d))[1],
    """SELECT event_id AS id, 'not JSON' AS reason FROM events WHERE event_id % 11 = 0 UNION ALL SELECT id, 'unknown endpoint' FROM e WHERE w = 7 UNION ALL SELECT id, 'no number: spo2' FROM e WHERE w = 3 AND k % 5 = 0""", E)  # fmt: skip


def _h14(s, d):
    """Profiles of two thirds of the documents, by a checksum of the identifier, and the language of all."""
    all_ = docs(s, d)
    return L.detect_language(all_, L.language_profiles(all_.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)))


add("h14_language_profiles", _h14)


def _d32(s, d):
    seen = links(s, d).groupBy(F.col("entity_id").alias("id")).agg(F.avg(F.col("relevance_score").cast("double")).alias("confidence"))
    deg = G.degree(G.both_ways(edges(s, d))).select("id", "degree")
    central = deg.crossJoin(F.broadcast(deg.agg(F.max("degree").alias("most")))).select("id", (F.col("degree") / F.col("most")).alias("centrality"))  # one row
    known = entities(s, d).select("id", "user_id", F.col("occurrence_count").alias("frequency")).join(seen, "id", "left")
    return X.expertise_rank(known, central)


add("d32_expertise_rank", _d32,
    """, c AS (SELECT src AS id, count(*) AS deg FROM both_ways GROUP BY 1), r AS (SELECT entity_id AS id, avg(relevance_score::DOUBLE) AS conf FROM links GROUP BY 1),
       x AS (SELECT e.id, user_id, ln(1 + occurrence_count) * 0.4::DOUBLE + coalesce(conf, 0.5) * 0.3::DOUBLE + coalesce(deg / (SELECT max(deg) FROM c), 0) * 0.3::DOUBLE AS s FROM entities e LEFT JOIN c ON c.id = e.id LEFT JOIN r ON r.id = e.id)
       SELECT id, user_id, round(s, 3) AS expertise_score, CASE WHEN s >= 2 THEN 'expert' WHEN s >= 1 THEN 'proficient' WHEN s >= 0.5 THEN 'intermediate' ELSE 'beginner' END AS level FROM x""", LINKS, ENTITIES, PAIRS, BOTH)  # fmt: skip
TARGET = [("Coding", 4.0), ("Data Analysis", 50.0), ("Writing", 1.0), ("Statistics", 10.0), ("Messaging", 3.0)]


def _gaps(s, d):
    own = hours_of_skills(activities(s, d), skill_table(s)).select("user_id", "skill", F.col("hours").alias("score"))
    return X.profile_gaps(own, s.createDataFrame(TARGET, "skill string, required double"))


add("d32_skill_gaps", _gaps,
    """, t AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k.lower()}', {v}::DOUBLE)" for k, v in TARGET) + """) v(skill, required)),
       g AS (SELECT u.user_id, t.skill, required - coalesce(hours, 0) AS gap, hours IS NULL AS none FROM (SELECT DISTINCT user_id FROM hours) u CROSS JOIN t LEFT JOIN hours h ON h.user_id = u.user_id AND lower(h.skill) = t.skill)
       SELECT user_id, coalesce(string_agg(skill, ',' ORDER BY gap DESC, skill) FILTER (none), '') AS missing, coalesce(string_agg(skill, ',' ORDER BY gap DESC, skill) FILTER (NOT none AND gap > 30), '') AS weak,
              coalesce(string_agg(skill, ',' ORDER BY gap DESC, skill) FILTER (NOT none AND gap > 0 AND gap <= 30), '') AS matched, coalesce(string_agg(skill, ',' ORDER BY gap DESC, skill) FILTER (NOT none AND gap <= 0), '') AS strong,
              round(count(*) FILTER (NOT none AND gap <= 30) / count(*) * 100, 1) AS readiness FROM g GROUP BY 1""", ACTIVITIES, SK, HOURS)  # fmt: skip
add("k3_sampled_betweenness", lambda s, d: X.sampled_betweenness(strong(s, d), 0.1))
