"""Queries on entities, goals, wellness, conversations, deduplication and sync (A, C, D, E, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as D
from ..operators import people as O
from ..operators import resolve as R
from ..sources import sync as Y
from ..sources.tables import ACTIVITIES, APPS, ENTITIES, GOALS, KNOWN, LINKS, METRICS, WEARABLE, activities, entities, goals, known_entities, links, table, wearable_data
from .productivity import DAILY, PREPARED, as_of, daily_metrics
from .registry import add, dates_as_text

V = (ACTIVITIES, PREPARED, DAILY)
SKILLS = {"vscode": ("Coding", "Engineering"), "pycharm": ("Coding", "Engineering"), "jupyter": ("Data Analysis", "Data"), "terminal": ("Shell", "Engineering"), "Notion": ("Writing", "Communication"), "Zoom": ("Meetings", "Communication"), "Slack": ("Messaging", "Communication"), "Outlook": ("Messaging", "Communication")}


def skill_table(s):
    return s.createDataFrame([(a, *v) for a, v in SKILLS.items()], "app string, skill string, skill_category string")


def metrics(s, d):
    return daily_metrics(activities(s, d))


SK = "sk AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{v[0]}', '{v[1]}')" for a, v in SKILLS.items()) + ") v(app, skill, skill_category))"
HOURS = "hours AS (SELECT user_id, coalesce(skill, a.app) AS skill, coalesce(skill_category, 'Other') AS category, sum(coalesce(duration_seconds, 0)) / 3600 AS hours FROM activities a LEFT JOIN sk ON a.app = sk.app WHERE a.app IS NOT NULL GROUP BY 1, 2, 3)"
add("d30_skill_levels", lambda s, d: O.skill_hours(activities(s, d), skill_table(s)),
    """SELECT user_id, skill, category, round(hours, 6) AS hours, round(hours / nullif(sum(hours) OVER (PARTITION BY user_id), 0), 6) AS share,
              CASE WHEN hours >= 200 THEN 'master' WHEN hours >= 100 THEN 'expert' WHEN hours >= 50 THEN 'advanced' WHEN hours >= 20 THEN 'intermediate' ELSE 'beginner' END AS level,
              round(CASE WHEN hours >= 200 THEN 100 WHEN hours >= 100 THEN (hours - 100) / 100 * 100 WHEN hours >= 50 THEN (hours - 50) / 50 * 100 WHEN hours >= 20 THEN (hours - 20) / 30 * 100 ELSE hours / 20 * 100 END, 4) AS progress FROM hours""", ACTIVITIES, SK, HOURS)  # fmt: skip
add("d32_cross_domain_entropy", lambda s, d: O.category_entropy(O.skill_hours(activities(s, d), skill_table(s))),
    """SELECT user_id, n AS categories, round(e, 6) AS entropy, round(CASE WHEN n > 1 THEN e / log2(n) ELSE 0 END, 6) AS evenness FROM (SELECT user_id, count(*) AS n, sum(-p * log2(p)) AS e FROM (
         SELECT user_id, h / sum(h) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, category, sum(round(hours, 6)) AS h FROM hours GROUP BY 1, 2) WHERE h > 0) GROUP BY 1)""", ACTIVITIES, SK, HOURS)  # fmt: skip


def _d30(s, d):
    a = activities(s, d)
    return O.skill_growth(a, as_of(a))


add("d30_skill_growth", _d30,
    """SELECT user_id, app, round(n, 6) AS hours_now, round(b, 6) AS hours_before, round(p, 4) AS growth_pct, CASE WHEN p > 10 THEN 'increasing' WHEN p < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM (
         SELECT *, CASE WHEN b > 0 THEN (n - b) / b * 100 WHEN n > 0 THEN 100 ELSE 0 END AS p FROM (SELECT user_id, app, coalesce(sum(h) FILTER (back < 7), 0) AS n, coalesce(sum(h) FILTER (back >= 7), 0) / 4 AS b FROM (
           SELECT user_id, app, coalesce(duration_seconds, 0) / 3600 AS h, date_diff('day', occurred_at::DATE, (SELECT max(occurred_at)::DATE FROM activities)) AS back FROM activities WHERE app IS NOT NULL) WHERE back < 35 GROUP BY 1, 2))""", ACTIVITIES)  # fmt: skip
add("d33_goal_stats", lambda s, d: O.goal_stats(goals(s, d)),
    """SELECT user_id, count(*) AS goals, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'paused') AS paused,
              round(count(*) FILTER (status = 'completed') / count(*) * 100, 4) AS completion_rate, round(avg(least(100.0, current_value / nullif(target_value, 0) * 100)), 4) AS mean_progress FROM goals GROUP BY 1""", GOALS)  # fmt: skip


def _d33(s, d):
    g = goals(s, d)
    return O.deadlines(g, as_of(g, "started"))


add("d33_deadlines", _d33,
    """SELECT id, user_id, n AS days_left, CASE WHEN n < 0 THEN 'overdue' WHEN n <= 3 THEN 'critical' WHEN n <= 7 THEN 'soon' WHEN n <= 30 THEN 'upcoming' ELSE 'later' END AS urgency
       FROM (SELECT *, date_diff('day', (SELECT max(started) FROM goals), deadline) AS n FROM goals WHERE status = 'active')""", GOALS)  # fmt: skip
add("d33_goal_milestones", lambda s, d: O.goal_milestones(goals(s, d)), "SELECT id, t::BIGINT AS threshold FROM goals, (VALUES (25), (50), (75), (100)) v(t) WHERE current_value / nullif(target_value, 0) * 100 >= t", GOALS)
BOUNDS = [10, 50, 100, 250]
add("d49_latency_histogram", lambda s, d: O.latency_histogram(table(s, d, "events").select("event_type", "value"), "value", ["event_type"], BOUNDS),
    """SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, """ + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in BOUNDS) + """,
              max(value) FILTER (r = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99
       FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")  # fmt: skip


def _d42(s, d):
    a = activities(s, d)
    return O.platform_overview(a, as_of(a))


add("d42_platform_overview", _d42, "SELECT count(DISTINCT user_id) AS users, count(*) AS activities, count(DISTINCT user_id) FILTER (occurred_at >= m - INTERVAL 7 DAY) AS active_users FROM activities, (SELECT max(occurred_at) AS m FROM activities)", ACTIVITIES)


def _d43(s, d):
    a = activities(s, d)
    return O.usage_quota(a, as_of(a), 80)


add("d43_usage_quota", _d43, """SELECT user_id, n AS used, round(n / 80 * 100, 4) AS percent, CASE WHEN n >= 80 THEN 'exceeded' WHEN n / 80 * 100 > 70 THEN 'warning' ELSE 'ok' END AS state
    FROM (SELECT user_id, count(*) AS n FROM activities WHERE date_trunc('month', occurred_at) = date_trunc('month', (SELECT max(occurred_at) FROM activities)) GROUP BY 1)""", ACTIVITIES)  # fmt: skip
add("d44_ingest_stats", lambda s, d: activities(s, d).groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")), "SELECT source, type, count(*) AS n, count(DISTINCT user_id) AS users FROM activities GROUP BY 1, 2", ACTIVITIES)
add("d44_entity_stats", lambda s, d: entities(s, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrence_count").alias("mentions"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")), "SELECT entity_type, count(*) AS n, sum(occurrence_count)::BIGINT AS mentions, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM entities GROUP BY 1", ENTITIES)
add("d45_conversation_stats", lambda s, d: O.conversation_stats(table(s, d, "conversations")), "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS from_user, count(*) FILTER (role = 'assistant') AS from_assistant, sum(length(text))::BIGINT AS characters FROM conversations GROUP BY 1")
add("e11_memory_window", lambda s, d: O.memory_window(table(s, d, "conversations")),
    """SELECT conv_id, r AS recent_messages, coalesce(array_to_string(o[1:5], ' | '), '') AS digest, regexp_split_to_array(f, '[.!?\\n]')[1][1:50] AS title FROM (
         SELECT conv_id, count(*) FILTER (b <= 4) AS r, array_agg(text[1:100] ORDER BY turn) FILTER (b > 4 AND role = 'user') AS o, arg_min(text, turn) FILTER (role = 'user') AS f
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) GROUP BY 1)""")  # fmt: skip
add("a22_export_conversations", lambda s, d: O.export_markdown(table(s, d, "conversations")).select("conv_id", F.sha2("markdown", 256).alias("markdown_sha256")),
    "SELECT conv_id, sha256(string_agg('**' || upper(role[1:1]) || role[2:] || '**: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS markdown_sha256 FROM conversations GROUP BY 1")
add("c7_client_id_dedup", lambda s, d: R.client_id_duplicates(activities(s, d)), "SELECT id, o AS original_id FROM (SELECT id, min(id) OVER (PARTITION BY user_id, source, client_generated_id) AS o FROM activities) WHERE id > o", ACTIVITIES)
HB = "CASE WHEN coalesce(duration_seconds, 0) < 5 THEN 0 WHEN coalesce(duration_seconds, 0) < 30 THEN 1 WHEN coalesce(duration_seconds, 0) < 120 THEN 2 WHEN coalesce(duration_seconds, 0) < 600 THEN 3 ELSE 4 END"
add("c7_heuristic_dedup", lambda s, d: R.heuristic_duplicates(activities(s, d), 3600),
    f"""SELECT a.id, arg_min(b.id, (a.b <> b.b, b.id)) AS original_id, bool_or(a.b = b.b) AS same_bucket FROM (SELECT *, {HB} AS b, coalesce(nullif(lower(domain), ''), nullif(lower(app), ''), '') AS place FROM activities) a
        JOIN (SELECT *, {HB} AS b, coalesce(nullif(lower(domain), ''), nullif(lower(app), ''), '') AS place FROM activities) b
        ON a.user_id = b.user_id AND a.type = b.type AND a.place = b.place AND b.id < a.id AND abs(epoch_us(a.occurred_at) - epoch_us(b.occurred_at)) / 1e6 <= 3600 GROUP BY 1""", ACTIVITIES)  # fmt: skip
def _as_text(x):
    return x.withColumn("reasons", F.array_join("reasons", ","))


add("m1_entity_dedup_scan", lambda s, d: _as_text(D.entity_pairs(known_entities(s, d))))
add("m1_entity_clusters", lambda s, d: (lambda e: D.entity_clusters(e, D.pair_sums(e)).withColumn("match_reasons", F.array_join("match_reasons", ",")))(known_entities(s, d)))
NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
CLASSES = f"""
classes AS (
  SELECT min(id) AS rep, count(*) AS n, user_id, entity_type, norm, list_distinct(string_split(norm, ' ')) AS tokens, al, sku
  FROM (SELECT *, {NORM.format("name")} AS norm, list_sort(list_distinct(list_transform(aliases, lambda a: {NORM.format("a")}))) AS al FROM known) GROUP BY user_id, entity_type, norm, al, sku
)"""
add("c14_entity_pair_join", lambda s, d: _as_text(D.entity_pairs(known_entities(s, d), ratio=False)).drop("ratio", "n_pairs"),
    f""", p AS (SELECT x.user_id, x.entity_type, x.rep AS a, y.rep AS b, coalesce(x.sku = y.sku, false) AS external,
              CASE WHEN len(x.al) > 0 AND len(y.al) > 0 THEN len(list_intersect(x.al, y.al)) / greatest(len(x.al), len(y.al)) ELSE 0 END AS alias,
              len(list_intersect(x.tokens, y.tokens)) AS k, k / greatest(len(x.tokens), len(y.tokens)) AS o, CASE WHEN k = least(len(x.tokens), len(y.tokens)) THEN greatest(o, 0.9) ELSE o END AS overlap
              FROM classes x JOIN classes y ON x.user_id = y.user_id AND x.entity_type = y.entity_type AND x.rep < y.rep),
       z AS (SELECT user_id, entity_type, a, b, overlap, alias, external, least(1.0, greatest(CASE WHEN external THEN 0.99 ELSE 0 END, CASE WHEN overlap >= 0.6 THEN overlap ELSE 0 END, alias) + 0.05) AS score,
              CASE WHEN alias > 0 THEN ['alias_match'] ELSE [] END || CASE WHEN external THEN ['external_id'] ELSE [] END || CASE WHEN overlap >= 0.6 THEN ['token_set'] ELSE [] END AS reasons FROM p
              UNION ALL SELECT c.user_id, c.entity_type, rep, id, 1.0, (len(al) > 0)::INT, c.sku IS NOT NULL, 1.0,
              CASE WHEN len(al) > 0 THEN ['alias_match'] ELSE [] END || CASE WHEN c.sku IS NOT NULL THEN ['external_id'] ELSE [] END || ['fuzzy_name', 'token_set']
              FROM classes c JOIN known k ON k.user_id = c.user_id AND k.entity_type = c.entity_type AND {NORM.format("k.name")} = c.norm AND k.sku IS NOT DISTINCT FROM c.sku AND (len(k.aliases) > 0) = (len(al) > 0) WHERE id <> rep)
       SELECT user_id, entity_type, a, b, round(overlap::DOUBLE, 6) AS overlap, round(alias::DOUBLE, 6) AS alias, external, round(score::DOUBLE, 6) AS score, array_to_string(reasons, ',') AS reasons,
              CASE WHEN score >= 0.97 THEN 'auto_merge' WHEN score >= 0.8 THEN 'suggest' ELSE 'review' END AS recommendation FROM z WHERE score >= 0.75""", ENTITIES, KNOWN, CLASSES)  # fmt: skip
add("m3_candidates_for_entity", lambda s, d: D.candidates(known_entities(s, d)))
add("d54_duplicate_scan_stats", lambda s, d: D.scan_stats(known_entities(s, d)))
add("m5_should_merge", lambda s, d: D.should_merge(known_entities(s, d)),
    """, c AS (SELECT min(id) AS rep, user_id, entity_type, lower(name) AS n, list_sort(list_transform(aliases, lambda a: lower(a))) AS al, sku FROM known GROUP BY ALL)
       SELECT x.rep AS a, y.rep AS b FROM c x JOIN c y ON x.user_id = y.user_id AND x.entity_type = y.entity_type AND x.rep < y.rep WHERE x.n = y.n OR list_contains(y.al, x.n) OR list_contains(x.al, y.n) OR x.sku = y.sku
       UNION SELECT rep, id FROM c JOIN known k ON k.user_id = c.user_id AND k.entity_type = c.entity_type AND lower(k.name) = n AND k.sku IS NOT DISTINCT FROM c.sku AND (len(k.aliases) > 0) = (len(al) > 0) WHERE id <> rep""", ENTITIES, KNOWN)  # fmt: skip


def _m2(s, d):
    e = known_entities(s, d)
    same = e.groupBy("user_id", "entity_type", "name").agg(F.min("id").alias("canonical_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    clusters = e.join(same, ["user_id", "entity_type", "name"]).select("id", "canonical_id")
    merged, moved = D.merge_entities(e, links(s, d), clusters)
    sums = moved.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("activities"))
    x = merged.join(sums, "id", "left").fillna(0, ["activities"])
    return x.select("id", "occurrence_count", "first_seen", "last_seen", "name", F.array_join("aliases", "|").alias("aliases"), F.element_at("external_ids", "sku").alias("sku"), "activities")


add("m2_merge_entities", _m2,
    """, g AS (SELECT *, min(id) OVER w AS new_id, count(*) OVER w AS m FROM known WINDOW w AS (PARTITION BY user_id, entity_type, name))
       SELECT new_id AS id, sum(CASE WHEN m > 1 THEN greatest(occurrence_count, 1) ELSE occurrence_count END)::BIGINT AS occurrence_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen, any_value(name) AS name,
              array_to_string(list_sort(list_distinct(flatten(list(aliases || CASE WHEN id <> new_id THEN [name] ELSE [] END)))), '|') AS aliases, arg_max(sku, (id <> new_id, id)) FILTER (sku IS NOT NULL) AS sku,
              any_value(activities) AS activities
       FROM g JOIN (SELECT new_id, count(DISTINCT activity_id) AS activities FROM g JOIN links ON entity_id = id GROUP BY 1) USING (new_id) GROUP BY 1""", ENTITIES, KNOWN, LINKS)  # fmt: skip


def snapshots(s, d):
    a = activities(s, d).select("id", "user_id", "type", "duration_seconds", F.col("id").alias("updated_at"))
    r = a.filter("id % 3 <> 1").withColumn("duration_seconds", F.when(F.col("id") % 3 == 2, F.col("duration_seconds") + 60).otherwise(F.col("duration_seconds")))
    return a, r.withColumn("updated_at", F.col("updated_at") + F.when(F.col("id") % 6 == 2, 1).otherwise(0)).unionByName(r.filter("id % 100 = 0").withColumn("id", F.col("id") + 10_000_000))


SNAP = """
l AS (SELECT id, user_id, type, duration_seconds, id AS updated_at FROM activities),
r0 AS (SELECT id, user_id, type, CASE WHEN id % 3 = 2 THEN duration_seconds + 60 ELSE duration_seconds END AS duration_seconds, updated_at FROM l WHERE id % 3 <> 1),
r AS (SELECT id, user_id, type, duration_seconds, updated_at + CASE WHEN id % 6 = 2 THEN 1 ELSE 0 END AS updated_at FROM r0 UNION ALL SELECT id + 10000000, user_id, type, duration_seconds, updated_at FROM r0 WHERE id % 100 = 0)"""
add("a18_snapshot_merge", lambda s, d: Y.merge_snapshots(*snapshots(s, d), ["user_id", "type", "duration_seconds"]),
    """SELECT coalesce(l.id, r.id) AS id, CASE WHEN x THEN r.updated_at ELSE l.updated_at END AS updated_at, CASE WHEN x THEN r.user_id ELSE l.user_id END AS user_id, CASE WHEN x THEN r.type ELSE l.type END AS type,
              CASE WHEN x THEN r.duration_seconds ELSE l.duration_seconds END AS duration_seconds, CASE WHEN x THEN 'remote' ELSE 'local' END AS origin
       FROM (SELECT l, r, (l.id IS NULL OR coalesce(r.updated_at > l.updated_at, false)) AS x FROM l FULL JOIN r ON l.id = r.id)""", ACTIVITIES, SNAP)  # fmt: skip
add("a18_changed_rows", lambda s, d: (lambda l, r: Y.changed_rows(r, l.select("id", Y.record_hash(["user_id", "type", "duration_seconds"]).alias("hash")), ["user_id", "type", "duration_seconds"]))(*snapshots(s, d)),
    "SELECT r.* FROM r ANTI JOIN l ON r.id = l.id AND r.user_id = l.user_id AND r.type = l.type AND r.duration_seconds = l.duration_seconds", ACTIVITIES, SNAP)
add("a17_upsert", lambda s, d: Y.upsert(*snapshots(s, d), ["id"]), "SELECT * FROM l ANTI JOIN r USING (id) UNION ALL SELECT * FROM r", ACTIVITIES, SNAP)
add("a17_restore", lambda s, d: Y.restore(*snapshots(s, d), ["id"]), "SELECT * FROM l UNION ALL SELECT * FROM r ANTI JOIN l USING (id)", ACTIVITIES, SNAP)
add("a20_trim_log", lambda s, d: Y.trim_log(activities(s, d).select("id", "type", "occurred_at"), ["type"], ["occurred_at", "id"], 100).select("id", "type"), "SELECT id, type FROM activities QUALIFY row_number() OVER (PARTITION BY type ORDER BY occurred_at DESC, id DESC) <= 100", ACTIVITIES)


def _b12(s, d):
    a = activities(s, d)
    policy = s.createDataFrame([("meeting", 7), ("web_visit", 14)], "category string, days int")
    return Y.purge_split(a.withColumn("category", F.col("type")), policy, as_of(a)).select("id", "purge")


add("b12_retention_purge", _b12, "SELECT id, coalesce(occurred_at < (SELECT max(occurred_at) FROM activities) - CASE type WHEN 'meeting' THEN INTERVAL 7 DAY WHEN 'web_visit' THEN INTERVAL 14 DAY END, false) AS purge FROM activities", ACTIVITIES)
add("a2_validate_activities", lambda s, d: Y.validate(activities(s, d), ["web_visit", "app_focus", "meeting"], ["browser", "desktop"], 7200).select("id", F.array_join("reject_reasons", ",").alias("reasons")),
    """SELECT id, array_to_string(list_filter([CASE WHEN type NOT IN ('web_visit', 'app_focus', 'meeting') THEN 'type' END, CASE WHEN source NOT IN ('browser', 'desktop') THEN 'source' END,
              CASE WHEN duration_seconds NOT BETWEEN 0 AND 7200 THEN 'duration' END, CASE WHEN length(data) > 10240 THEN 'context' END], lambda x: x IS NOT NULL), ',') AS reasons FROM activities""", ACTIVITIES)  # fmt: skip
add("a4_wearable_wide", lambda s, d: wearable_data(s, d).groupBy("user_id", F.to_date("recorded_at").alias("date")).pivot("metric_type", METRICS).agg(F.round(F.sum("metric_value"), 4)),
    "SELECT user_id, recorded_at::DATE AS date, " + ", ".join(f"round(sum(metric_value) FILTER (metric_type = '{m}'), 4) AS {m}" for m in METRICS) + " FROM wearable_data GROUP BY 1, 2", WEARABLE)
add("b9_dynamic_listing", lambda s, d: table(s, d, "customer").filter(F.col("c_name").ilike("%99%") & (F.col("c_mktsegment") == "BUILDING")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_acctbal"),
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_name ILIKE '%99%' AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
add("b1_user_time_range", lambda s, d: activities(s, d).filter((F.col("user_id") < 20) & (F.col("occurred_at") >= "2024-01-05") & (F.col("occurred_at") < "2024-01-12")).select("id", "user_id"), "SELECT id, user_id FROM activities WHERE user_id < 20 AND occurred_at >= '2024-01-05' AND occurred_at < '2024-01-12'", ACTIVITIES)
add("b8_json_path_predicate", lambda s, d: activities(s, d).filter(F.get_json_object("data", "$.platform") == "zoom").select("id", F.get_json_object("data", "$.organizer").alias("organizer")), "SELECT id, json_extract_string(data, '$.organizer') AS organizer FROM activities WHERE json_extract_string(data, '$.platform') = 'zoom'", ACTIVITIES)
dates_as_text("first_seen last_seen", "d44_entity_stats", "m2_merge_entities")
dates_as_text("date", "a4_wearable_wide")
assert set(SKILLS) <= set(APPS)
