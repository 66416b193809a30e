"""Queries on intake, filters, proximity, citations, symbols, chained enrichment, schema checks and streams of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advice as V
from ..operators import extras as X
from ..operators import graph as G
from ..operators import intake as I
from ..operators import names as N
from ..session import new_folder
from ..sources.tables import ACTIVITIES, ENTITIES, activities, entities, table
from ..streaming import activities as A
from .graphs import every, strong
from .names import BASE, DETAILED, detailed
from .registry import add
from .streams import FOLD, FOLD_SQL, stream


def _synced(s, d):
    rows = detailed(s, d).withColumn("data", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("title"), F.upper("title"), F.lit("n"), (F.col("id") % 7).cast("string")))).withColumn("source", F.when(F.col("id") % 3 > 0, F.col("source")))
    c = I.sync_activities(rows)
    return c.select("id", "source", F.array_join(F.array_sort(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), ";").alias("context"))


add("a3_sync_activities", _synced,
    """SELECT id, CASE WHEN id % 3 > 0 THEN source ELSE 'sync' END AS source, array_to_string(list_sort(list_concat(['app_name=' || coalesce(app, ''), 'domain=' || coalesce(domain, ''), 'url=' || coalesce(url, ''), 'title=' || CASE WHEN id % 2 = 0 THEN upper(title) ELSE title END],
              CASE WHEN id % 2 = 0 THEN ['n=' || id % 7] ELSE [] END)), ';') AS context FROM detailed""", ACTIVITIES, DETAILED)  # fmt: skip


def _sessions(s, d):
    rows = activities(s, d).filter("type <> 'break'")
    new = rows.select("user_id", F.col("app").alias("app_name"), "domain", F.when(F.col("id") % 2 == 0, "work").alias("category"), F.when(F.col("id") % 5 > 0, F.col("duration_seconds")).alias("duration_seconds"), F.when(F.col("duration_seconds") > 1500, "Deep").alias("depth"), F.when(F.col("id") % 4 == 0, 80).alias("score"), F.lit(None).cast("string").alias("source"), F.col("occurred_at").cast("date").cast("string").alias("created_at"))
    stored = activities(s, d).filter("type = 'break'").select("user_id", F.lit("old").alias("app_name"), F.lit("").alias("category"), "duration_seconds", F.lit("Shallow").alias("depth"), F.lit(0).alias("score"), F.lit("browser").alias("source"), F.col("occurred_at").cast("date").cast("string").alias("created_at"))
    return I.store_focus_sessions(stored, new)


add("a5_store_focus_sessions", _sessions,
    """SELECT user_id, coalesce(app, domain, '') AS app_name, CASE WHEN id % 2 = 0 THEN 'work' ELSE '' END AS category, CASE WHEN id % 5 > 0 THEN duration_seconds ELSE 0 END AS duration_seconds, CASE WHEN duration_seconds > 1500 THEN 'Deep' ELSE 'Shallow' END AS depth, CASE WHEN id % 4 = 0 THEN 80 ELSE 0 END AS score,
              'desktop' AS source, occurred_at::DATE::VARCHAR AS created_at FROM activities WHERE type <> 'break'
       UNION ALL SELECT user_id, 'old', '', duration_seconds, 'Shallow', 0, 'browser', occurred_at::DATE::VARCHAR FROM activities WHERE type = 'break'""", ACTIVITIES)  # fmt: skip


def _bundle(s, d):
    return X.bundle({"activities": activities(s, d).select("user_id", "id", "type"), "entities": entities(s, d).select("user_id", "id", "entity_type")})


add("a14_export_user_bundle", _bundle,
    """SELECT 'activities' AS "table", user_id, '{"user_id":' || user_id || ',"id":' || id || ',"type":"' || type || '"}' AS "row" FROM activities UNION ALL
       SELECT 'entities', user_id, '{"user_id":' || user_id || ',"id":' || id || ',"entity_type":"' || entity_type || '"}' FROM entities""", ACTIVITIES, ENTITIES)  # fmt: skip
add("a15_import_user_bundle", lambda s, d: I.import_bundle(_bundle(s, d), "activities", "user_id long, id long, type string").withColumn("table", F.lit("activities")).unionByName(I.import_bundle(_bundle(s, d), "entities", "user_id long, id long, entity_type string").withColumnRenamed("entity_type", "type").withColumn("table", F.lit("entities"))),
    """SELECT user_id, id, type, 'activities' AS "table" FROM activities UNION ALL SELECT user_id, id, entity_type, 'entities' FROM entities""", ACTIVITIES, ENTITIES)  # fmt: skip
add("a16_gdpr_export", lambda s, d: _bundle(s, d).select("table", "user_id", F.sha2("row", 256).alias("row_sha256")),
    """SELECT 'activities' AS "table", user_id, sha256('{"user_id":' || user_id || ',"id":' || id || ',"type":"' || type || '"}') AS row_sha256 FROM activities UNION ALL
       SELECT 'entities', user_id, sha256('{"user_id":' || user_id || ',"id":' || id || ',"entity_type":"' || entity_type || '"}') FROM entities""", ACTIVITIES, ENTITIES)  # fmt: skip
add("a13_export_content", lambda s, d: table(s, d, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256")), "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents")
add("b5_search_filters", lambda s, d: activities(s, d).filter((F.col("type") == "meeting") & (F.col("occurred_at") > "2024-01-05") & (F.col("occurred_at") < "2024-01-20") & (F.col("source") == "browser")).select("id", "user_id"),
    "SELECT id, user_id FROM activities WHERE type = 'meeting' AND occurred_at > '2024-01-05' AND occurred_at < '2024-01-20' AND source = 'browser'", ACTIVITIES)
add("b10_not_in_types", lambda s, d: table(s, d, "documents").filter(~F.col("source").isin("src0", "src1") & (F.col("lang") == "en")).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1') AND lang = 'en'")
add("b11_not_deleted", lambda s, d: table(s, d, "customer").withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("date"))).filter("deleted_at is null").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN DATE '2024-01-01' END AS deleted_at FROM customer) WHERE deleted_at IS NULL")
add("b17_filtered_listing", lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'O'").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50")
add("c9_time_proximity", lambda s, d: I.time_proximity(N.entities_of(detailed(s, d))),
    "SELECT x.user_id, x.name AS a, y.name AS b, count(*) AS n FROM (SELECT DISTINCT user_id, name, occurred_at FROM found) x JOIN (SELECT DISTINCT user_id, name, occurred_at FROM found) y ON x.user_id = y.user_id AND x.name < y.name AND abs(epoch_us(x.occurred_at) - epoch_us(y.occurred_at)) <= 3600000000 GROUP BY 1, 2, 3", *BASE)


def _citations(s, d):
    known = table(s, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("title"), F.array(F.concat(F.lit("writer "), F.col("item_id").cast("string"))).alias("authors"), F.concat(F.lit("10.5/"), F.col("item_id").cast("string")).alias("doi"))
    return I.citations(table(s, d, "documents").select((F.col("doc_id") + 10**12).alias("id"), F.col("text").alias("content")), known).withColumn("id", F.col("id") - 10**12)


add("c12_citation_join", _citations,
    """SELECT doc_id AS id, item_id::BIGINT AS cited, concat_ws(',', CASE WHEN a THEN 'author' END, CASE WHEN o THEN 'doi' END, CASE WHEN t THEN 'title' END) AS signals, CASE WHEN o THEN 0.95 WHEN a::INT + o::INT + t::INT > 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence
       FROM (SELECT doc_id, item_id, contains(lower(d.text), lower(b.text)) AS t, contains(lower(d.text), 'writer ' || item_id) AS a, contains(d.text, '10.5/' || item_id) AS o FROM documents d, benchmark b) WHERE t OR a OR o""")  # fmt: skip
add("f7_last_n", lambda s, d: I.last_n(activities(s, d).select("user_id", "occurred_at", "id"), ["user_id"], ["occurred_at", "id"], 50).select("user_id", "id"), "SELECT user_id, id FROM activities QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) <= 50", ACTIVITIES)


def _symbols(s, d):
    code = F.concat(F.lit("import os\nfrom "), "source", F.lit(".x import y\n\nclass C"), F.col("doc_id").cast("string"), F.lit(":\n    def run(self):\n        pass\n\ndef f"), (F.col("doc_id") % 3).cast("string"), F.lit("():\n    return 1\n"))
    x = table(s, d, "documents").select("doc_id", code.alias("code"))
    return x.select("doc_id", *[F.array_join(v, ",").alias(k) for k, v in V.code_symbols(F.col("code")).items()])


add("h21_code_symbols", _symbols, "SELECT doc_id, 'os,' || source || '.x' AS imports, 'run,f' || doc_id % 3 AS functions, 'C' || doc_id AS classes FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE source IS NULL")
URL = "CASE WHEN id % 10 = 0 THEN 'http://[bad' ELSE url END"
add("h24_enrichment_chain", lambda s, d: I.enrich_chain(detailed(s, d).withColumn("url", F.when(F.col("id") % 10 == 0, "http://[bad").otherwise(F.col("url")))).select("id", "hour", "weekday", "host", "path", F.contains("failed", F.lit("url")).alias("url_failed")),
    f"""SELECT id, hour(occurred_at)::BIGINT AS hour, (isodow(occurred_at) - 1)::BIGINT AS weekday, CASE WHEN {URL} LIKE 'https://%' THEN regexp_extract({URL}, '^https://([^/]+)', 1) END AS host, CASE WHEN {URL} LIKE 'https://%' THEN regexp_extract({URL}, '^https://[^/]+(/.*)$', 1) END AS path, id % 10 = 0 AS url_failed FROM detailed""", ACTIVITIES, DETAILED)
SCHEMA = {"paper": {"required": ["title"], "optional": ["year"]}, "skill": {"required": ["name", "level"], "optional": []}}


def _nodes(s, d):
    p = table(s, d, "part")
    kind = F.element_at(F.array(F.lit("paper"), F.lit("skill"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    props = F.create_map(F.lit("title"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(""), F.lit("name"), F.col("p_name"), F.lit("user_id"), F.lit("1"))
    return I.validate_nodes(p.select(F.col("p_partkey").alias("id"), kind.alias("node_type"), props.alias("props")), SCHEMA)


add("k24_schema_validate", _nodes,
    """SELECT id, errors = '' AS valid, errors, warnings FROM (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size > 10 THEN '' ELSE 'title' END WHEN 1 THEN 'level' ELSE 'unknown type other' END AS errors, CASE p_partkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'title' ELSE '' END AS warnings FROM part)""")  # fmt: skip


def _k8(s, d):
    some = every(s, d, 50)
    return I.all_centralities(strong(s, d), {
        "degree": lambda e: G.degree(e).withColumn("score", F.col("degree")), "pagerank": lambda e: G.pagerank(e, 20), "eigenvector": lambda e: G.eigenvector(e, 20),
        "closeness": lambda e: G.closeness(e, some).withColumn("score", F.col("closeness")), "betweenness": lambda e: G.betweenness(e, some).withColumn("score", F.col("betweenness")),
    }).withColumn("score", F.round("score", 6))


add("k8_all_centralities", _k8)


def _i1(s, d):
    x = stream(s, d).withColumn("k", F.get_json_object("props", "$.k"))
    return A.drain(A.without_duplicates(x, ["user_id", "k"]), name="i1").groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))


add("i1_stream_ingest_dedup", _i1, "SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k, 1::BIGINT AS n FROM events")


def _i2(s, d):
    kinds = ["view", "click", "purchase"]
    folders = {k: new_folder(s, f"fan-{k}") for k in kinds}
    query = stream(s, d).writeStream.option("checkpointLocation", new_folder(s, "fan-progress")).trigger(availableNow=True).foreachBatch(A.fan_out(stream(s, d), folders)).start()
    query.awaitTermination()
    parts = [s.read.parquet(folders[k]).select(F.lit(k).alias("sink"), "user_id") for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sink", "user_id").agg(F.count(F.lit(1)).alias("n"))


add("i2_activity_fanout", _i2, "SELECT event_type AS sink, user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _i3(s, d):
    before = s.conf.get(PROVIDER)
    s.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # this state needs it
    try:
        rows = A.drain(A.user_state(stream(s, d)), "update", "i3")
    finally:
        s.conf.set(PROVIDER, before)
    return rows.groupBy("user_id").agg(F.max(F.struct("version", "total_seconds", "active")).alias("x")).select("user_id", "x.*")


add("i3_event_sourced_state", _i3, FOLD_SQL, "RECURSIVE " + FOLD.strip())
add("i3_state_replay", lambda s, d: A.replay_state(table(s, d, "events")), FOLD_SQL, "RECURSIVE " + FOLD.strip())


def _i9(s, d):
    late = F.timestamp_seconds(F.unix_timestamp("occurred_at") + F.col("event_id") % 5 * 1800)
    return A.drain(A.late_rows(stream(s, d).withColumn("received_at", late)), name="i9").select("event_id", "lateness")


add("i9_late_data", _i9, "SELECT event_id, event_id % 5 * 1800 AS lateness FROM events WHERE event_id % 5 * 1800 > 3600")
