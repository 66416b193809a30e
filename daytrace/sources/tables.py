"""Readers of the given tables, and adapters to the activity model.

Each adapter has a SQL twin, a common table expression for DuckDB, so that a query and its check start from one rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPS = ["vscode", "pycharm", "jupyter", "terminal", "Notion", "Zoom", "Slack", "teams", "youtube", "spotify", "reddit", "chrome", "firefox", "Outlook", "finder", "inhouse-tool"]
DOMAINS = ["github.com", "stackoverflow.com", "docs.python.org", "arxiv.org", "youtube.com", "reddit.com", "twitter.com", "meet.google.com", "mail.google.com", "intranet.example.org"]
METRICS = ["steps", "heart_rate", "resting_heart_rate", "sleep_hours", "calories", "active_minutes", "hrv", "spo2"]
TYPES = {"view": "web_visit", "click": "app_focus", "purchase": "meeting", "signup": "page_view", "error": "break"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as activities: ``id, user_id, occurred_at, type, app, domain, title, duration_seconds, data,
    client_generated_id, source``."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("event_type")]
    e = e.withColumn("type", kind)
    e = e.withColumn("app", F.when(F.col("type") != "web_visit", _pick(APPS, F.col("k")))).withColumn("domain", F.when(F.col("type") == "web_visit", _pick(DOMAINS, F.col("k"))))
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("occurred_at"), "type", "app", "domain",
        F.concat(F.coalesce("app", "domain"), F.lit(" - "), "event_type", F.lit(" "), F.col("k").cast("string")).alias("title"),
        F.floor(F.col("value") * 60).cast("int").alias("duration_seconds"),
        F.when(F.col("type") == "meeting", F.format_string('{"platform":"%s","participants":["p%d","p%d"],"organizer":"p%d"}', _pick(["zoom", "teams", "meet"], F.col("k")), F.col("k") % 7, F.col("k") % 11, F.col("k") % 5)).alias("data"),
        F.concat_ws(":", "user_id", "k").alias("client_generated_id"), _pick(["browser", "desktop", "mobile"], F.col("k")).alias("source"),
    )


ACTIVITIES = f"""
activities AS (
  SELECT event_id AS id, user_id, ts AS occurred_at, type, app, domain,
         coalesce(app, domain) || ' - ' || event_type || ' ' || k::VARCHAR AS title,
         floor(value * 60)::INTEGER AS duration_seconds,
         CASE WHEN type = 'meeting' THEN '{{"platform":"' || {_sql_list(["zoom", "teams", "meet"])}[k % 3 + 1] || '","participants":["p' || (k % 7)::VARCHAR
              || '","p' || (k % 11)::VARCHAR || '"],"organizer":"p' || (k % 5)::VARCHAR || '"}}' END AS data,
         user_id::VARCHAR || ':' || k::VARCHAR AS client_generated_id,
         {_sql_list(["browser", "desktop", "mobile"])}[k % 3 + 1] AS source
  FROM (SELECT *, CASE WHEN type <> 'web_visit' THEN {_sql_list(APPS)}[k % 16 + 1] END AS app,
               CASE WHEN type = 'web_visit' THEN {_sql_list(DOMAINS)}[k % 10 + 1] END AS domain
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
                     CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())} END AS type FROM events))
)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities and parts as entities: ``activity_id, entity_id, relevance_score``; a task groups about a million items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    parts = items.count() // 1_000_000 + 1
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        items = items.repartition(parts, "l_orderkey")
    return items.groupBy(F.col("l_orderkey").alias("activity_id"), F.col("l_partkey").alias("entity_id")).agg((1 - F.min("l_discount")).alias("relevance_score"))


LINKS = "links AS (SELECT l_orderkey AS activity_id, l_partkey AS entity_id, 1 - min(l_discount) AS relevance_score FROM lineitem GROUP BY ALL)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities, with counts and dates from orders: ``id, user_id, entity_type, name, occurrence_count, first_seen, last_seen``."""
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = seen.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("o_orderdate").cast("date").alias("first_seen"), F.max("o_orderdate").cast("date").alias("last_seen"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("user_id"), F.col("p_type").alias("entity_type"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return p.join(seen, "id")


ENTITIES = """
entities AS (
  SELECT p_partkey AS id, p_partkey % 50 AS user_id, p_type AS entity_type, p_name || ' ' || p_brand AS name,
         count(*) AS occurrence_count, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
)"""


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with ``aliases`` for every second part and ``external_ids`` for every third."""
    more = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", F.concat_ws(" ", "p_brand", "p_name"))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("sku"), F.concat_ws("/", "p_brand", "p_size"))).otherwise(F.create_map().cast("map<string,string>")).alias("external_ids"),
    )
    return entities(spark, sf_dir).join(more, "id")


KNOWN = """
known AS (
  SELECT e.*, CASE WHEN id % 2 = 0 THEN [p_name, p_brand || ' ' || p_name] ELSE []::VARCHAR[] END AS aliases,
         CASE WHEN id % 3 = 0 THEN p_brand || '/' || p_size END AS sku
  FROM entities e JOIN part ON id = p_partkey
)"""


PEOPLE = ["Ann Lee", "A. Lee", "Bob Stone", "Stone, Bob", "Anne Lee", "Bobby Stone", "ann lee "]


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities as mentions: tools by application, organisations by host and persons by meeting, written in several ways:
    ``id, user_id, label, text, platform, ts``."""
    a, way = activities(spark, sf_dir), F.pmod("id", F.lit(3))
    host = F.substring_index("domain", ".", 1)
    tool = F.when(way == 0, F.col("app")).when(way == 1, F.upper("app")).otherwise(F.concat_ws(" ", "app", F.lit("app")))
    org = F.when(way == 0, F.col("domain")).when(way == 1, F.concat(F.initcap(host), F.lit(" Inc"))).otherwise(host)
    text = F.when(F.col("type") == "meeting", _pick(PEOPLE, F.col("id"))).when(F.col("app").isNotNull(), tool).otherwise(org)
    label = F.when(F.col("type") == "meeting", "PERSON").when(F.col("app").isNotNull(), "TOOL").otherwise("ORG")
    return a.select("id", "user_id", label.alias("label"), text.alias("text"), F.col("source").alias("platform"), F.col("occurred_at").alias("ts"))


MENTIONS = f"""
mentions AS (
  SELECT id, user_id, CASE WHEN type = 'meeting' THEN 'PERSON' WHEN app IS NOT NULL THEN 'TOOL' ELSE 'ORG' END AS label,
         CASE WHEN type = 'meeting' THEN {_sql_list(PEOPLE)}[id % 7 + 1]
              WHEN app IS NOT NULL THEN CASE id % 3 WHEN 0 THEN app WHEN 1 THEN upper(app) ELSE app || ' app' END
              ELSE CASE id % 3 WHEN 0 THEN domain WHEN 1 THEN upper(domain[1]) || lower(split_part(domain, '.', 1)[2:]) || ' Inc' ELSE split_part(domain, '.', 1) END END AS text,
         source AS platform, occurred_at AS ts
  FROM activities
)"""


def wearable_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as wearable samples: ``user_id, metric_type, metric_value, recorded_at, provider, id``."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select("user_id", _pick(METRICS, F.col("k")).alias("metric_type"), F.col("value").alias("metric_value"), F.col("ts").cast("timestamp").alias("recorded_at"), _pick(["fitbit", "oura"], F.col("k")).alias("provider"), F.col("event_id").alias("id"))


WEARABLE = f"""
wearable_data AS (
  SELECT user_id, {_sql_list(METRICS)}[k % 8 + 1] AS metric_type, value AS metric_value, ts AS recorded_at,
         {_sql_list(["fitbit", "oura"])}[k % 2 + 1] AS provider, event_id AS id
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: ``id, user_id, endpoint, ts``."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"))


def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as goals: ``id, user_id, title, category, target_value, current_value, started, deadline, status``."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("current_value"))
    o = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("goal "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("target_value"), "current_value", F.col("o_orderdate").cast("date").alias("started"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("deadline"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("paused").alias("status"))


GOALS = """
goals AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, 'goal ' || o_orderkey::VARCHAR AS title, o_orderpriority AS category, o_totalprice AS target_value,
         s.v AS current_value, o_orderdate::DATE AS started, o_orderdate::DATE + 30 AS deadline,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'paused' END AS status
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey
)"""
