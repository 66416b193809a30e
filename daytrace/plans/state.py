"""Queries on state: request limits, sending, the event store, and edges merged by micro-batches (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import event_store as E
from ..operators import wellbeing as W
from ..session import cut_lineage, new_folder, written
from ..sources.tables import LINKS, links, table
from ..streaming import activities as A
from ..streaming import limits as L
from ..streaming import merging as M
from .intake import PROVIDER
from .registry import add
from .streams import stream

#: The log runs 5,000 times faster, so that its users come to their limits.
TIER = L.Tier(30, 500, 5_000, 10, 0.5, {"view": 5, "click": 8})


def _i6(s, d):
    before = s.conf.get(PROVIDER)
    s.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # this state needs it
    try:
        fast = F.timestamp_micros((F.unix_micros("occurred_at") / 5000).cast("long"))
        return A.drain(L.limited(stream(s, d).select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("endpoint"), fast.alias("ts")), TIER), "append", "i6")
    finally:
        s.conf.set(PROVIDER, before)


add("i6_rate_limits", _i6)


def _h25(s, d):
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), F.pmod("k", F.lit(len(v))) + 1)
    notices = e.select(F.col("event_id").alias("id"), "user_id", pick(*W.PRIORITY).alias("kind"), pick("in_app", "email", "desktop").alias("channel"), F.when(F.col("k") % 13 == 0, "critical").alias("priority"), F.col("ts").cast("timestamp").alias("at"))
    u = F.col("user_id")
    users = e.select("user_id").distinct().select("user_id", F.when(u % 2 == 0, F.array(F.lit("email"))).otherwise(F.array().cast("array<string>")).alias("channels_off"), F.array(F.lit("achievement")).alias("kinds_off"), (u % 3 == 0).alias("dnd"),
                                                  F.lit(22).alias("start_hour"), F.lit(8).alias("end_hour"), (u % 5 > 0).alias("override_critical"), F.lit(1).alias("max_per_hour"), F.lit(3).alias("max_per_day"), (u % 7 == 0).alias("digest"))
    return W.send_decisions(notices, users)


KINDS = "[" + ", ".join(f"'{k}'" for k in W.PRIORITY) + "]"
RANKS = "[" + ", ".join(f"'{k}'" for k in W.PRIORITY.values()) + "]"
add("h25_send_decisions", _h25,
    f"""WITH n AS (SELECT event_id AS id, user_id AS u, ts, {KINDS}[k % 11 + 1] AS kind, ['in_app', 'email', 'desktop'][k % 3 + 1] AS channel, CASE WHEN k % 13 = 0 THEN 'critical' ELSE {RANKS}[k % 11 + 1] END AS rank
                  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
             r AS (SELECT *, CASE WHEN u % 2 = 0 AND channel = 'email' THEN 'channel_email_disabled' WHEN kind = 'achievement' THEN 'type_achievement_disabled'
                   WHEN u % 3 = 0 AND (hour(ts) >= 22 OR hour(ts) < 8) AND NOT (rank = 'critical' AND u % 5 > 0) THEN 'dnd_active' WHEN u % 7 = 0 AND rank IN ('low', 'medium') THEN 'digest_mode_active' END AS reason FROM n),
             h AS (SELECT *, reason IS NULL AND count(*) FILTER (reason IS NULL) OVER (PARTITION BY u, ts::DATE, hour(ts) ORDER BY ts, id) <= 1 AS in_hour FROM r),
             s AS (SELECT *, in_hour AND count(*) FILTER (in_hour) OVER (PARTITION BY u, ts::DATE ORDER BY ts, id) <= 3 AS sent FROM h)
        SELECT id, sent AS send, coalesce(reason, CASE WHEN sent THEN 'approved' WHEN count(*) FILTER (sent) OVER (PARTITION BY u, ts::DATE, hour(ts) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 1 THEN 'hourly_cap_reached' ELSE 'daily_cap_reached' END) AS reason
        FROM s""")  # fmt: skip


def commands(s, d):
    """Events as the log of two aggregates a user, one of activities and one of settings."""
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.create_map(*[F.lit(x) for x in ("view", "activity_recorded", "click", "activity_tagged", "error", "activity_deleted", "purchase", "setting_changed", "signup", "settings_reset")])[F.col("event_type")]
    k = F.col("k").cast("string")
    data = F.when(kind == "activity_recorded", F.format_string('{"id":"%s","duration":%d,"timestamp":"t%d"}', k, F.floor(F.col("value") * 60), "event_id")).when(kind == "activity_tagged", F.format_string('{"tag":"tag%d"}', F.col("k") % 7)).when(kind == "activity_deleted", F.format_string('{"activity_id":"%s"}', k)) \
        .when(kind == "setting_changed", F.format_string('{"key":"s%d","value":"%s"}', F.col("k") % 4, k)).otherwise(F.format_string('{"defaults":{"s1":"d%s"}}', k))
    side = F.when(kind.isin("setting_changed", "settings_reset"), "settings").otherwise("activity")
    return e.select("event_id", F.concat_ws(":", side, "user_id").alias("aggregate_id"), kind.alias("event_type"), data.alias("data"), "ts", F.lit(None).cast("long").alias("expected_version"))


def _store(s, d):
    c = commands(s, d)
    return E.appended(c.select("aggregate_id", F.lit(0).alias("version")).limit(0), c)[0]


LOG = """
log AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'settings:' ELSE 'activity:' END || user_id AS agg, event_type AS et, k, trunc(value * 60)::DOUBLE AS dur,
               row_number() OVER (PARTITION BY user_id, event_type IN ('purchase', 'signup') ORDER BY ts, event_id) AS v
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""


def _i3(s, d):
    """Snapshots of the log up to the last full ten events, and the rest replayed on them."""
    log = cut_lineage(_store(s, d).filter("aggregate_id LIKE 'activity:%'"))
    snapshot, living = E.activity_state(E.up_to_snapshot(log))
    state = E.activity_state(log, cut_lineage(snapshot), cut_lineage(living))[0]
    return state.withColumn("tags", F.array_join("tags", ","))


add("i3_snapshot_replay", _i3,
    """, t AS (SELECT agg, string_agg(tag, ',' ORDER BY v) AS tags FROM (SELECT agg, 'tag' || k % 7 AS tag, min(v) AS v FROM log WHERE et = 'click' GROUP BY 1, 2) GROUP BY 1),
       c AS (SELECT agg, count(*) AS n FROM log x WHERE et = 'view' AND NOT EXISTS (SELECT 1 FROM log y WHERE y.agg = x.agg AND y.et = 'error' AND y.k = x.k AND y.v > x.v) GROUP BY 1)
       SELECT agg AS aggregate_id, max(v) AS version, coalesce(sum(dur) FILTER (et = 'view'), 0) AS total_duration, 't' || arg_max(event_id, v) FILTER (et = 'view') AS last_activity_time, coalesce(any_value(tags), '') AS tags, coalesce(any_value(n), 0) AS activity_count
       FROM log LEFT JOIN t USING (agg) LEFT JOIN c USING (agg) WHERE agg LIKE 'activity:%' GROUP BY 1""", LOG)  # fmt: skip
SETTING = """
st AS (SELECT *, 's' || k % 4 AS key, count(*) FILTER (et = 'signup') OVER (PARTITION BY agg ORDER BY v) AS epoch FROM log WHERE agg LIKE 'settings:%'),
rs AS (SELECT agg, epoch, 'd' || k AS given FROM st WHERE et = 'signup')"""
add("i3_settings_history", lambda s, d: E.setting_history(_store(s, d)),
    """, h AS (SELECT *, lag(k::VARCHAR) OVER w AS before, row_number() OVER w AS n FROM st WHERE et = 'purchase' WINDOW w AS (PARTITION BY agg, epoch, key ORDER BY v))
       SELECT h.agg AS aggregate_id, v AS version, key, CASE WHEN n > 1 THEN before WHEN key = 's1' THEN given END AS old, k::VARCHAR AS new FROM h LEFT JOIN rs ON h.agg = rs.agg AND h.epoch = rs.epoch
       UNION ALL SELECT agg, v, NULL, NULL, NULL FROM st WHERE et = 'signup'""", LOG, SETTING)  # fmt: skip
add("i3_settings", lambda s, d: E.settings(_store(s, d)),
    """, l AS (SELECT agg, max(epoch) AS epoch FROM st GROUP BY 1),
       x AS (SELECT agg, key, k::VARCHAR AS value, v FROM st JOIN l USING (agg, epoch) WHERE et = 'purchase' UNION ALL SELECT agg, 's1', given, 0 FROM rs JOIN l USING (agg, epoch))
       SELECT agg AS aggregate_id, key, arg_max(value, v) AS value FROM x GROUP BY 1, 2""", LOG, SETTING)  # fmt: skip
add("i4_floored_counts", lambda s, d: E.activity_counts(_store(s, d), 16),
    """, p AS (SELECT agg, v, sum(CASE WHEN et = 'view' THEN 1 ELSE -1 END) OVER (PARTITION BY agg ORDER BY v) AS p FROM log WHERE et IN ('view', 'error'))
       SELECT agg AS aggregate_id, (arg_max(p, v) - least(0, min(p)))::BIGINT AS n FROM p GROUP BY 1""", LOG)  # fmt: skip


def _i8(s, d):
    """The links by ranges of activities, of which each comes in one batch of many files."""
    rows = written(links(s, d).select(F.col("activity_id").cast("long"), F.col("entity_id").cast("long"), F.col("relevance_score").cast("double")), "all-links")
    source, store, progress = new_folder(s, "links"), new_folder(s, "edges"), new_folder(s, "edges-progress")
    last = rows.agg(F.max("activity_id")).first()[0] or 0
    for k in range(3):
        rows.filter(F.floor(F.col("activity_id") * 3 / (last + 1)) == k).write.mode("append").parquet(source)
        found = M.streamed_edges(s.readStream.schema(rows.schema).parquet(source), store, progress)
    return found.withColumn("strength", F.round("strength", 9))


add("i8_merged_edges", _i8,
    """, p AS (SELECT a.entity_id AS a, b.entity_id AS b, a.activity_id AS t, (a.relevance_score::DOUBLE + b.relevance_score::DOUBLE) / 2 AS r, CASE WHEN r > 0.9 THEN 0.9 WHEN r > 0.8 THEN 0.7 ELSE 0.5 END::DOUBLE AS s
             FROM links a JOIN links b ON a.activity_id = b.activity_id AND a.entity_id < b.entity_id),
       k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t) AS k FROM p),
       f AS (SELECT a, b, k, s FROM k WHERE k = 1 UNION ALL SELECT k.a, k.b, k.k, (f.s + k.s) / 2 FROM f JOIN k ON k.a = f.a AND k.b = f.b AND k.k = f.k + 1)
       SELECT a, b, round(arg_max(f.s, f.k), 9) AS strength, max(f.k) AS n, min(t) AS first_seen, max(t) AS last_seen FROM f JOIN k USING (a, b, k) GROUP BY 1, 2""", "RECURSIVE " + LINKS)  # fmt: skip
