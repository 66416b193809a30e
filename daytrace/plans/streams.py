"""Queries that run a stream over the event table and compare with the batch result (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import activities as A
from .registry import add


def stream(s, d):
    return A.event_stream(s, f"{d}/events.parque[t]", table(s, d, "events").schema)


add("i4_projections", lambda s, d: A.drain(A.running_counts(stream(s, d), ["user_id", "event_type"]), "complete", "i4"), "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("i7_metrics_stream", lambda s, d: A.drain(A.windowed_counts(stream(s, d), ["event_type"]), "complete", "i7").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
FOLD = """
e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, trunc(value * 60)::BIGINT AS s FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS active FROM (SELECT DISTINCT user_id FROM events) UNION ALL
      SELECT f.user_id, e.k, CASE WHEN e.event_type = 'error' THEN greatest(0, f.active - 1) ELSE f.active + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)"""
FOLD_SQL = "SELECT user_id, version, total_seconds, active FROM (SELECT user_id, max(k) AS version, arg_max(active, k) AS active FROM f GROUP BY 1) JOIN (SELECT user_id, sum(s)::BIGINT AS total_seconds FROM e GROUP BY 1) USING (user_id)"
