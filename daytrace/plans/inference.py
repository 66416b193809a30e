"""Queries on inferred relationships and reports of communities (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import inference as I
from ..sources.tables import LINKS, entities, links, table
from .graphs import STRONG, edges, strong
from .registry import add

KINDS = ["PERSON", "PAPER", "TOPIC", "PROJECT", "TOOL", "INSTITUTION", "ORGANIZATION", "DATASET"]
NOW = "TIMESTAMP '2024-03-01 06:00:00'"


def _kinds(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("kind"), (F.col("p_size") > 20).alias("known"))


def _orders(s, d):
    """Orders as activities of the last hundred days."""
    k = F.col("o_orderkey")
    types = F.element_at(F.array(*[F.lit(t) for t in [*I.STRENGTH, "other"]]), (k % 8 + 1).cast("int"))
    return table(s, d, "orders").select(k.alias("activity_id"), types.alias("type"), F.when(k % 3 > 0, (k % 3).cast("double")).alias("importance"), (F.expr(NOW) - F.make_dt_interval((k % 100).cast("int"), F.lit(1))).alias("at"))


add("k25_infer_relations", lambda s, d: I.inferred_relations(links(s, d), _orders(s, d), _kinds(s, d), I.pair_table(s), F.expr(NOW)).withColumns({c: F.round(c, 6) for c in ("weight", "confidence")}),
    """, o AS (SELECT o_orderkey AS activity_id, o_orderkey % 100 AS age, [""" + ", ".join(str(x) for x in [*I.STRENGTH.values(), 1.0]) + """][o_orderkey % 8 + 1]::DOUBLE * CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS s FROM orders WHERE o_orderkey % 100 < 90),
       k AS (SELECT p_partkey AS id, ['""" + "', '".join(KINDS) + """'][p_partkey % 8 + 1] AS kind, p_size > 20 AS known FROM part),
       p AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS n, least(5.0, greatest(0.1, (1 + log10(count(*))) * exp(-0.693::DOUBLE * min(age) / 365) * avg(s))) AS w
             FROM links a JOIN links b ON a.activity_id = b.activity_id AND a.entity_id < b.entity_id JOIN o ON o.activity_id = a.activity_id GROUP BY 1, 2 HAVING count(*) >= 2),
       x AS (SELECT src AS f, dst AS t, n, w FROM p UNION ALL SELECT dst, src, n, w FROM p),
       r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}', '{m}', {I.BASE[m]})" for a, b, c, m in I.PAIRS) + """) v(a, b, rel_type, method, base))
       SELECT f AS from_id, t AS to_id, rel_type, method, n, round(w, 6) AS weight, round(least(1.0, base::DOUBLE + least(0.2, w * 0.05) + CASE WHEN kf.known AND kt.known THEN 0.1 ELSE 0 END + 0.1)::DOUBLE, 6) AS confidence
       FROM x JOIN k kf ON kf.id = f JOIN k kt ON kt.id = t JOIN r ON kf.kind = r.a AND kt.kind = r.b""", LINKS)  # fmt: skip


def _k9(s, d):
    e = edges(s, d).filter("weight >= 2")
    return I.community_report(e, G.label_propagation(e, 50), entities(s, d).select("id", F.col("entity_type").alias("kind"))).withColumn("modularity", F.round("modularity", 6))


add("k9_community_report", _k9)


def _parity(s, d):
    e = edges(s, d).filter("weight >= 2")
    labels = strong(s, d).select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id") % 7)
    return I.community_report(e, labels, entities(s, d).select("id", F.col("entity_type").alias("kind"))).withColumn("modularity", F.round("modularity", 6))


add("k9_report_of_given_labels", _parity,
    """, pairs AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS weight FROM links a JOIN links b ON a.activity_id = b.activity_id AND a.entity_id < b.entity_id GROUP BY 1, 2),
       both_ways AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), """ + STRONG + """,
       m AS (SELECT DISTINCT src AS id, src % 7 AS label, p_type AS kind FROM strong JOIN part ON p_partkey = src),
       t AS (SELECT label, kind, count(*) AS n, min(id) AS first FROM m GROUP BY 1, 2),
       e AS (SELECT src % 7 AS a, dst % 7 AS b, weight FROM strong), g AS (SELECT a AS label, sum(weight) FILTER (a = b) AS inside, sum(weight) AS degree FROM e GROUP BY 1)
       SELECT label, size, CASE WHEN size > 1 THEN round(coalesce(inside, 0) / 2 / (size * (size - 1) / 2), 3) ELSE 0 END AS density, dominant_type, types, round(coalesce(inside, 0) / s - (degree / s) ** 2, 6) AS modularity
       FROM (SELECT label, sum(n)::BIGINT AS size, arg_min(kind, (-n, first)) AS dominant_type, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS types FROM t GROUP BY 1) JOIN g USING (label), (SELECT sum(weight) AS s FROM strong)""", LINKS)  # fmt: skip
