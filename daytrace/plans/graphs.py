"""Queries on graphs (C, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import paths as R
from ..operators import skipgram as K
from ..session import written
from ..sources.tables import ENTITIES, LINKS, entities, links, table
from .registry import add

PAIRS = "pairs AS (SELECT a.entity_id AS src, b.entity_id AS dst, count(*) AS weight FROM links a JOIN links b ON a.activity_id = b.activity_id AND a.entity_id < b.entity_id GROUP BY 1, 2)"
BOTH = "both_ways AS (SELECT src, dst, weight FROM pairs UNION ALL SELECT dst, src, weight FROM pairs)"
REC = "RECURSIVE " + LINKS
V = (LINKS, PAIRS, BOTH)
RV = (REC, PAIRS, BOTH)


def edges(s, d):
    return G.co_occurrence(links(s, d)).select("src", "dst", "weight")


def every(s, d, n):
    return table(s, d, "part").filter(F.col("p_partkey") % n == 0).select(F.col("p_partkey").alias("id"))


add("c1_co_occurrence", lambda s, d: G.co_occurrence(links(s, d)), "SELECT *, weight / max(weight) OVER () AS strength FROM pairs", LINKS, PAIRS)
add("c2_cross_type_co_occurrence", lambda s, d: G.cross_type(links(s, d), entities(s, d)),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type_a, type_b ORDER BY weight DESC, a, b) AS rank FROM (
         SELECT least(x.entity_type, y.entity_type) AS type_a, greatest(x.entity_type, y.entity_type) AS type_b, CASE WHEN x.entity_type < y.entity_type THEN src ELSE dst END AS a,
                CASE WHEN x.entity_type < y.entity_type THEN dst ELSE src END AS b, weight FROM pairs JOIN entities x ON src = x.id JOIN entities y ON dst = y.id WHERE weight >= 2 AND x.entity_type <> y.entity_type)) WHERE rank <= 10""", LINKS, ENTITIES, PAIRS)  # fmt: skip
add("c3_entity_neighbors", lambda s, d: G.entity_neighbors(links(s, d)), "SELECT src AS entity_id, dst AS neighbor_id, weight AS n, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM both_ways QUALIFY rank <= 20", *V)
add("k2_degree", lambda s, d: G.degree(G.both_ways(edges(s, d))), "SELECT src AS id, count(*) AS degree, sum(weight)::BIGINT AS weight FROM both_ways GROUP BY 1", *V)
add("k7_pagerank_cooccurrence", lambda s, d: G.pagerank(G.both_ways(edges(s, d))).select("id", F.round("score", 9).alias("score")),
    """, shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM both_ways), n AS (SELECT count(DISTINCT src) AS n FROM both_ways),
       r AS (SELECT DISTINCT src AS id, 0 AS k, 1.0::DOUBLE / n AS score FROM both_ways, n UNION ALL
             SELECT dst, k + 1, 0.15 / any_value(n) + 0.85 * sum(score * share) FROM r JOIN shares ON r.id = src, n WHERE k < 20 GROUP BY dst, k)
       SELECT id, round(score / sum(score) OVER (), 9) AS score FROM r WHERE k = 20""", *RV)  # fmt: skip
add("k5_eigenvector", lambda s, d: G.eigenvector(G.both_ways(edges(s, d)), 20).select("id", F.round("score", 8).alias("score")),
    """, r AS (SELECT DISTINCT src AS id, 0 AS k, 1.0::DOUBLE AS score FROM both_ways UNION ALL
             SELECT id, k, s / sqrt(sum(s * s) OVER ()) FROM (SELECT dst AS id, k + 1 AS k, sum(score * weight) AS s FROM r JOIN both_ways ON r.id = src WHERE k < 20 GROUP BY dst, k))
       SELECT id, round(score, 8) AS score FROM r WHERE k = 20""", *RV)  # fmt: skip
add("k9_label_propagation", lambda s, d: G.label_propagation(edges(s, d).filter("weight >= 2"), 50))
STRONG = "strong AS (SELECT src, dst, weight FROM both_ways WHERE weight >= 2)"


def strong(s, d):
    return G.both_ways(edges(s, d)).filter("weight >= 2")


add("k10_louvain", lambda s, d: G.louvain(strong(s, d)))


def _k10(s, d):
    e = strong(s, d)
    found = G.louvain(e)
    return G.community_stats(found).crossJoin(F.broadcast(G.modularity_both(e, found))).select("communities", "smallest", "largest", *[F.round(c, 6).alias(c) for c in ("mean_size", "deviation", "modularity")])  # one row each


add("k10_community_stats", _k10)


def kept(s, d):
    """Edges of weight two and more, each once, written, as some queries read them more than once."""
    return written(edges(s, d).filter("weight >= 2"), "edges")


add("c15_community_bridges", lambda s, d: (lambda e: G.bridges(e, G.louvain(G.both_ways(e))))(kept(s, d)))
add("k28_node2vec", lambda s, d: (lambda e: K.skip_gram(K.context_pairs(G.node2vec_walks(e, e.select(F.col("src").alias("id")).distinct(), p=1.0, q=0.5)))[0])(strong(s, d)))
REACH = ", seeds AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0), hop AS (SELECT DISTINCT src, dst FROM strong), b(source, id, depth) USING KEY (source, id) AS (SELECT id, id, 0::BIGINT FROM seeds UNION SELECT f.source, f.id, f.depth FROM (SELECT source, dst AS id, min(depth) + 1 AS depth FROM b JOIN hop ON b.id = src GROUP BY ALL) f LEFT JOIN recurring.b AS o ON o.source = f.source AND o.id = f.id WHERE o.id IS NULL)"
add("k16_ego_network", lambda s, d: G.bfs(strong(s, d), every(s, d, 50), 2, 200).select("source", "id", F.col("depth").cast("long").alias("depth")),
    REACH + " SELECT source, id, depth FROM b WHERE depth <= 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY depth, id) <= 200", *RV, STRONG)
add("k13_unweighted_path", lambda s, d: G.bfs(strong(s, d), every(s, d, 50)).select("source", "id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent")),
    REACH + " SELECT b.source, b.id, b.depth, coalesce((SELECT min(o.id) FROM b o JOIN hop ON o.id = hop.src WHERE o.source = b.source AND hop.dst = b.id AND o.depth = b.depth - 1), -1) AS parent FROM b", *RV, STRONG)
add("k12_shortest_path_weighted", lambda s, d: G.shortest_paths(strong(s, d).withColumn("weight", F.round(1 / F.col("weight"), 6)), every(s, d, 50)).withColumn("distance", F.round("distance", 6)),
    """, r(source, id, d) USING KEY (source, id) AS (SELECT p_partkey, p_partkey, 0.0::DOUBLE FROM part WHERE p_partkey % 50 = 0
         UNION SELECT f.source, f.id, f.d FROM (SELECT source, dst AS id, min(d + round(1 / weight, 6)) AS d FROM r JOIN strong ON r.id = src GROUP BY 1, 2) f LEFT JOIN recurring.r AS o ON o.source = f.source AND o.id = f.id WHERE o.d IS NULL OR f.d < o.d)
       SELECT source, id, round(d, 6) AS distance FROM r""", *RV, STRONG)  # fmt: skip
GOALS = ", asked AS (SELECT x.p_partkey AS source, y.p_partkey AS goal FROM part x JOIN part y ON x.p_partkey % 50 = 0 AND y.p_partkey % 50 = 7 AND y.p_partkey % 350 = x.p_partkey % 350 + 7)"


def asked(s, d, e):
    """Pairs of start and goal: parts whose keys are divisible by 50, and the parts seven further in the same group, as far as
    the edges ``e`` link them."""
    key = F.col("p_partkey")
    a = table(s, d, "part").filter(key % 50 == 0).select(key.alias("source"), (key % 350 + 7).alias("k"))
    b = table(s, d, "part").filter(key % 50 == 7).select(key.alias("goal"), (key % 350).alias("k"))
    return R.pairs_with_a_way(e, a, b)


def routed(s, d, routes, e):
    """``routes`` of the asked pairs over the edges ``e``, which are written once."""
    e = written(e, "edges")
    return routes(e, asked(s, d, e)).withColumn("path", F.array_join("path", ">"))


def inverse(s, d):
    return strong(s, d).withColumn("weight", F.round(1 / F.col("weight"), 6))


add("k12_shortest_routes", lambda s, d: routed(s, d, R.shortest_routes, inverse(s, d)),
    GOALS + """, inv AS (SELECT src, dst, round(1 / weight, 6) AS w FROM strong),
       r(source, id, d) USING KEY (source, id) AS (SELECT DISTINCT source, source, 0.0::DOUBLE FROM asked
         UNION SELECT f.source, f.id, f.d FROM (SELECT source, dst AS id, min(d + w) AS d FROM r JOIN inv ON r.id = src GROUP BY 1, 2) f LEFT JOIN recurring.r AS o ON o.source = f.source AND o.id = f.id WHERE o.d IS NULL OR f.d < o.d),
       b AS MATERIALIZED (SELECT y.source, y.id, min(src) AS parent FROM r x JOIN inv ON x.id = src JOIN r y ON y.source = x.source AND y.id = dst AND x.d + w = y.d WHERE y.id <> y.source GROUP BY 1, 2),
       w(source, goal, spot, path) AS (SELECT source, goal, goal, [goal] FROM asked UNION ALL SELECT w.source, w.goal, parent, list_prepend(parent, path) FROM w JOIN b ON b.source = w.source AND b.id = w.spot)
       SELECT w.source, w.goal, array_to_string(path, '>') AS path, len(path) AS total_steps, round(d, 3) AS total_cost, CASE WHEN len(path) <= 2 THEN 'beginner' WHEN len(path) <= 4 THEN 'intermediate' WHEN len(path) <= 6 THEN 'advanced' ELSE 'expert' END AS difficulty
       FROM w JOIN r ON r.source = w.source AND r.id = w.goal WHERE w.spot = w.source""", *RV, STRONG)  # fmt: skip
add("k13_hop_routes", lambda s, d: routed(s, d, R.hop_routes, strong(s, d)))
add("k11_all_routes", lambda s, d: routed(s, d, R.all_routes, inverse(s, d)))
add("k4_closeness", lambda s, d: G.closeness(strong(s, d), every(s, d, 50)).select("id", "reached", F.round("closeness", 6).alias("closeness")),
    REACH + " SELECT source AS id, count(*) AS reached, round(count(*) / sum(depth), 6) AS closeness FROM b WHERE depth > 0 GROUP BY 1", *RV, STRONG)
add("k18_ego_stats", lambda s, d: (lambda e: G.subgraph_stats(e, G.bfs(G.both_ways(e), every(s, d, 50), 2)))(kept(s, d)).withColumns({"density": F.round("density", 6), "mean_degree": F.round("mean_degree", 6)}),
    REACH + """, near AS (SELECT * FROM b WHERE depth <= 2), m AS (SELECT x.source, count(*) AS edges FROM near x JOIN near y ON x.source = y.source JOIN hop ON hop.src = x.id AND hop.dst = y.id WHERE x.id < y.id GROUP BY 1)
       SELECT source, vertices, coalesce(edges, 0) AS edges, round(CASE WHEN vertices > 1 THEN 2 * coalesce(edges, 0) / (vertices * (vertices - 1)) ELSE 0 END, 6) AS density, round(2 * coalesce(edges, 0) / vertices, 6) AS mean_degree, eccentricity
       FROM (SELECT source, count(*) AS vertices, max(depth) AS eccentricity FROM near GROUP BY 1) LEFT JOIN m USING (source)""", *RV, STRONG)  # fmt: skip
add("k3_betweenness", lambda s, d: G.betweenness(strong(s, d), strong(s, d).select(F.col("src").alias("id"))).withColumn("betweenness", F.round("betweenness", 6)))
add("k18_subgraph_stats", lambda s, d: G.clustering(edges(s, d), once=True).withColumn("coefficient", F.round("coefficient", 9)),
    """, t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM pairs x JOIN pairs y ON x.dst = y.src JOIN pairs z ON z.src = x.src AND z.dst = y.dst),
       n AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
       SELECT id, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS coefficient
       FROM (SELECT src AS id, count(*) AS degree FROM both_ways GROUP BY 1) LEFT JOIN n USING (id)""", *V)  # fmt: skip
add("k19_link_prediction", lambda s, d: G.link_prediction(edges(s, d).filter("weight >= 2"), 0.0, 5).select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"), F.round("adamic_adar", 6).alias("adamic_adar"), "preferential", F.round("score", 6).alias("score"), "rank"),
    """, deg AS (SELECT src, count(*) AS deg FROM strong GROUP BY 1), top AS (SELECT max(deg) AS top FROM deg),
       w AS (SELECT x.src AS a, y.src AS b, count(*) AS common, sum(CASE WHEN deg > 1 THEN 1 / ln(deg) ELSE 0 END) AS aa FROM strong x JOIN strong y ON x.dst = y.dst AND x.src < y.src JOIN deg ON deg.src = x.dst
             WHERE NOT EXISTS (SELECT 1 FROM strong e WHERE e.src = x.src AND e.dst = y.src) GROUP BY 1, 2),
       p AS (SELECT a, b, common, common / (da.deg + db.deg - common) AS jaccard, aa, da.deg * db.deg AS preferential,
             (0.25 * common / top + 0.25 * common / (da.deg + db.deg - common) + 0.20 * least(1.0, aa / (common / ln(2))) + 0.15 * da.deg * db.deg / (top * top)) / 0.85 AS score FROM w JOIN deg da ON da.src = a JOIN deg db ON db.src = b, top)
       SELECT a, b, common, round(jaccard, 6) AS jaccard, round(aa, 6) AS adamic_adar, preferential, round(score, 6) AS score, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS rank FROM p QUALIFY rank <= 5""", *V, STRONG)  # fmt: skip


def _k21(s, d):
    x = table(s, d, "lineitem").withColumn("rel", F.element_at(F.array(*[F.lit(v) for v in ("AUTHORED", "CITES", "COLLABORATES_WITH", "ON_TOPIC", "USES")]), (F.col("l_partkey") % 5 + 1).cast("int")))
    w = G.edge_weight(F.col("rel"), F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount"))
    sources = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("api"), F.lit("inference"))).when(F.col("l_suppkey") % 3 == 1, F.array(F.lit("inference"))).otherwise(F.array(F.lit("unheard")))
    c = G.edge_confidence(sources, F.col("l_returnflag") == "A", F.col("l_suppkey") % 3 == 1, F.col("l_linestatus") == "F")
    k = G.inferred_weight(F.col("l_quantity"), F.col("l_partkey") % 1000, F.col("l_tax") + 0.5)
    return x.select("l_orderkey", "l_linenumber", F.round(w, 6).alias("weight"), F.round(c, 6).alias("confidence"), F.round(k, 6).alias("inferred_weight")).distinct()


add("k21_k22_k25_edge_rules", _k21,
    """SELECT DISTINCT l_orderkey, l_linenumber, round(greatest(0.1, CASE l_partkey % 5 WHEN 0 THEN CASE WHEN l_linenumber = 1 THEN 2.0 WHEN l_linenumber <= 3 THEN 1.5 ELSE 1.0 END WHEN 1 THEN least(3.0, 1 + l_quantity * 0.1)
              WHEN 2 THEN least(5.0, l_quantity * 0.5) WHEN 3 THEN l_discount * 2 ELSE 1.0 END)::DOUBLE, 6) AS weight,
              round(least(1.0, CASE l_suppkey % 3 WHEN 0 THEN 0.95 * 1.1 WHEN 1 THEN 0.7 ELSE 0.5 END::DOUBLE * CASE WHEN l_returnflag = 'A' THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN l_suppkey % 3 = 1 AND l_linestatus <> 'F' THEN 0.8 ELSE 1.0 END::DOUBLE)::DOUBLE, 6) AS confidence,
              round(least(5.0, greatest(0.1, (1 + log10(l_quantity)) * power(2.0, -(l_partkey % 1000) / 365) * (l_tax + 0.5)))::DOUBLE, 6) AS inferred_weight FROM lineitem""")  # fmt: skip
