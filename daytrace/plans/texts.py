"""Queries on texts, URLs and scalar rules (H) and on search (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions import text as T
from ..functions.dims import contains_any
from ..operators import search as S
from ..sources.tables import ACTIVITIES, activities, table
from .registry import add


def docs(s, d):
    return table(s, d, "documents")


add("h1_format_duration", lambda s, d: activities(s, d).select("id", C.format_duration(F.col("duration_seconds")).alias("text")),
    "SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS text FROM (SELECT id, coalesce(duration_seconds, 0) AS s FROM activities)", ACTIVITIES)
BUCKET = "CASE WHEN s < 5 THEN 'very_short' WHEN s < 30 THEN 'short' WHEN s < 120 THEN 'medium' WHEN s < 600 THEN 'long' ELSE 'very_long' END"
add("h2_duration_bucket", lambda s, d: activities(s, d).select("id", C.duration_bucket(F.col("duration_seconds")).alias("bucket")), f"SELECT id, {BUCKET} AS bucket FROM (SELECT id, coalesce(duration_seconds, 0) AS s FROM activities)", ACTIVITIES)
add("h3_dedup_hash", lambda s, d: activities(s, d).select("id", C.dedup_hash(F.col("user_id"), F.col("type"), F.col("occurred_at"), F.col("domain"), F.col("duration_seconds")).alias("hash")),
    f"SELECT id, substr(sha256(concat_ws(':', user_id::VARCHAR, type, (epoch_us(occurred_at) // 10000000 * 10)::VARCHAR, coalesce(domain, ''), {BUCKET})), 1, 16) AS hash FROM (SELECT *, coalesce(duration_seconds, 0) AS s FROM activities)", ACTIVITIES)
add("h4_temporal_enrich", lambda s, d: activities(s, d).select("id", *[c.alias(n) for n, c in C.temporal_context(F.col("occurred_at"), F.col("duration_seconds"), 2).items()]),
    """SELECT id, h::BIGINT AS local_hour, CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' ELSE 'night' END AS time_of_day,
              h BETWEEN 9 AND 17 AND w < 5 AS is_work_hours, h BETWEEN 10 AND 16 AND w < 5 AS is_core_hours, w >= 5 AS is_weekend, w::BIGINT AS weekday,
              CASE WHEN s < 30 THEN 'glance' WHEN s < 120 THEN 'brief' WHEN s < 300 THEN 'short' WHEN s < 900 THEN 'medium' WHEN s < 1800 THEN 'focused' WHEN s < 3600 THEN 'extended' ELSE 'deep' END AS duration_category
       FROM (SELECT id, hour(occurred_at + INTERVAL 2 HOUR) AS h, isodow(occurred_at + INTERVAL 2 HOUR) - 1 AS w, coalesce(duration_seconds, 0) AS s FROM activities)""", ACTIVITIES)  # fmt: skip
WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '')"
add("h11_text_stats", lambda s, d: docs(s, d).select("doc_id", *[(F.round(c, 6) if n == "complexity" else c).alias(n) for n, c in T.text_stats(F.col("text")).items()]),
    f"""SELECT doc_id, n AS word_count, length(text) AS char_count, sents AS sentence_count, greatest(1, ceil(n / 200 * 60))::BIGINT AS reading_seconds,
              round(CASE WHEN n = 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (0.39 * (n / sents) + 11.8 * (syl / nullif(n, 0)) - 15.59) / 16)) END, 6) AS complexity
       FROM (SELECT doc_id, text, len(ws) AS n, greatest(1, len(regexp_split_to_array(text, '[.!?]+'))) AS sents,
                    list_sum(list_transform(ws[1:1000], lambda w: greatest(1, len(regexp_extract_all(regexp_replace(lower(w), 'e+$', ''), '[aeiou]+')))))::BIGINT AS syl FROM (SELECT *, {WORDS} AS ws FROM documents))""")  # fmt: skip


def _h12(s, d):
    w = docs(s, d).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]+)"), 1)).alias("term")).filter((F.length("term") >= 3) & ~F.col("term").isin(*T.STOPWORDS))
    n = w.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")).cast("long")).filter("rank <= 12")


STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
add("h12_keyphrases", _h12, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM (
    SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) WHERE length(term) >= 3 AND term NOT IN {STOP} GROUP BY 1, 2)) WHERE rank <= 12""")  # fmt: skip
HITS = {t: "(" + " + ".join(f"contains(l, '{h}')::INT" for h in hs) + ")" for t, hs in T.TOPICS.items()}
BEST = "greatest(" + ", ".join(HITS.values()) + ")"
add("h13_classify_topic", lambda s, d: docs(s, d).select("doc_id", T.topic(F.col("text")).alias("t")).select("doc_id", "t.topic", F.round("t.confidence", 4).alias("confidence"), F.size("t.secondary").cast("long").alias("secondary")),
    f"""SELECT doc_id, CASE WHEN best = 0 THEN 'general' {" ".join(f"WHEN {h} = best THEN '{t}'" for t, h in HITS.items())} END AS topic, round(CASE WHEN best = 0 THEN 0.5 ELSE least(0.95, best / 10) END, 4) AS confidence,
               least(3, {" + ".join(f"({h} >= 2)::INT" for h in HITS.values())} - (best >= 2)::INT)::BIGINT AS secondary FROM (SELECT *, {BEST} AS best FROM (SELECT doc_id, lower(text) AS l FROM documents))""")  # fmt: skip
add("h15_chunk_text", lambda s, d: docs(s, d).select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.position").cast("long").alias("position"), F.sha2("c.chunk", 256).alias("chunk_sha256")),
    f"SELECT doc_id, (p // 900)::BIGINT AS position, sha256(array_to_string(ws[p + 1 : p + 1000], ' ')) AS chunk_sha256 FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), 900)) AS p FROM (SELECT doc_id, {WORDS} AS ws FROM documents))")
add("h17_url_parts", lambda s, d: table(s, d, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"), T.url_title(F.col("url")).alias("title")),
    r"""SELECT page_id, domain, CASE WHEN t = '' THEN domain ELSE t END AS title FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS domain,
          translate(regexp_replace(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '\.[A-Za-z0-9]+$', ''), '-_', '  ') AS t FROM pages)""")  # fmt: skip
COUNTS = {c: "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '{p}')) > 0 THEN len(regexp_extract_all(text, '{p}'))" for p in ps) + " ELSE 0 END::BIGINT" for c, ps in T.PII_PATTERNS.items()}
add("h18_detect_pii", lambda s, d: docs(s, d).select("doc_id", *[c.alias(n) for n, c in T.pii_counts(F.col("text")).items()]), "SELECT doc_id, " + ", ".join(f"{c} AS {n}" for n, c in COUNTS.items()) + " FROM documents")
REDACTED = "text"
for _c, _ps in T.PII_PATTERNS.items():
    for _p in _ps:
        REDACTED = f"regexp_replace({REDACTED}, '{_p}', '[{_c.upper()}_REDACTED]', 'g')"
add("h18_filter_pii", lambda s, d: docs(s, d).select("doc_id", T.redact(F.col("text")).alias("text")), f"SELECT doc_id, {REDACTED} AS text FROM documents")
add("h19_mask_email", lambda s, d: docs(s, d).select("doc_id", F.sha2(T.mask_email(F.col("text")), 256).alias("masked_sha256")), r"SELECT doc_id, sha256(regexp_replace(text, '\b([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b', '\1***@\2', 'g')) AS masked_sha256 FROM documents")
add("h10_context_enrich", lambda s, d: table(s, d, "pages").select("page_id", T.document_type(F.col("url"), F.substring("html", 1, 200)).alias("kind")),
    f"""SELECT page_id, CASE WHEN regexp_matches(b, '{contains_any(["arxiv", "doi.org", "paper"])}') THEN 'paper' WHEN regexp_matches(b, '{contains_any(["github.com", "gitlab.com"])}') THEN 'code'
        WHEN regexp_matches(b, '{contains_any(["docs.", "documentation", "/docs"])}') THEN 'documentation' WHEN regexp_matches(b, '{contains_any(["mail."])}') THEN 'email' ELSE 'web' END AS kind FROM (SELECT page_id, lower(url || ' ' || html[1:200]) AS b FROM pages)""")  # fmt: skip

# search over documents and vectors
TEXT_QUERIES = {1: "the ingha thst", 2: "version license general", 3: "de la mente ción", 4: "der und ein"}


def text_queries(s):
    return s.createDataFrame(list(TEXT_QUERIES.items()), "query_id int, query string")


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(s, d):
    return vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def bm25_hits(s, d, k):
    return S.bm25(docs(s, d), text_queries(s), k)


QUERIES_CTE = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in TEXT_QUERIES.items()) + ") v(query_id, query))"
BM25 = """
bm25 AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))) AS score
    FROM (SELECT id, dl, term, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM (SELECT id, dl, unnest(ts) AS term FROM d) GROUP BY 1, 2, 3)
    JOIN (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM queries) USING (term), (SELECT count(*) AS n, avg(dl) AS avgdl FROM d) GROUP BY 1, 2)
)"""
DOC_TOKENS = "d AS (SELECT doc_id AS id, ts, len(ts) AS dl FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM documents))"
COSINE = """
cosine AS (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) WHERE score >= 0
)"""
SV = (QUERIES_CTE, DOC_TOKENS, BM25, COSINE)
add("l2_keyword_search", lambda s, d: bm25_hits(s, d, 10).withColumn("score", F.round("score", 6)), "SELECT query_id, id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10", *SV)
add("l1_semantic_search", lambda s, d: S.cosine_search(vectors(s, d), vector_queries(s, d)).withColumn("score", F.round("score", 6)), "SELECT query_id, id, round(score, 6) AS score, rank FROM cosine WHERE rank <= 10", *SV)


def _l3(s, d):
    v = S.cosine_search(vectors(s, d), vector_queries(s, d), 30).withColumn("query_id", (F.col("query_id") / 50 + 1).cast("int"))
    return S.fuse(v, bm25_hits(s, d, 30)).withColumn("score", F.round("score", 8))


add("l3_hybrid_search", _l3, """SELECT query_id, id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT coalesce(a.query_id, b.query_id)::INTEGER AS query_id, coalesce(a.id, b.id) AS id, coalesce(0.7 / (60 + a.rank), 0) + coalesce(0.3 / (60 + b.rank), 0) AS score
    FROM (SELECT query_id // 50 + 1 AS query_id, id, rank FROM cosine WHERE rank <= 30) a FULL JOIN (SELECT * FROM bm25 WHERE rank <= 30) b ON a.query_id = b.query_id AND a.id = b.id) QUALIFY rank <= 10""", *SV)  # fmt: skip


def _labelled(s, d, k):
    return S.cosine_search(vectors(s, d), vector_queries(s, d), k).join(vectors(s, d).select("id", "label"), "id")


add("l4_rerank", lambda s, d: S.rerank(_labelled(s, d, 30), {"label": 0.02}).select("query_id", "id", F.round("score", 6).alias("score"), "rank"),
    "SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM (SELECT query_id, id, score + 0.02 * label AS s FROM cosine JOIN embeddings ON id = vec_id WHERE rank <= 30) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 10", *SV)
add("l5_diversity_sample", lambda s, d: S.diversify(_labelled(s, d, 30), "label"))
add("l6_expand_query", lambda s, d: S.expand_query(vectors(s, d), S.cosine_search(vectors(s, d), vector_queries(s, d), 5), vector_queries(s, d)).select("query_id", F.posexplode("query_vector").alias("place", "x")).select("query_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x")),
    """SELECT query_id, place, round(avg(x), 6) AS x FROM (SELECT query_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM (
         SELECT query_id, embedding FROM cosine JOIN embeddings ON id = vec_id WHERE rank <= 5 UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)) GROUP BY 1, 2""", *SV)  # fmt: skip
add("l7_faceted_search", lambda s, d: S.facets(_labelled(s, d, 50), "label").withColumnRenamed("value", "label"), "SELECT query_id, label, count(*) AS n FROM cosine JOIN embeddings ON id = vec_id WHERE rank <= 50 GROUP BY 1, 2", *SV)


def _l8(s, d):
    v = vectors(s, d)
    parts = [S.cosine_search(v.filter(F.col("label") % 2 == k), vector_queries(s, d)).drop("rank") for k in (0, 1)]
    return S.top_k(parts[0].unionByName(parts[1]), 10).withColumn("score", F.round("score", 6))


add("l8_multi_collection", _l8, "SELECT query_id, id, round(score, 6) AS score, rank FROM cosine WHERE rank <= 10", *SV)

def titled(s, d):
    """Pages with their titles."""
    return table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("text"))


TITLED = "titled AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS text FROM pages)"
OVERLAP = """overlap AS (SELECT * FROM (SELECT id, title, least(1.0, 0.6 * len(list_intersect(['the', 'for', 'main'], regexp_extract_all(lower(title), '[a-z0-9_]+'))) / 3 + 0.4 * len(list_intersect(['the', 'for', 'main'], regexp_extract_all(lower(text), '[a-z0-9_]+'))) / 3
    + CASE WHEN contains(lower(title), 'for the main') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), 'for the main') THEN 0.1 ELSE 0 END) AS s FROM titled) WHERE s >= 0.1)"""
add("l9_term_overlap_retrieve", lambda s, d: S.term_overlap(titled(s, d), "for the main", 0.1, 20).select("id", F.round("score", 6).alias("score"), "rank"),
    "SELECT id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM overlap) WHERE rank <= 20", TITLED, OVERLAP)


add("l12_keyword_fallback", lambda s, d: titled(s, d).select("doc_id", F.round(0.6 * F.contains(F.lower("title"), F.lit("the")).cast("int") + 0.2 * F.contains(F.lower("text"), F.lit("the")).cast("int"), 4).alias("score")).filter("score > 0"),
    "SELECT id AS doc_id, round(0.6 * contains(lower(title), 'the')::INT + 0.2 * contains(lower(text), 'the')::INT, 4)::DOUBLE AS score FROM titled WHERE contains(lower(title), 'the') OR contains(lower(text), 'the')", TITLED)


def _l14(s, d):
    v = vectors(s, d)
    return S.dbscan(v, S.eps_pairs(v, chained=True))  # two points make a core, so chains give the same clusters


add("l14_semantic_clusters", _l14, """, v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
     p AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE 1 - list_cosine_similarity(x.e, y.e) <= 0.35),
     c AS (SELECT DISTINCT a AS id FROM p), r AS (SELECT id, id AS root FROM c UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a)
     SELECT v.id, coalesce(min(root), -1) AS cluster FROM v LEFT JOIN r ON v.id = r.id GROUP BY 1""", "RECURSIVE one AS (SELECT 1)")  # fmt: skip
CLUSTERED = """
c AS (SELECT DISTINCT a AS id FROM p),
k AS (SELECT v.id, v.label, v.e, coalesce(min(root), -1) AS cluster FROM v LEFT JOIN r ON v.id = r.id GROUP BY ALL),
u AS (SELECT k.*, e[i] AS x, i, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS norm FROM k, range(1, 65) t(i)),
s AS (SELECT cluster, i, sum(x) AS s, sum(x / norm) AS su FROM u GROUP BY 1, 2),
m AS (SELECT id, cluster, label, sum(x * s) / any_value(norm) / sqrt(sum(s * s)) AS similarity FROM u JOIN s USING (cluster, i) WHERE cluster <> -1 GROUP BY 1, 2, 3)"""
NEAR = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id WHERE 1 - list_cosine_similarity(x.e, y.e) <= 0.35),
r AS (SELECT id, id AS root FROM (SELECT DISTINCT a AS id FROM p) UNION SELECT p.b, r.root FROM r JOIN p ON r.id = p.a)"""
add("l14_cluster_members", lambda s, d: S.cluster_members(vectors(s, d), _l14(s, d)).withColumn("similarity", F.round("similarity", 6)),
    "SELECT id, cluster, label, round(similarity, 6) AS similarity FROM m", "RECURSIVE one AS (SELECT 1)", NEAR, CLUSTERED)
add("l14_cluster_report", lambda s, d: S.cluster_report(vectors(s, d), _l14(s, d)),
    """, b AS (SELECT cluster, count(*) AS size, arg_min(id, (-round(similarity, 3), id)) AS nearest FROM m GROUP BY 1),
       t AS (SELECT cluster, label, count(*) AS n, min(id) AS first FROM m GROUP BY 1, 2),
       d AS (SELECT cluster, arg_min(label, (-n, first))::VARCHAR AS dominant_type, string_agg(label || ':' || n, ',' ORDER BY label || ':' || n) AS types FROM t GROUP BY 1),
       h AS (SELECT cluster, sum(su * su) AS length FROM s GROUP BY 1)
       SELECT cluster, size, round(CASE WHEN size > 1 THEN (length - size) / (size * (size - 1)) ELSE 1.0 END, 3) AS coherence, dominant_type, dominant_type || ' cluster: ' || nearest AS title, types FROM b JOIN d USING (cluster) JOIN h USING (cluster)
       UNION ALL SELECT cluster, count(*), NULL, NULL, NULL, NULL FROM k WHERE cluster = -1 GROUP BY 1""", "RECURSIVE one AS (SELECT 1)", NEAR, CLUSTERED)  # fmt: skip
