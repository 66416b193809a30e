"""The numbered queries over the given tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mpeg, token_shards
from .common import LOWER, UPPER, documents
from .exact_dedup import exact_duplicates
from .filter_audit import audit
from .importance import resample
from .licenses import license_matches
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .pii import pseudonyms
from .positional_index import contamination
from .simhash import near_duplicates


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many values were found, of which kinds and where, and the text with their pseudonyms.

    A null text stays null and an empty one empty, without finds; long texts are whole; repeated rows repeat; an empty table
    gives no rows. Without ``spark.daytrace.pii.key`` each run has a key of its own, so pseudonyms differ between runs.
    """
    out = pseudonyms(documents(spark, sf_dir))
    return out.select("doc_id", "n_found", F.to_json("kinds").alias("kinds"), F.to_json("spans").alias("spans"), "text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint and component, as ``near_duplicates`` states it for nulls, ties, repeated
    rows, long texts and an empty table."""
    return near_duplicates(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and template that a part of its text matches; null and empty texts have none, repeated
    rows repeat, long texts are whole, templates with equal scores all stay, an empty table gives no rows."""
    return license_matches(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, dropped ones too; of equal texts the largest identifier stays. Null texts are empty ones;
    a null identifier stays only where all of the group are null; repeated rows are all kept; an empty table gives no rows."""
    return exact_duplicates(documents(spark, sf_dir), keep="max")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, as ``bpe.digests`` states it for nulls, empty and long texts, repeated rows and an empty table."""
    return bpe.digests(documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rows of all documents with their source, block, slot and place in the mix, as ``mix_sources`` states it
    for nulls, ties, repeated rows and an empty table; long texts are carried whole."""
    out = mix_sources(documents(spark, sf_dir))
    return out.select("row.*", "mix_source", "mix_block", "mix_slot", "mix_order")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the payload as read back from the stored audio, its media, durations, checksums and the
    offset of every frame. A null text is an empty one, which is stored as 192 spaces; repeated rows repeat; long texts
    are whole; an empty table gives no rows."""
    out = mpeg.describe(mpeg.to_media(documents(spark, sf_dir)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_num", "duration_den", "bad_crc", "skipped_bytes", "vbr", "vbr_right", F.to_json("tags").alias("tags"), "seek_offsets")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the files, as ``stored_digests`` states it for nulls, ties and repeats."""
    return token_shards.stored_digests(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the text that is left, as ``dedup_lines`` states it for nulls, ties and repeated rows."""
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, as ``langid.identify`` states it for nulls, ties, repeated rows and an empty table."""
    return langid.identify(documents(spark, sf_dir))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: which of its words lie in a passage of ten words of the benchmark, as ``contamination``
    states it for nulls, empty and long texts, repeated rows and empty tables."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language, order of five filters and step, as ``audit`` states it for nulls, empty and long texts,
    repeated rows and empty tables."""
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its weight, score and rank among the tenth that is drawn, as ``resample`` states it for
    nulls, empty and long texts, ties, repeated rows and empty tables."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash_near_dedup, op3_license_scan, op4_exact_dedup, op5_bpe, op6_mix_sources, op7_media_columns, op8_token_shards, op9_line_dedup, op10_language_id, op11_decontaminate, op12_filter_audit, op13_importance_resampling)}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op11_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
             iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS win
                    FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
             dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS win
                    FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
             m AS (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, win)),
             h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
             g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
             w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
             f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                          | CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                          | CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END
                          | CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                          | CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS bits FROM w),
             c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
                   FROM f LEFT JOIN labels USING (doc_id) GROUP BY part, bits),
             x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
             p AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
                   FROM x a, x b, x c, x d, x e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
             s AS (SELECT filter_order, k::INTEGER AS step, bs[k] AS own, coalesce(list_sum(bs[1 : k - 1]), 0)::INTEGER AS before FROM p, range(1, 6) r(k)),
             o AS (SELECT part, filter_order, step, own,
                          sum(n) FILTER (bits & (own | before) = 0) AS kept,
                          sum(n) FILTER (bits & own > 0 AND bits & before = 0) AS removed,
                          sum(n) FILTER (bits & own > 0 AND bits & before > 0) AS redundant,
                          sum(n) FILTER (bits = own) AS unique_fails,
                          sum(good) FILTER (bits & own > 0 AND bits & before = 0) AS good_lost,
                          sum(toxic) FILTER (bits & own > 0 AND bits & before = 0) AS toxic_lost
                   FROM c, s GROUP BY ALL)
        SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
        FROM o
    """,
    "op13_importance_resampling": f"""
        WITH RECURSIVE step(i, v, k) AS (SELECT i, i, 0 FROM range(0, 256) r(i)
                 UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
             tab AS (SELECT list(v ORDER BY i) AS tab FROM step WHERE k = 8),
             d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             b AS (SELECT {_WORDS} AS w FROM benchmark),
             dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
             v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
             crc AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                                  lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
             s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
             t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
             g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE / ((s + 1) * ((SELECT count(*) FROM bw) + 10000))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
             f AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM dw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY doc_id),
             z AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                          floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN f ON d.doc_id = f.doc_id),
             r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS k FROM z)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND k <= (SELECT 10 * count(*) // 100 FROM z WHERE n_features >= 20) THEN k END AS rank
        FROM r
    """,
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op9_line_dedup": """
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
             w AS (SELECT doc_id, p AS pos, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS w
                   FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3)),
             r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k
                   FROM w WHERE trim(replace(w, chr(10), '')) <> ''),
             c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
             s AS (SELECT doc_id, p AS pos, ls[p + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS p FROM l)),
             k AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.pos) AS text
                   FROM s ANTI JOIN c ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY s.doc_id),
             n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
        SELECT l.doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(n.n, 0)::INTEGER AS n_removed,
               CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM l LEFT JOIN k ON l.doc_id = k.doc_id LEFT JOIN n ON l.doc_id = n.doc_id
    """,
}
