"""Queries on exports, smart search, resolution by alias and recommended paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras as X
from ..operators import graph as G
from ..operators import mentions as M
from ..operators import productivity as P
from ..operators import search as S
from ..sources.tables import ACTIVITIES, ENTITIES, MENTIONS, activities, entities, mentions
from .graphs import PAIRS, REC, RV, STRONG, edges, every, strong
from .productivity import DAILY, KEY, PREPARED
from .records import HOURS, SK, skill_table
from .registry import add
from .texts import OVERLAP, TITLED, titled

add("a11_export_csv", lambda s, d: P.daily_productivity(activities(s, d)).select("user_id", F.to_csv(F.struct(F.col("date").cast("string").alias("date"), "activity_count", "total_seconds", "context_switches")).alias("line")),
    "SELECT user_id, date::VARCHAR || ',' || activity_count || ',' || total_seconds || ',' || context_switches AS line FROM daily", ACTIVITIES, PREPARED, DAILY)
TOOLS = ["vscode", "pycharm", "jupyter", "terminal", "notion", "zoom", "slack"]
add("h7_tool_regex", lambda s, d: activities(s, d).select("id", F.explode(F.array_intersect(F.split(F.lower("title"), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in TOOLS]))).alias("tool")),
    "SELECT id, unnest(list_filter([" + ", ".join(f"'{t}'" for t in TOOLS) + "], lambda t: list_contains(regexp_split_to_array(lower(title), '[^a-z0-9]+'), t))) AS tool FROM activities", ACTIVITIES)
add("k6_pagerank_gds", lambda s, d: G.pagerank_engine(edges(s, d), 20).select("id", F.round("score", 10).alias("score")),
    """, ids AS (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs), shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM pairs UNION ALL SELECT id, id, 0.0 FROM ids),
       r AS (SELECT id, 0 AS k, 0.15::DOUBLE AS score FROM ids UNION ALL SELECT dst, k + 1, 0.15 + 0.85 * sum(score * share) FROM r JOIN shares ON r.id = src WHERE k < 20 GROUP BY dst, k)
       SELECT id, round(score, 10) AS score FROM r WHERE k = 20""", REC, PAIRS)  # fmt: skip
add("k15_recommend_paths", lambda s, d: X.recommend_paths(strong(s, d), every(s, d, 50), every(s, d, 3), 2, 5),
    """, known AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0),
       w AS (SELECT p_partkey AS source, [p_partkey] AS path, 0 AS d FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT source, list_append(path, dst), d + 1 FROM w JOIN strong ON path[len(path)] = src WHERE d < 2 AND NOT list_contains(path, dst)),
       b AS (SELECT source, path[len(path)] AS target, min((d, path)) AS m FROM w WHERE d > 0 GROUP BY 1, 2),
       p AS (SELECT source, target, m[2] AS path FROM b WHERE target <> source AND target NOT IN (SELECT id FROM known)),
       q AS (SELECT source, target, len(path) AS steps, len(list_filter(path, lambda v: v % 3 = 0)) AS known FROM p)
       SELECT source, target, steps - 1 AS hops, round(1 / steps + 0.1 * known + 0.5 * (steps - known) / steps, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(1 / steps + 0.1 * known + 0.5 * (steps - known) / steps, 9) DESC, target) AS rank FROM q QUALIFY rank <= 5""", *RV, STRONG)  # fmt: skip
add("k30_graph_visualization", lambda s, d: P.top_keys(activities(s, d).filter("type = 'web_visit'"), 8).select("user_id", F.lit("domain").alias("kind"), "key", "seconds").unionByName(P.top_keys(activities(s, d).filter("app is not null"), 8).select("user_id", F.lit("app").alias("kind"), "key", "seconds")),
    f"SELECT user_id, kind, key, s AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY kind, user_id ORDER BY s DESC, key) AS r FROM (SELECT user_id, CASE WHEN type = 'web_visit' THEN 'domain' ELSE 'app' END AS kind, {KEY} AS key, sum(least(coalesce(duration_seconds, 0), 7200))::BIGINT AS s FROM activities WHERE type = 'web_visit' OR app IS NOT NULL GROUP BY 1, 2, 3)) WHERE r <= 8", ACTIVITIES)
add("k31_learning_recommendations", lambda s, d: X.learning_gaps(activities(s, d), skill_table(s)),
    "SELECT u.user_id, k.skill, CASE WHEN h.hours IS NULL THEN 'missing' ELSE 'weak' END AS gap, CASE WHEN h.hours IS NULL THEN 1 ELSE 2 END::BIGINT AS priority FROM (SELECT DISTINCT user_id FROM activities) u CROSS JOIN (SELECT DISTINCT skill FROM sk) k LEFT JOIN hours h ON h.user_id = u.user_id AND h.skill = k.skill WHERE h.hours IS NULL OR round(h.hours, 6) < 1", ACTIVITIES, SK, HOURS)


def _l10(s, d):
    docs = titled(s, d)
    hits = S.overlap_scores(docs, "for the main", 0.1)
    return X.smart_rank(hits.join(docs.select(F.col("doc_id").alias("id"), "title"), "id").withColumn("days_old", F.pmod("id", F.lit(400))), "the").select("id", F.round("score", 6).alias("score"), "rank")


add("l10_smart_search", _l10, """SELECT id, round(s2, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(s2, 9) DESC, id) AS rank FROM (
    SELECT id, least(1.0, s + greatest(0, 0.1 * (1 - id % 400 / 365)) + CASE WHEN contains(lower(title), 'the') THEN 0.15 ELSE 0 END) AS s2 FROM overlap)) WHERE rank <= 10""", TITLED, OVERLAP)  # fmt: skip
add("m4_resolve_mentions", lambda s, d: M.resolve_mentions(mentions(s, d)),
    """, w AS (SELECT *, trim(text) AS t, lower(trim(text)) AS l, string_split(trim(text), ' ') AS ws, list_distinct(string_split(lower(trim(text)), '')) AS ch FROM mentions),
       c AS (SELECT *, list_distinct([l] || CASE label
               WHEN 'PERSON' THEN CASE WHEN len(ws) >= 2 THEN [lower(ws[1][1] || '. ' || ws[-1]), lower(ws[1] || ' ' || ws[-1][1] || '.'), lower(ws[1]), lower(ws[-1]), lower(ws[-1] || ', ' || ws[1])] ELSE [] END
               WHEN 'ORG' THEN list_transform(list_filter([' inc.', ' inc', ' corp.', ' corp', ' ltd.', ' ltd', ' llc', ' llp', ' co.', ' co'], lambda x: suffix(l, x)), lambda x: trim(replace(l, x, '')))
                    || CASE WHEN len(ws) >= 2 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= 2 THEN [lower(array_to_string(list_transform(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]')), lambda x: x[1]), ''))] ELSE [] END
               ELSE [replace(l, '.', ''), replace(l, '-', ''), replace(l, ' ', '')] END) AS al FROM w),
       p AS (SELECT x.id, y.id AS other, x.label, x.platform <> y.platform AS across, x.l = y.l AS same, len(list_intersect(x.al, y.al)) AS k, abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 3600000000 AS near,
               least(1.0, 0.5::DOUBLE * len(list_intersect(x.ch, y.ch)) / len(list_distinct(x.ch || y.ch)) + 0.5::DOUBLE * least(length(x.l), length(y.l)) / greatest(length(x.l), length(y.l))
                     + CASE WHEN starts_with(x.l, y.l) OR starts_with(y.l, x.l) THEN 0.15 ELSE 0 END)::DOUBLE AS f
             FROM c x JOIN c y ON x.user_id = y.user_id AND x.label = y.label AND x.id <> y.id),
       m AS (SELECT id, other, across, CASE WHEN same THEN 'exact' ELSE 'alias' END AS method, CASE WHEN same THEN 1.0 WHEN k > 1 THEN 0.9 ELSE 0.85 END::DOUBLE AS score FROM p WHERE same OR k > 0
             UNION ALL SELECT id, other, across, 'time_window', 0.75 FROM p WHERE NOT same AND k = 0 AND near AND f > 0.7
             UNION ALL SELECT id, other, across, 'fuzzy', round(f, 3) FROM p WHERE NOT same AND k = 0 AND label IN ('PERSON', 'ORG') AND f >= 0.85),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other, method DESC) AS rank FROM m QUALIFY rank <= 5),
       g AS (SELECT id, arg_min(other, rank) AS other, arg_min(method, rank) AS method, arg_min(across, rank) AS across, count(*) AS n, string_agg(other || ' ' || method || ' ' || printf('%.3f', score), '; ' ORDER BY rank) AS says FROM r GROUP BY 1)
       SELECT mentions.id, other IS NOT NULL AS resolved, coalesce(other, mentions.id) AS canonical_id, coalesce(method, 'none') AS method, coalesce(across, false) AS cross_platform, coalesce(n, 0) AS n_matches, coalesce(says, '') AS matches
       FROM mentions LEFT JOIN g USING (id)""", ACTIVITIES, MENTIONS)  # fmt: skip
add("m4_mention_clusters", lambda s, d: M.cluster_mentions(mentions(s, d)))
add("m4_cross_activity_resolve", lambda s, d: X.resolve_by_alias(entities(s, d)),
    """, a AS (SELECT id, user_id, entity_type, lower(name) AS n, unnest(list_distinct([lower(name), array_to_string(list_reverse(string_split(lower(name), ' ')), ' ')])) AS alias FROM entities)
       SELECT x.id AS a, y.id AS b, max(CASE WHEN x.n = y.n THEN 1.0 ELSE 0.9 END)::DOUBLE AS score FROM a x JOIN a y ON x.user_id = y.user_id AND x.entity_type = y.entity_type AND x.alias = y.alias AND x.id < y.id GROUP BY 1, 2""", ENTITIES)  # fmt: skip
