"""Queries on tags, named entities and learning, with SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dictionaries import APP_NAMES, APP_TAGS, DOMAIN_ORGS, DOMAIN_TAGS, FILE_TYPES, TAG_HIERARCHY, TECH_SKILLS, TITLE_TAGS
from ..operators import names as N
from ..sources.tables import ACTIVITIES, activities, table
from .registry import add


def quoted(x: object) -> str:
    return str(x) if isinstance(x, (int, float)) else "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A common table expression of fixed rows, numbered in their order."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, [i, *r])) + ')' for i, r in enumerate(rows))}) v(i, {columns}))"


def detailed(s, d):
    """Activities with URLs, working folders and fuller titles, made from the same table."""
    a, k = activities(s, d), F.split_part("client_generated_id", F.lit(":"), F.lit(2)).cast("int")
    text = lambda x: x.cast("string")
    url = F.when(F.col("domain") == "github.com", F.concat(F.lit("https://github.com/team"), text(k % 3), F.lit("/repo"), text(k % 4), F.lit("/issues"))).when(F.col("domain").isNotNull(), F.concat(F.lit("https://"), "domain", F.lit("/p/"), text(k)))
    folder = F.when(F.col("app") == "terminal", F.concat(F.lit("/home/u/Projects/github-"), text(k % 3))).when(F.col("app") == "vscode", F.concat(F.lit("/home/u/Projects/p"), text(k % 4), F.lit("/"))).when(F.col("app") == "pycharm", F.lit("/home/u/Projects/src"))
    title = F.when(F.col("app") == "jupyter", F.concat(F.lit("Notebook — analysis"), text(k % 3), F.lit(".py"))).when(F.col("app") == "Notion", F.lit("Notes by Ada Lovelace on standup")).when(F.col("app") == "chrome", F.lit("python docker deploy guide")).when(F.col("app") == "finder", F.lit("Sales Report - budget.xlsx")).otherwise(F.col("title"))
    return a.withColumns({"url": url, "working_directory": folder, "title": title})


DETAILED = """
detailed AS (SELECT * REPLACE (CASE app WHEN 'jupyter' THEN 'Notebook — analysis' || k % 3 || '.py' WHEN 'Notion' THEN 'Notes by Ada Lovelace on standup' WHEN 'chrome' THEN 'python docker deploy guide' WHEN 'finder' THEN 'Sales Report - budget.xlsx' ELSE title END AS title),
      CASE WHEN domain = 'github.com' THEN 'https://github.com/team' || k % 3 || '/repo' || k % 4 || '/issues' WHEN domain IS NOT NULL THEN 'https://' || domain || '/p/' || k END AS url,
      CASE app WHEN 'terminal' THEN '/home/u/Projects/github-' || k % 3 WHEN 'vscode' THEN '/home/u/Projects/p' || k % 4 || '/' WHEN 'pycharm' THEN '/home/u/Projects/src' END AS working_directory
    FROM (SELECT *, split_part(client_generated_id, ':', 2)::INT AS k FROM activities))"""
DTAGS, ATAGS, TTAGS = values("dtags", "domain, tag, subtag", DOMAIN_TAGS), values("atags", "app, tag, subtag", APP_TAGS), values("ttags", "pattern, tag, subtag", TITLE_TAGS)
DOMAIN_TAG = "SELECT a.id, d.tag, d.subtag FROM (SELECT DISTINCT id, domain FROM detailed WHERE domain IS NOT NULL) a JOIN dtags d ON a.domain = d.domain OR ends_with(a.domain, '.' || d.domain) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY length(d.domain) DESC) = 1"
APP_TAG = """SELECT a.id, t.tag, t.subtag FROM detailed a JOIN atags t ON a.app = t.app OR lower(a.app) = lower(t.app) OR contains(lower(a.app), lower(t.app)) OR contains(lower(t.app), lower(a.app)) WHERE a.app <> ''
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY CASE WHEN a.app = t.app THEN 0 WHEN lower(a.app) = lower(t.app) THEN 1 ELSE 2 END, t.i) = 1"""
add("c11b_lookup_domain_tag", lambda s, d: detailed(s, d).select("id", N.domain_tag(F.col("domain")).alias("x")).filter("x is not null").select("id", "x.*"), DOMAIN_TAG, ACTIVITIES, DETAILED, DTAGS)
add("c11c_lookup_app_tag", lambda s, d: detailed(s, d).select("id", N.app_tag(F.col("app")).alias("x")).filter("x is not null").select("id", "x.*"), APP_TAG, ACTIVITIES, DETAILED, ATAGS)
add("c11h_lookup_parent_tag", lambda s, d: detailed(s, d).select("id", N.domain_tag(F.col("domain"))["subtag"].alias("subtag")).filter("subtag is not null").select("id", "subtag", N.parent_tag(F.col("subtag")).alias("parent")),
    f"SELECT x.id, x.subtag, p.tag AS parent FROM ({DOMAIN_TAG}) x LEFT JOIN (SELECT subtag, arg_min(tag, i) AS tag FROM hier GROUP BY 1) p ON x.subtag = p.subtag", ACTIVITIES, DETAILED, DTAGS, values("hier", "tag, subtag", [(t, u) for t, us in TAG_HIERARCHY.items() for u in us]))
add("h5_auto_tag", lambda s, d: N.auto_tag(detailed(s, d)),
    f"""SELECT a.id, coalesce((SELECT string_agg(DISTINCT v, ',' ORDER BY v) FROM unnest(list_concat([dt.tag, dt.subtag, apt.tag, apt.subtag], coalesce(tt.all_tags, []))) u(v)), '') AS tags, coalesce(dt.tag, apt.tag, tt.first, 'uncategorized') AS primary_category,
              CASE WHEN dt.tag IS NOT NULL THEN 0.95 WHEN apt.tag IS NOT NULL THEN 0.9 WHEN tt.n > 0 THEN 0.8 ELSE 0 END::DOUBLE AS confidence, ((dt.tag IS NOT NULL)::INT + (apt.tag IS NOT NULL)::INT + coalesce(tt.n, 0))::BIGINT AS n_categories
       FROM detailed a LEFT JOIN ({DOMAIN_TAG}) dt ON a.id = dt.id LEFT JOIN ({APP_TAG}) apt ON a.id = apt.id
       LEFT JOIN (SELECT a.id, count(*) AS n, flatten(array_agg([t.tag, t.subtag])) AS all_tags, arg_min(t.tag, t.i) AS first FROM detailed a JOIN ttags t ON regexp_matches(lower(a.title), t.pattern, 'i') GROUP BY 1) tt ON a.id = tt.id""", ACTIVITIES, DETAILED, DTAGS, ATAGS, TTAGS)  # fmt: skip
add("c11e_lookup_app_name", lambda s, d: detailed(s, d).filter("app is not null").select("id", N.usual_name(F.col("app")).alias("name")), "SELECT a.id, coalesce(n.usual, a.app) AS name FROM detailed a LEFT JOIN names n ON lower(a.app) = n.app WHERE a.app IS NOT NULL", ACTIVITIES, DETAILED, values("names", "app, usual", APP_NAMES))
add("c11e_lookup_file_type", lambda s, d: table(s, d, "pages").select("page_id", F.coalesce(N.file_kind(F.regexp_replace("url", r"[?#].*$", "")), F.lit("other")).alias("kind")),
    r"SELECT page_id, coalesce(kind, 'other') AS kind FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1)) AS e FROM pages) LEFT JOIN kinds ON e = extension", values("kinds", "extension, kind", FILE_TYPES))

CLASSES = f"""
classes AS (
  SELECT domain, CASE WHEN edu AND NOT contains(lower(label), 'university') THEN label || ' University' ELSE label END AS name, CASE WHEN edu THEN 'educational' WHEN gov THEN 'government' WHEN news THEN 'media' WHEN research THEN 'educational' WHEN fin THEN 'company' WHEN tld IN ('org', 'io', 'dev', 'app') THEN 'open_source' ELSE 'company' END AS org_type,
         CASE WHEN edu THEN 'education' WHEN gov THEN 'government' WHEN news THEN 'news' WHEN research THEN 'research' WHEN fin THEN 'finance' ELSE 'tech' END AS industry,
         CASE WHEN edu THEN 0.8 WHEN gov THEN 0.85 WHEN news THEN 0.7 WHEN research THEN 0.72 WHEN fin THEN 0.68 WHEN tld IN ('org', 'io', 'dev', 'app') THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence
  FROM (SELECT *, list_aggregate(list_transform(string_split(replace(sld, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label, regexp_matches(domain, '{N.EDU}') OR tld = 'edu' AS edu, regexp_matches(domain, '{N.GOV}') OR tld IN ('gov', 'mil') AS gov,
               regexp_matches(sld, '{N.NEWS}') OR tld IN ('news', 'press', 'media') AS news, regexp_matches(domain, '{N.RESEARCH}') OR tld = 'ac' AS research, regexp_matches(sld, '{N.FINANCE}') AS fin
        FROM (SELECT *, CASE WHEN parts[-2] IN ('ac', 'co', 'com', 'org', 'gov', 'net', 'edu') AND len(parts) >= 3 THEN parts[-3] ELSE parts[-2] END AS sld, parts[-1] AS tld
              FROM (SELECT DISTINCT lower(domain) AS domain, string_split(lower(domain), '.') AS parts FROM places WHERE contains(domain, '.')))))"""
ORGS = values("orgs", "domain, name, entity_type, org_type, industry, confidence", DOMAIN_ORGS)


def _places(s, d):
    """Domains of visits, and made-up hosts of suppliers, so that each pattern has cases."""
    endings = ["example.edu", "treasury.gov", "dailypress.news", "research-lab.ac.uk", "firstbank.com", "tools.dev", "acme.co.uk", "plain.net"]
    hosts = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(e) for e in endings]), (F.col("s_suppkey") % len(endings) + 1).cast("int"))).alias("domain"))
    return activities(s, d).filter("domain is not null").select("id", "domain").unionByName(hosts)


PLACES = "places AS (SELECT id, domain FROM activities WHERE domain IS NOT NULL UNION ALL SELECT s_suppkey, 's' || s_suppkey || '.' || ['example.edu', 'treasury.gov', 'dailypress.news', 'research-lab.ac.uk', 'firstbank.com', 'tools.dev', 'acme.co.uk', 'plain.net'][s_suppkey % 8 + 1] FROM supplier)"
add("c11d_lookup_domain_org", lambda s, d: _places(s, d).select("id", "domain", N.domain_entity(F.col("domain")).alias("x")).filter("x is not null").select("id", "domain", "x.name", "x.entity_type", "x.org_type", "x.industry", "x.confidence"),
    """SELECT p.id, p.domain, coalesce(o.name, c.name) AS name, coalesce(o.entity_type, 'organization') AS entity_type, CASE WHEN o.entity_type IS NULL THEN c.org_type WHEN o.entity_type = 'organization' THEN o.org_type END AS org_type,
              CASE WHEN o.entity_type IS NULL THEN c.industry WHEN o.entity_type = 'organization' THEN o.industry END AS industry, coalesce(o.confidence, c.confidence)::DOUBLE AS confidence
       FROM places p LEFT JOIN orgs o ON lower(p.domain) = o.domain LEFT JOIN classes c ON lower(p.domain) = c.domain
       WHERE o.name IS NOT NULL OR NOT regexp_matches(p.domain, '(co\\.uk|com\\.au|co\\.in|co\\.nz|com\\.br)$')""", ACTIVITIES, PLACES, ORGS, CLASSES)  # fmt: skip

FOUND = f"""
found AS (
  SELECT * FROM (
    SELECT a.id, a.user_id, a.occurred_at, a.type, 1 AS r, 0 AS q, coalesce(n.usual, a.app) AS name, 'artifact' AS entity_type, 0.95::DOUBLE AS confidence, 'app' AS source, NULL AS org_type FROM detailed a LEFT JOIN names n ON lower(a.app) = n.app WHERE a.app <> '' AND lower(a.app) NOT IN ('unknown', 'untitled')
    UNION ALL SELECT a.id, a.user_id, a.occurred_at, a.type, 2, 0, coalesce(o.name, c.name), coalesce(o.entity_type, 'organization'), coalesce(o.confidence, c.confidence), 'domain', CASE WHEN o.entity_type IS NULL THEN c.org_type WHEN o.entity_type = 'organization' THEN o.org_type END
      FROM detailed a LEFT JOIN orgs o ON lower(a.domain) = o.domain LEFT JOIN classes c ON lower(a.domain) = c.domain WHERE a.domain IS NOT NULL
    UNION ALL SELECT id, user_id, occurred_at, type, 3, 0, f, 'artifact', 0.85, 'file', NULL FROM files
    UNION ALL SELECT id, user_id, occurred_at, type, 4, 0, l.language, 'skill', 0.7, 'file_ext', NULL FROM files JOIN langs l ON lower(regexp_extract(f, '\\.([^.]*)$', 1)) = l.extension
    UNION ALL SELECT id, user_id, occurred_at, type, 5, 0, folder[-1], 'project', 0.65, 'working_dir', NULL FROM (SELECT *, string_split(rtrim(working_directory, '/'), '/') AS folder FROM detailed) WHERE len(folder) >= 4 AND lower(folder[-1]) NOT IN ('src', 'lib', 'bin', 'home', 'documents', 'desktop', 'downloads', '')
    UNION ALL SELECT a.id, a.user_id, a.occurred_at, a.type, 6, k.i, CASE WHEN length(k.skill) > 3 THEN upper(k.skill[1]) || k.skill[2:] ELSE upper(k.skill) END, 'skill', 0.6, 'pattern', NULL
      FROM (SELECT *, regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(url, ''), coalesce(app, ''))), '[a-z0-9#+.]+') AS words FROM detailed) a JOIN tech k ON list_contains(a.words, k.skill) OR list_contains(a.words, replace(k.skill, '.', ''))
    UNION ALL SELECT id, user_id, occurred_at, type, 7, 0, regexp_extract(url, 'github\\.com/([^/]+/[^/]+)', 1), 'project', 0.8, 'url', NULL FROM detailed WHERE regexp_matches(url, '^https://github\\.com/[^/]+/[^/]+')
    UNION ALL SELECT id, user_id, occurred_at, type, 8, 0, regexp_extract(title, '(?i)(?:by|author[:\\s]+)([A-Z][a-z]+ [A-Z][a-z]+)', 1), 'person', 0.6, 'title', NULL FROM detailed
    UNION ALL SELECT id, user_id, occurred_at, type, 9, q, p[q], 'person', 0.5, 'title_name', NULL FROM (SELECT *, regexp_extract_all(title, '\\b([A-Z][a-z]{{2,15}}\\s+[A-Z][a-z]{{2,15}})\\b', 1) AS p FROM detailed), (VALUES (1), (2)) v(q) WHERE lower(coalesce(p[q], '')) NOT IN ({', '.join(map(quoted, N.NO_PERSON))}))
  WHERE length(name) > 1 QUALIFY row_number() OVER (PARTITION BY id, lower(name), entity_type ORDER BY r, q) = 1)"""
FILES = "files AS (SELECT * FROM (SELECT *, trim(regexp_extract(title, '[—–-]\\s*(.+?\\.\\w{2,5})\\s*$', 1)) AS f FROM detailed) WHERE f <> '')"
BASE = (ACTIVITIES, DETAILED, "places AS (SELECT domain FROM detailed WHERE domain IS NOT NULL)", ORGS, CLASSES, values("names", "app, usual", APP_NAMES), values("langs", "extension, language", N.LANGUAGES.items()), values("tech", "skill", [(x,) for x in TECH_SKILLS]), FILES, FOUND)
add("h6_lightweight_ner", lambda s, d: N.entities_of(detailed(s, d)).select("id", "entity_type", "name", "confidence", "source", "org_type"), "SELECT id, entity_type, name, confidence, source, org_type FROM found", *BASE)
add("a9_upsert_entities", lambda s, d: N.upsert_entities(N.entities_of(detailed(s, d))).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen", "last_seen")}),
    "SELECT user_id, entity_type, name, count(*) AS occurrence_count, count(DISTINCT id) AS activities, strftime(min(occurred_at), '%Y-%m-%d') AS first_seen, strftime(max(occurred_at), '%Y-%m-%d') AS last_seen, max(confidence) AS confidence FROM found GROUP BY 1, 2, 3", *BASE)
add("a9_entity_links", lambda s, d: N.entities_of(detailed(s, d)).groupBy("user_id", "entity_type", "name").agg(F.min("id").alias("entity_id"), F.count_distinct("id").alias("n")), "SELECT user_id, entity_type, name, min(id) AS entity_id, count(DISTINCT id) AS n FROM found GROUP BY 1, 2, 3", *BASE)
add("k26_infer_learning", lambda s, d: N.learning_edges(N.entities_of(detailed(s, d))),
    """SELECT user_id, name, rel_type, n AS session_count, round(CASE rel_type WHEN 'LEARNED_FROM' THEN least(0.85, 0.6 + n * 0.04) WHEN 'CONTRIBUTED_TO' THEN least(0.85, 0.6 + n * 0.05) ELSE least(0.8, 0.55 + n * 0.04) END, 6)::DOUBLE AS confidence, round(1 + log10(n), 6) AS weight
       FROM (SELECT user_id, name, 'LEARNED_FROM' AS rel_type, count(*) AS n FROM found WHERE type IN ('web_visit', 'reading_analytics', 'web_browsing') AND entity_type = 'organization' AND org_type IN ('educational', 'open_source', 'community', 'media') GROUP BY 1, 2
             UNION ALL SELECT user_id, name, 'CONTRIBUTED_TO', count(*) FROM found WHERE type IN ('app_focus', 'code_editing') AND entity_type = 'project' AND (source = 'url' OR contains(lower(name), 'github')) GROUP BY 1, 2 HAVING count(*) >= 2
             UNION ALL SELECT user_id, name, 'WORKS_ON', count(*) FROM found WHERE type = 'app_focus' AND entity_type = 'project' GROUP BY 1, 2 HAVING count(*) >= 3)""", *BASE)  # fmt: skip
