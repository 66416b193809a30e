"""Tags of activities, and the entities that they name: applications, organisations, files, projects, skills, persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import APP_NAMES, APP_TAGS, DOMAIN_ORGS, DOMAIN_TAGS, FILE_TYPES, TAG_HIERARCHY, TECH_SKILLS, TITLE_TAGS

# Patterns of domains by kind of organisation, language by file extension, and words that name nothing.
EDU = r"umich\.edu|umdearborn\.edu|mit\.edu|stanford\.edu|harvard\.edu|berkeley\.edu|cmu\.edu|gatech\.edu|[a-z]+\.edu"
GOV = r"\.(gov|mil)(\.[a-z]{2})?$|(cdc\.gov|nih\.gov|nasa\.gov|fbi\.gov|cia\.gov|whitehouse\.gov|congress\.gov|senate\.gov|house\.gov)"
NEWS = r"^(news|bbc|cnn|nytimes|theguardian|techcrunch|wired|arstechnica|theverge|engadget|reuters|bloomberg|ft\.com|wsj|forbes|businessinsider)"
FINANCE = r"(bank|finance|invest|capital|trading|crypto|btc|eth|coinbase|robinhood|etrade|fidelity|schwab|vanguard|blackrock)"
RESEARCH = r"(research|journal|review|pubmed|arxiv|scholar|ieee|acm|springer|elsevier|nature\.com|science\.org)"
LANGUAGES = {
    "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "jsx": "JavaScript", "rs": "Rust", "go": "Go", "java": "Java", "rb": "Ruby", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "cpp": "C++", "c": "C",
    "html": "HTML", "css": "CSS", "scss": "Sass/SCSS",
}
COMPOUND = ["ac", "co", "com", "org", "gov", "net", "edu"]
COUNTRY = ["co.uk", "com.au", "co.in", "co.nz", "com.br"]
NO_FOLDER = ["src", "lib", "bin", "home", "documents", "desktop", "downloads"]
NO_PERSON = ["document viewer", "text editor", "image viewer", "file manager", "system monitor", "activity monitor", "google chrome", "visual studio", "sublime text", "microsoft word", "libre office"]

ENTITY = "array<struct<name:string,entity_type:string,confidence:double,source:string,org_type:string,industry:string>>"


# every way a skill may be written as one word: its name, and its name without dots
SPELLINGS = list(dict.fromkeys(w for s in TECH_SKILLS for w in (s, s.replace(".", ""))))


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs for v in kv])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), 0)


def parents(domain: Column) -> Column:
    """The domain and every parent of it with at least one dot, the longest first."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def domain_tag(domain: Column) -> Column:
    """``struct<tag, subtag>`` of the domain or of its nearest parent in the dictionary; null where none is."""
    table = _map([(d, i) for i, (d, _, _) in enumerate(DOMAIN_TAGS)])
    at = F.get(F.array_compact(F.transform(parents(domain), lambda p: F.element_at(table, p))), 0)
    return _tag_at(at, DOMAIN_TAGS)


def _tag_at(at: Column, table: list[tuple[str, str, str]]) -> Column:
    return F.get(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(u).alias("subtag")) for _, t, u in table]), at)


def app_tag(app: Column) -> Column:
    """``struct<tag, subtag>`` of the application: by name, by name in any case, else the first entry that contains it
    or that it contains."""
    low = F.lower(app)
    same = F.element_at(_map([(a, i) for i, (a, _, _) in enumerate(APP_TAGS)]), app)
    any_case = F.element_at(_map([(a.lower(), i) for i, (a, _, _) in enumerate(APP_TAGS)]), low)
    part = F.coalesce(*[F.when(F.contains(low, F.lit(a.lower())) | F.contains(F.lit(a.lower()), low), i) for i, (a, _, _) in enumerate(APP_TAGS)])
    return F.when(app != "", _tag_at(F.coalesce(same, any_case, part), APP_TAGS))


def title_tags(title: Column) -> Column:
    """H5: ``array<struct<tag, subtag>>`` of the patterns that a title has, in their order."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("(?i)" + p), F.struct(F.lit(t).alias("tag"), F.lit(u).alias("subtag"))) for p, t, u in TITLE_TAGS]))


def parent_tag(subtag: Column) -> Column:
    """C11h: the first tag that has the subtag."""
    first: dict[str, str] = {}
    for tag, subs in TAG_HIERARCHY.items():
        for s in subs:
            first.setdefault(s, tag)
    return F.element_at(_map(first.items()), subtag)


def auto_tag(acts: DataFrame) -> DataFrame:
    """H5: all tags and subtags of each activity, sorted; the primary category: the domain's (.95), else the application's
    (.90), else the title's first (.80), else "uncategorized"; and its confidence. No shuffle."""
    none = F.array().cast("array<struct<tag:string,subtag:string>>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    x = acts.select("id", domain_tag(F.col("domain")).alias("d"), app_tag(F.col("app")).alias("a"), title_tags(F.col("title")).alias("t"))
    found = F.concat(one(F.col("d")), one(F.col("a")), F.col("t"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda f: F.array(f["tag"], f["subtag"])))))
    confidence = F.when(F.col("d").isNotNull(), 0.95).when(F.col("a").isNotNull(), 0.9).when(F.size("t") > 0, 0.8).otherwise(0.0)
    return x.select("id", F.array_join(tags, ",").alias("tags"), F.coalesce("d.tag", "a.tag", F.get("t", 0)["tag"], F.lit("uncategorized")).alias("primary_category"), confidence.alias("confidence"), F.size(found).cast("long").alias("n_categories"))


def usual_name(app: Column) -> Column:
    """C11e: the usual name of an application."""
    return F.coalesce(F.element_at(_map(APP_NAMES), F.lower(app)), app)


def file_kind(name: Column) -> Column:
    """C11e: kind of a file by its extension; null for others."""
    return F.element_at(_map(FILE_TYPES), F.lower(F.nullif(F.regexp_extract(name, r"(\.[^./]+)$", 1), F.lit(""))))


def classify_domain(domain: Column) -> Column:
    """C11d: ``struct<name, org_type, industry, confidence>`` of a domain that the dictionary doesn't have, by patterns."""
    label = lambda sld: F.initcap(F.replace(sld, F.lit("-"), F.lit(" ")))
    of = lambda d, parts: _let(_second_level(parts), lambda sld: _let(label(sld), lambda name: _kind(d, F.size(parts), F.element_at(parts, -1), sld, name)))
    return _let(F.lower(F.trim(domain)), lambda d: _let(F.split(d, r"\."), lambda parts: of(d, parts)))


def _second_level(parts: Column) -> Column:
    second = F.try_element_at(parts, F.lit(-2))
    return F.when(second.isin(COMPOUND) & (F.size(parts) >= 3), F.try_element_at(parts, F.lit(-3))).otherwise(second)


def _kind(d: Column, n: Column, tld: Column, sld: Column, name: Column) -> Column:
    kind = lambda label, org, industry, conf: F.struct(label.alias("name"), F.lit(org).alias("org_type"), F.lit(industry).alias("industry"), F.lit(conf).alias("confidence"))
    school = F.when(F.contains(F.lower(name), F.lit("university")), name).otherwise(F.concat(name, F.lit(" University")))
    return (
        F.when(n < 2, kind(F.lit(None).cast("string"), "company", "tech", 0.45))
        .when(d.rlike(EDU) | (tld == "edu"), kind(school, "educational", "education", 0.80))
        .when(d.rlike(GOV) | tld.isin("gov", "mil"), kind(name, "government", "government", 0.85))
        .when(sld.rlike(NEWS) | tld.isin("news", "press", "media"), kind(name, "media", "news", 0.70))
        .when(d.rlike(RESEARCH) | (tld == "ac"), kind(name, "educational", "research", 0.72))
        .when(sld.rlike(FINANCE), kind(name, "company", "finance", 0.68))
        .when(tld.isin("org", "io", "dev", "app"), kind(name, "open_source", "tech", 0.60))
        .otherwise(kind(name, "company", "tech", 0.55))
    )


def domain_entity(domain: Column) -> Column:
    """C11d: the entity of a domain: of the dictionary, else by its pattern; null for local names and bare country domains."""
    return _let(F.lower(domain), lambda low: F.coalesce(_known_domain(low), _let(classify_domain(low), lambda c: _guessed(low, c))))


def _known_domain(low: Column) -> Column:
    return F.get(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("entity_type"), F.lit(c).alias("confidence"), F.lit("domain").alias("source"), F.lit(o if e == "organization" else None).cast("string").alias("org_type"), F.lit(i if e == "organization" else None).cast("string").alias("industry")) for _, n, e, o, i, c in DOMAIN_ORGS]),
        F.element_at(_map([(d, k) for k, (d, *_) in enumerate(DOMAIN_ORGS)]), low),
    )


def _guessed(low: Column, c: Column) -> Column:
    parts = F.split(low, r"\.")
    tail = F.array_join(F.slice(parts, -2, 2), ".")
    fits = ~low.isin("localhost", "127.0.0.1", "", "unknown") & (F.size(parts) >= 2)
    named = ~tail.isin(COUNTRY) & ~F.lower(c["name"]).isin("www", "com", "org", "net", "io", "")
    guessed = F.struct(c["name"].alias("name"), F.lit("organization").alias("entity_type"), c["confidence"].alias("confidence"), F.lit("domain").alias("source"), c["org_type"].alias("org_type"), c["industry"].alias("industry"))
    return F.when(fits & F.when(fits, named).otherwise(False), guessed)


def entities_of(acts: DataFrame) -> DataFrame:
    """H6: the entities that each activity names, one row for each (activity, name in any case, type), from the first rule
    that gives it, with confidence, source and, for organisations, type and industry. No shuffle.

    Rules, in order: the application (.95), the domain (.45 to .95), a file from ``file_name`` or the title's end (.85) and its
    language (.7), the last folder of ``working_directory`` (.65), technical skills among the words of title, URL and
    application (.6), a repository in a code host's URL (.8), an author in the title (.6), and two Title-Case pairs (.5).
    Columns that ``acts`` lacks count as null; names of one character don't count.
    """
    col = lambda c: F.coalesce(F.col(c) if c in acts.columns else F.lit(None).cast("string"), F.lit(""))
    title, app, url = col("title"), col("app"), col("url")
    item = lambda name, kind, conf, source: F.struct(F.trim(name).alias("name"), F.lit(kind).alias("entity_type"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("org_type"), F.lit(None).cast("string").alias("industry"))
    none = F.array().cast(ENTITY)
    when = lambda test, one: F.when(test, F.array(one)).otherwise(none)
    at_end = F.trim(F.regexp_extract(title, r"[—–-]\s*(.+?\.\w{2,5})\s*$", 1))
    language_of = F.element_at(_map(LANGUAGES.items()), F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1)))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, url, app)), F.lit(r"([a-z0-9#+.]+)"), 1)
    hits = F.col("hits")
    skills = F.when(F.size(hits) > 0, F.filter(F.lit(TECH_SKILLS), lambda s: F.array_contains(hits, s) | F.array_contains(hits, F.replace(s, F.lit("."), F.lit(""))))).otherwise(F.array().cast("array<string>"))
    shown = F.transform(skills, lambda s: item(F.when(F.length(s) > 3, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 100))).otherwise(F.upper(s)), "skill", 0.6, "pattern"))
    repo_of = F.regexp_extract(url, r"^[a-z]+://[^/]*github\.com[^/]*/([^/?#]+/[^/?#]+)", 1)
    author_of = F.regexp_extract(title, r"(?i)(?:by|author[:\s]+)([A-Z][a-z]+ [A-Z][a-z]+)", 1)
    pairs = F.filter(F.slice(F.regexp_extract_all(title, F.lit(r"\b([A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15})\b"), 1), 1, 2), lambda p: ~F.lower(p).isin(NO_PERSON))
    parts = {
        "usual": usual_name(app), "file": F.coalesce(F.nullif(col("file_name"), F.lit("")), at_end), "folder": F.split(F.regexp_replace(col("working_directory"), "/+$", ""), "/"),
        "hits": F.array_intersect(F.lit(SPELLINGS), words), "repo": repo_of, "author": author_of, "pairs": pairs, "org": domain_entity(F.col("domain")) if "domain" in acts.columns else F.lit(None),
    }
    usual, file_name, folder, repo, author = (F.col(c) for c in ("usual", "file", "folder", "repo", "author"))
    language, last = F.col("language"), F.element_at(folder, -1)
    found = F.concat(
        when((usual != "") & ~F.lower(usual).isin("unknown", "untitled"), item(usual, "artifact", 0.95, "app")),
        F.when(F.col("org").isNotNull(), F.array(F.col("org"))).otherwise(none) if "domain" in acts.columns else none,
        when(file_name != "", item(file_name, "artifact", 0.85, "file")),
        when((file_name != "") & language.isNotNull(), item(language, "skill", 0.7, "file_ext")),
        when((F.size(folder) >= 4) & (last != "") & ~F.lower(last).isin(NO_FOLDER), item(last, "project", 0.65, "working_dir")),
        shown,
        when(repo != "", item(repo, "project", 0.8, "url")),
        when(author != "", item(author, "person", 0.6, "title")),
        F.transform("pairs", lambda p: item(p, "person", 0.5, "title_name")),
    )
    rows = acts.select("id", "user_id", "occurred_at", "type", *[c.alias(k) for k, c in parts.items()]).withColumn("language", language_of)
    rows = rows.select("id", "user_id", "occurred_at", "type", F.filter(found, lambda e: F.length(e["name"]) > 1).alias("found"))
    keys = F.transform("found", lambda e: F.concat_ws("\x00", F.lower(e["name"]), e["entity_type"]))
    firsts = F.filter("found", lambda e, i: F.array_position(F.col("keys"), F.concat_ws("\x00", F.lower(e["name"]), e["entity_type"])) == i + 1)
    return rows.withColumn("keys", keys).select("id", "user_id", "occurred_at", "type", F.explode(firsts).alias("e")).select("id", "user_id", "occurred_at", "type", "e.*")


def upsert_entities(found: DataFrame) -> DataFrame:
    """One entity for each (user, type, name), with its number of mentions and of activities, first and last time and the
    highest confidence."""
    return found.groupBy("user_id", "entity_type", "name").agg(F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("id").alias("activities"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.max("confidence").alias("confidence"))


def learning_edges(found: DataFrame, reading: tuple[str, ...] = ("web_visit", "reading_analytics", "web_browsing"), coding: tuple[str, ...] = ("app_focus", "code_editing")) -> DataFrame:
    """LEARNED_FROM organisations that teach, are open, a community or media and whose pages a user read, once or more;
    CONTRIBUTED_TO projects known from a URL or named after a code host, with twice coding or more; WORKS_ON projects with
    three times of focus or more. Confidence rises by .04, .05 and .04 for each, to .85, .85 and .80."""
    project, focus = F.col("entity_type") == "project", F.col("type") == "app_focus"
    rules = {
        "LEARNED_FROM": (F.col("type").isin(*reading) & (F.col("entity_type") == "organization") & F.col("org_type").isin("educational", "open_source", "community", "media"), 1, 0.60, 0.04, 0.85),
        "CONTRIBUTED_TO": (F.col("type").isin(*coding) & project & ((F.col("source") == "url") | F.contains(F.lower("name"), F.lit("github"))), 2, 0.60, 0.05, 0.85),
        "WORKS_ON": (focus & project, 3, 0.55, 0.04, 0.80),
    }
    kinds = F.array_compact(F.array(*[F.when(test, k) for k, (test, *_) in rules.items()]))
    n = found.select("user_id", "name", F.explode(kinds).alias("rel_type")).groupBy("user_id", "name", "rel_type").agg(F.count(F.lit(1)).alias("session_count"))
    least = _map([(k, r[1]) for k, r in rules.items()])[F.col("rel_type")]
    confidence = F.coalesce(*[F.when(F.col("rel_type") == k, F.least(F.lit(most), base + F.col("session_count") * step)) for k, (_, _, base, step, most) in rules.items()])
    return n.filter(F.col("session_count") >= least).select("user_id", "name", "rel_type", "session_count", F.round(confidence, 6).alias("confidence"), F.round(1 + F.log10("session_count"), 6).alias("weight"))
