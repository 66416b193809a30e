"""Synchronised rows, bundles, sessions, proximity, citations, symbols, chained enrichment and schema checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from . import names as N


def sync_activities(rows: DataFrame) -> DataFrame:
    """A3: client rows (``data`` a map of strings or null) as activities with a ``context``: application, title, domain and URL,
    overridden by ``data``; the source is "sync" where none is given."""
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("app_name"), "app", F.lit("title"), "title", F.lit("domain"), "domain", F.lit("url"), "url")
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(data, k))
    return rows.withColumn("context", F.map_concat(kept, data)).withColumn("source", F.coalesce("source", F.lit("sync")))


def store_focus_sessions(stored: DataFrame, sessions: DataFrame) -> DataFrame:
    """A5: the stored sessions and the new ones, with defaults: the domain for a missing application, empty category, 0 s,
    depth Shallow, score 0 and source desktop."""
    new = sessions.select(
        "user_id", F.coalesce("app_name", "domain", F.lit("")).alias("app_name"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("duration_seconds", F.lit(0)).alias("duration_seconds"), F.coalesce("depth", F.lit("Shallow")).alias("depth"), F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("source", F.lit("desktop")).alias("source"), "created_at",
    )
    return stored.unionByName(new)


def import_bundle(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one table of a bundle (``table, row``), typed by its schema; rows that aren't such JSON are left out."""
    parsed = rows.filter(F.col("table") == name).select(F.from_json("row", schema).alias("r"))
    return parsed.filter("r is not null").select("r.*")


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """the last ``n`` rows of each group in an order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def time_proximity(found: DataFrame, minutes: int = 60) -> DataFrame:
    """Pairs of different names that a user's activities mention within ``minutes`` of each other, with how often.

    Mentions are dealt into buckets of that length; one side visits its own and the two next to it, so the join is one on
    equal keys. The mentions are written once, so that both sides don't find them anew.
    """
    t = F.unix_micros("occurred_at")
    width = minutes * 60_000_000
    x = written(found.select("user_id", "name", t.alias("t"), F.floor(t / width).alias("bucket")).distinct(), "named")
    a = x.select("user_id", F.col("name").alias("a"), F.col("t").alias("ta"), "bucket")
    b = x.select("user_id", F.col("name").alias("b"), F.col("t").alias("tb"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = a.join(b, ["user_id", "bucket"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width))
    return near.groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: w != "")


def _mentions(needles: list[tuple[int, str, str]]):
    """Which of the strings a text has, from one pass over it; identifiers as they are, others in lower case."""

    def task(batches):
        from ahocorasick import Automaton

        finders = []
        for exact in (True, False):
            finder, at = Automaton(), {}
            for cited, signal, needle in needles:
                if needle and (signal == "doi") == exact:
                    at.setdefault(needle, []).append((cited, signal))
            for needle, who in at.items():
                finder.add_word(needle, who)
            if at:
                finder.make_automaton()
                finders.append((exact, finder))
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for exact, finder in finders:
                    found = {hit for _, who in finder.iter((text or "") if exact else (text or "").lower()) for hit in who}
                    out += [(key, *hit) for hit in sorted(found)]
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string()])], ["id", "cited", "signal"])

    return task


def citations(papers: DataFrame, known: DataFrame, most_short: int = 10_000) -> DataFrame:
    """Papers (``id, content``) that mention known ones (``id, title, authors, doi``): confidence .7, .85 for more than
    one signal, .95 with the identifier of the publisher; none of itself.

    A long title is met through three words from within it, as whole words stand there wherever it is mentioned; titles of
    fewer than five words, authors and identifiers, ``most_short`` at most (an error above), are looked for together in one
    pass over each text.
    """
    k = known.select(F.col("id").alias("cited"), "title", "authors", "doi")
    words = _words(F.coalesce("title", F.lit("")))
    long = F.size(words) >= 5
    keyed = k.filter(long).select("cited", F.lower("title").alias("needle"), F.xxhash64(F.get(words, 1), F.get(words, 2), F.get(words, 3)).alias("h"))
    # the words are a column of their own, so that they are made once for each text
    text = papers.select("id", F.lower("content").alias("low"), _words(F.col("content")).alias("ws")).filter(F.size("ws") >= 3)
    triples = F.array_distinct(F.zip_with(F.arrays_zip("ws", F.slice("ws", 2, F.size("ws"))), F.slice("ws", 3, F.size("ws")), lambda p, c: F.xxhash64(p["ws"], p["1"], c)))
    hits = text.select("id", "low", F.explode(triples).alias("h")).join(keyed, "h").filter((F.col("id") != F.col("cited")) & F.contains("low", F.col("needle")))
    found = hits.select("id", "cited", F.lit("title").alias("signal"))
    short = k.select("cited", F.explode(F.array_compact(F.concat(
        F.array(F.when(~long & (F.size(words) > 0), F.struct(F.lit("title").alias("signal"), F.lower("title").alias("needle"))), F.when(F.col("doi").isNotNull(), F.struct(F.lit("doi").alias("signal"), F.col("doi").alias("needle")))),
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.lit("author").alias("signal"), F.lower(a).alias("needle"))),
    ))).alias("x")).select("cited", "x.*")
    needles = [(r.cited, r.signal, r.needle) for r in short.limit(most_short + 1).collect()]
    if len(needles) > most_short:
        raise ValueError(f"more than {most_short} short strings to look for")
    more = papers.select("id", "content").mapInArrow(_mentions(needles), "id long, cited long, signal string")
    more = more.filter(F.col("id") != F.col("cited"))
    per = found.union(more).groupBy("id", "cited").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    confidence = F.when(F.array_contains("signals", "doi"), 0.95).when(F.size("signals") > 1, 0.85).otherwise(0.7)
    return per.select("id", "cited", F.array_join("signals", ",").alias("signals"), confidence.alias("confidence"))


def enrich_chain(acts: DataFrame) -> DataFrame:
    """One chain of five stages over each activity: the tool's usual name, the parts of the time, the category, the host
    and path of the URL, and the entities' number; ``failed`` names the stages that gave nothing although there was input, and
    the others go on."""
    x = acts.withColumn("tool", N.usual_name(F.col("app"))).withColumns({"hour": F.hour("occurred_at").cast("long"), "weekday": F.weekday("occurred_at").cast("long")})
    x = x.withColumn("category", F.coalesce(N.domain_tag(F.col("domain"))["tag"], N.app_tag(F.col("app"))["tag"]))
    x = x.withColumn("host", F.try_parse_url("url", F.lit("HOST"))).withColumn("path", F.try_parse_url("url", F.lit("PATH")))
    failed = F.array_compact(F.array(
        F.when(F.col("app").isNotNull() & F.col("tool").isNull(), "tool"), F.when(F.col("hour").isNull(), "time"), F.when((F.col("app").isNotNull() | F.col("domain").isNotNull()) & F.col("category").isNull(), "category"), F.when(F.col("url").isNotNull() & F.col("host").isNull(), "url"),
    ))
    return x.select("id", "tool", "hour", "weekday", "category", "host", "path", F.array_join(failed, ",").alias("failed"))


def validate_nodes(nodes: DataFrame, schema: Mapping[str, Mapping[str, list[str]]], common: tuple[str, ...] = ("user_id", "entity_id", "created_at", "updated_at", "canonical_name")) -> DataFrame:
    """Nodes (``id, node_type, props`` map) against a schema of required and optional properties by type: valid or not,
    missing ones, and unknown ones as warnings."""
    table = lambda k: F.create_map(*[v for t, s in schema.items() for v in (F.lit(t), F.array(*[F.lit(p) for p in s[k]]).cast("array<string>"))])
    required, optional = F.element_at(table("required"), F.col("node_type")), F.element_at(table("optional"), F.col("node_type"))
    missing = F.filter(required, lambda p: F.coalesce(F.element_at("props", p), F.lit("")) == "")
    unknown = F.array_except(F.map_keys("props"), F.concat(required, optional, F.array(*[F.lit(c) for c in common])))
    errors = F.when(required.isNull(), F.concat(F.lit("unknown type "), "node_type")).otherwise(F.array_join(missing, ","))
    return nodes.select("id", (errors == "").alias("valid"), errors.alias("errors"), F.coalesce(F.array_join(F.array_sort(unknown), ","), F.lit("")).alias("warnings"))


def all_centralities(edges: DataFrame, metrics: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """K8: ``metric, id, score, error`` of each metric over the same edges; each is written before the next one, so that one
    that fails takes no other with it. A metric that failed is one row with its error and neither vertex nor score."""
    shared, spark = cut_lineage(edges), edges.sparkSession
    out, failed = None, []
    for name, run in metrics.items():
        try:
            rows = cut_lineage(run(shared).select(F.lit(name).alias("metric"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error")))
        except PySparkException as problem:
            failed.append((name, None, None, problem.getCondition() or str(problem)))
            continue
        out = rows if out is None else out.unionByName(rows)
    report = spark.createDataFrame(failed, "metric string, id long, score double, error string")
    return report if out is None else out.unionByName(report)

