"""Figures and advice put together from other operators: collaboration, careers, wellness, recommendations, walks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded

# Extensions of content that isn't ingested, corrections of names.
BINARY = ["png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "mp4", "mp3", "wav", "avi", "mov", "zip", "tar", "gz", "rar", "exe", "dmg", "iso", "woff", "woff2", "ttf", "bin"]
CORRECTIONS = {"pyhton": "Python", "javscript": "JavaScript", "githb": "GitHub", "kuberntes": "Kubernetes"}
CASING = {"github": "GitHub", "javascript": "JavaScript", "postgresql": "PostgreSQL", "vscode": "VS Code", "youtube": "YouTube", "pycharm": "PyCharm"}


def ingestible(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Pages that are neither local nor of a binary kind, with text without NUL, a snippet of 500 characters and an
    importance tier by length."""
    low = F.lower(F.regexp_replace(F.col(url), r"[?#].*$", ""))
    keep = ~low.rlike(r"^[a-z]+://(localhost|127\.0\.0\.1)([:/]|$)") & ~low.rlike(r"\.(" + "|".join(BINARY) + ")$")
    text = F.translate(F.col(body), "\x00", "")
    n = F.length(text)
    return pages.filter(keep).withColumn("snippet", F.substring(text, 1, 500)).withColumn("tier", F.when(n >= 2000, "high").when(n >= 1000, "medium").otherwise("low"))


def collaboration_score(met: DataFrame) -> DataFrame:
    """3 for ten people met or more, 4 for 25 meetings, 3 for three kinds, each in proportion, for each user."""
    score = F.least(F.col("people") / 10, F.lit(1.0)) * 3 + F.least(F.col("interactions") / 25, F.lit(1.0)) * 4 + F.least(F.col("kinds") / 3, F.lit(1.0)) * 3
    return met.withColumn("score", score)


def role_readiness(skills: DataFrame, roles: DataFrame) -> DataFrame:
    """For each user and role (``role, required array``): share of the required skills that the user has, which are
    missing, and the best role."""
    own = skills.groupBy("user_id").agg(F.collect_set("skill").alias("own"))
    x = own.crossJoin(bounded(roles))
    have = F.size(F.array_intersect("own", "required"))
    y = x.withColumn("readiness", have / F.size("required")).withColumn("missing", F.array_sort(F.array_except("required", "own")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("readiness"), "role"))
    return y.select("user_id", "role", "readiness", "missing", (rank == 1).alias("best_fit"))


def spelling(name: Column) -> Column:
    """H9: known misspellings and casings of names, word by word."""
    table = F.create_map(*[F.lit(x) for kv in (CASING | CORRECTIONS).items() for x in kv])
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), " ")


def content_tags(kind: Column, importance: Column) -> Column:
    """Tier by importance (70, 50, 35) and the kind of document."""
    return F.array_compact(F.array(F.when(importance >= 70, "tier:core").when(importance >= 50, "tier:important").when(importance >= 35, "tier:useful"), F.concat(F.lit("type:"), kind)))


def code_symbols(source: Column) -> dict[str, Column]:
    """Imports, functions and classes of Python sources."""
    pick = lambda p: F.array_distinct(F.regexp_extract_all(source, F.lit(p), 1))
    return {"imports": pick(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)"), "functions": pick(r"(?m)^\s*def\s+([A-Za-z_]\w*)"), "classes": pick(r"(?m)^\s*class\s+([A-Za-z_]\w*)")}


def missing_props(edges: DataFrame, required: Mapping[str, list[str]]) -> DataFrame:
    """Required properties of its type that each edge (``rel_type, props`` map) doesn't have."""
    table = F.create_map(*[v for k, ps in required.items() for v in (F.lit(k), F.array(*[F.lit(p) for p in ps]))])
    return edges.withColumn("missing", F.coalesce(F.array_except(F.element_at(table, F.col("rel_type")), F.map_keys("props")), F.array().cast("array<string>")))
