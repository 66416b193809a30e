"""Removal of passages that repeat: overlapping three-line windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Remove every later occurrence of a run of ``window`` lines that occurs more than once in the table.

    Each text is split at line feeds, and each run of ``window`` consecutive lines is hashed to 128 bits. Of the
    occurrences of a run, the one with the smallest (identifier, line number) stays; the lines of the others are
    covered, covered lines are merged into intervals, and the text is put together from the lines between them. An
    occurrence that overlaps the first one is a later one too, so of lines that repeat in turn one period stays. Runs of
    blank lines alone don't count. Texts with fewer lines than ``window`` have no run and stay as they are.

    Returns the rows and columns of ``docs`` with the new text and, after them, a struct ``line_dedup`` of ``n_lines``
    and ``n_removed``. A null text stays null, with both counts 0. A null identifier sorts first. Rows repeated with the
    same identifier and text count as one document listed twice: none is a later occurrence of the other. An empty table
    gives no rows. Columns of ``docs`` may have any names but ``line_dedup``, which would be replaced.

    A run that is in a third of all texts is combined before the shuffle; the joins are plain equi joins, which adaptive
    execution splits at hot keys. Memory is bounded by the longest single text.
    """
    columns = [c for c in docs.columns if c != "line_dedup"]
    text = F.col("row")[text_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).select("row", F.col("row")[id_col].alias("id"), F.xxhash64(text).alias("tx"))
    lines = F.split(text, "\n", -1)
    hashes = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) == "").alias("blank")))
    at = [lambda i, k=k: F.get(F.col("lh"), i + k) for k in range(window)]
    found = (
        base.select("id", "tx", lines.alias("lines"))
        .filter(F.size("lines") >= window)
        .select("id", "tx", hashes.alias("lh"))
        .select("id", "tx", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lh") - window), lambda i: F.struct(F.xxhash64(*[g(i)["a"] for g in at]).alias("a"), F.xxhash64(*[g(i)["b"] for g in at]).alias("b"), F.array_min(F.array(*[g(i)["blank"] for g in at])).alias("blank")))).alias("pos", "w"))
        .filter(~F.col("w.blank"))
        .select("id", "tx", "pos", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    )
    first = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tx", "pos")).alias("first")).filter("n > 1").drop("n")
    later = found.join(first, ["a", "b"]).filter(~F.struct("id", "tx", "pos").eqNullSafe(F.col("first"))).select("id", "tx", "pos")

    by_doc = Window.partitionBy("id", "tx").orderBy("pos")
    gap = F.coalesce((F.col("pos") > F.lag("pos").over(by_doc) + window).cast("int"), F.lit(1))
    cuts = (
        later.withColumn("gap", gap)
        .withColumn("island", F.sum("gap").over(by_doc))
        .groupBy("id", "tx", "island")
        .agg(F.struct(F.min("pos").alias("s"), (F.max("pos") + window).alias("e")).alias("cut"))
        .groupBy("id", "tx")
        .agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    )
    cuts = cuts.select(F.col("id").alias("cut_id"), F.col("tx").alias("cut_tx"), "cuts")
    start = lambda i: F.coalesce(F.get(F.col("cuts"), i - 1)["e"], F.lit(0))
    stop = lambda i: F.coalesce(F.get(F.col("cuts"), i)["s"], F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.slice(F.col("lines"), start(i) + 1, stop(i) - start(i))))
    removed = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["e"] - c["s"])
    joined = base.join(cuts, F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("tx") == F.col("cut_tx")), "left").withColumn("lines", lines)
    out = joined.select("row", F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("new"), F.struct(F.coalesce(F.when(text.isNotNull(), F.size("lines")), F.lit(0)).alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed")).alias("stats"))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns], F.col("stats").alias("line_dedup"))
