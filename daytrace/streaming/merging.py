"""Edges kept up to date by micro-batches of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import by_pair, sized_pairs

EDGE = "a long, b long, strength double, n long, first_seen long, last_seen long"


def level(relevance: Column) -> Column:
    """Strength of a pair by its mean relevance; a missing relevance counts as 1."""
    return F.when(relevance > 0.9, 0.9).when(relevance > 0.8, 0.7).otherwise(0.5)


def batch_edges(links: DataFrame) -> DataFrame:
    """``a, b, fresh, n, first_s, first_seen, last_seen``: what the activities of a batch, in order, do to each pair.

    Each activity replaces a strength by the mean of it and its own level, so the k-th last of n levels counts 2^-k and what
    was before 2^-n: a sum, with no list of activities in one row. ``fresh`` is that sum, ``first_s`` the first level.
    """
    one = links.groupBy("activity_id", "entity_id").agg(F.max(F.coalesce("relevance_score", F.lit(1.0))).alias("r"))
    met, parts = sized_pairs(one.select(F.col("activity_id").alias("u"), F.col("entity_id").alias("i"), "r"), carried=("r",))
    rows = met.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("u").alias("activity_id"), level((F.col("r_src") + F.col("r_dst")) / 2).alias("s"))
    rows = by_pair(rows, parts, "a", "b")
    back = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("activity_id")))
    return rows.withColumn("k", back).groupBy("a", "b").agg(
        F.sum(F.col("s") * F.pow(F.lit(0.5), F.col("k"))).alias("fresh"), F.count(F.lit(1)).alias("n"), F.min_by("s", "activity_id").alias("first_s"),
        F.min("activity_id").alias("first_seen"), F.max("activity_id").alias("last_seen"),
    )


def merged_edges(old: DataFrame, links: DataFrame) -> DataFrame:
    """The stored edges ``old`` after a batch of links whose activities are later than all before."""
    new = batch_edges(links).withColumnsRenamed({"n": "m", "first_seen": "since", "last_seen": "until"})
    x = old.join(new, ["a", "b"], "full_outer")
    faded = F.pow(F.lit(0.5), F.col("m"))
    # a new pair starts with its first level instead of the mean of nothing and it
    strength = F.when(F.col("m").isNull(), F.col("strength")).otherwise(F.col("fresh") + F.coalesce("strength", "first_s") * faded)
    return x.select("a", "b", strength.alias("strength"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("first_seen", "since").alias("first_seen"), F.coalesce("until", "last_seen").alias("last_seen"))


def edges_at(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The edges after batch ``number``; before the first batch there are none."""
    try:
        return spark.read.schema(EDGE).parquet(f"{folder}/after={number}")
    except AnalysisException:
        if number >= 0:
            raise
        return spark.createDataFrame([], EDGE)


def merge_into(folder: str) -> Callable[[DataFrame, int], None]:
    """I8: a ``foreachBatch`` function that merges a batch of links (``activity_id, entity_id, relevance_score``) into the
    edges stored in ``folder``.

    Each batch writes a version of its own, from the version of the batch before: a batch that is run again after a failure
    starts from the same edges and overwrites its own version, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        merged_edges(edges_at(batch.sparkSession, folder, number - 1), batch).write.mode("overwrite").parquet(f"{folder}/after={number}")

    return write


def streamed_edges(links: DataFrame, folder: str, progress: str) -> DataFrame:
    """Run a stream of links over what there is now, and return the edges; ``progress`` lets a later run go on."""
    last = [-1]
    merge = merge_into(folder)

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, number)
        last[0] = number

    links.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return edges_at(links.sparkSession, folder, last[0])
