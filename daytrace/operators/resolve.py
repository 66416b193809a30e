"""Activity deduplication, and the similarity of two strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import duration_bucket


def client_id_duplicates(acts: DataFrame) -> DataFrame:
    """Activities whose (user, source, client identifier) an earlier one has: ``id, original_id``."""
    first = F.min("id").over(Window.partitionBy("user_id", "source", "client_generated_id"))
    return acts.filter("client_generated_id is not null").withColumn("original_id", first).filter("id > original_id").select("id", "original_id")


def heuristic_duplicates(acts: DataFrame, window: int = 30) -> DataFrame:
    """For each activity the earlier one (smaller id) it repeats: same user and type within ``window`` seconds, and
    the same domain, else application; of several, one of the same duration bucket first, then the smallest id.

    A range join: times are dealt into buckets of ``window`` seconds, and each row probes its own and the two beside it.
    """
    rows = acts.select("id", "user_id", "type", F.coalesce(F.nullif(F.lower("domain"), F.lit("")), F.nullif(F.lower("app"), F.lit("")), F.lit("")).alias("place"), (F.unix_micros("occurred_at") / 1e6).alias("t"), duration_bucket(F.col("duration_seconds")).alias("bucket"))
    rows = rows.withColumn("slot", F.floor(F.col("t") / window))
    left = rows.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)))
    right = rows.select(F.col("id").alias("other"), "user_id", "type", "place", F.col("t").alias("t2"), F.col("bucket").alias("bucket2"), "slot")
    hits = left.join(right, ["user_id", "type", "place", "slot"]).filter((F.col("other") < F.col("id")) & (F.abs(F.col("t") - F.col("t2")) <= window))
    best = hits.groupBy("id").agg(F.min(F.struct((F.col("bucket") != F.col("bucket2")).alias("unlike"), "other")).alias("x"))
    return best.select("id", F.col("x.other").alias("original_id"), (~F.col("x.unlike")).alias("same_bucket"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; 0 with a null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")
