"""Upserts, snapshots and exports between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``delta`` take the place of those of ``target`` with the same keys; missing columns are null."""
    return target.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def restore(target: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``remote`` whose keys ``target`` doesn't have are added."""
    return target.unionByName(remote.join(target.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def unsynced(rows: DataFrame) -> DataFrame:
    """Rows never synced, or changed since."""
    return rows.filter("synced_at is null or updated_at > synced_at")


def record_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def changed_rows(rows: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that the manifest (``id, hash``) doesn't have, or has with another hash."""
    return rows.withColumn("hash", record_hash(columns)).join(manifest.select("id", "hash"), ["id", "hash"], "left_anti").drop("hash")


def merge_snapshots(local: DataFrame, remote: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each id; the remote one only if its ``updated_at`` is strictly newer, or the local one is missing."""
    l, r = local.select("id", F.struct("updated_at", *columns).alias("l")), remote.select("id", F.struct("updated_at", *columns).alias("r"))
    newer = F.col("l").isNull() | (F.col("r.updated_at") > F.col("l.updated_at"))
    best = F.when(F.col("r").isNotNull() & newer, F.col("r")).otherwise(F.col("l"))
    return l.join(r, "id", "full_outer").select("id", best.alias("x"), F.when(F.col("r").isNotNull() & newer, "remote").otherwise("local").alias("origin")).select("id", "x.*", "origin")


def trim_log(log: DataFrame, keys: list[str], order: list[str], most: int = 10_000) -> DataFrame:
    """The newest ``most`` records of each stream."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("rank_in_log", rank).filter(F.col("rank_in_log") <= most).drop("rank_in_log")


def purge_split(rows: DataFrame, policy: DataFrame, as_of: Column, at: str = "occurred_at") -> DataFrame:
    """Each row with ``purge`` set if it is older than its category's days; without days or time, rows stay.

    ``policy``: ``category, days``; a few rows, joined by the optimiser's choice.
    """
    old = F.col(at) < as_of - F.make_dt_interval(F.col("days"))
    return rows.join(policy, "category", "left").withColumn("purge", F.coalesce(old, F.lit(False))).drop("days")


def validate(acts: DataFrame, types: list[str], sources: list[str], longest: int = 86400) -> DataFrame:
    """A2: rows with an array of reasons to reject them, empty for good ones."""
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("type").isin(types), F.lit(False)), "type"), F.when(~F.coalesce(F.col("source").isin(sources), F.lit(False)), "source"),
        F.when(F.col("duration_seconds").isNotNull() & ~F.col("duration_seconds").between(0, longest), "duration"), F.when(F.length("data") > 10240, "context"),
    ))
    return acts.withColumn("reject_reasons", reasons)
