"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "daytrace", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; other settings, such as the master, come from the submission."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``. Only a local master may leave it unset (tests); then
    it's a new folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="daytrace-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written to a new folder in the shared one and read from there: one job, where a checkpoint takes two."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is, so that the join deals out both sides.

    The count stops at the bound.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``groups``, where one key may have a third of all rows.

    ``groups`` has each key once, and in ``size`` how many of the ``total`` rows have it. Groups above a thousandth of all
    rows are fewer than 1,000 by that, and are broadcast; no key of the join that deals out the rest has more than a
    thousandth. ``how`` is inner or left. Both tables are read twice, so cut their lineage first.
    """
    large = F.broadcast(groups.filter(F.col(size) * 1000 > total))
    small = groups.filter(F.col(size) * 1000 <= total)
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(small, keys, how))
