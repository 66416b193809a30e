"""Streams of activities: ingest without duplicates, windowed counts, running state, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..session import new_folder


def event_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 16) -> DataFrame:
    """Files of events as a stream, with ``occurred_at`` as a time that watermarks take."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("occurred_at", F.col("ts").cast("timestamp"))


def without_duplicates(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within ``delay``; state is dropped after it."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and sum of ``value`` by tumbling window and keys."""
    window = F.window("occurred_at", width)
    return stream.withWatermark("occurred_at", delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def running_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """I4: projection of the number of rows by key."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


STATE = StructType([StructField("version", LongType()), StructField("total", LongType()), StructField("active", LongType())])
SUMMARY = StructType([StructField("user_id", LongType()), StructField("version", LongType()), StructField("total_seconds", LongType()), StructField("active", LongType())])


class UserAggregate(StatefulProcessor):
    """State of a user from its events: version, seconds in all, and rows that are active; an "error" event takes one
    active row back, never below 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aggregate", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        version, total, active = self.state.get() if self.state.exists() else (0, 0, 0)
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            version, total = version + 1, total + int(row.value * 60)
            active = max(0, active - 1) if row.event_type == "error" else active + 1
        self.state.update((version, total, active))
        yield pd.DataFrame({"user_id": [key[0]], "version": [version], "total_seconds": [total], "active": [active]})

    def close(self) -> None:
        pass


def user_state(stream: DataFrame) -> DataFrame:
    """An updated row for each user with new events. Needs the RocksDB state store; a batch's rows of one user are
    put in order in memory."""
    return stream.groupBy("user_id").transformWithStateInPandas(UserAggregate(), outputStructType=SUMMARY, outputMode="update", timeMode="none")


def replay_state(events: DataFrame, block: int = 4096) -> DataFrame:
    """I3 as a batch: the same state from sums. The active rows with their floor at 0 are the running sum less its lowest value
    below 0, found for blocks of a user's events and then over the blocks, so no user's history is in one row; numbering the events is one sort by user."""
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    rows = events.select("user_id", "ts", "event_id", (F.col("value") * 60).cast("long").alias("s"), step.alias("d"))
    rows = rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / block))
    running = F.sum("d").over(Window.partitionBy("user_id", "block").orderBy("ts", "event_id"))
    blocks = rows.withColumn("p", running).groupBy("user_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("d").alias("d"), F.min("p").alias("low"))
    before = F.coalesce(F.sum("d").over(Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("low", before + F.col("low")).groupBy("user_id").agg(F.sum("n").alias("version"), F.sum("s").alias("total_seconds"), (F.sum("d") - F.least(F.lit(0), F.min("low"))).alias("active"))


def late_rows(events: DataFrame, delay_seconds: int = 3600) -> DataFrame:
    """Rows that were received more than ``delay_seconds`` after they occurred."""
    return events.withColumn("lateness", F.unix_timestamp("received_at") - F.unix_timestamp("occurred_at")).filter(F.col("lateness") > delay_seconds)


def fan_out(stream: DataFrame, sinks: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each type of event to its own folder, in one pass over the batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, folder in sinks.items():
            batch.filter(F.col("event_type") == kind).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return write


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over what there is now and return what it gave: appended rows, or the last complete result.

    Output and progress go to new folders in the shared one.
    """
    spark = stream.sparkSession
    out, progress = new_folder(spark, name), new_folder(spark, f"{name}-progress")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:06d}" if mode != "complete" else f"{out}/{number % 2:06d}")
        last[0] = number

    last = [-1]
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/{last[0] % 2:06d}" if mode == "complete" else f"{out}/*")
