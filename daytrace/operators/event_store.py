"""An event store as tables: versions, snapshots, state after replay, projections.

Events are ``event_id, aggregate_id, event_type, data`` in the order of ``ts`` and ``event_id``; the store adds ``version``, 1, 2,
3... in each aggregate. ``data`` is JSON. Kinds of events: activity_recorded (id, duration, timestamp), activity_tagged
(tag), activity_deleted (activity_id), setting_changed (key, value), settings_reset (defaults).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVERY = 10  # fixed value: a snapshot after so many events of an aggregate
STATE = ["version", "total_duration", "last_activity_time", "tags"]


def _text(path: str) -> Column:
    return F.get_json_object("data", path)


def appended(heads: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their versions, after those of ``heads(aggregate_id, version)``, and the events refused.

    Where ``expected_version`` of an aggregate's first new event isn't null and isn't the version in the store, somebody
    wrote in between: all of the aggregate's new events are refused, with both versions.
    """
    order = Window.partitionBy("aggregate_id").orderBy("ts", "event_id")
    x = events.withColumns({"k": F.row_number().over(order), "expects": F.first("expected_version").over(order)})
    x = x.join(heads.withColumnRenamed("version", "head"), "aggregate_id", "left").withColumn("head", F.coalesce("head", F.lit(0)).cast("long"))
    fits = F.coalesce(F.col("expects") == F.col("head"), F.lit(True))
    columns = ["event_id", "aggregate_id", "event_type", "data", "ts"]
    return x.filter(fits).select(*columns, (F.col("head") + F.col("k")).alias("version")), x.filter(~fits).select(*columns, F.col("expects").cast("long").alias("expected_version"), F.col("head").alias("version"))


def heads(store: DataFrame) -> DataFrame:
    return store.groupBy("aggregate_id").agg(F.max("version").alias("version"))


def activity_state(events: DataFrame, snapshot: DataFrame | None = None, living: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The state of each aggregate of activities after ``events``, from ``snapshot`` on, and its living activities.

    State: ``aggregate_id, version, total_duration`` (deletions don't lower it)``, last_activity_time, tags`` (once each, in the
    order in which they came) ``, activity_count``. ``living(aggregate_id, activity_id, n)`` has what was recorded and not
    deleted after, one row an identifier. Events up to the snapshot's version are left out, so replay starts there. Sums,
    a maximum by version, and first versions of tags: no aggregate's history is in one row.
    """
    if snapshot is not None:
        since = snapshot.select("aggregate_id", F.col("version").alias("since"))
        events = events.join(since, "aggregate_id", "left").filter(F.col("version") > F.coalesce("since", F.lit(0))).drop("since")
    kind = F.col("event_type")
    recorded, deleted = kind == "activity_recorded", kind == "activity_deleted"
    sums = events.groupBy("aggregate_id").agg(
        F.max("version").alias("version"), F.sum(F.when(recorded, F.coalesce(_text("$.duration").cast("double"), F.lit(0.0))).otherwise(0.0)).alias("total_duration"),
        F.max(F.when(recorded, F.struct("version", _text("$.timestamp").alias("t"))))["t"].alias("last_activity_time"),
    )
    tags = events.filter((kind == "activity_tagged") & (_text("$.tag") != "")).groupBy("aggregate_id", _text("$.tag").alias("tag")).agg(F.min("version").alias("v"))
    ids = events.filter(recorded | deleted).select("aggregate_id", "version", F.coalesce(F.when(recorded, _text("$.id")), _text("$.activity_id")).alias("activity_id"), deleted.alias("gone"))
    cut = ids.filter("gone").groupBy("aggregate_id", "activity_id").agg(F.max("version").alias("cut"))
    fresh = ids.filter("not gone").join(cut, ["aggregate_id", "activity_id"], "left").filter(F.col("version") > F.coalesce("cut", F.lit(0))).groupBy("aggregate_id", "activity_id").agg(F.count(F.lit(1)).alias("n"))
    if snapshot is not None:
        old = snapshot.select("aggregate_id", *[F.col(c).alias("old_" + c) for c in STATE])
        x = old.join(sums, "aggregate_id", "full_outer")
        sums = x.select("aggregate_id", F.coalesce("version", "old_version").alias("version"), (F.coalesce("old_total_duration", F.lit(0.0)) + F.coalesce("total_duration", F.lit(0.0))).alias("total_duration"), F.coalesce("last_activity_time", "old_last_activity_time").alias("last_activity_time"))
        # tags of the snapshot come before all later ones, in their order
        before = snapshot.select("aggregate_id", F.posexplode("tags").alias("p", "tag"))
        tags = tags.union(before.select("aggregate_id", "tag", (F.col("p") - 1_000_000_000).cast("long"))).groupBy("aggregate_id", "tag").agg(F.min("v").alias("v"))
        kept = living.join(cut.select("aggregate_id", "activity_id"), ["aggregate_id", "activity_id"], "left_anti")
        fresh = fresh.union(kept.select(fresh.columns)).groupBy("aggregate_id", "activity_id").agg(F.sum("n").alias("n"))
    listed = tags.groupBy("aggregate_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "tag"))), lambda t: t["tag"]).alias("tags"))
    counts = fresh.groupBy("aggregate_id").agg(F.sum("n").alias("activity_count"))
    state = sums.join(listed, "aggregate_id", "left").join(counts, "aggregate_id", "left")
    return state.select("aggregate_id", "version", "total_duration", "last_activity_time", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("activity_count", F.lit(0)).cast("long").alias("activity_count")), fresh


def up_to_snapshot(store: DataFrame, every: int = EVERY) -> DataFrame:
    """The events that the last snapshot of each aggregate covers: those up to the last full ``every``."""
    last = store.groupBy("aggregate_id").agg((F.floor(F.max("version") / every) * every).alias("upto"))
    return store.join(last, "aggregate_id").filter(F.col("version") <= F.col("upto")).drop("upto")


def setting_history(store: DataFrame) -> DataFrame:
    """Each change of a setting with its old value: ``aggregate_id, version, key, old, new``; a reset is a row with the key null.

    Resets divide an aggregate's versions; after one, a setting's old value is what the reset gave it, if it did.
    """
    by = Window.partitionBy("aggregate_id").orderBy("version")
    x = store.filter(F.col("event_type").isin("setting_changed", "settings_reset"))
    reset = F.col("event_type") == "settings_reset"
    x = x.withColumn("epoch", F.sum(reset.cast("int")).over(by)).withColumn("given", F.when(reset, F.from_json(_text("$.defaults"), "map<string,string>")))
    resets = x.filter(reset).select("aggregate_id", "epoch", F.explode("given").alias("key", "given"))
    changes = x.filter(~reset).select("aggregate_id", "version", "epoch", _text("$.key").alias("key"), _text("$.value").alias("new"))
    before = F.lag("new").over(Window.partitionBy("aggregate_id", "epoch", "key").orderBy("version"))
    first = F.row_number().over(Window.partitionBy("aggregate_id", "epoch", "key").orderBy("version")) == 1
    changes = changes.withColumns({"before": before, "first": first}).join(resets, ["aggregate_id", "epoch", "key"], "left")
    out = changes.select("aggregate_id", "version", "key", F.when(F.col("first"), F.col("given")).otherwise(F.col("before")).alias("old"), "new")
    return out.union(x.filter(reset).select("aggregate_id", "version", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def settings(store: DataFrame) -> DataFrame:
    """``aggregate_id, key, value`` now: the last change since the last reset, else what the reset gave."""
    x = store.filter(F.col("event_type").isin("setting_changed", "settings_reset"))
    reset = F.col("event_type") == "settings_reset"
    given = x.filter(reset).groupBy("aggregate_id").agg(F.max("version").alias("cut"), F.max_by(_text("$.defaults"), "version").alias("defaults"))
    defaults = given.select("aggregate_id", F.explode(F.from_json("defaults", "map<string,string>")).alias("key", "value"), F.col("cut").alias("version"))
    changed = x.filter(~reset).join(given.select("aggregate_id", "cut"), "aggregate_id", "left").filter(F.col("version") > F.coalesce("cut", F.lit(0))).select("aggregate_id", _text("$.key").alias("key"), _text("$.value").alias("value"), "version")
    return changed.union(defaults).groupBy("aggregate_id", "key").agg(F.max_by("value", "version").alias("value"))


def activity_counts(store: DataFrame, block: int = 4096) -> DataFrame:
    """I4: ``aggregate_id, n``: recorded less deleted activities, never below 0 on the way.

    The running sum with that floor ends at the sum less the lowest running sum below 0. Both are found for blocks of
    versions first and then over the blocks, so that an aggregate with very many events is spread over tasks.
    """
    step = F.when(F.col("event_type") == "activity_recorded", 1).when(F.col("event_type") == "activity_deleted", -1)
    x = store.select("aggregate_id", "version", step.alias("d")).filter("d is not null").withColumn("block", F.floor(F.col("version") / block))
    running = F.sum("d").over(Window.partitionBy("aggregate_id", "block").orderBy("version"))
    blocks = x.withColumn("p", running).groupBy("aggregate_id", "block").agg(F.sum("d").alias("s"), F.min("p").alias("low"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("aggregate_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("low", before + F.col("low")).groupBy("aggregate_id").agg((F.sum("s") - F.least(F.lit(0), F.min("low"))).alias("n"))
