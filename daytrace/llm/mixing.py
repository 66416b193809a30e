"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import ceil, lcm, log2

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots that one task schedules by itself, if no source has fewer than one block in so many.
CHUNK = 8192


def quotas(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole numbers of blocks in a period, at least 1 each, nearest to the weights, that add up to the period."""
    period, total = max(period, len(weights)), sum(weights.values())
    exact = {s: (period - len(weights)) * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def pfair(quota: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period.

    Block j of a source with quota p of q slots is released at floor((j - 1) q / p) and due by ceil(j q / p); each
    slot takes, of the released blocks, the one that is due first. Every prefix of the schedule, and of its repetition,
    has less than one block more or less of each source than the weights ask for.
    """
    q = sum(quota.values())
    waiting = [(0, s, 1) for s in sorted(quota)]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    out = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * q // quota[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j < quota[s]:
            heapq.heappush(waiting, (j * q // quota[s], s, j + 1))
    return out


def whole(weights: Mapping[str, float]) -> dict[str, int]:
    """The same weights, exactly, as whole numbers."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def border(weights: Mapping[str, int], slot: int) -> dict[str, int]:
    """Blocks of each source before a slot, such that the slots before and after can be scheduled apart from each other.

    A source with share w has floor(slot w) or one more. Let x be the fractions of slot w. Those that have one more are
    chosen so that, for every k, of the k sources with the latest deadlines at most ceil(sum of x) are among them, and of
    the k sources with the earliest releases at least floor(sum of x). The first keeps all deadlines after the slot, the
    second all releases before it. With the sums of x cut into cells of 1 in both orders, each cell gets one source that
    reaches into it; as the fractions themselves fill the cells, a matching exists.
    """
    total = sum(weights.values())
    out = {s: slot * w // total for s, w in weights.items()}
    part = {s: x for s, w in sorted(weights.items()) if (x := slot * w % total)}

    def cells(order: list[str]) -> dict[str, set[int]]:
        at, found = 0, {}
        for s in order:
            found[s] = {at // total, (at + part[s] - 1) // total}
            at += part[s]
        return found

    due = cells(sorted(part, key=lambda s: (-((out[s] + 1) * total // -weights[s]), s), reverse=True))
    free = cells(sorted(part, key=lambda s: (out[s] * total // weights[s], s)))
    reach: dict[int, list[str]] = {}
    for s, found in due.items():
        for c in sorted(found):
            reach.setdefault(c, []).append(s)
    # left: cells by deadline and the sources' outer ends; right: the sources' inner ends and cells by release
    left_of: dict[object, object] = {s: s for s in part}
    for c in sorted(reach):
        came: dict[object, object] = {}
        queue: list[object] = [c]
        for node in queue:
            for right in reach[node] if isinstance(node, int) else [node, *(("cell", d) for d in sorted(free[node]))]:
                if right not in came:
                    came[right] = node
                    if right in left_of:
                        queue.append(left_of[right])
                        continue
                    back = {v: k for k, v in left_of.items()}
                    while right is not None:
                        node = came[right]
                        left_of[right], right = node, back.get(node)
                    break
            else:
                continue
            break
    for s in part:
        out[s] += left_of[s] != s
    return out


def deal(weights: Mapping[str, int], slot: int, used: Mapping[str, int], goal: Mapping[str, int], stop: int | None) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) from a border on, earliest deadline first: to the border ``stop``, where the sources have
    ``goal`` blocks, or, without one, until a source has its ``goal``."""
    total = sum(weights.values())
    waiting = [(used[s] * total // weights[s], s, used[s] + 1) for s in weights if used[s] < goal[s]]
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    while stop is None or slot < stop:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = -(-j * total // weights[s])
            heapq.heappush(ready, (due if stop is None else min(due, stop), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j - 1, slot
        slot += 1
        if j < goal[s]:
            heapq.heappush(waiting, (j * total // weights[s], s, j + 1))
        elif stop is None:
            return


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int | None = None) -> list[dict]:
    """Stretches of the schedule with the same sources; a source leaves when its blocks are used up.

    Each phase has its first slot, the blocks of each source before it, whole weights, the length of its chunks and the
    start of the last one, which goes on until a source is used up. Only that chunk is dealt here. No block may be open
    at two borders, so chunks are longer than the time between two blocks of the smallest weight. Sources of weight 0 come
    when no others are left.
    """
    left, used, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while left := {s: n for s, n in left.items() if n > 0}:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, 1)
        exact = whole(quotas(live, period) if period else live)
        total = sum(exact.values())
        chunk = max(CHUNK, total // min(exact.values()) + 3)
        chunk = -(-chunk // total) * total if period else chunk
        start = min((left[s] - 1) * total // w for s, w in exact.items()) // chunk * chunk
        taken, end = border(exact, start), start
        for s, j, end in deal(exact, start, taken, left, None):
            taken[s] = j + 1
        out.append({"slot": slot, "used": {s: used[s] for s in exact}, "goal": {s: left[s] for s in exact}, "weights": exact, "chunk": chunk, "last": start})
        for s, n in taken.items():
            used[s] += n
            left[s] -= n
        slot += end + 1
    return out


def chunk_rows(phase: Mapping, start: int) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot) of the whole schedule in the chunk of a phase that starts there."""
    w, stop = phase["weights"], None if start == phase["last"] else start + phase["chunk"]
    goal = phase["goal"] if stop is None else border(w, stop)
    return ((s, phase["used"][s] + j, phase["slot"] + at) for s, j, at in deal(w, start, border(w, start), goal, stop))


def schedule(spark, plan: list[dict]) -> DataFrame:
    """``mix_source, mix_block, mix_slot`` of every block; each chunk is dealt in a task by itself."""
    firsts = [0]
    for p in plan:
        firsts.append(firsts[-1] + p["last"] // p["chunk"] + 1)

    def task(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                k = bisect_right(firsts, c) - 1
                rows = chunk_rows(plan[k], (c - firsts[k]) * plan[k]["chunk"])
                while part := list(islice(rows, 1 << 14)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), [pa.string(), pa.int64(), pa.int64()])], ["mix_source", "mix_block", "mix_slot"])

    return spark.range(0, firsts[-1], 1, max(1, min(firsts[-1], 1000))).mapInArrow(task, "mix_source string, mix_block long, mix_slot long")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, period: int | None = None, seed: str = "mix", temper: float = 0.5, max_sources: int = 1000) -> DataFrame:
    """Deal the documents of each source into blocks and give each block a slot: ``mix_source, mix_block, mix_slot,
    mix_order`` after the columns of ``docs`` (in a struct ``row``), one row per input row.

    Within a source, documents are in the order of a seeded hash of the identifier; ``block_docs`` of them are a block.
    ``weights`` by source are the target; a source without one has weight 0.001 times the smallest. By default a
    source's weight is its number of documents to the power ``temper``. Until the first source is used up, each prefix
    of the schedule has less than one block more or less of each source than its exact weight asks for; then the others
    go on among themselves, so no row is lost. With ``period``, weights are first rounded to whole slots of so many, at
    least one per source. ``mix_order`` sorts the rows as scheduled.

    The number of a document within its source comes from counts by (source, hash range), so that a source with a third
    of all rows is spread over many tasks. The schedule is dealt in chunks, each in a task by itself, and reaches the rows
    as one list of slots per hash range. The driver sees counts by source, and deals the last chunk of each phase; above ``max_sources`` different sources
    are an error, as the target weights are set by hand or by count for a bounded list. Null sources are one source,
    "(none)". Equal identifiers are ordered by the rest of their row's hash; wholly repeated rows are interchangeable. An
    empty table gives no rows. ``docs`` may have any column names.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    source = F.coalesce(F.col("row")[source_col].cast("string"), F.lit("(none)"))
    keyed = packed.select("row", source.alias("mix_source"), F.xxhash64(F.lit(seed), F.col("row")[id_col]).alias("h"), F.xxhash64("row").alias("tie"))
    counts = {r.mix_source: r.n for r in keyed.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    bits = min(30, max(4, ceil(log2(max(counts.values(), default=1)) / 2) + 2))
    ranged = keyed.withColumn("b", F.shiftright("h", 64 - bits))
    sizes = ranged.groupBy("mix_source", "b").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("mix_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("mix_source", "b", "n", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("mix_source", "b").orderBy("h", "tie")) - 1
    numbered = ranged.withColumn("in_range", number)

    if weights and min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    smallest = min((w for w in weights.values() if w > 0), default=0) * 0.001 if weights else 0
    target = {s: (weights.get(s, smallest) if weights else n**temper) for s, n in counts.items()}
    plan = schedule(spark, phases({s: -(-n // block_docs) for s, n in counts.items()}, target, period))
    touched = sizes.withColumn("mix_block", F.explode(F.sequence(F.floor(F.col("before") / block_docs), F.floor((F.col("before") + F.col("n") - 1) / block_docs))))
    slots = touched.join(plan, ["mix_source", "mix_block"]).groupBy("mix_source", "b").agg(F.min("before").alias("before"), F.sort_array(F.collect_list("mix_slot")).alias("slots"))
    scheduled = numbered.join(slots, ["mix_source", "b"]).withColumn("n", F.col("before") + F.col("in_range")).withColumn("mix_block", F.floor(F.col("n") / block_docs).cast("long"))
    # a source's slots rise with its blocks
    slot = F.get("slots", (F.col("mix_block") - F.floor(F.col("before") / block_docs)).cast("int"))
    return scheduled.select("row", "mix_source", "mix_block", slot.alias("mix_slot"), (slot * block_docs + F.col("n") % block_docs).cast("long").alias("mix_order"))
