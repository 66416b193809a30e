"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_groups
from .common import ascii_lower, cut_lineage

#: SHA-256, byte length and a second hash of a text, in big-endian order, so that they sort as bytes.
KEY = np.dtype("S48")
_RUN = "prefix long, node long, keys binary, ids binary, known binary, counts binary"
_NAMES = ["prefix", "node", "keys", "ids", "known", "counts"]
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def combined(run: Run, keep: str) -> Run:
    """A sorted run with one row per key: the smallest or largest known identifier, and the sum of counts."""
    keys, ids, known, counts = run
    if not len(keys):
        return run
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    info = np.iinfo(np.int64)
    pick, none = (np.maximum, info.min) if keep == "max" else (np.minimum, info.max)
    return keys[start], pick.reduceat(np.where(known, ids, none), start), np.logical_or.reduceat(known, start), np.add.reduceat(counts, start)


def merged(runs: list[Run], keep: str) -> Run:
    """Multiway merge of sorted runs, two neighbours at a time; equal keys are combined at every step."""
    while len(runs) > 1:
        out = []
        for a, b in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a[0], b[0], "right") + np.arange(len(b[0]))
            own = np.ones(len(a[0]) + len(b[0]), bool)
            own[at] = False
            both = []
            for x, y in zip(a, b):
                z = np.empty(len(own), x.dtype)
                z[own], z[at] = x, y
                both.append(z)
            out.append(combined(tuple(both), keep))
        runs = out + runs[len(runs) & ~1 :]
    return runs[0]


def pieces(run: Run, prefix: int, node: int, bits: int, round_: int):
    """The row of each part of a run that goes to another group: the next ``bits`` of the digest tell which."""
    first = np.frombuffer(np.ascontiguousarray(run[0]).tobytes(), np.uint8).reshape(-1, KEY.itemsize)[:, :8].copy().view(">u8").ravel()
    part = (first << np.uint64(round_ * bits) >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield [prefix << bits | k, node >> bits, *(np.ascontiguousarray(x[a:b]).tobytes() for x in run)]


def _batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 4)], _NAMES)


def _leaf(keep: str, bits: int, rounds: int, most: int):
    """Sorted rows of a partition to runs of at most about ``most`` keys, each at a node of the tree by its number."""

    def task(batches):
        partition, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def run():
            nonlocal number, held, size
            got = merged(held, keep)
            node = (partition + number * 40503) % (1 << bits * rounds)
            number, held, size = number + 1, [], 0
            return _batch(list(pieces(got, 0, node, bits, 0)) if rounds else [[0, 0, *(x.tobytes() for x in got)]])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), KEY)
            ids = batch.column(1)
            held.append(combined((keys, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), np.ones(len(keys), np.int64)), keep))
            size += len(keys)
            if size >= most:
                yield run()
        if held:
            yield run()

    return task


def _run_of(row: list[bytes]) -> Run:
    return tuple(np.frombuffer(x, t) for x, t in zip(row, [KEY, np.int64, np.bool_, np.int64]))


def _merge(keep: str, bits: int, round_: int, last: bool):
    """Merge the runs of each group, and send the parts of the result to the groups of the next round."""

    def task(batches):
        group, held = None, []

        def flush():
            got = merged(held, keep)
            return _batch([[*group, *(x.tobytes() for x in got)]] if last else list(pieces(got, *group, bits, round_)))

        for batch in batches:
            for i in range(batch.num_rows):
                prefix, node, *row = (batch.column(c)[i].as_py() for c in range(6))
                if (prefix, node) != group:
                    if held:
                        yield flush()
                    group, held = (prefix, node), []
                held.append(_run_of(row))
        if held:
            yield flush()

    return task


def _rows(batches):
    """The keys of merged runs that more than one row has, as rows."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(2, 6))):
            keys, ids, known, counts = _run_of(row)
            for k in range(0, len(keys), 1 << 16):
                at = k + np.flatnonzero(counts[k : k + (1 << 16)] > 1)
                raw = [bytes(x).ljust(KEY.itemsize, b"\0") for x in keys[at].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(ids[at], pa.int64(), mask=~known[at]), pa.array(counts[at])], ["key", "best", "group_size"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8, run_rows: int = 1 << 18) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; one row per input row.

    Every input partition sorts its keys into runs. In each round ``fan_in`` (a power of two) neighbouring nodes of a tree
    exchange their runs as in a binomial exchange: a run is cut by the next bits of the digest, each node gets one range
    of the ``fan_in`` nodes' runs, merges them and keeps one identifier and a count per key. A group of runs so stays about
    as large as one run, however large the table; after the last round each range of digests is one run. Fan-in 8 takes a
    third of the rounds, and of the shuffles, of fan-in 2. Texts count as equal, at every level, only if SHA-256, byte
    length and a second 64-bit hash all agree.

    A text with any number of copies is one row per run, so a hot group never meets in one task; in the join back to the
    documents, groups above a thousandth of all rows are broadcast.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. ``keep``: "min" or "max" identifier stays. A null text
    counts as empty; very long texts are hashed whole in the JVM. A null identifier never wins over another; a group of
    null identifiers alone has a null ``keep_id``. Rows repeated with the same identifier and text are all marked as kept.
    An empty table gives no rows. Other columns of ``docs`` are not looked at, whatever their names.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    digest = F.unhex(F.sha2("norm", 256))
    key = F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length("norm").cast("long")), 16, "0")), F.unhex(F.lpad(F.hex(F.xxhash64("norm")), 16, "0")))
    hashed = cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm")).select("id", key.alias("key")))
    total, bits = hashed.count(), fan_in.bit_length() - 1
    runs, rounds = max(hashed.rdd.getNumPartitions(), total // run_rows), 0
    while 1 << bits * rounds < runs:
        rounds += 1
    level = hashed.select("key", "id").sortWithinPartitions("key").mapInArrow(_leaf(keep, bits, rounds, run_rows), _RUN)
    for k in range(1, rounds + 1):
        level = level.repartition("prefix", "node").sortWithinPartitions("prefix", "node").mapInArrow(_merge(keep, bits, k, k == rounds), _RUN)
    groups = cut_lineage(level.mapInArrow(_rows, "key binary, best long, group_size long"))
    one = F.col("group_size").isNull()
    found = join_groups(hashed, groups, ["key"], "group_size", total, "left").withColumn("keep_id", F.when(one, F.col("id")).otherwise(F.col("best")))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.when(one, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))
