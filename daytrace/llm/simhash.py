"""Near-duplicates by SimHash fingerprints, found with the general pigeonhole principle."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import join_groups
from .common import LOWER, UPPER, cut_lineage, rows_of

BITS = 64
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the XXH64 hashes of all word shingles, repeats included; 0 for a text without words."""
    parts = (text or b"").translate(_FOLD).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *accumulate(len(p) + 1 for p in parts)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s : e - 1], seed) for s, e in zip(starts, starts[words:])]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` for each row, and the columns of longs in ``carry``; fp is the fingerprint as a signed long. A null
    text counts as empty."""

    def task(batches):
        for batch in batches:
            for ids, texts, *more in rows_of(batch, ["id", "text", *carry], 512):
                fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps), *(pa.array(x, pa.int64()) for x in more)], ["doc_id", "fp", *carry])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *carry)
    return chosen.mapInArrow(task, "doc_id long, fp long" + "".join(f", {c} long" for c in carry))


def _bit_matrix(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set: 64 x 64 counts over all of them."""

    def task(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bit_matrix(np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))).astype(np.float32)
            for k in range(0, len(x), 1 << 16):
                total += x[k : k + (1 << 16)].T @ x[k : k + (1 << 16)]
            n += len(x)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "c"])

    got = {r.k: r.c for r in classes.select("fp").mapInArrow(task, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    flat = np.array([got.get(k, 0) for k in range(BITS * BITS + 1)], float)
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def plan_partitions(n: int, together: np.ndarray, distance: int, row_cost: float = 400.0) -> list[tuple[list[int], int]]:
    """Partitions of the bits and the threshold of each: ``[(bits, threshold)]``, without partitions that aren't probed.

    For each number of partitions up to distance + 1, correlated bits are grouped into partitions of like width. The
    candidates of a partition at a threshold are estimated from the share of set bits; dynamic programming then gives
    thresholds that add up to distance - partitions + 1 at the least cost, in pairs to compare plus ``row_cost`` for
    each row to shuffle. A pair within the distance is within the threshold in at least one partition, whatever the
    estimates were.
    """
    n = max(n, 2)
    p = np.clip(np.diag(together) / n, 1e-6, 1 - 1e-6)
    corr = np.abs((together / n - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p))))
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, distance + 2):
        widths = [BITS // m + (k < BITS % m) for k in range(m)]
        left, groups = set(range(BITS)), []
        for w in widths:
            group = [max(left, key=lambda b: (sum(corr[b, x] for x in left if x != b), -b))]
            left.discard(group[0])
            while len(group) < w:
                group.append(max(left, key=lambda b: (corr[b, group].mean(), -b)))
                left.discard(group[-1])
            groups.append(sorted(group))
        costs = []
        for g in groups:
            dist = np.array([1.0])
            for b in g:
                differ = 2 * p[b] * (1 - p[b])
                dist = np.convolve(dist, [1 - differ, differ])
            near = np.cumsum(dist)
            probes = [sum(math.comb(len(g), j) / (1 if j == 0 else 2) for j in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0] + [n * probes[t] * row_cost + n * n / 2 * near[min(t, len(g))] for t in range(distance + 1)])
        want = distance - m + 1 + m  # thresholds start at -1
        table = {0: (0.0, [])}
        for c in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in table.items():
                for t in range(len(c)):
                    if used + t <= want and cost + c[t] < new.get(used + t, (math.inf,))[0]:
                        new[used + t] = (cost + c[t], [*ts, t - 1])
            table = new
        if want in table and table[want][0] < best[0]:
            best = (table[want][0], [(g, t) for g, t in zip(groups, table[want][1]) if t >= 0])
    return best[1]


def _signature_rows(plan: list[tuple[list[int], int]]):
    """Index and probe rows of each fingerprint: its own signature, and those within the threshold.

    Of two signatures that differ, only the one with a 0 at the lowest differing bit probes, so a pair meets once.
    """
    from itertools import combinations

    def task(batches):
        for batch in batches:
            all_fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for start in range(0, len(all_fps), 4096):
                fps = all_fps[start : start + 4096]
                for part, (bits, threshold) in enumerate(plan):
                    sig = np.zeros(len(fps), np.uint64)
                    for k, b in enumerate(bits):
                        sig |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
                    for t in range(threshold + 1):
                        for flips in combinations(range(len(bits)), t):
                            mask = np.uint64(sum(1 << k for k in flips))
                            pick = np.ones(len(fps), bool) if not t else (sig >> np.uint64(flips[0])) & np.uint64(1) == 0
                            if pick.any():
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(pick.sum(), part, np.int32)), pa.array((sig[pick] ^ mask).view(np.int64)), pa.array(fps[pick].view(np.int64)), pa.array(np.full(pick.sum(), t > 0))], ["part", "sig", "fp", "probe"])

    return task


def _links_of(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within the distance do: each to its component's smallest."""
    n = len(fps)
    near = np.empty((n, n), bool)
    for k in range(0, n, 256):
        near[k : k + 256] = np.bitwise_count(fps[k : k + 256, None] ^ fps[None, :]) <= distance
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(linked):
        return fps[:0], fps[:0]
    near, own = near[np.ix_(linked, linked)], fps[linked]
    label = np.arange(len(own))
    while True:
        new = np.where(near, label[None, :], len(own)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = own != own[label]
    return own[apart], own[label][apart]


def _verify(distance: int):
    """Compare the fingerprints of each block pair of a bucket; rows arrive sorted by (part, sig, lo, hi)."""

    def task(batches):
        held: list[np.ndarray] = []

        def groups(last: bool):
            nonlocal held
            data = np.concatenate(held)
            cut = np.flatnonzero((data[1:, :4] != data[:-1, :4]).any(axis=1)) + 1
            bounds = [0, *cut.tolist(), len(data)]
            stop = len(bounds) - 1 if last else len(bounds) - 2
            a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for s, e in zip(bounds[:stop], bounds[1 : stop + 1]):
                if e - s > 1 and not data[s:e, 5].all():
                    x, y = _links_of(np.unique(np.ascontiguousarray(data[s:e, 4]).view(np.uint64)), distance)
                    a.append(x)
                    b.append(y)
            held = [data[bounds[stop] :]]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(6)], axis=1))
            if batch.num_rows:
                yield groups(False)
        if held:
            yield groups(True)

    return task


def near_links(classes: DataFrame, distance: int = 4, block: int = 1024) -> DataFrame:
    """``(a, b)``: links between different fingerprints whose components are those of all pairs within ``distance``.

    Buckets above ``block`` rows are dealt into blocks by a hash of the fingerprint, and each pair of blocks is a group of
    its own, so no task holds more than about two blocks; a group gives at most one link per member, not all pairs.
    """
    n, together = bit_statistics(classes)
    plan = plan_partitions(n, together, distance)
    rows = classes.select("fp").mapInArrow(_signature_rows(plan), "part int, sig long, fp long, probe boolean")
    sizes = rows.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("no_index")).filter("n > 1 and not no_index")
    sized = rows.join(sizes.select("part", "sig", F.ceil(F.col("n") / block).cast("int").alias("k")), ["part", "sig"])
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("part", "sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "probe")
    key = ["part", "sig", "lo", "hi"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify(distance), "a long, b long").distinct()


def rooted(classes: DataFrame, distance: int, block: int) -> DataFrame:
    """``classes``, one row per fingerprint, with the ``root`` of its component."""
    roots = connected_components(near_links(classes, distance, block)).withColumnRenamed("v", "fp")
    return cut_lineage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, block: int = 1024) -> DataFrame:
    """Components of documents whose fingerprints are chained by at most ``distance`` differing bits.

    Equal fingerprints are one class before any search. Classes are searched by the general pigeonhole principle:
    correlated bits share a partition, dynamic programming on estimated candidate counts gives each partition its own
    threshold, signatures within it are probed and every candidate is verified on all 64 bits.

    Returns ``doc_id, fingerprint`` (16 lowercase hex digits) and ``component_id``, the smallest identifier that is
    reachable, itself included; one row per input row. A null or empty text has fingerprint zero, linked like any other;
    very long texts count whole. A null identifier is never a component's smallest unless it is alone, and then the
    component is null. Repeated rows are in one component. An empty table gives no rows. Other columns of ``docs`` are not
    looked at, whatever their names.

    A fingerprint or a component with a third of all rows is met by a broadcast of the few such.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, words))
    classes = rooted(cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"))), distance, block)
    smallest = cut_lineage(classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes")))
    named = cut_lineage(join_groups(classes, smallest, ["root"], "n_classes", classes.count()).select("fp", "component_id", "n_docs"))
    found = join_groups(marked, named, ["fp"], "n_docs", marked.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, block: int = 1024) -> DataFrame:
    """The rows of ``docs``, with its columns, of which one stays for each component of near-duplicates.

    It is the one with the smallest identifier; nulls come last, and of equal identifiers a hash of the whole row decides,
    so that repeated or null identifiers let no second row of a component through. Null and empty texts are one component.
    An empty table gives no rows.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.xxhash64("row").alias("h"), F.xxhash64(F.lit(1), "row").alias("g"))
    narrow = keyed.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), "h", "g")
    marked = cut_lineage(fingerprints(narrow, "id", "text", words, ("h", "g")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")).alias("first")
    classes = rooted(cut_lineage(marked.groupBy("fp").agg(first)), distance, block)
    stays = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.h", "first.g")
    copy = F.row_number().over(Window.partitionBy("h", "g").orderBy("h"))
    return keyed.join(stays, ["h", "g"], "left_semi").withColumn("copy", copy).filter("copy = 1").select("row.*")
