"""Binary token-id shards with a minimal perfect hash index from document keys to offsets."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, default_tokenizer
from .common import new_folder, rows_of

MAGIC = b"DTIX0001"
_ENCODERS: dict[str, LibraryEncoder] = {}


class LibraryEncoder(Codec):
    """A codec that lets the tokenizers library do all the work on what it hasn't met: it normalises and splits pieces,
    merges words and finds special tokens. White space never joins two pieces, so the ids are those of the whole text."""

    def __init__(self, path: str):
        super().__init__(path, merges=False)
        self.model = self.library.model

    def merge(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def apart(self, piece: str) -> bytes:
        if "<|" in piece:
            return array(self.code, self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        return super().apart(piece)


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys, another for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level, keys that are alone at their bit keep it, and the
    others go on to the next. A key's slot is the number of bits set before its own."""

    GAMMA, LEVELS = 2.0, 48

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        total = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(ones)]))
            total += int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            if len(levels) == cls.LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, -(-int(len(left) * cls.GAMMA) // 64) * 64)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that weren't in, any slot for others."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for n, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = _mix(keys[todo], n) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = before[word[hit]] + np.bitwise_count(below[hit])
            todo = todo[~hit]
        return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 101) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: list[int | None], lengths: list[int], code: str) -> bytes:
    """Index of a shard: header, hash levels, then per slot fingerprint, first row and rows, then offsets of all rows.

    Keys are in ascending order, nulls first; rows of an equal key are neighbours and share a slot.
    """
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    distinct, first, rows = np.unique(known, return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slots = mph.slots(distinct)
    table = np.zeros(len(distinct), [("mark", "<u4"), ("row", "<u4"), ("rows", "<u4")])
    table["mark"][slots], table["row"][slots], table["rows"][slots] = _fingerprints(distinct), first + nulls, rows
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    head = json.dumps({"code": code, "nulls": nulls, "keys": len(distinct), "docs": len(keys), "levels": [len(x) for x in mph.levels]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(x.astype("<u8").tobytes() for x in mph.levels), table.tobytes(), offsets.tobytes()])


class Shard:
    """Keyed access to one shard: a constant number of steps and one read for each document."""

    def __init__(self, files: pafs.FileSystem, path: str):
        with files.open_input_file(path + ".idx") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path}.idx isn't a token index")
        n = int.from_bytes(data[8:12], "little")
        self.head, at = json.loads(data[12 : 12 + n]), 12 + n
        levels = []
        for size in self.head["levels"]:
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        self.mph = PerfectHash(levels)
        self.table = np.frombuffer(data, [("mark", "<u4"), ("row", "<u4"), ("rows", "<u4")], self.head["keys"], at)
        self.offsets = np.frombuffer(data, "<u8", self.head["docs"] + 1, at + self.table.nbytes).astype(np.int64)
        self.kind = np.dtype("<u2" if self.head["code"] == "H" else "<u4")
        self.ids = files.open_input_file(path + ".ids")

    def rows(self, keys: list[int | None]) -> list[tuple[int, int] | None]:
        """First row and number of rows of each key, or None where the stored fingerprint tells that it isn't in."""
        out: list[tuple[int, int] | None] = [(0, self.head["nulls"]) if k is None and self.head["nulls"] else None for k in keys]
        known = [i for i, k in enumerate(keys) if k is not None]
        if known and len(self.table):
            wanted = np.array([keys[i] for i in known], np.int64)
            slots = self.mph.slots(wanted)
            got = self.table[np.maximum(slots, 0)]
            right = (slots >= 0) & (got["mark"] == _fingerprints(wanted))
            for i, ok, row, n in zip(known, right.tolist(), got["row"].tolist(), got["rows"].tolist()):
                if ok:
                    out[i] = (row, n)
        return out

    def read(self, rows: list[int], most: int = 1 << 22) -> list[np.ndarray]:
        """Ids of each row. Rows that follow one another in the file are read at once, up to ``most`` ids or one row."""
        out: list[np.ndarray] = []
        k, size = 0, self.kind.itemsize
        while k < len(rows):
            stop = k + 1
            while stop < len(rows) and rows[stop] == rows[stop - 1] + 1 and self.offsets[rows[stop] + 1] - self.offsets[rows[k]] <= most:
                stop += 1
            at = self.offsets[rows[k] : rows[stop - 1] + 2] - self.offsets[rows[k]]
            ids = np.frombuffer(self.ids.read_at(int(at[-1]) * size, int(self.offsets[rows[k]]) * size), self.kind)
            out += [ids[a:b] for a, b in zip(at, at[1:])]
            k = stop
        return out

    def close(self) -> None:
        self.ids.close()


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, docs_per_shard: int = 8192, max_shards: int = 65536) -> DataFrame:
    """Encode whole texts and write them in ascending order of the identifier to raw id files with an index each.

    ``folder`` is a URI that all executors reach (file, hdfs, s3 or gs). One shuffle deals the texts by ranges of the
    identifier; each task streams its range into one file. Files have the task attempt's name, and only those in the
    manifest, which Spark commits last, count, so attempts that were lost or repeated leave nothing that is read.
    Returns the manifest: ``shard, path, min_id, max_id, n_docs, n_tokens``, at most ``max_shards`` rows.

    A null or empty text is the end id alone. Null identifiers come first. Rows with an equal identifier are neighbours,
    in order of their text. An empty table gives an empty manifest. Other columns of ``docs`` are not looked at.
    """
    path = tokenizer or default_tokenizer()
    shards = max(1, min(max_shards, -(-docs.count() // docs_per_shard)))

    def task(batches):
        enc, keys, lengths, out = encoder(path), [], [], None
        files, base = pafs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        name = f"{base}/shard-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        end, width = array(enc.code, [end_id]).tobytes(), array(enc.code).itemsize
        for batch in batches:
            for ids, texts in rows_of(batch, ["id", "text"]):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(name + ".ids")
                for key, text in zip(ids, texts):
                    data = enc.encode_bytes(text or "") + end
                    out.write(data)
                    keys.append(key)
                    lengths.append(len(data) // width)
        if out is None:
            return
        out.close()
        with files.open_output_stream(name + ".idx") as f:
            f.write(index_bytes(keys, lengths, enc.code))
        known = [k for k in keys if k is not None]
        row = [[ctx.partitionId()], [name], known[:1] or [None], known[-1:] or [None], [len(keys)], [sum(lengths)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 4])], ["shard", "path", "min_id", "max_id", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    done = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text").mapInArrow(task, "shard int, path string, min_id long, max_id long, n_docs long, n_tokens long")
    done.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_keys(keys: DataFrame, folder: str, id_col: str = "doc_id", summary=None, fields: str = "ids array<int>") -> DataFrame:
    """Look up each row's key in the shards: ``doc_id, start`` (ids of all documents before it), ``n_tokens`` and ids.

    Keys are dealt to their shards, whose ranges (at most ``max_shards`` rows) are broadcast, in as many partitions as
    there are shards; a task opens one shard at a time. A key that isn't stored but falls in a shard's range is taken for
    another one with a probability of 2**-32, as the index has 32 bits of its fingerprint. The n-th of several rows with an equal key gets the n-th stored document with it. Keys that aren't stored give
    no row. ``summary(ids)`` may give other columns, named in ``fields``, in the ids' place. Null keys find the documents
    with a null identifier. Other columns of ``keys`` are not looked at.
    """
    spark = keys.sparkSession
    shards = sorted((r.shard, r.path, r.min_id, r.max_id, r.n_tokens) for r in spark.read.parquet(f"{folder}/manifest").collect())
    starts = np.concatenate([[0], np.cumsum([s[-1] for s in shards])]).astype(np.int64)
    bounds = np.array([np.iinfo(np.int64).max if s[3] is None else s[3] for s in shards], np.int64)
    if shards and shards[0][3] is None:
        bounds[0] = np.iinfo(np.int64).min
    shared = spark.sparkContext.broadcast((shards, starts, bounds))
    summary = summary or (lambda ids: (ids.tolist(),))
    schema = f"doc_id long, start long, n_tokens long, {fields}"

    def deal(batches):
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(shared.value[2], ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32))], ["doc_id", "shard"])

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(keys_schema)
        shards, starts, _ = shared.value
        files, _ = pafs.FileSystem.from_uri(folder)
        open_at, shard, last, seen = -1, None, object(), 0
        for batch in batches:
            for ids, at in rows_of(batch, ["doc_id", "shard"]):
                out = []
                for k in sorted(set(at)):
                    if k >= len(shards):
                        continue
                    if k != open_at:
                        if shard:
                            shard.close()
                        shard, open_at = Shard(files, shards[k][1]), k
                    mine = [i for i, s in zip(ids, at) if s == k]
                    wanted = []
                    for key, found in zip(mine, shard.rows(mine)):
                        seen = seen + 1 if key == last else 0
                        last = key
                        if found and seen < found[1]:
                            wanted.append((key, found[0] + seen))
                    for (key, row), got in zip(wanted, shard.read([row for _, row in wanted])):
                        out.append((key, int(starts[k] + shard.offsets[row]), len(got), *summary(got)))
                cols = list(zip(*out)) if out else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)
        if shard:
            shard.close()

    from pyspark.sql.types import StructType

    keys_schema = StructType.fromDDL(schema)
    dealt = keys.select(F.col(id_col).cast("long").alias("id")).mapInArrow(deal, "doc_id long, shard int")
    return dealt.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(task, schema)


def checksum(ids: np.ndarray) -> tuple[int]:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def stored_digests(docs: DataFrame) -> DataFrame:
    """Write all documents to shards in the shared folder and read each back by its key: ``doc_id, start, n_tokens,
    ids_crc32``, one row per document.

    A null or empty text is the end id alone; very long texts are whole. Null identifiers come first; documents with an
    equal identifier are told apart by their place, in order of their texts. An empty table gives no rows. Columns other
    than ``doc_id`` and ``text`` are not looked at, whatever their names. The shards stay in the folder.
    """
    folder = new_folder(docs.sparkSession, "token-shards")
    write_shards(docs, folder)
    return read_keys(docs, folder, summary=checksum, fields="ids_crc32 long")
