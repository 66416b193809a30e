"""Byte-pair encoding and decoding with the merge table of a tokenizer file."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

#: Entries that a worker keeps in each of two generations: words, and pieces between white space. Only speed depends on them.
CACHE_WORDS, CACHE_PIECES = 250_000, 120_000
_CODECS: dict[str, Codec] = {}
MARKS = ".,;:!?%&$*#|()"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Cache:
    """A bounded cache in two generations: when the younger is full it becomes the older, whose entries come back as
    they are used, so frequent words stay."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.most:
                self.young, self.old = {}, self.young
            self.young[key] = found
        return found


class Codec:
    """Encoder and decoder for a byte-level BPE file with word ends, lower case and white space dropped.

    How text is normalised and split into words is the file's own: the library reads that part of it.
    """

    def __init__(self, path: str, merges: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.normalise, self.split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        self.code = "H" if max(vocab.values()) < 1 << 16 else "I"
        self.merges = self.merge_table(model) if merges else {}
        self.shown = dict(enumerate(alphabet))
        self.inner = {c: vocab[c] for c in alphabet}
        self.final = {c: vocab[c + end] for c in alphabet}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # of what Python's split takes for white space, what the file drops between two words too
        blank = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.other = [c for c in blank if [w for w, _ in self.split(self.normalise(f"a{c}a"))] != ["a", "a"]]
        self.space = regex.compile("[" + "".join(map(regex.escape, sorted({*blank} - {*self.other}))) + "]+")
        self.words = Cache(lambda word: array(self.code, self.merge(word)).tobytes(), CACHE_WORDS)
        self.chunks = Cache(self.chunk, CACHE_PIECES)

    @staticmethod
    def merge_table(model: dict) -> dict[tuple[int, int], tuple[int, int]]:
        """Pairs of ids to the rank of their merge and the id that it makes."""
        vocab, out = model["vocab"], {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            out[vocab[a], vocab[b]] = (rank, vocab[a + b])
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet. Merge candidates wait in a heap by rank; symbols form a doubly linked
        list; an entry whose symbols have changed since it was pushed is stale and skipped."""
        n = len(word)
        sym = [self.inner[c] for c in word]
        sym[-1] = self.final[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.merges.get
        heap = []
        for i in range(n - 1):
            if hit := find((sym[i], sym[i + 1])):
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := find((joined, sym[k])):
                    heapq.heappush(heap, (hit[0], i, joined, sym[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := find((sym[h], joined))):
                heapq.heappush(heap, (hit[0], h, sym[h], joined, hit[1]))
        return [s for s in sym if s >= 0]

    def chunk(self, piece: str) -> bytes:
        """Ids of a piece of text without white space, as little-endian bytes.

        Latin letters below U+0250 with ASCII marks after them, as most pieces are, are a word and a run of marks: these
        letters are in normal form by themselves and have been letters, with these small forms, in every version of Unicode.
        Other pieces are normalised and split as the file asks, between its special tokens.
        """
        word = self.words.get
        if piece.isascii() and piece.isalpha():
            return word(piece.lower())
        core = piece.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            low = core.lower()
            if low.isalpha():
                low = low if low.isascii() else low.encode().decode("latin-1").translate(self.shown)
                return word(low) + word(piece[len(core) :]) if len(core) < len(piece) else word(low)
        return self.apart(piece)

    def apart(self, piece: str) -> bytes:
        """Ids of a piece that has to be normalised and split as the file asks, between its special tokens."""
        word, out = self.words.get, []
        for part in self.mark.split(piece) if "<|" in piece else [piece]:
            if part in self.special:
                out.append(array(self.code, [self.special[part]]).tobytes())
            elif part:
                out += [word(w) for w, _ in self.split(self.normalise(part))]
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        pieces = self.pieces(text)
        found = list(map(self.chunks.young.get, pieces))
        if None in found:
            get = self.chunks.get
            found = [get(piece) if ids is None else ids for piece, ids in zip(pieces, found)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast(self.code).tolist()

    def pieces(self, text: str) -> list[str]:
        """A text between white space; Python's own split takes some more characters for white space."""
        return list(filter(None, self.space.split(text))) if any(c in text for c in self.other) else text.split()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids with a space between them, as a file without a decoder asks for."""
        return " ".join(map(self.strings.__getitem__, ids))


def codec(path: str) -> Codec:
    """One codec for each file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, one row per input row, without a shuffle.

    White space never joins two words of this kind of tokenizer, so each piece between white space is encoded once for
    each worker and looked up after that; the cache is bounded by ``CACHE_WORDS``. A null or empty text has no ids. The
    strings of special tokens in a text become those tokens. A null identifier stays null. Other columns of ``docs``
    are not looked at. Memory is bounded by the cache and the longest text.
    """
    path = tokenizer or default_tokenizer()

    def task(batches):
        enc = codec(path).encode
        for batch in batches:
            for ids, texts in rows_of(batch, ["id", "text"]):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([enc(t or "") for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``tokens`` with a column ``decoded`` after its own; null ids give a null text. An id out of the vocabulary fails."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("string")
    def text(ids):
        dec = codec(path).decode
        return ids.map(lambda x: None if x is None else dec(x))

    return tokens.withColumn("decoded", text(F.col(ids_col)))


def digests(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the ids, joined by a space, and of the decoded text; if wanted,
    the ids; and the columns of longs in ``carry``.

    Encoding and decoding run in one pass over the texts, so that ids don't cross to the JVM and back, and an executor
    holds one tokenizer for each core. One row per input row; repeated rows give repeated results. A null or empty text
    has no ids and an empty decoded text. A null identifier stays null. Very long texts are encoded whole; memory is
    bounded by the caches and the longest text. An empty table gives no rows. Columns of ``docs`` other than ``doc_id``
    and ``text`` are not looked at, whatever their names.
    """
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + list(carry)

    def task(batches):
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for keys, texts, *more in rows_of(batch, ["id", "text", *carry]):
                rows = []
                for t in texts:
                    got = c.encode(t or "")
                    rows.append((len(got), sha(" ".join(map(str, got))), sha(c.decode(got)), got if with_ids else None))
                n, a, b, ids = zip(*rows)
                cols = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                cols += [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(x, pa.int64()) for x in more]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", {c} long" for c in carry)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", *carry).mapInArrow(task, schema)
