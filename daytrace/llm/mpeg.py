"""MPEG audio in a media column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

# Fixed values of the MPEG audio header: kbit/s by (MPEG-1 or not, layer), and sample rates of MPEG-1.
KBITS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]

#: Payload bytes of a stored frame, and the frame: MPEG-1 layer III, 48 kHz, 80 kbit/s, mono, with a checksum.
BLOCK, FRAME, HEAD = 192, 240, b"\xff\xfa\x64\xc0"
SIDE = bytes(17)


@lru_cache(1 << 16)
def crc16(data: bytes) -> int:
    """CRC-16 of an audio frame: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


@lru_cache(1 << 12)
def header(four: bytes) -> dict | None:
    """Fields of a frame header, or None if it isn't one. A free-format frame has length 0: its header doesn't tell."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bitrate == 15 or rate == 3:
        return None
    kbits = KBITS[1 if version == 1 else 2, layer][bitrate]
    hertz = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    pad = four[2] >> 1 & 1
    length = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    length = length if kbits else 0
    mode, extension = four[3] >> 6, four[3] >> 4 & 3
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbits": kbits, "hertz": hertz, "samples": samples, "length": length, "mono": mono, "crc": not four[1] & 1, "side": side, "pad": pad * (4 if layer == 1 else 1), "joint": 4 * extension + 4 if mode == 1 else 32}


def crc_bits(data: bytes, bits: int) -> int:
    """CRC-16 as ``crc16``, over the first ``bits`` bits."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        top = crc >> 15 ^ (data[k // 8] >> 7 - k % 8 & 1)
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


def allocation_widths(h: dict) -> list[int]:
    """Bits of the allocation of each subband in layer II: fixed values of the standard, by rate and bitrate a channel."""
    if h["version"] != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h["kbits"] // (1 if h["mono"] else 2)
    if 0 < each < 56:
        return [4] * 2 + [3] * (10 if h["hertz"] == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if h["hertz"] != 48000 and (each == 0 or each >= 96) else 4)


def protected_bits(body: bytes, h: dict) -> int | None:
    """Bits after the checksum that it covers: the side information of layer III, the allocation of layers I and II, and in
    layer II the choice of scale factors. None if the frame is too short for them."""
    if h["layer"] == 3:
        return 8 * h["side"]
    channels = 1 if h["mono"] else 2
    widths = [4] * 32 if h["layer"] == 1 else allocation_widths(h)
    own = [channels if k < h["joint"] else 1 for k in range(len(widths))]
    if h["layer"] == 1:
        return 4 * sum(own)
    if sum(w * c for w, c in zip(widths, own)) > 8 * len(body):
        return None
    value, size, at, scale = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for w, c in zip(widths, own):
        for _ in range(c):
            used = value >> size - at - w & (1 << w) - 1
            at, scale = at + w, scale + (2 * channels // c if used else 0)
    return at + scale


def sound(frame: bytes, h: dict) -> bool:
    """Whether a frame's checksum, if it has one, is right."""
    if not h["crc"]:
        return True
    bits = protected_bits(frame[6:], h)
    if bits is None or 6 + (bits + 7) // 8 > len(frame):
        return False
    data = frame[2:4] + frame[6 : 6 + (bits + 7) // 8]
    return (crc16(data) if bits % 8 == 0 else crc_bits(data, 16 + bits)) == frame[4] << 8 | frame[5]


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def tags_of(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where the audio between an ID3v2 tag and an ID3v1 tag starts and ends."""
    tags, start, stop = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        start = min(len(data), 10 + _syncsafe(data[6:10]))
        at = 10
        while at + 10 <= start and data[at : at + 1].isalnum():
            name = data[at : at + 4].decode("latin-1")
            n = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value.rstrip("\0")
            at += 10 + n
    if stop - start >= 128 and data[stop - 128 : stop - 125] == b"TAG":
        stop -= 128
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[stop + a : stop + b].rstrip(b"\0 ").decode("latin-1"):
                tags.setdefault(key, value)
    return tags, start, stop


def vbr_of(frame: bytes, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    at = 4 + 2 * h["crc"] + h["side"]
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at2 = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None}
        for bit, key, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
            if flags & bit:
                out[key] = frame[at2 : at2 + n] if key == "toc" else int.from_bytes(frame[at2 : at2 + n], "big")
                at2 += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = *struct.unpack(">II", frame[46:54]), *struct.unpack(">HHH", frame[54:60])
        toc = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def free_length(data: bytes, at: int, stop: int) -> int:
    """Length without padding of a free-format frame: up to the next header of the same stream that another one, or the
    audio's end, follows. 0 if there is none."""
    pad, nxt = header(data[at : at + 4])["pad"], at + 4
    while (nxt := data.find(data[at : at + 2], nxt + 1, stop)) >= 0:
        h = header(data[nxt : nxt + 4])
        if h and not h["length"] and data[nxt + 2] & 0xFC == data[at + 2] & 0xFC:
            after = nxt + nxt - at - pad + h["pad"]
            if after == stop or (after < stop and header(data[after : after + 4])):
                return nxt - at - pad
    return 0


def parse(data: bytes) -> dict:
    """Frames of an MPEG audio stream: offsets, exact duration, checksum errors, bytes skipped, tags and the VBR table.

    A header counts where the next frame's header follows its frame, or the audio ends there; bytes between are skipped.
    Free-format frames are as long as the way to the next one. A VBR table's frame isn't audio; ``vbr_right`` tells whether
    its numbers of frames and bytes are those found (None without a table or numbers). Data without frames has none, and
    duration 0.
    """
    tags, at, stop = tags_of(data)
    offsets: list[int] = []
    kinds: set[bytes] = set()
    skipped = bad = 0
    samples: dict[int, int] = {}
    vbr, first, free, began = None, True, 0, 0
    while at + 4 <= stop:
        four = data[at : at + 4]
        h = header(four)
        length = h["length"] if h else 0
        if h and not length:
            free = free or free_length(data, at, stop)
            length = free and free + h["pad"]
        end = at + length
        if not length or end > stop or (four not in kinds and end + 4 <= stop and not header(data[end : end + 4])):
            nxt = data.find(b"\xff", at + 1, stop)
            skipped, at = skipped + ((nxt if nxt >= 0 else stop) - at), nxt if nxt >= 0 else stop
            continue
        if not sound(data[at:end], h):
            bad += 1
        found = vbr_of(data[at:end], h) if first else None
        if found:
            vbr = found
        else:
            offsets.append(at)
            samples[h["hertz"]] = samples.get(h["hertz"], 0) + h["samples"]
        kinds.add(four)
        began = at if first else began
        first, at = False, end
    skipped += max(0, stop - at)
    duration = sum((Fraction(n, hz) for hz, n in samples.items()), Fraction(0))
    told = [] if not vbr else [(vbr["frames"], (len(offsets), len(offsets) + 1)), (vbr["bytes"], (at - began,))]
    right = all(x in y for x, y in told if x is not None) if any(x is not None for x, _ in told) else None
    return {"tags": tags, "offsets": offsets, "duration": duration, "bad_crc": bad, "skipped": skipped, "vbr": vbr, "vbr_right": right, "first": header(data[offsets[0] : offsets[0] + 4]) if offsets else None}


def store(payload: bytes, n_bytes: int) -> bytes:
    """MPEG audio whose frames carry ``payload``, a positive multiple of 192 bytes, in the room after their main data.

    The frames decode to silence. An ID3v2 tag has the length before padding, and an Info frame the frame count, the
    size and the seek table.
    """
    n = len(payload) // BLOCK
    body = b"\x03payload-bytes\0" + str(n_bytes).encode()
    frame = b"TXXX" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + bytes([0, 0, len(frame) >> 7 & 127, len(frame) & 127]) + frame
    start = HEAD + crc16(HEAD[2:] + SIDE).to_bytes(2, "big") + SIDE
    toc = bytes(min(255, 256 * (FRAME + FRAME * (n * i // 100)) // (FRAME * (n + 1))) for i in range(100))
    info = start + b"Info" + struct.pack(">III", 7, n, FRAME * (n + 1)) + toc
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, : len(start)] = np.frombuffer(start, np.uint8)
    frames[:, len(start) : len(start) + BLOCK] = np.frombuffer(payload, np.uint8).reshape(n, BLOCK)
    return tag + info.ljust(FRAME, b"\0") + frames.tobytes()


def payload_of(data: bytes, found: dict) -> bytes:
    """The payload that ``store`` put into the frames."""
    room = 6 + len(SIDE)
    return b"".join([data[o + room : o + room + BLOCK] for o in found["offsets"]])


def padded(text: str | None) -> tuple[bytes, int]:
    """A text as UTF-8 with spaces up to a positive multiple of 192 bytes, and its length before that."""
    data = (text or "").encode()
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" "), len(data)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text stored as MPEG audio, one row per input row; null counts as empty, very long texts are
    stored whole, equal texts are equal audio. An empty table gives no rows; other columns are not looked at."""

    def task(batches):
        for batch in batches:
            for ids, texts in rows_of(batch, ["id", "text"], 128):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([store(*padded(t)) for t in texts], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, media binary")


def describe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", seek_every: int = 1) -> DataFrame:
    """Features of each row's MPEG audio, read from its bytes.

    ``doc_id, n_frames, duration_num, duration_den`` (seconds as an exact fraction), ``bad_crc, skipped_bytes, vbr``
    (kind of table or null) and ``vbr_right`` (whether its numbers agree with the frames), ``tags`` (map), ``seek_offsets``
    (of every ``seek_every``-th frame), ``media_bytes, media_sha256, feature``, and of a stored payload ``payload_bytes,
    payload_sha256, tail_crc32`` and ``n_bytes``. Null, empty or foreign bytes have no frames, duration 0/1 and nulls where
    there is nothing to tell. Repeated rows give repeated results, an empty table none. Memory is bounded by the longest
    media; other columns are not looked at, whatever their names.
    """
    fields = "doc_id long, n_frames long, duration_num long, duration_den long, bad_crc long, skipped_bytes long, vbr string, vbr_right boolean, tags map<string,string>, seek_offsets array<long>, media_bytes long, media_sha256 string, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long, n_bytes long"
    kinds = [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split(" ")[0] for x in fields.split(", ")]

    def one(key, data: bytes | None) -> tuple:
        data = data or b""
        x = parse(data)
        d, h = x["duration"], x["first"]
        text = "none" if not h else f"mpeg{h['version']};layer{h['layer']};{h['hertz']}Hz;{'mono' if h['mono'] else 'stereo'};{h['kbits']}kbps;frames={len(x['offsets'])};duration={d.numerator}/{d.denominator}s;vbr={x['vbr']['kind'] if x['vbr'] else 'none'};bad_crc={x['bad_crc']};seek={zlib.crc32(np.array(x['offsets'], '<u8').tobytes()):08x}"
        n = x["tags"].get("payload-bytes")
        got = payload_of(data, x) if n is not None else None
        stored = (len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), int(n)) if got is not None else (None,) * 4
        return (key, len(x["offsets"]), d.numerator, d.denominator, x["bad_crc"], x["skipped"], x["vbr"] and x["vbr"]["kind"], x["vbr_right"], list(x["tags"].items()), x["offsets"][::seek_every], len(data), hashlib.sha256(data).hexdigest(), text, *stored)

    def task(batches):
        for batch in batches:
            for ids, blobs in rows_of(batch, ["id", "media"], 128):
                cols = zip(*(one(k, m) for k, m in zip(ids, blobs)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(task, fields)
