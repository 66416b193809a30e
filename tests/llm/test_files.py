"""Media columns, token shards, mixing and the pipeline."""

import hashlib
import os
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from daytrace.llm import bpe, langid, mixing, mpeg, token_shards
from daytrace.llm.common import new_folder
from test_dedup import slow_components, slow_fingerprint, slow_lines


def test_media_round_trip(odd, none, docs, texts):
    rows = mpeg.describe(mpeg.to_media(docs)).collect()
    for r in rows:
        payload, n = mpeg.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.bad_crc, r.skipped_bytes) == (n, len(payload), 0, 0)
        media = mpeg.store(payload, n)
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest(), len(media))
        assert r.vbr == "Info" and r.vbr_right and r.tags == {"payload-bytes": str(n)} and r.n_frames == len(r.seek_offsets) == len(payload) // 192
        assert b"".join(media[o + 23 : o + 215] for o in r.seek_offsets) == payload
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and Fraction(r.duration_num, r.duration_den) == Fraction(1152 * len(payload) // 192, 48000)
    got = {r.doc_id: r for r in mpeg.describe(mpeg.to_media(odd)).collect()}
    assert got[2].media_sha256 == got[3].media_sha256 and got[2].payload_bytes == 192 and mpeg.to_media(none).count() == 0


def test_media_resynchronises_and_checks():
    payload = bytes(range(256)) * 3
    data = mpeg.store(payload, 700)
    clean = mpeg.parse(data)
    assert mpeg.payload_of(data, clean) == payload and clean["vbr"]["frames"] == 4 and clean["tags"] == {"payload-bytes": "700"}
    o = clean["offsets"][2]
    broken = mpeg.parse(data[:o] + b"\xff\xe0junk\xff" + data[o:])
    assert len(broken["offsets"]) == 4 and broken["skipped"] == 7 and broken["offsets"][2] == o + 7
    flipped = bytearray(data)
    flipped[o + 10] ^= 1
    assert mpeg.parse(bytes(flipped))["bad_crc"] == 1
    tagged = mpeg.parse(data + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert tagged["tags"]["TIT2"] == "Title" and tagged["skipped"] == 0
    for foreign in (b"", b"\xff", b"no audio at all", b"ID3\x04"):
        assert mpeg.parse(foreign)["offsets"] == [] and mpeg.parse(foreign)["duration"] == 0


def slow_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc, top = crc << 1 & 0xFFFF, crc >> 15 ^ b
        crc ^= 0x8005 if top else 0
    return crc


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


@pytest.mark.parametrize("second,third,fourth,n_bits", [
    (0xFE, 0x54, 0xC0, 128), (0xFE, 0x54, 0x00, 256), (0xFE, 0x54, 0x50, 160), (0xFC, 0x84, 0xC0, None), (0xFC, 0x80, 0x00, None), (0xFC, 0x84, 0x60, None), (0xF4, 0x84, 0x00, None),
])
def test_checksums_of_layers_one_and_two(second, third, fourth, n_bits):
    head = bytes([0xFF, second, third, fourth])
    h = mpeg.header(head)
    rng = random.Random(second * fourth)
    frames = b""
    for _ in range(3):
        body = bytes(rng.randrange(255) for _ in range(h["length"] - 6))
        bits = mpeg.protected_bits(body, h)
        assert n_bits in (None, bits) and 0 < bits < 8 * len(body)
        crc = slow_crc(bits_of(head[2:]) + bits_of(body)[:bits])
        frames += head + crc.to_bytes(2, "big") + body
    assert (len(mpeg.parse(frames)["offsets"]), mpeg.parse(frames)["bad_crc"]) == (3, 0)
    broken = bytearray(frames)
    broken[h["length"] + 8] ^= 0x10
    assert mpeg.parse(bytes(broken))["bad_crc"] == 1


def test_layer_two_bits_by_hand():
    h = mpeg.header(bytes([0xFF, 0xFC, 0x84, 0xC0]))  # 48 kHz, 128 kbit/s, mono: 27 subbands
    widths = mpeg.allocation_widths(h)
    assert (len(widths), sum(widths)) == (27, 88)
    assert mpeg.protected_bits(bytes(100), h) == 88 and mpeg.protected_bits(b"\x10" + bytes(99), h) == 90 and mpeg.protected_bits(b"\xff" * 100, h) == 88 + 54
    assert len(mpeg.allocation_widths(mpeg.header(bytes([0xFF, 0xFC, 0x14, 0xC0])))) == 8


def test_free_format_and_wrong_tables():
    head = bytes([0xFF, 0xFB, 0x04, 0xC0])  # no bitrate
    frame = head + bytes(300)
    got = mpeg.parse(frame * 4)
    assert got["offsets"] == [0, 304, 608, 912] and got["skipped"] == 0 and got["duration"] == Fraction(4 * 1152, 48000)
    assert mpeg.parse(head + bytes(40))["offsets"] == []
    data = mpeg.store(bytes(192 * 5), 9)
    assert mpeg.parse(data)["vbr_right"] is True and mpeg.parse(data[:-240])["vbr_right"] is False and mpeg.parse(b"")["vbr_right"] is None


def test_header_fields():
    h = mpeg.header(b"\xff\xfb\x90\x00")
    assert (h["version"], h["layer"], h["kbits"], h["hertz"], h["length"], h["samples"], h["side"]) == (1, 3, 128, 44100, 417, 1152, 32)
    assert mpeg.header(b"\xff\xf3\x40\xc0")["samples"] == 576 and mpeg.header(b"\xff\xfb\xf0\x00") is None and mpeg.header(b"\xff\xff\x10\x00")["layer"] == 1


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
        assert sorted(token_shards.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_shards_read_back(spark, docs, texts, library):
    folder = new_folder(spark, "test-shards")
    manifest = token_shards.write_shards(docs, folder, docs_per_shard=64)
    assert manifest.count() > 1
    got = {r.doc_id: r for r in token_shards.read_keys(docs.repartition(3), folder).collect()}
    sums = {r.doc_id: r for r in token_shards.stored_digests(docs).collect()}
    assert len(sums) == len(texts)
    start = 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids) == (start, len(ids), ids)
        assert (sums[k].start, sums[k].n_tokens, sums[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    missing = spark.createDataFrame([(10**9 + i,) for i in range(50)] + [(-5,)], "doc_id long")
    assert token_shards.read_keys(missing, folder).count() == 0


def test_shards_of_odd_rows(odd, none):
    got = token_shards.stored_digests(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, 2, 3, None, 5, 6, 7, 8, 9])
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert [r for r in got if r.doc_id is None][0].start == 0
    assert {r.doc_id: r.n_tokens for r in got}[2] == 1 and token_shards.stored_digests(none).count() == 0


def test_pfair_deviation():
    rng = random.Random(1)
    for _ in range(60):
        quota = mixing.quotas({f"s{i}": rng.random() ** 3 + 0.01 for i in range(rng.randint(1, 30))}, rng.choice([50, 200, 777]))
        order, seen = mixing.pfair(quota), Counter()
        for slot, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[x] - slot * q / len(order)) < 1 for x, q in quota.items())
        assert seen == quota


def slow_mix(blocks, weights, period):
    """Slots of all blocks, one slot at a time; schedules start anew when a source is used up."""
    left, done, out, slot = dict(blocks), Counter(), {}, 0
    while any(left.values()):
        active = {s: weights[s] for s, n in left.items() if n}
        order, k = mixing.pfair(mixing.quotas(active, period)), 0
        while all(left[s] for s in active):
            s = order[k % len(order)]
            out[s, done[s]] = slot
            done[s], left[s], k, slot = done[s] + 1, left[s] - 1, k + 1, slot + 1
    return out


@pytest.mark.parametrize("weights", [None, {"src0": 5, "src1": 1, "src2": 3.5}])
def test_mix_against_loop(docs, weights):
    rows = mixing.mix_sources(docs, weights, block_docs=2, period=37).select("row.doc_id", "mix_source", "mix_block", "mix_slot", "mix_order").collect()
    assert len(rows) == docs.count() and len({r.mix_order for r in rows}) == len(rows)
    n = Counter(r.mix_source for r in rows)
    target = {s: (weights.get(s, min(weights.values()) * 0.001) if weights else c**0.5) for s, c in n.items()}
    want = slow_mix({s: -(-c // 2) for s, c in n.items()}, target, 37)
    assert {(r.mix_source, r.mix_block): r.mix_slot for r in rows} == want
    assert Counter((r.mix_source, r.mix_block) for r in rows).most_common(1)[0][1] == 2


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix_sources(odd)
    assert got.count() == 10 and mixing.mix_sources(none).count() == 0 and got.select("row.*").columns == odd.columns
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, max_sources=2)


def prefixes_stay_close(weights, blocks):
    """Every prefix, until a source is used up, against the true weights; all blocks once, in order."""
    plan = mixing.phases(blocks, weights)
    rows = [r for p in plan for start in range(0, p["last"] + 1, p["chunk"]) for r in mixing.chunk_rows(p, start)]
    exact = mixing.whole(weights)
    total, seen, whole = sum(exact.values()), Counter(), True
    assert [r[2] for r in rows] == list(range(sum(blocks.values())))
    for s, j, slot in rows:
        assert j == seen[s]
        seen[s] += 1
        assert not whole or all(abs(seen[x] * total - (slot + 1) * w) < total for x, w in exact.items())
        whole = whole and seen[s] < blocks[s]
    assert seen == blocks


@pytest.mark.parametrize("chunk", [1, 64, 8192])
def test_prefixes_against_exact_weights(monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    prefixes_stay_close({"a": 0.9, "b": 0.099, "c": 0.001}, {"a": 2800, "b": 310, "c": 4})
    prefixes_stay_close({"big": 100, **{f"s{i}": 1 for i in range(99)}}, {"big": 300, **{f"s{i}": 5 for i in range(99)}})
    prefixes_stay_close({f"s{i}": 1 + i**0.5 for i in range(300)}, {f"s{i}": 2 + int(i**0.5) for i in range(300)})
    rng = random.Random(chunk)
    for _ in range(20):
        weights = {f"s{i}": rng.random() ** 4 + 1e-4 for i in range(rng.randint(1, 20))}
        prefixes_stay_close(weights, {s: 1 + int(rng.uniform(20, 60) * w) for s, w in weights.items()})


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'big' ELSE 's' || id % 300 END AS source")
    n = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    weights = {s: 150 if s == "big" else 1 for s in n}
    rows = sorted((r.mix_order, r.mix_source, r.mix_block, r.mix_slot) for r in mixing.mix_sources(docs, weights, block_docs=2).drop("row").select("mix_order", "mix_source", "mix_block", "mix_slot").collect())
    assert len(rows) == 9000 and len({r[0] for r in rows}) == 9000 and len({(r[1], r[2]) for r in rows}) == sum(-(-k // 2) for k in n.values())
    first = {r[3]: r[1] for r in rows}
    assert sorted(first) == list(range(len(first)))
    assert abs(sum(first[i] == "big" for i in range(700)) - 700 * 150 / sum(weights.values())) < 1


def test_weight_of_zero_comes_last(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "IF(id < 20, 'a', 'b') AS source")
    rows = mixing.mix_sources(docs, {"a": 0, "b": 1}, block_docs=2).collect()
    assert max(r.mix_slot for r in rows if r.mix_source == "b") < min(r.mix_slot for r in rows if r.mix_source == "a") and len(rows) == 40


def test_pipeline_against_brute_force(spark, sf, docs, library):
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    known = {r.doc_id: r for r in langid.predict(docs, langid.train(langid.training_rows(docs))).collect()}
    kept = stages["language_id"](spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in known.items() if r.lang_pred != "und" and r.score >= 0.5} and kept.columns == docs.columns
    lines = dict(slow_lines([(r.doc_id, r.text) for r in kept.collect()]))
    deduped = stages["line_dedup"](spark, kept, sf)
    assert {r.doc_id: (r.text, r.n_chars) for r in deduped.collect()} == {k: (t, len(t)) for k, t in lines.items()} and deduped.columns == docs.columns
    comps = slow_components({k: slow_fingerprint(t) for k, t in lines.items()})
    single = stages["simhash_near_dedup"](spark, deduped, sf)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(comps.values())) and single.columns == docs.columns
    mixed = stages["mix_sources"](spark, single, sf)
    order = [r.row.doc_id for r in mixing.mix_sources(single.select(*docs.columns)).orderBy("mix_order").collect()]
    assert [r.doc_id for r in mixed.collect()] == order and mixed.columns == docs.columns
    final = {r.doc_id: r.ids for r in stages["bpe_tokens"](spark, mixed, sf).collect()}
    assert final == {k: library.encode(lines[k], add_special_tokens=False).ids for k in set(comps.values())}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in whole} == final and set(final) <= set(rows)
    assert [r.doc_id for r in sorted(whole, key=lambda r: (r.mix_file, r.mix_row))] == order


def test_stages_take_odd_rows(spark, odd, none, sf):
    plain = odd.select(*corpus_pipeline.COLUMNS)
    left = {"language_id": 5, "simhash_near_dedup": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() == left.get(name, 10), name
        assert stage(spark, plain.filter(F.lit(False)), sf).count() == 0 and stage(spark, none, sf).count() == 0


def test_plain_words_are_not_taken_apart(monkeypatch):
    from daytrace.llm import bpe, token_shards

    path = bpe.default_tokenizer()
    text = "Word word, (x) a|b <|endoftext|> x<|y Straße ﬁne 12 a1 ... |word| été; 漢字\x1cz"
    want = bpe.Codec(path).library.encode(text, add_special_tokens=False).ids
    for kind in (bpe.Codec, token_shards.LibraryEncoder):
        made, apart = kind(path), []
        odd = made.apart
        monkeypatch.setattr(made, "apart", lambda piece: apart.append(piece) or odd(piece))
        assert made.encode(text) == want == made.encode(text)
        assert not {"Word", "word,", "Straße", "été;"} & {*apart} and {"(x)", "a|b", "12"} <= {*apart}
