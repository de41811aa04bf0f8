"""Packing, BPE and media: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrykit.llm import bpe, media, packing, units, webp


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(packing.tokenizer_file())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "..", ",", "<|endoftext|>", " ", "　", "\x1c", "​", "中文", "🙂", "DON'T", "\r\n", "x. y"]), max_size=14).map("".join))
def test_bpe_equals_library(text):
    t, p = Tokenizer.from_file(packing.tokenizer_file()), test_bpe_equals_library.__dict__.setdefault("p", bpe.BytePairs(packing.tokenizer_file()))
    want = t.encode(text, add_special_tokens=False).ids
    (cached,) = units.PartCache(p.encode, limit=4).ids([text], tuple(p.added))
    for got in (cached, p.encode(text), packing.id_encoder(packing.tokenizer_file())(text)):
        assert np.frombuffer(got, "<u4").tolist() == want
        assert p.decode(got) == text


def test_bpe_rows(docs, nothing, texts, tokenizer):
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(docs).collect()}
    for i, t in texts.items():
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["decoded"] == (t or "")
    assert bpe.encode_and_decode(nothing).count() == 0


def test_plan():
    rng = random.Random(1)
    for _ in range(200):
        counts = {}
        for _ in range(rng.randrange(1, 120)):
            counts[rng.randrange(1, rng.choice([20, 200, 1025]))] = rng.randrange(1, 9)
        used = {}
        for lengths, times in packing.plan(dict(counts)):
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
    assert packing.plan({600: 5, 424: 3, 200: 2, 224: 2}) == [((600, 424), 3), ((600, 224, 200), 2)]
    assert sum(n for _, n in packing.plan({512: 7})) == 4 and packing.plan({}) == []


def test_plan_uses_combinations(spark):
    """Close to the least number of sequences that all tokens need, with pairs and triples that fill gaps exactly."""
    encode = packing.id_encoder(packing.tokenizer_file())
    sizes = [len(encode(r["text"] or "")) // 4 + 1 for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    counts = {}
    for n in sizes:
        for x in [(n - 1) % 1024 + 1, *[1024] * ((n - 1) // 1024)]:
            counts[x] = counts.get(x, 0) + 1
    made = packing.plan(counts)
    least = -(-sum(sizes) // 1024)
    assert least <= sum(n for _, n in made) <= least + 1
    assert sum(n for lengths, n in made if len(lengths) > 2 and sum(lengths) == 1024) > 30


def test_sum_index():
    """Pairs and triples against all combinations, while counts fall."""
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(8)}
        index = packing.SumIndex(counts, 40)
        while index.left.any():
            have = [x for x in range(41) for _ in range(index.left[x])]
            pairs = {have[i] + have[j] for i in range(len(have)) for j in range(i)}
            triples = {have[i] + have[j] + have[k] for i in range(len(have)) for j in range(i) for k in range(j)}
            for total in range(1, 41):
                for made, sums in ((index.pair(total), pairs), (index.triple(total), triples)):
                    assert (made is not None) == (total in sums) and (made is None or sum(made) == total)
                    assert made is None or all(index.left[x] >= made.count(x) for x in made)
            index.left[rng.choice(have)] -= 1


def test_other_tokenizer_files(tmp_path):
    """Files whose options change the ids are left to the library."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(packing.tokenizer_file()))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"model": {**spec["model"], "ignore_merges": True}}):
        path = str(tmp_path / "other.json")
        json.dump({**spec, **change}, open(path, "w"))
        assert not bpe.BytePairs(path).plain
        text = "Hello the World  again"
        assert np.frombuffer(packing.id_encoder(path)(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert bpe.BytePairs(packing.tokenizer_file()).plain


def check_packing(rows, texts, tokenizer):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in texts.items():
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by_doc.pop(i), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["length"] <= 1024 and (k == 0 or r["length"] == 1024)
            piece = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert bytes(r["ids"]) == piece if "ids" in r.asDict() else r["ids_crc32"] == zlib.crc32(piece)
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence), -(-sum(r["length"] for r in rows) // 1024)


def test_packing(docs, nothing, texts, tokenizer):
    check_packing(packing.pack_documents(docs).collect(), texts, tokenizer)
    assert packing.pack_documents(nothing).count() == 0


def test_packing_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    own = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made, least = check_packing(packing.op3_best_fit_packing(spark, sf).collect(), own, tokenizer)
    assert made <= 1.02 * least + 1
    got = {r["doc_id"]: r for r in bpe.op9_bpe_round_trip(spark, sf).collect()}
    for i, t in own.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_repeated_rows_are_packed_as_often(spark):
    rows = spark.createDataFrame([(1, "a b")] * 5 + [(None, None)] * 2, "doc_id long, text string")
    assert packing.pack_documents(rows).count() == 7


@pytest.mark.parametrize("high", [1, 2, 3, 17, 130, 256])
@pytest.mark.parametrize("n", [64, 64 * 33])
def test_samples_round_trip(high, n):
    samples = np.random.default_rng(high).integers(0, high, n).astype(np.uint8)
    pixels = webp.decode(webp.encode_samples(samples))
    assert (pixels[..., 2].ravel() == samples).all() and (pixels[..., 0] == 255).all()


def test_wide_image():
    samples = np.random.default_rng(0).integers(0, 9, 64 * webp.MOST + 64).astype(np.uint8)
    parts = webp.images(webp.encode_samples(samples))
    assert [p.shape[:2] for p in parts] == [(webp.MOST, 64), (1, 64)]
    assert (np.concatenate([p[..., 2].ravel() for p in parts]) == samples).all()


def test_writer_methods(monkeypatch):
    """Palette, predictor, prefix codes by frequency and back-references are all written where they shrink, and read back."""
    rng = np.random.default_rng(5)
    text = np.frombuffer((" ".join(rng.choice(["the", "words", "of", "some", "prose", "are", "unequal"], 900)) + " " * 64).encode(), np.uint8)
    cases = {
        "one value": np.full(640, 9), "palette 2": rng.integers(0, 2, 6400), "palette 4": rng.integers(0, 4, 6400), "palette 16": rng.integers(0, 16, 6400), "noise": rng.integers(0, 256, 6400),
        "ramp": np.cumsum(rng.integers(0, 3, 6400)) % 256, "skewed": np.minimum(rng.geometric(0.3, 6400), 255), "repeats": np.tile(rng.integers(0, 256, 100), 64), "text": text[: len(text) // 64 * 64],
    }
    sizes = {}
    for name, x in cases.items():
        x = x.astype(np.uint8)
        data = webp.encode_samples(x)
        (got,) = webp.images(data)
        assert (got[..., 2].ravel() == x).all() and (got[..., 0] == 255).all() and not got[..., [1, 3]].any()
        sizes[name] = len(data) / len(x)
        monkeypatch.setattr(webp, "_read_green", lambda *_: None)  # symbol by symbol
        assert (webp.images(data)[0] == got).all()
        monkeypatch.undo()
    assert sizes["one value"] < 0.1 and sizes["palette 2"] < 0.2 and sizes["palette 4"] < 0.33 and sizes["palette 16"] < 0.6 and sizes["noise"] < 1.1
    assert sizes["ramp"] < 0.3 and sizes["skewed"] < 0.5 and sizes["repeats"] < 0.1 and sizes["text"] < 0.5


def test_long_codes():
    """Frequencies that grow like Fibonacci numbers would need more than 15 bits."""
    counts = np.array([1, 1])
    while len(counts) < 24:
        counts = np.append(counts, counts[-1] + counts[-2])
    lengths = webp.code_lengths(counts)
    assert lengths.max() <= 15 and (2.0 ** -lengths).sum() == 1


def plain(out, pixels):
    """Codes of 8 bits for every channel, then literal ARGB pixels."""
    for size in (280, 256, 256, 256):
        used = np.zeros(size, bool)
        used[:256] = True
        out.put_code(np.where(used, 8, 0))
    out.put_single(0)
    for p in pixels:
        for shift in (8, 16, 0, 24):
            out.put_bits(np.array([int(p) >> shift >> 7 - k & 1 for k in range(8)], np.uint8))


def image(width, height, pixels, transform):
    out = webp.Writer()
    transform(out)
    out.put(0, 3)
    plain(out, pixels)
    return webp.decode(out.file(width, height))


def one_block(out, kind, argb):
    """A transform whose table is one pixel (blocks of 512)."""
    out.put(1, 1)
    out.put(kind, 2)
    out.put(7, 3)
    out.put(0, 1)
    plain(out, [argb])


def test_predictor_modes():
    rng = np.random.default_rng(3)
    residual = rng.integers(0, 1 << 32, 12, dtype=np.uint64)
    for mode in range(14):
        got = image(4, 3, residual, lambda out: one_block(out, 0, mode << 8)).astype(int)
        argb = np.stack([(residual >> np.uint64(s) & np.uint64(255)).astype(int) for s in (24, 16, 8, 0)], 1).reshape(3, 4, 4)
        want, flat = np.zeros((3, 4, 4), int), None
        for y in range(3):
            for x in range(4):
                flat = want.reshape(-1, 4)
                i = 4 * y + x
                if i == 0:
                    p = np.array([255, 0, 0, 0])
                elif y == 0:
                    p = flat[i - 1]
                elif x == 0:
                    p = flat[i - 4]
                else:
                    left, top, corner, right = flat[i - 1], flat[i - 4], flat[i - 5], flat[i - 3]
                    mean = lambda a, b: (a + b) // 2
                    table = {0: np.array([255, 0, 0, 0]), 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}
                    guess = left + top - corner
                    table[11] = left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
                    table[12] = np.clip(guess, 0, 255)
                    a = mean(left, top)
                    table[13] = np.clip([v + int((v - c) / 2) for v, c in zip(a, corner, strict=True)], 0, 255)
                    p = table[mode]
                flat[i] = (argb[y, x] + p) & 255
        assert (got == want).all(), mode


def test_other_transforms():
    pixel = 0xFF102030
    got = image(1, 1, [pixel], lambda out: (out.put(1, 1), out.put(2, 2)))
    assert got[0, 0].tolist() == [255, 0x30, 0x20, 0x50]  # green is added to red and blue
    got = image(1, 1, [pixel], lambda out: one_block(out, 1, 0xFF000000 | 0x08 << 16 | 0x10 << 8 | 0x20))
    red = 0x10 + (0x20 * 0x20 >> 5)
    assert got[0, 0].tolist() == [255, red, 0x20, (0x30 + (0x10 * 0x20 >> 5) + (0x08 * red >> 5)) & 255]

    def palette(out):
        out.put(1, 1)
        out.put(3, 2)
        out.put(2, 8)  # three colours, four to a pixel
        out.put(0, 1)
        plain(out, [0xFF000001, 0x00000001, 0x00010000])

    out = webp.Writer()
    palette(out)
    out.put(0, 3)
    plain(out, [0b10_01_00_01 << 8, 0b00_00_00_10 << 8])
    got = webp.decode(out.file(5, 1))
    assert [p.tolist() for p in got[0]] == [[255, 0, 0, 2], [255, 0, 0, 1], [255, 0, 0, 2], [255, 1, 0, 2], [255, 1, 0, 2]]


def test_back_references_and_cache():
    """Two literals, a copy of four pixels from one back, then both colours from the cache; codes of unequal lengths."""
    key = lambda g: (0x1E35A7BD * (0xFF000000 | g << 8) & 0xFFFFFFFF) >> 31
    first = 7
    second = next(g for g in range(8, 60) if key(g) != key(first))
    out = webp.Writer()
    out.put(0, 1)
    out.put(1, 1)
    out.put(1, 4)  # a colour cache of two
    out.put(0, 1)
    lengths = {first: 1, second: 2, 256 + 3: 3, 280: 4, 281: 4}
    out.put(0, 1)
    out.put(15, 4)
    order = {0: 1, 1: 3, 2: 3, 3: 3, 4: 3}  # lengths of the code-length code
    for k in webp.LENGTH_ORDER:
        out.put(order.get(k, 0), 3)
    out.put(0, 1)
    bits = {0: "0", 1: "100", 2: "101", 3: "110", 4: "111"}
    for s in range(282):
        out.put_bits(np.array([int(c) for c in bits[lengths.get(s, 0)]], np.uint8))
    for symbol in (0, 0, 255):
        out.put_single(symbol)
    out.put_single(1)  # distance code 2: the pixel to the left
    code = {first: "0", second: "10", 259: "110", 280: "1110", 281: "1111"}
    out.put_bits(np.array([int(c) for c in code[first] + code[second] + code[259] + code[280 + key(second)] + code[280 + key(first)]], np.uint8))
    assert webp.decode(out.file(8, 1))[0, :, 2].tolist() == [first, second, second, second, second, second, second, first]


def test_copies_that_overlap():
    """One literal and a run of it: distance code 1 or 2 names the pixel to the left in a single row."""
    out = webp.Writer()
    out.put(0, 3)
    out.put(0, 1)
    out.put(15, 4)
    for k in webp.LENGTH_ORDER:
        out.put(int(k in (0, 1)), 3)
    out.put(0, 1)
    for s in range(280):
        out.put(int(s in (65, 256 + 4)), 1)
    for symbol in (0, 0, 255):
        out.put_single(symbol)
    out.put_single(1)  # distance code 2: (1, 0)
    out.put_bits(np.array([0, 1, 1], np.uint8))  # literal 65; length prefix 4, extra bit 1: six pixels
    assert webp.NEAR[:2] == [(0, 1), (1, 0)]
    assert webp.decode(out.file(7, 1))[0, :, 2].tolist() == [65] * 7


def test_near_offsets():
    assert len(webp.NEAR) == 120 and webp.NEAR[4:8] == [(0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0", webp.encode_samples(np.arange(64, dtype=np.uint8))[:40]])
def test_broken_files(data):
    with pytest.raises((ValueError, IndexError)):
        webp.decode(data)


def test_media_rows(docs, nothing, texts):
    made = media.decode_media(media.encode_media(docs)).collect()
    for r in made:
        raw = (texts[r["doc_id"]] or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        assert bytes(r["payload"]) == raw + b"\0" * (size - len(raw)) and (r["n_bytes"], r["payload_bytes"]) == (len(raw), size)
    by_text = {}
    for r in made:
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add((bytes(r["media"]), r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.decode_media(media.encode_media(nothing)).count() == 0


def test_media_parts_follow_payloads(spark):
    """Stored forms of few bytes are unfolded one by one where their payloads are large."""
    texts = ["a" * 600_000, "b" * 600_000, "", None, "c" * 1_200_000, "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    stored = media.encode_media(docs)
    assert stored.agg({"payload_bytes": "sum"}).first()[0] > 1000 * stored.selectExpr("sum(octet_length(media))").first()[0]
    rows = {r["doc_id"]: r for r in media.decode_media(stored).collect()}
    assert all(bytes(rows[i]["payload"][: rows[i]["n_bytes"]]).decode() == (t or "") for i, t in enumerate(texts))
    table = pa.record_batch({"n": pa.array([5, 5, 30, 1, 1, 9, 40])})
    assert [p.column(0).to_pylist() for p in media.by_payload(table, 0, 20)] == [[5, 5], [30, 1, 1, 9], [40]]


def test_media_query(spark):
    sf = "/root/testdata/sf0.001"
    own = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op10_media_columns(spark, sf).collect():
        raw = own[r["doc_id"]]
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_the_plan_is_no_rows_of_python(spark, monkeypatch):
    """Rows of Python would pass through workers of their own kind, which stay idle beside those of the other steps."""
    pieces = spark.createDataFrame([(i, 0, 0, 5 + i % 3) for i in range(9)], "doc_id long, piece int, start long, length long")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows of Python"))
    made = packing.packed_pieces(pieces, 16)
    assert made.schema["sequence_id"].dataType.simpleString() == "bigint" and made.count() == 9
    assert packing.packed_pieces(pieces.where("length > 99"), 16).count() == 0


def test_packed_pieces_with_clashing_names(spark):
    names = ["lo", "hi", "first", "offset", "_salt", "salt", "row", "rank", "sequence_id", "n", "before", "a.b"]
    lengths = [700, 300, 24, 1024, 500, 524, 1, 700]
    rows = [(i // 2, i % 2, n, *(f"{name}{i}" for name in names)) for i, n in enumerate(lengths)]
    made = packing.packed_pieces(spark.createDataFrame(rows, ["doc_id", "piece", "length", *names]))
    kept = [n for n in names if n not in ("offset", "sequence_id")]
    assert made.columns == ["doc_id", "piece", "length", *kept, "sequence_id", "offset"]
    got = sorted(map(tuple, made.collect()))
    assert [r[:-2] for r in got] == [tuple(x for x, name in zip(r, ["", "", "", *names], strict=True) if name not in ("offset", "sequence_id")) for r in rows]
    used = {}
    for r in sorted(got, key=lambda r: r[-2:]):
        assert r[-1] == used.get(r[-2], 0)
        used[r[-2]] = r[-1] + r[2]
    assert max(used.values()) <= 1024 and len(used) == 4
