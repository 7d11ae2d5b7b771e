import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import media as m
from claimloom.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=5))
def test_round_trip(texts):
    payloads = [m.payload(t) for t in texts]
    files = m.stored(payloads)
    assert [x.samples.tobytes() for x in m.decoded(files)] == payloads
    assert m.stored(payloads[::-1]) == files[::-1]


def test_extreme_differences_and_several_riff_chunks(monkeypatch):
    p = bytes([0, 255] * 96) + bytes([255] * 64) + bytes(range(256))
    assert m.decoded(m.stored([p])[0])[0].samples.tobytes() == p
    monkeypatch.setattr(m, "PART", 128)
    avi = m.stored([p, p[:64]])[0]
    assert avi.count(b"RIFF") == 4 and m.decoded(avi)[0].samples.tobytes() == p


def test_index_forms():
    avi = m.stored([bytes(range(192))])[0]
    want = m.parse(avi)
    at = avi.index(b"idx1")
    assert len(want) == 3 and all(avi[a : a + 2] == b"\xff\xd8" and avi[a + n - 2 : a + n] == b"\xff\xd9" for a, n in want)
    cut = avi[:at]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert (m.parse(cut) == want).all()  # no index
    absolute = bytearray(avi)
    base = avi.index(b"movi")
    for i in range(3):
        place = at + 8 + 16 * i + 8
        struct.pack_into("<I", absolute, place, struct.unpack_from("<I", avi, place)[0] + base)
    assert (m.parse(bytes(absolute)) == want).all()
    with pytest.raises(ValueError):
        m.parse(b"RIFF\4\0\0\0WAVE")


def test_plain_decoder_agrees():
    avi = m.stored([bytes(random.Random(1).choices(range(256), k=256))])[0]
    for (a, n), want in zip(m.parse(avi), m.decoded(avi)[0].samples):
        dc = m.coefficients(avi[a : a + n])[1][:, :, 0].ravel()
        assert (dc / 8 + 128 == want).all()


def jpeg_with_standard_tables(blocks, restart, rows, columns):
    """A brute-force encoder of quantised zigzag blocks, bit string by bit string, tables left out."""
    dc = {s: (n, c) for (n, c), s in m.huffman_codes(*m.STANDARD_DC[0]).items()}
    ac = {s: (n, c) for (n, c), s in m.huffman_codes(*m.standard_ac(0)).items()}
    bits = lambda code: format(code[1], f"0{code[0]}b")
    size = lambda v: abs(v).bit_length()
    tail = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    out, s, level = b"", "", 0

    def flush(s):
        s += "1" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0")

    for i, b in enumerate(blocks):
        if i and i % restart == 0:
            out += flush(s) + bytes([0xFF, 0xD0 + (i // restart - 1) % 8])
            s, level = "", 0
        s += bits(dc[size(b[0] - level)]) + tail(b[0] - level)
        level, run = b[0], 0
        for v in b[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                s += bits(ac[0xF0])
                run -= 16
            s += bits(ac[run * 16 + size(v)]) + tail(v)
            run = 0
        if run:
            s += bits(ac[0])
    out += flush(s)
    head = b"\xff\xd8" + m._segment(0xDB, b"\0" + bytes(range(1, 65))) + m._segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * columns, 1, 1, 0x11, 0))
    return head + m._segment(0xDD, struct.pack(">H", restart)) + m._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"


def test_other_cameras_frames():
    rng = random.Random(4)
    blocks = [[rng.randint(-60, 60)] + [rng.choice([0] * 9 + [rng.randint(-40, 40)]) for _ in range(63)] for _ in range(12)]
    info, got = m.coefficients(jpeg_with_standard_tables(blocks, 5, 3, 4))
    assert (info["width"], info["height"]) == (32, 24)
    for b, g in zip(blocks, got.reshape(-1, 64)):
        assert all(g[m.ZIGZAG[k]] == v * (k + 1) for k, v in enumerate(b))


def test_pixels_by_the_cosine_sum():
    rng = random.Random(7)
    blocks = [[rng.randint(-20, 20)] + [rng.choice([0] * 9 + [rng.randint(-9, 9)]) for _ in range(63)] for _ in range(6)]
    data = jpeg_with_standard_tables(blocks, 2, 2, 3)
    got = m.pixels(data)
    assert got.shape == (16, 24)
    c = lambda u: 0.5**0.5 if u == 0 else 1.0
    for i, b in enumerate(blocks):
        f = np.zeros(64)
        for k, v in enumerate(b):
            f[m.ZIGZAG[k]] = v * (k + 1)
        for y in range(8):
            for x in range(8):
                want = 128 + sum(c(u) * c(v) / 4 * f[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
                assert abs(float(got[i // 3 * 8 + y, i % 3 * 8 + x]) - min(255, max(0, want))) <= 0.5 + 1e-6


def plain_avi(p):
    """The file of a short payload, frame by frame and bit by bit."""
    codes = {s: format(c, f"0{n}b") for (n, c), s in m.huffman_codes(m._DC_LENGTHS, m._DC_SYMBOLS).items()}
    body, index = b"movi", b""
    chunks = []
    for i in range(0, len(p), 64):
        bits, last = "", 0
        for v in (x - 128 for x in p[i : i + 64]):
            d, last = v - last, v
            n = abs(d).bit_length()
            bits += codes[n] + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
        bits += "1" * (-len(bits) % 8)
        scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        chunks.append(m._JPEG_HEAD + scan + b"\xff\xd9")
    for data in chunks:
        index += b"00dc" + struct.pack("<III", 0x10, len(body), len(data))
        body += m._chunk(b"00dc", data)
    return m._chunk(b"RIFF", b"AVI " + m._head(len(chunks), max(map(len, chunks))) + m._chunk(b"LIST", body) + m._chunk(b"idx1", index))


def plain_feature(p):
    """Shots by loops over the histograms of single frames."""
    frames = [p[i : i + 64] for i in range(0, len(p), 64)]
    h = [[sum(x >> 4 == b for x in f) for b in range(16)] for f in frames]
    d = [sum(abs(a - b) for a, b in zip(x, y)) // 2 for x, y in zip(h, h[1:])]
    starts = [0]
    for i in range(len(d)) if len(frames) > 2 else ():
        near = d[max(0, i - 4) : i] + d[i + 1 : i + 5]
        if d[i] > (d[i - 1] if i else -1) and d[i] >= (d[i + 1] if i + 1 < len(d) else -1) and 2 * d[i] * len(near) > 3 * sum(near) + 32 * len(near):
            starts.append(i + 1)
    ends = [*starts[1:], len(frames)]
    return f"frames={len(frames)};clips={len(starts)};starts={','.join(map(str, starts))};mean={sum(p) * 100 // len(p)}", ",".join(f"{40 * a}-{40 * b}" for a, b in zip(starts, ends))


def test_shots():
    rng = np.random.default_rng(0)
    frames = np.concatenate([rng.integers(a, a + 30, (20, 64)) for a in (0, 120, 60, 220)]).astype(np.uint8)
    bins = m._flat(frames).histograms
    assert m.shots(bins).tolist() == [0, 20, 40, 60]
    assert m.shots(m._flat(np.zeros((50, 64), np.uint8)).histograms).tolist() == [0] and m.shots(bins[:1]).tolist() == [0]


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_avi_motion_jpeg"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = m.payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        if r.doc_id % 4 == 0:
            avi = plain_avi(p)
            assert (r.media_bytes, r.media_sha256, r.feature, r.clips) == (len(avi), hashlib.sha256(avi).hexdigest(), *plain_feature(p))


def test_edges_and_clips(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "ab " * 999, 0), (2, "ab " * 999, 0)], "doc_id bigint, text string, media int")
    rows = m.described(docs).collect()
    assert [r.payload_bytes for r in rows] == [64, 64, 3008, 3008] and rows[2] == rows[3]
    df, name = m.with_media(docs)
    got = m.clips(df, media_col=name).collect()
    assert name == "_media" and {(r.start_ms, r.end_ms) for r in got if r.doc_id == 2 and r.clip == 0} == {(0, 47 * 40)}
    assert m.described(docs.limit(0)).count() == 0
