"""Motion-JPEG in AVI: stored losslessly, parsed by the RIFF index, decoded frame by frame, cut into shots.

A payload is stored as 8-bit samples: each is the level of one flat 8 x 8 block of a grey 64 x 64
baseline JPEG frame (quantiser 8, so a block's mean is coded exactly), 64 samples a frame, FPS
frames a second, every frame whole by itself, with an ``idx1`` index. Payloads of more than
PART bytes become several RIFF chunks in a row.

``parse`` walks the RIFF chunks and takes frames from ``idx1`` (offsets from the list or from the
file), or by walking ``movi`` where there is no index. ``decoded`` gives each frame's pixels: frames
with equal tables and flat blocks are read together, block by block in numpy (each pixel of such a
block has the block's level), others by a plain baseline decoder (Huffman tables of the frame or the
standard's, several components, restarts) and the inverse cosine transform. ``shots`` cuts where the
difference of two frames' histograms of pixels is a local peak above one and a half times the mean of its
neighbours plus FLOOR. ``clips`` gives the timed rows, and so does the column ``clips`` of ``described``.

Defined cases: a null or empty text is 64 zero bytes, one frame and one clip. Equal texts give equal
values. A very long text is several RIFF chunks of one file. Peaks of equal height side by side: the first
cuts. Null ids and repeated rows are kept; further columns aren't read, whatever their names. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import binaries, unused, utf8

FPS = 25
SIDE = 64
SAMPLES = 64
PART = 1 << 24
#: Frames worked on at a time.
_AT_ONCE = 1 << 13
BINS = 16
REACH = 4
FLOOR = 16

# Own tables: DC categories by length 3, 4 and 5; the AC table has the end of block alone.
_DC_LENGTHS = (0, 0, 7, 1, 1, *[0] * 11)
_DC_SYMBOLS = (3, 4, 5, 6, 7, 2, 1, 0, 8)
_AC_LENGTHS = (1, *[0] * 15)
_AC_SYMBOLS = (0,)

# Fixed values of the JPEG standard (Annex K): Huffman tables of luminance (0) and chrominance (1), for frames that leave theirs out.
STANDARD_DC = (
    ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
)
STANDARD_AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
STANDARD_AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a",
)


def standard_ac(i: int) -> tuple[tuple[int, ...], list[int]]:
    """The irregular symbols, then every other run and size in order."""
    first = [int(x, 16) for x in STANDARD_AC_FIRST[i].split()]
    return STANDARD_AC_LENGTHS[i], first + [16 * run + size for run in range(16) for size in range(1, 11) if 16 * run + size not in first]


#: Row-major place of each coefficient in zigzag order: diagonals, up the even ones and down the odd ones.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_JPEG_HEAD = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *_DC_LENGTHS, *_DC_SYMBOLS, 0x10, *_AC_LENGTHS, *_AC_SYMBOLS])),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)


def huffman_codes(lengths, symbols) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, by the canonical rule."""
    code, at, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a flat block (DC code, magnitude, end of block) and their number."""
    by_symbol = {s: k for k, s in huffman_codes(_DC_LENGTHS, _DC_SYMBOLS).items()}
    words, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        n, code = by_symbol[category]
        magnitude = d if d >= 0 else d + (1 << category) - 1
        words[d + 255] = ((code << category) | magnitude) << 1
        sizes[d + 255] = n + category + 1
    return words, sizes


_WORDS, _SIZES = _code_tables()


def _entropy_coded(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of all frames (n, 64) in a row, with stuffing, and where each starts (n + 1)."""
    n = len(frames)
    level = frames.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    size = np.empty((n, SAMPLES + 1), np.int64)
    word = np.empty((n, SAMPLES + 1), np.uint64)
    size[:, :-1], word[:, :-1] = _SIZES[diff], _WORDS[diff]
    bits = size[:, :-1].sum(axis=1)
    size[:, -1] = -bits % 8
    word[:, -1] = (1 << (-bits % 8)) - 1  # padded by ones
    size, word = size.ravel(), word.ravel()
    end = np.cumsum(size)
    at = end - size
    placed = word << (64 - size - (at & 31)).astype(np.uint64) if len(word) else word
    placed[size == 0] = 0
    cell = at >> 5
    words = np.zeros(int(end[-1] + 31 >> 5) + 2, np.uint32)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    words[cell[first]] |= np.bitwise_or.reduceat((placed >> np.uint64(32)).astype(np.uint32), first)
    words[cell[first] + 1] |= np.bitwise_or.reduceat(placed.astype(np.uint32), first)
    raw = words.astype(">u4").view(np.uint8)[: end[-1] >> 3]
    starts = np.append(0, end[SAMPLES :: SAMPLES + 1] >> 3)
    full = raw == 0xFF
    before = np.append(0, np.cumsum(full))
    out = np.zeros(len(raw) + before[-1], np.uint8)
    out[np.arange(len(raw)) + before[:-1]] = raw
    return out, starts + before[starts]


def _movi(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all frames in a row, where each starts (n + 1), and the sizes of their data."""
    scan, starts = _entropy_coded(frames)
    length = np.diff(starts)
    head = len(_JPEG_HEAD)
    size = head + length + 2
    chunk = 8 + size + (size & 1)
    at = np.append(0, np.cumsum(chunk))
    out = np.zeros(at[-1], np.uint8)
    begin = at[:-1, None]
    out[begin + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    out[begin + np.arange(4, 8)] = size.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begin + np.arange(8, 8 + head)] = np.frombuffer(_JPEG_HEAD, np.uint8)
    out[np.arange(len(scan)) + np.repeat(at[:-1] + 8 + head - starts[:-1], length)] = scan
    last = at[:-1] + 8 + head + length
    out[last], out[last + 1] = 0xFF, 0xD9
    return out, at, size


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _head(n: int, biggest: int) -> bytes:
    avih = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, n, 0, 1, biggest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, biggest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))


def stored(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload; each payload's length is a positive multiple of 64."""
    out: list[bytes] = []
    group: list[bytes] = []
    for p in payloads:
        if len(p) > PART:
            out += _stored(group) if group else []
            group = []
            out.append(b"".join(x for i in range(0, len(p), PART) for x in _stored([p[i : i + PART]])))
            continue
        group.append(p)
        if sum(map(len, group)) >= _AT_ONCE * SAMPLES:
            out += _stored(group)
            group = []
    return out + (_stored(group) if group else [])


def _stored(payloads: list[bytes]) -> list[bytes]:
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SAMPLES)
    data, at, size = _movi(frames)
    index = np.zeros(len(frames), [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, size
    out, a = [], 0
    for p in payloads:
        b = a + len(p) // SAMPLES
        index["offset"][a:b] = 4 + at[a:b] - at[a]
        body = b"AVI " + _head(b - a, int(size[a:b].max())) + _chunk(b"LIST", b"movi" + data[at[a] : at[b]].tobytes()) + _chunk(b"idx1", index[a:b].tobytes())
        out.append(_chunk(b"RIFF", body))
        a = b
    return out


def parse(avi: bytes) -> np.ndarray:
    """(frames, 2): where each video frame's data starts and its size; from idx1 where there is one."""
    found, at = [], 0
    while at + 12 <= len(avi):
        name, size, kind = struct.unpack_from("<4sI4s", avi, at)
        if name != b"RIFF" or kind not in (b"AVI ", b"AVIX"):
            raise ValueError("not a RIFF AVI file")
        end, movi, index = min(at + 8 + size, len(avi)), None, None
        p = at + 12
        while p + 8 <= end:
            name, n = struct.unpack_from("<4sI", avi, p)
            if name == b"LIST" and avi[p + 8 : p + 12] == b"movi":
                movi = (p + 8, min(p + 8 + n, end))
            elif name == b"idx1":
                index = np.frombuffer(avi, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], n // 16, p + 8)
            p += 8 + n + (n & 1)
        if movi is None:
            raise ValueError("no movi list")
        if index is not None and len(index):
            own = index[np.char.endswith(index["id"], b"dc") | np.char.endswith(index["id"], b"db")] if len(set(index["id"].tolist())) > 1 else index
            base = movi[0] if avi[movi[0] + int(own["offset"][0]) :][:4] == own["id"][0] else 0  # from the list's name, or from the file's start
            found.append(np.stack([own["offset"].astype(np.int64) + base + 8, own["size"].astype(np.int64)], axis=1))
        else:
            p, rows = movi[0] + 4, []
            while p + 8 <= movi[1]:
                name, n = struct.unpack_from("<4sI", avi, p)
                if name[2:] in (b"dc", b"db"):
                    rows.append((p + 8, n))
                p += 12 if name == b"LIST" else 8 + n + (n & 1)
            found.append(np.array(rows, np.int64).reshape(-1, 2))
        at = end + (size & 1)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _lookup(codes: dict[tuple[int, int], int], bits: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """By the next bits: the symbol, and its code's length (0: none)."""
    symbol, length = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for (n, code), s in codes.items():
        if n <= bits:
            a = code << (bits - n)
            symbol[a : a + (1 << (bits - n))], length[a : a + (1 << (bits - n))] = s, n
    return symbol, length


_FLAT = _lookup(huffman_codes(_DC_LENGTHS, _DC_SYMBOLS), 5)


def _flat_levels(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (n, 64) of frames with this module's tables, their scans at start to end; and which are sound."""
    n, size = len(start), end - start
    at = np.append(0, np.cumsum(size))
    scan = raw[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    stuffed = np.zeros(len(scan), bool)
    stuffed[1:] = (scan[1:] == 0) & (scan[:-1] == 0xFF)
    gone = np.append(0, np.cumsum(stuffed))
    scan, at = scan[~stuffed], at - gone[at]
    wide = np.append(scan, np.zeros(4, np.uint8)).astype(np.uint32)
    window = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    p, level = at[:-1] * 8, np.zeros(n, np.int64)
    out, sound = np.empty((n, SAMPLES), np.uint8), np.ones(n, bool)
    symbol, length = _FLAT
    top = len(window) - 1
    for k in range(SAMPLES):
        v = (window[np.minimum(p >> 3, top)].astype(np.int64) << (p & 7)) & 0xFFFFFFFF
        prefix = v >> 27
        category, used = symbol[prefix], length[prefix]
        rest = (v << used) & 0xFFFFFFFF
        magnitude = rest >> (32 - category)
        magnitude = np.where(magnitude < (1 << category) >> 1, magnitude - (1 << category) + 1, magnitude)
        level += magnitude
        sound &= (used > 0) & ((rest << category & 0x80000000) == 0)  # the end of block is a zero bit
        out[:, k] = level + 128
        p = p + used + category + 1
    return out, sound & (p <= at[1:] * 8)


def _plain_scan(data: bytes) -> tuple[dict, bytes]:
    """The tables and scan data of a baseline JPEG."""
    info: dict = {"q": {}, "dc": {}, "ac": {}, "restart": 0}
    p = 2
    while p + 4 <= len(data):
        marker, size = data[p + 1], struct.unpack_from(">H", data, p + 2)[0]
        body = data[p + 4 : p + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                info["q"][body[0] & 15] = struct.unpack(">64H", body[1:n]) if wide else tuple(body[1:n])
                body = body[n:]
        elif marker == 0xC0 or marker == 0xC1:
            _, info["height"], info["width"], n = struct.unpack_from(">BHHB", body)
            info["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are intra frames of motion-JPEG")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                info["ac" if body[0] >> 4 else "dc"][body[0] & 15] = _lookup(huffman_codes(body[1:17], body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            info["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            info["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            return info, data[p + 2 + size :]
        p += 2 + size
    raise ValueError("no scan")


def _segments(scan: bytes) -> list[bytes]:
    """The scan between restart markers, without stuffing, up to the next other marker."""
    out, now, p = [], bytearray(), 0
    while p < len(scan):
        q = scan.find(b"\xff", p)
        if q < 0 or q + 1 >= len(scan):
            now += scan[p:]
            break
        now += scan[p:q]
        if scan[q + 1] == 0:
            now.append(0xFF)
        elif 0xD0 <= scan[q + 1] <= 0xD7:
            out.append(bytes(now))
            now = bytearray()
        else:
            break
        p = q + 2
    return [*out, bytes(now)]


def coefficients(data: bytes) -> tuple[dict, np.ndarray]:
    """A baseline frame's header and the dequantised coefficients of its first component: (rows, columns, 64) of blocks."""
    info, scan = _plain_scan(data)
    parts = info["parts"]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        most_h = most_v = 1
    columns, rows = -(-info["width"] // (8 * most_h)), -(-info["height"] // (8 * most_v))
    first = parts[0]
    out = np.zeros((rows * first[2], columns * first[1], 64))
    dc_tables, ac_tables = ({i: _lookup(huffman_codes(*t)) for i, t in enumerate(k)} | info[n] for n, k in (("dc", STANDARD_DC), ("ac", (standard_ac(0), standard_ac(1)))))
    mcu = 0
    for segment in _segments(scan):
        bits, left, p = 0, 0, 0

        def need(n: int) -> int:
            nonlocal bits, left, p
            while left < n:
                bits = (bits << 8 | (segment[p] if p < len(segment) else 0xFF)) & ((1 << 48) - 1)
                p, left = p + 1, left + 8
            return bits >> (left - n) & ((1 << n) - 1)

        def symbol(table) -> int:
            nonlocal left
            k = need(16)
            if not table[1][k]:
                raise ValueError("no such code")
            left -= int(table[1][k])
            return int(table[0][k])

        def value(n: int) -> int:
            nonlocal left
            if not n:
                return 0
            v = need(n)
            left -= n
            return v if v >> (n - 1) else v - (1 << n) + 1

        level = dict.fromkeys((x[0] for x in parts), 0)
        for _ in range(min(info["restart"] or columns * rows, columns * rows - mcu)):
            for name, h, v, quantiser in parts:
                dc, ac = info["tables"][name]
                for y in range(v):
                    for x in range(h):
                        level[name] += value(symbol(dc_tables[dc]))
                        q = info["q"][quantiser]
                        block = np.zeros(64)
                        block[0], k = level[name] * q[0], 1
                        while k < 64:
                            s = symbol(ac_tables[ac])
                            if not s & 15 and s != 0xF0:
                                break
                            k += s >> 4
                            if s != 0xF0:
                                block[ZIGZAG[k]] = value(s & 15) * q[k]
                            k += 1
                        if name == first[0]:
                            out[mcu // columns * v + y, mcu % columns * h + x] = block
            mcu += 1
    return info, out


_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def pixels(data: bytes) -> np.ndarray:
    """A baseline frame's first component, (height, width) of samples 0 to 255, by the inverse cosine transform of its blocks."""
    info, blocks = coefficients(data)
    rows, columns, _ = blocks.shape
    spatial = _COSINES.T @ blocks.reshape(rows, columns, 8, 8) @ _COSINES
    whole = np.clip(np.rint(spatial + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
    (_, h, v, _), parts = info["parts"][0], info["parts"]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        h = v = across = down = 1
    return whole[: -(-info["height"] * v // down), : -(-info["width"] * h // across)]


def _histogram(samples: np.ndarray) -> np.ndarray:
    return np.bincount(samples.ravel() >> 4, minlength=BINS)


@dataclass(frozen=True)
class Frames:
    """samples: (frames, blocks) means of the first component's blocks, where all are flat, else None; histograms: (frames, BINS) of pixels; means: of pixels."""

    samples: np.ndarray | None
    histograms: np.ndarray
    means: np.ndarray

    def __len__(self) -> int:
        return len(self.histograms)


def _flat(samples: np.ndarray) -> Frames:
    """Frames of flat blocks: every block is 64 pixels of its level."""
    n = len(samples)
    bins = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    return Frames(samples, 64 * bins, samples.mean(axis=1))


def decoded(avi: bytes | list[bytes]) -> list[Frames]:
    """The frames of each file."""
    files = [avi] if isinstance(avi, bytes) else avi
    places = [parse(a) for a in files]
    raw = np.frombuffer(b"".join(files), np.uint8)
    base = np.append(0, np.cumsum([len(a) for a in files]))
    at = np.concatenate([p[:, 0] + b for p, b in zip(places, base)]) if files else np.zeros(0, np.int64)
    size = np.concatenate([p[:, 1] for p in places]) if files else at
    head, n = len(_JPEG_HEAD), len(at)
    out = np.zeros((n, SAMPLES), np.uint8)
    plain = np.ones(n, bool)
    for i in range(0, n, _AT_ONCE):
        own = np.flatnonzero(size[i : i + _AT_ONCE] > head + 2) + i
        own = own[(raw[at[own][:, None] + np.arange(head)] == np.frombuffer(_JPEG_HEAD, np.uint8)).all(axis=1)] if len(own) else own
        if len(own):
            out[own], sound = _flat_levels(raw, at[own] + head, at[own] + size[own] - 2)
            plain[own[sound]] = False
    found, a = [], 0
    for p in places:
        b = a + len(p)
        if plain[a:b].any():
            rows = []
            for k in range(a, b):  # the pixels of one frame at a time
                if plain[k]:
                    seen = pixels(raw[at[k] : at[k] + size[k]].tobytes())
                    rows.append((_histogram(seen), seen.mean()))
                else:
                    rows.append((64 * _histogram(out[k]), out[k].mean()))
            found.append(Frames(None, np.stack([h for h, _ in rows]), np.array([m for _, m in rows])))
        else:
            found.append(_flat(out[a:b]))
        a = b
    return found


def shots(histograms: np.ndarray) -> np.ndarray:
    """Where shots start, 0 first, from histograms (frames, BINS) of pixels."""
    n = len(histograms)
    if n < 3:
        return np.zeros(min(n, 1), np.int64)
    # in 64ths of a frame's pixels: frames of any size weigh alike
    d = np.abs(np.diff(histograms * 64 / np.maximum(histograms.sum(axis=1, keepdims=True), 1), axis=0)).sum(axis=1) / 2  # d[i]: between frames i and i + 1
    total, m = np.append(0, np.cumsum(d)), len(d)
    low, high = np.maximum(np.arange(m) - REACH, 0), np.minimum(np.arange(m) + REACH + 1, m)
    around, count = total[high] - total[low] - d, high - low - 1
    peak = (d > np.append(-1, d[:-1])) & (d >= np.append(d[1:], -1))
    cut = peak & (2 * d * count > 3 * around + 2 * FLOOR * count)
    return np.append(0, np.flatnonzero(cut) + 1)


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % SAMPLES or (0 if text else SAMPLES))


_FIELDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "clips": pa.string()}


def timed(frames: Frames) -> list[tuple[int, int, int, int, float]]:
    """(start_frame, end_frame, start_ms, end_ms, mean) of each shot; ends are exclusive."""
    cuts = [*shots(frames.histograms).tolist(), len(frames)]
    return [(a, b, a * 1000 // FPS, b * 1000 // FPS, float(frames.means[a:b].mean())) for a, b in zip(cuts, cuts[1:])]


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t) + SAMPLES
        if size >= _AT_ONCE * SAMPLES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _described(texts: list[bytes]) -> list[tuple]:
    media = stored([payload(t) for t in texts])
    out = []
    for t, avi, frames in zip(texts, media, decoded(media)):
        samples, found = frames.samples, timed(frames)
        back = samples.tobytes()
        feature = f"frames={len(samples)};clips={len(found)};starts={','.join(str(c[0]) for c in found)};mean={int(samples.sum(dtype=np.int64)) * 100 // samples.size}"
        out.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLES:]), len(avi), hashlib.sha256(avi).hexdigest(), feature, ",".join(f"{a}-{b}" for _, _, a, b, _ in found)))
    return out


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, sizes and digests of its payload as read back and of the file, the feature string, and its clips (milliseconds)."""

    def of(text: pa.Array) -> pa.Array:
        rows = [r for g in _groups(binaries(text)) for r in _described(g)]
        columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values())], names=list(_FIELDS))

    udf = F.arrow_udf(of, ", ".join(f"{k} {'string' if pa.types.is_string(t) else 'bigint'}" for k, t in _FIELDS.items())).asNondeterministic()
    return docs.select(F.col(id_col).alias("doc_id"), udf(utf8(text_col)).alias("m")).select("doc_id", "m.*")


def with_media(docs: DataFrame, text_col: str = "text", out: str = "media") -> tuple[DataFrame, str]:
    """docs with the AVI file of each text, a binary column; and that column's name."""
    out = unused(docs, out)
    udf = F.arrow_udf(lambda x: pa.array([m for g in _groups(binaries(x)) for m in stored([payload(t) for t in g])], pa.binary()), "binary").asNondeterministic()
    return docs.withColumn(out, udf(utf8(text_col))), out


_CLIP = "array<struct<clip:int,start_frame:bigint,end_frame:bigint,start_ms:bigint,end_ms:bigint,mean:double>>"


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per shot of each AVI file: id, clip, start_frame, end_frame, start_ms, end_ms (ends exclusive), mean."""

    def of(column: pa.Array) -> pa.Array:
        out = []
        for avi in column.to_pylist():
            found = timed(decoded(avi)[0]) if avi else []
            out.append([dict(zip(("clip", "start_frame", "end_frame", "start_ms", "end_ms", "mean"), (i, *c))) for i, c in enumerate(found)])
        kind = pa.struct([("clip", pa.int32()), ("start_frame", pa.int64()), ("end_frame", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean", pa.float64())])
        return pa.array(out, pa.list_(kind))

    return media.select(F.col(id_col), F.inline(F.arrow_udf(of, _CLIP).asNondeterministic()(F.col(media_col))))
