"""The least of the texts within a share of edits, exact: filters that lose no pair, then the distance itself.

Edits are counted in bytes of UTF-8, lengths in characters, as DuckDB's ``levenshtein`` and ``length`` do. Two texts are
near if their edits are at most ``most`` of the longer one's length. Let ``e`` be the edits allowed to a pair:

* lengths differ by at most ``e``, in bytes and in characters;
* of the bytes of either, counted in 64 classes, at most ``e`` are not in the other;
* an edit touches at most 4 grams of 4 bytes, and what is moved by ``s`` bytes has ``|s|`` edits before it and as many after it
  as bring it to the other's end. So of the distinct grams in each window of one, all windows together, at most ``4 e`` are
  missing from the other's windows within that reach. Grams are hashed to bits; a collision hides a loss and never makes one.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np

GRAM, WINDOW, BITS = 4, 32, 2048  # _windows reads 4 bytes
#: Pairs, and windows of pairs, that are looked at together.
PAIRS, ROWS = 1 << 18, 1 << 14


def distance(a: bytes, b: bytes, most: int) -> int:
    """The edits from a to b, or some number above ``most`` if they are more (Myers' bit vectors over a)."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return max(len(a), len(b)) - n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    k = int(x.argmax())
    a, b, n = a[k:], b[k:], n - k
    if a[len(a) - n :] == b[len(b) - n :]:
        return max(len(a), len(b)) - n
    x = np.frombuffer(a, np.uint8)[len(a) - n :] != np.frombuffer(b, np.uint8)[len(b) - n :]
    k = int(x[::-1].argmax())
    a, b = a[: len(a) - k], b[: len(b) - k]
    at: dict[int, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d, left = whole, 0, len(a), len(b)
    for c in b:
        eq = at.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (whole & ~(h | up)), up & h
        left -= 1
        if more & last:
            d += 1
        elif less & last:
            d -= 1
        if d - left > most:
            return d - left
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | (whole & ~(v | more)), more & v
    return d


def _letters(texts: Sequence[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.repeat(np.arange(len(texts)) * 64, size) + (np.frombuffer(b"".join(texts), np.uint8) & 63)
    return np.bincount(at, minlength=len(texts) * 64).reshape(-1, 64).astype(np.int16 if size.max(initial=0) < 1 << 15 else np.int64)


def _windows(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, first, n): a row of bits for each window of grams, each text's first row and number of rows; the last row is zero."""
    grams = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)) - GRAM + 1, 0)
    n = -(-grams // WINDOW)
    first = np.cumsum(n) - n
    bits = np.zeros((int(n.sum()) + 1, BITS // 64), np.uint64)
    for k, x in enumerate(texts):
        if not grams[k]:
            continue
        b = np.frombuffer(x, np.uint8).astype(np.uint32)
        m = int(grams[k])
        code = b[:m] | b[1 : m + 1] << np.uint32(8) | b[2 : m + 2] << np.uint32(16) | b[3 : m + 3] << np.uint32(24)
        h = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS.bit_length() + 1)
        flags = np.zeros((int(n[k]), BITS), np.bool_)
        flags[np.arange(m) // WINDOW, h] = True
        bits[first[k] : first[k] + n[k]] = np.packbits(flags, axis=1).view(np.uint64)
    return bits, first, n


def _alike(texts: Sequence[bytes], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether pairs pass the windows' filter, from either side."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    bits, first, n = _windows([texts[k] for k in used])
    size = np.fromiter((len(texts[k]) for k in used), np.int64, len(used))
    pairs, keep = np.arange(len(i)), np.ones(len(i), bool)
    for a, b in ((back[: len(i)], back[len(i) :]), (back[len(i) :], back[: len(i)])):
        pairs = pairs[keep[pairs]]
        keep[pairs] = _lost(bits, first, n, a[pairs], b[pairs], (size[b] - size[a])[pairs], most[pairs]) <= GRAM * most[pairs]
    return keep


def _lost(bits: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, longer: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The bits of a's windows that aren't in b's windows within reach: to move by s and end ``longer`` off takes |s| + |longer - s| edits."""
    spare = (most - np.abs(longer)) // 2
    left, right = (np.minimum(longer, 0) - spare) // WINDOW, -(-(np.maximum(longer, 0) + spare) // WINDOW)
    lost, ends, lo = np.zeros(len(a), np.int64), np.cumsum(n[a]), 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[a[lo]] + ROWS, "right")))
        p = np.repeat(np.arange(lo, hi), n[a[lo:hi]])
        k = np.arange(len(p)) - (ends - n[a])[p] + (ends[lo] - n[a[lo]])
        near = np.zeros((len(p), bits.shape[1]), np.uint64)
        for d in range(int(left[lo:hi].min()), int(right[lo:hi].max()) + 1):
            there = (k + d >= 0) & (k + d < n[b[p]]) & (left[p] <= d) & (d <= right[p])
            near |= bits[np.where(there, first[b[p]] + k + d, len(bits) - 1)]
        gone = np.bitwise_count(bits[first[a[p]] + k] & ~near).sum(1, dtype=np.int64)
        lost[lo:hi] = np.bincount(p - lo, gone, hi - lo)
        lo = hi
    return lost


def least_near(texts: Sequence[bytes], chars: np.ndarray, start: np.ndarray, most: float, part: np.ndarray | None = None) -> np.ndarray:
    """For each text the index of the least near one of its group, itself included.

    Groups lie together, their texts distinct and ascending; ``start`` has each text's group's first index. Where ``part``
    is given, texts of equal parts aren't compared.
    """
    share = Fraction(str(most))
    out = np.arange(len(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars, start = np.asarray(chars, np.int64), np.asarray(start, np.int64)
    letters = _letters(texts)
    before = out - start
    ends = np.cumsum(before)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - before[lo] + PAIRS, "right")))
        j = np.repeat(np.arange(lo, hi), before[lo:hi])
        i = np.arange(len(j)) - np.repeat(ends[lo:hi] - before[lo:hi] - (ends[lo] - before[lo]) - start[lo:hi], before[lo:hi])
        edits = np.maximum(chars[i], chars[j]) * share.numerator // share.denominator
        keep = (np.abs(chars[i] - chars[j]) <= edits) & (np.abs(size[i] - size[j]) <= edits)
        if part is not None:
            keep &= part[i] != part[j]
        i, j, edits = i[keep], j[keep], edits[keep]
        more = letters[i] - letters[j]
        gone = np.maximum(more, 0).sum(1, dtype=np.int64)
        keep = np.maximum(gone, gone - more.sum(1, dtype=np.int64)) <= edits
        i, j, edits = i[keep], j[keep], edits[keep]
        for x, y in zip(i.tolist(), j.tolist()):  # in order of j and i; a beginning is near, as lengths are
            if out[y] == y and texts[y].startswith(texts[x]):
                out[y] = x
        keep = i < out[j]
        i, j, edits = i[keep], j[keep], edits[keep]
        if len(i):
            keep = _alike(texts, i, j, edits)
            for x, y, e in zip(i[keep].tolist(), j[keep].tolist(), edits[keep].tolist()):
                if x < out[y] and distance(texts[x], texts[y], e) <= e:
                    out[y] = x
        lo = hi
    return out
