"""A trigram language model with deleted interpolation, learnt and applied over blocks of documents.

Tokens are the lower-cased words and one end per document, which is also both words before the first one.
With c the counts of the training documents, N their tokens and V their distinct tokens,

    P1(w) = l1 c(w) / N + (1 - l1) / (V + 1)
    P2(w | u) = l2 c(u, w) / c(u) + (1 - l2) P1(w)
    P3(w | t, u) = l3 c(t, u, w) / c(t, u) + (1 - l3) P2(w | u)

where l3 and l2 depend on the bucket of the context's frequency, a power of two, however large; an unseen
context has weight 0. The weights are learnt by expectation-maximisation: one part of the training documents
is held out, its own counts are deleted from all others, and the weights are those that make its tokens
likeliest. Every round sums the shares of all held-out tokens, until they gain less than GAIN nats a token.

How it is computed: documents are gathered into blocks of about BLOCK_TOKENS tokens, stored once.
A block sends each distinct n-gram (a hash of 56 bits; 64 for a word) with its count to the bucket of its hash;
buckets add up the counts of all blocks and send them back in the block's order. So a shuffle holds an
n-gram once per block, in sorted arrays (differences, byte planes, zstd), no word or document is hot, and
both sides work in numpy. One pass sends one order, and of a corpus of more than GROUP_TOKENS tokens the hashes
that share their top bits, in up to PASSES passes; a pass's shuffle and tables are removed before the next, so the disk holds the
blocks, the sums so far and one pass. In a pass a block never sends more than 2^CUT messages: where a pass has more than
GROUP_TOKENS tokens, its blocks first add up in groups, whose sums go on as the blocks of the next
level, cut by the next bits of the hash, and the totals come back the same way. Messages so grow
in proportion to the corpus times its number of levels, the logarithm of its size to the base 2^CUT. The part that
fits the weights lies in blocks of its own.

Defined cases: a null or empty text is its end alone. Null ids count as the text "" for the split into
training and held-out documents; rows keep their ids; repeated rows are counted as often as they come. A very long
text is read in slices and makes a block longer. Further columns aren't read, whatever their names. Without training
documents N and V are 0 and every token has the base's probability, 1 / (V + 1). No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import dropped, shuffles_removed, stored, utf8, word_slices, workspace

BLOCK_TOKENS = 1 << 20
#: Tokens for each bucket of n-grams.
BUCKET_TOKENS = 1 << 21
#: Bits of the hash by which a level is cut, and tokens whose blocks add up in one group.
CUT = 8
GROUP_TOKENS = BLOCK_TOKENS << CUT
#: Passes of an order at most, a power of two.
PASSES = 8
#: Tasks of a shuffle at most; beyond, a task takes several buckets, one after the other.
TASKS = 100_000
FOLDS, HELD_OUT, DELETED = 7, 2, 0
#: A count of 64 bits has one of so many buckets: 0, or 1 + floor(log2 c).
BUCKETS = 65
DEFAULT = 0.5
GAIN = 1e-5
ORDERS = (1, 2, 3)
_END = np.uint64(xxhash.xxh64_intdigest(b""))
_BLOCK_SCHEMA = "block bigint, deleted boolean, doc_ids array<bigint>, roles binary, lengths binary, words binary, stream binary"
TRAIN, TRAIN_DELETED, SCORED = 1, 2, 0


def role(doc_id: int | None) -> int:
    """SCORED for a held-out document, TRAIN_DELETED for the training documents that fit the weights, else TRAIN."""
    r = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
    return SCORED if r == HELD_OUT else TRAIN_DELETED if r == DELETED else TRAIN


def _packed(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


class _Gathering:
    """Documents of one kind on their way into a block."""

    def __init__(self, deleted: bool):
        self.deleted = deleted
        self.ids: list = []
        self.lengths: list[int] = []
        self.streams: list[np.ndarray] = []
        self.held = 0
        self.local: defaultdict[bytes, int] = defaultdict(count().__next__)

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for words in word_slices(text.lower()):
            self.streams.append(np.fromiter(map(self.local.__getitem__, words), "<u4", len(words)))
            n += len(words)
        self.streams.append(np.array([self.local[b""]], "<u4"))
        self.ids.append(doc_id)
        self.lengths.append(n + 1)
        self.held += n + 1

    def block(self, number: int) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.local), np.uint64, len(self.local))
        row = [[number], [self.deleted], [self.ids], [bytes(map(role, self.ids))], [_packed(np.array(self.lengths, "<u8"))], [_packed(hashes)], [_packed(np.concatenate(self.streams))]]
        types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=["block", "deleted", "doc_ids", "roles", "lengths", "words", "stream"])


def _blocks(block_tokens: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 24)
        kinds = [_Gathering(False), _Gathering(True)]
        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                k = role(d) == TRAIN_DELETED
                kinds[k].add(d, text.as_py())
                if kinds[k].held >= block_tokens:
                    yield kinds[k].block(next(number))
                    kinds[k] = _Gathering(k)
        for k in kinds:
            if k.ids:
                yield k.block(next(number))

    return gather


class Block:
    """A block's tokens and n-grams as arrays."""

    def __init__(self, roles: bytes, lengths: bytes, words: bytes, stream: bytes):
        self.lengths = _unpacked(lengths, "<u8").astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))[:-1]
        self.roles = np.repeat(np.frombuffer(roles, np.uint8), self.lengths)
        self.words = _unpacked(words, "<u8")
        self.stream = _unpacked(stream, "<u4")
        self.end = int(np.flatnonzero(self.words == _END)[0])
        self.before = np.append(np.uint32(self.end), self.stream[:-1])  # each document follows an end

    def hashes(self, order: int) -> np.ndarray:
        """A hash of each token with the one before it, or the two."""
        with np.errstate(over="ignore"):
            x = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9)
            x = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ self.words[self.stream]
            if order == 3:
                first = np.append(np.uint32(self.end), self.before[:-1])
                first[self.starts] = self.end
                x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + self.words[first] * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ x >> np.uint64(32)) & ~np.uint64(0xFF)  # 56 bits: a byte less for each n-gram that is sent

    def placed(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys ascending, and each token's place among them."""
        if order > 1:
            return np.unique(self.hashes(order), return_inverse=True)
        rank = np.argsort(self.words)
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        return self.words[rank], place[self.stream]

    def counted(self, order: int, pre: int, done: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys whose first ``done`` bits are pre, ascending, and how often training has each."""
        train = self.roles > 0
        if order > 1 and done:
            own = self.hashes(order)
            at = own >> np.uint64(64 - done) == pre
            keys, where = np.unique(own[at], return_inverse=True)
            return keys, np.bincount(where[train[at]], minlength=len(keys))
        keys, where = self.placed(order)
        counts = np.bincount(where[train], minlength=len(keys))
        at = keys >> np.uint64(64 - done) == pre if done else slice(None)
        return keys[at], counts[at]


def _batch(names: str, kinds: list, *rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names.split())


_SENT, _SENT_KINDS = "src pre sub ord keys counts gone", [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 3
_SENT_SCHEMA = "src bigint, pre bigint, sub bigint, ord int, keys binary, counts binary, gone binary"


def _cut(src: int, pre: int, order: int, keys: np.ndarray, counts: np.ndarray, gone: np.ndarray | None, done: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys that share their first ``done`` bits, a message for each value of the next ``bits``; gone: the held-out part's counts."""
    start = int(pre) << (64 - done) if done else 0
    edges = [start + (k << (64 - done - bits)) for k in range(1 << bits)]
    cuts = np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[k], cuts[k + 1])
        lost = None if gone is None else _packed(gone[at].astype("<u8"))
        yield _batch(_SENT, _SENT_KINDS, [src, pre, k, order, _packed(np.diff(keys[at], prepend=np.uint64(0))), _packed(counts[at].astype("<u8")), lost])


def _sent(order: int, pre: int, done: int, bits: int):
    """A block's n-grams of an order whose first ``done`` bits are pre, a row for each bucket (the next bits of the hash)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = Block(row["roles"], row["lengths"], row["words"], row["stream"])
                keys, counts = block.counted(order, pre, done)
                yield from _cut(row["block"], pre, order, keys, counts, counts if row["deleted"] else None, done, bits)

    return send


def _sent_on(done: int, bits: int):
    """The same for the sums of a group of blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys = np.cumsum(_unpacked(r["keys"], "<u8"), dtype=np.uint64)
                yield from _cut(r["src"], r["pre"], r["ord"], keys, _unpacked(r["counts"], "<u8"), None if r["gone"] is None else _unpacked(r["gone"], "<u8"), done, bits)

    return send


def _sums(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct keys of messages, each message's places among them, and the sums of counts and of the held-out part."""
    keys = [np.cumsum(_unpacked(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("keys")]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    places = [place[a:b] for a, b in zip(cuts, cuts[1:])]
    total, gone = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for p, c, g in zip(places, table.column("counts"), table.column("gone")):
        total[p] += _unpacked(c.as_py(), "<u8").astype(np.int64)  # the keys of a message are distinct
        if g.is_valid:
            gone[p] += _unpacked(g.as_py(), "<u8").astype(np.int64)
    return every, places, total, gone


_BACK, _BACK_KINDS = "src pre sub ord counts gone kinds left", [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 2 + [pa.int64()] * 2
_BACK_SCHEMA = "src bigint, pre bigint, sub bigint, ord int, counts binary, gone binary, kinds bigint, left bigint"


def _returned(table: pa.Table, places: list[np.ndarray], total: np.ndarray, gone: np.ndarray, kinds: int, left: int) -> pa.Table:
    rows = []
    for i, (r, p) in enumerate(zip(table.select(["src", "pre", "sub", "ord", "gone"]).to_pylist(), places)):
        lost = None if r["gone"] is None else _packed(gone[p].astype("<u8"))
        rows.append([r["src"], r["pre"], r["sub"], r["ord"], _packed(total[p].astype("<u8")), lost, 0 if i else kinds, 0 if i else left])
    return pa.Table.from_batches([_batch(_BACK, _BACK_KINDS, *rows)])


def _added(table: pa.Table) -> pa.Table:
    """Sums of one bucket over all blocks, back in each block's order; kinds: distinct keys that training has (left: without the held-out part)."""
    _, places, total, gone = _sums(table)
    return _returned(table, places, total, gone, int((total > 0).sum()), int((total > gone).sum()))


def _merged(bits: int):
    """One row of sums for a group's messages in a bucket."""

    def merge(table: pa.Table) -> pa.Table:
        every, _, total, gone = _sums(table)
        head = [table.column(c)[0].as_py() for c in ("grp", "pre", "sub", "ord")]
        row = [head[0], (head[1] << bits) | head[2], 0, head[3], _packed(np.diff(every, prepend=np.uint64(0))), _packed(total.astype("<u8")), _packed(gone.astype("<u8")) if gone.any() else None]
        return pa.Table.from_batches([_batch(_SENT, _SENT_KINDS, row)])

    return merge


def _handed_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """Totals of a group's sums, back to its messages."""
    right = right.sort_by("sub")
    join = lambda name: np.concatenate([_unpacked(x.as_py(), "<u8").astype(np.int64) for x in right.column(name)])
    _, places, total, _ = _sums(left)
    gone = join("gone") if right.column("gone").null_count == 0 else np.zeros(len(total), np.int64)
    return _returned(left, places, join("counts"), gone, sum(right.column("kinds").to_pylist()), sum(right.column("left").to_pylist()))


def _tasks(n: int) -> int:
    return max(1, min(n, TASKS))


def _totals(sent: DataFrame, tokens: int, bits: int, done: int, prefixes: int, sizes: tuple[int, int, int], scratch: str) -> DataFrame:
    """The messages' counts over the whole corpus.

    tokens: of one prefix of ``done`` bits; prefixes: how many of those there are; sizes: tokens of a bucket and of a group, and bits of a cut;
    scratch: a folder for the tables between, which may go once the counts are stored.
    """
    _, group, _ = sizes
    buckets = prefixes << bits
    if tokens <= group:
        return sent.repartition(_tasks(buckets), "pre", "sub", "ord").groupBy("pre", "sub", "ord").applyInArrow(_added, _BACK_SCHEMA)
    groups = -(-tokens // group)
    messages = stored(sent.withColumn("grp", F.pmod(F.xxhash64("src"), F.lit(groups))), f"{scratch}/messages-{done}")
    key = ["grp", "pre", "sub", "ord"]
    merged = stored(messages.repartition(_tasks(buckets * groups), *key).groupBy(*key).applyInArrow(_merged(bits), _SENT_SCHEMA), f"{scratch}/merged-{done}")
    done, tokens = done + bits, -(-tokens >> bits)
    following = _bits(tokens, sizes)
    totals = _totals(merged.mapInArrow(_sent_on(done, following), _SENT_SCHEMA), tokens, following, done, buckets, sizes, scratch)
    # a group's sums have the bucket of their messages as their prefix
    down = messages.withColumn("to", F.shiftleft(F.col("pre"), bits).bitwiseOR(F.col("sub"))).groupBy("grp", "to", "ord")
    return down.cogroup(totals.groupBy("src", "pre", "ord")).applyInArrow(_handed_down, _BACK_SCHEMA)


def _passes(tokens: int, group: int, most: int) -> int:
    """Bits of the hash by which an order is cut into passes."""
    return min(max(0, int(-(-tokens // group) - 1).bit_length()), most.bit_length() - 1)


def _counted(blocks: DataFrame, tokens: int, passes: int, sizes: tuple[int, int, int]) -> DataFrame:
    """The stored counts of all n-grams in their blocks' order, pass by pass."""
    spark, folder = blocks.sparkSession, workspace(blocks.sparkSession)
    done = _passes(tokens, sizes[1], passes)
    part = -(-tokens >> done)
    bits = _bits(part, sizes)
    written = []
    for order in ORDERS:
        for pre in range(1 << done):
            scratch = workspace(spark)
            with shuffles_removed(spark):
                counts = _totals(blocks.mapInArrow(_sent(order, pre, done, bits), _SENT_SCHEMA), part, bits, done, 1, sizes, scratch)
                written.append(f"{folder}/{order}-{pre}")
                stored(counts, written[-1])
            dropped(spark, scratch)
    return spark.read.schema(_BACK_SCHEMA).parquet(*written)


def _bits(tokens: int, sizes: tuple[int, int, int]) -> int:
    bucket, group, cut = sizes
    return cut if tokens > group else max(0, int(-(-tokens // bucket) - 1).bit_length())


def _joined(left: pa.Table, right: pa.Table, columns: tuple[str, ...] = ("counts",)) -> tuple[dict, Block, list[list[np.ndarray]]]:
    """A block's row, its arrays, and for each order each token's numbers of the given columns."""
    row = left.to_pylist()[0]
    block = Block(row["roles"], row["lengths"], row["words"], row["stream"])
    cells = sorted(right.select(["pre", "sub", "ord", *columns]).to_pylist(), key=lambda r: (r["pre"], r["sub"]))
    out = []
    for order in ORDERS:
        where = block.placed(order)[1]
        own = [c for c in cells if c["ord"] == order]
        out.append([np.concatenate([_unpacked(c[x], "<u8") for c in own]).astype(np.int64)[where] for x in columns])
    return row, block, out


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 c)."""
    exact = np.frexp(c.astype(np.float64))[1].astype(np.int64)
    return exact - ((c > 0) & (c >> np.maximum(exact - 1, 0) == 0))  # less one where a count was rounded up to a power of two


def _shares(block: Block, c: list[np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """Each token's maximum-likelihood estimates of orders 3, 2 and 1, and the buckets of its two contexts."""
    c1, c2, c3 = c
    by_word = np.zeros(len(block.words), np.int64)
    by_word[block.stream] = c1
    cu = by_word[block.before]  # the end is in every block
    ctu = np.append(0, c2[:-1])
    ctu[block.starts] = by_word[block.end]
    return c3 / np.maximum(ctu, 1), c2 / np.maximum(cu, 1), c1 / max(n, 1), context_bucket(ctu), context_bucket(cu)


@dataclass(frozen=True)
class Weights:
    """by_order: the weight of order 3 and of order 2 by the context's bucket (2, BUCKETS); of order 1; the counts they go with."""

    by_order: np.ndarray
    first: float
    tokens: int
    kinds: int


def start_weights() -> np.ndarray:
    """Order 3 by bucket, order 2 by bucket, order 1."""
    w = np.full(2 * BUCKETS + 1, DEFAULT)
    w[0] = w[BUCKETS] = 0.0
    return w


def expected(p3, p2, p1, b3, b2, w: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For each weight, how often it chose and how often it took its order, expected over tokens; and the tokens' log-likelihood."""
    l3, l2, l1 = w[b3], w[BUCKETS + b2], w[-1]
    low1 = l1 * p1 + (1 - l1) / (kinds + 1)
    low2 = l2 * p2 + (1 - l2) * low1
    p = l3 * p3 + (1 - l3) * low2
    took3 = l3 * p3 / p
    left = 1 - took3
    took2 = left * l2 * p2 / low2
    left2 = left - took2
    asked = np.concatenate([np.bincount(b3, minlength=BUCKETS), np.bincount(b2, left, BUCKETS), [left2.sum()]])
    took = np.concatenate([np.bincount(b3, took3, BUCKETS), np.bincount(b2, took2, BUCKETS), [(left2 * l1 * p1 / low1).sum()]])
    return asked, took, float(np.log(p).sum())


def improved(asked: np.ndarray, took: np.ndarray) -> np.ndarray:
    """The next weights; one choice of the default's keeps a sparse bucket's weight off zero and one."""
    w = (took + DEFAULT) / (asked + 1)
    w[0] = w[BUCKETS] = 0.0
    return w


_HELD_SCHEMA = "p3 binary, p2 binary, p1 binary, b3 binary, b2 binary"


def _held_out(n: int):
    """A held-out block's estimates, without its own part's counts."""

    def shares(left: pa.Table, right: pa.Table) -> pa.Table:
        _, block, numbers = _joined(left, right, ("counts", "gone"))
        *p, b3, b2 = _shares(block, [c - d for c, d in numbers], n)
        data = [*(_packed(x) for x in p), _packed(b3.astype(np.uint8)), _packed(b2.astype(np.uint8))]
        return pa.table({name: pa.array([x], pa.binary()) for name, x in zip(("p3", "p2", "p1", "b3", "b2"), data)})

    return shares


def _expectations(w: np.ndarray, kinds: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, took, gain = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.0
        for b in batches:
            for row in b.to_pylist():
                p = [_unpacked(row[x], "<f8") for x in ("p3", "p2", "p1")]
                a, t, g = expected(*p, _unpacked(row["b3"], "<u1").astype(np.int64), _unpacked(row["b2"], "<u1").astype(np.int64), w, kinds)
                asked[:-1] += a
                took[:-1] += t
                asked[-1] += len(p[0])
                took[-1] += g
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w) + 1)), pa.array(asked), pa.array(took)], names=["i", "asked", "took"])

    return add


def fit_weights(held: DataFrame, kinds: int) -> np.ndarray:
    """EM over all held-out tokens; a round brings 2 * BUCKETS + 2 rows to the driver."""
    w, last = start_weights(), None
    while True:
        rows = held.mapInArrow(_expectations(w, kinds), "i bigint, asked double, took double").groupBy("i").agg(F.sum("asked").alias("asked"), F.sum("took").alias("took")).orderBy("i").collect()
        if not rows or not rows[-1].asked:
            return w
        *sums, (_, n, now) = rows
        w = improved(np.array([r.asked for r in sums]), np.array([r.took for r in sums]))
        if last is not None and now - last < GAIN * n:
            return w
        last = now


def _scores(w: Weights):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, block, numbers = _joined(left, right)
        c = [x for (x,) in numbers]
        p3, p2, p1, b3, b2 = _shares(block, c, w.tokens)
        l3, l2 = w.by_order[0][b3], w.by_order[1][b2]
        first = w.first if w.tokens else 0.0
        model = np.log10(l3 * p3 + (1 - l3) * (l2 * p2 + (1 - l2) * (first * p1 + (1 - first) / (w.kinds + 1))))
        base = np.log10((c[0] + 1) / (w.tokens + w.kinds + 1))
        add = lambda x: np.add.reduceat(x, block.starts)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array([r == SCORED for r in row["roles"]]),
                "n_tokens": pa.array(block.lengths),
                "n_known": pa.array(add((c[0] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(block.starts), w.tokens)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(model)),
            }
        )

    return score


_SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


@dataclass(frozen=True)
class Model:
    blocks: DataFrame
    n_blocks: int
    counts: DataFrame
    weights: Weights


def _paired(blocks: DataFrame, counts: DataFrame, n: int):
    return blocks.repartition(_tasks(n), "block").groupBy("block").cogroup(counts.withColumnRenamed("src", "block").repartition(_tasks(n), "block").groupBy("block"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS, group_tokens: int = GROUP_TOKENS, cut: int = CUT, passes: int = PASSES) -> Model:
    """Blocks and their n-grams' counts, stored, and the weights."""
    spark = docs.sparkSession
    sizes = (bucket_tokens, group_tokens, cut)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(block_tokens), _BLOCK_SCHEMA))
    n_blocks = blocks.count()
    sums = blocks.select("roles", "lengths").mapInArrow(_role_sums, "role int, n bigint").groupBy("role").agg(F.sum("n").alias("n")).collect()  # three rows
    by_role = {r.role: r.n for r in sums}
    tokens, train = sum(by_role.values()), by_role.get(TRAIN, 0) + by_role.get(TRAIN_DELETED, 0)
    counts = _counted(blocks, tokens, passes, sizes)
    kinds = counts.filter("ord = 1").agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("left"), F.lit(0)).alias("left")).first()
    folder = workspace(spark)
    with shuffles_removed(spark):
        held = stored(_paired(blocks.filter("deleted"), counts.filter("gone IS NOT NULL").select("src", "pre", "sub", "ord", "counts", "gone"), n_blocks).applyInArrow(_held_out(by_role.get(TRAIN, 0)), _HELD_SCHEMA), folder)
    w = fit_weights(held, kinds.left)
    dropped(spark, folder)
    return Model(blocks, n_blocks, counts, Weights(w[:-1].reshape(2, BUCKETS), float(w[-1]), train, kinds.kinds))


def _role_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(3, np.int64)
    for b in batches:
        for roles, lengths in zip(b.column("roles"), b.column("lengths")):
            sums += np.bincount(np.frombuffer(roles.as_py(), np.uint8), _unpacked(lengths.as_py(), "<u8"), 3).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(sums)], names=["role", "n"])


def scored(model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return _paired(model.blocks, model.counts.select("src", "pre", "sub", "ord", "counts"), model.n_blocks).applyInArrow(_scores(model.weights), _SCORE_SCHEMA)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the training documents of docs and scores all of them."""
    return scored(learn(docs, id_col, text_col))
