"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint takes each bit by majority over the XXH64 values of its word shingles. Two
fingerprints link at MAX_DISTANCE or fewer differing bits. To find the links:

1. Bits that are correlated over the distinct fingerprints are grouped into MAX_DISTANCE + 1
   partitions (a 64 x 64 matrix of counts is all that reaches the driver).
2. For each fingerprint, unequal thresholds t_i >= -1 with sum(t_i + 1) = MAX_DISTANCE + 1 are
   chosen by dynamic programming on candidate counts, estimated from histograms of half
   partitions (bounded: 2^11 counters each). Any fingerprint within MAX_DISTANCE then differs in
   at most t_i bits in some partition i.
3. Probes within t_i of the partition's value meet all fingerprints of that value; the pairs are
   verified within buckets of at most BUCKET rows.
4. A larger bucket is not paired out. Its members are dealt again by the values within one bit of
   their remaining bits: two members are within two bits just if they share such a value, so each
   value's few members are linked in a star. That is exact and linear in the bucket's rows.

Components of the links give the classes. Copies share a fingerprint and are never paired.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links
like any other. Fewer words than a shingle: the whole sequence is hashed. A bit that exactly half of the hashes
set is 0. A very long text is read in slices and its hashes are added up part by part. A null id keeps its row;
the class id is the smallest non-null id of the class. Repeated rows stay; further columns do no harm. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import near_copies
from claimloom.llm.common import binaries, stored, unused, utf8, word_slices
from claimloom.llm.components import components

MAX_DISTANCE = 2
#: Buckets of more rows than this are dealt again instead of paired out.
BUCKET = 128
#: What shuffling one probe costs, in verified candidates.
PROBE_COST = 4.0
SEED = 42
_HALF = 11


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of one UTF-8 text, unsigned."""
    ones, total = np.zeros(64, np.int64), 0
    carry: list[bytes] = []
    slices = list(word_slices(text.lower())) if len(text) <= 1 << 20 else word_slices(text.lower())
    for words in slices:
        words = carry + words
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(width)]))]
        if hashes:
            h = np.array(hashes, np.uint64)
            for at in range(0, len(h), 1 << 14):
                part = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        carry = words[-(width - 1) :] if width > 1 else []
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3, out: str = "fingerprint") -> tuple[DataFrame, str]:
    """docs with the fingerprint as a signed long; and that column's name."""
    out = unused(docs, out)

    def of(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, width) for x in binaries(text)], np.uint64).view(np.int64))

    return docs.withColumn(out, F.arrow_udf(of, "bigint").asNondeterministic()(utf8(text_col))), out


def _bits(values: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, bit 0 first."""
    return np.unpackbits(values.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _longs(batch: pa.RecordBatch, i: int = 0) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((64, 64))
    n = 0
    for b in batches:
        x = _bits(_longs(b)).astype(np.float32)
        both += x.T @ x
        n += len(x)
    if n:
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["cell", "n"])


def bit_groups(both: np.ndarray, n: int, parts: int = MAX_DISTANCE + 1) -> list[list[int]]:
    """Bits 0 to 63 in ``parts`` groups of near equal width, correlated bits together (greedily)."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group: list[int] = []
        for _ in range(width):
            rest = sorted(left)
            strength = corr[np.ix_(rest, group)].sum(1) if group else corr[np.ix_(rest, rest)].sum(1)
            group.append(rest[int(np.argmax(strength))])
            left.discard(group[-1])
        groups.append(group)
    return groups


def _values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def _halves(groups: list[list[int]]) -> list[list[int]]:
    return [h for g in groups for h in (g[:_HALF], g[_HALF:])]


def near_counts(counts: np.ndarray, width: int) -> np.ndarray:
    """From a histogram over width-bit values: per value, how many lie at distance 0 and 1."""
    v = np.arange(1 << width)
    return np.stack([counts, sum(counts[v ^ (1 << b)] for b in range(width))])


def allocate(estimates: np.ndarray, widths: list[int]) -> np.ndarray:
    """Thresholds per row and partition, -1 to 1, by dynamic programming.

    estimates: (rows, parts, 2), candidates expected at thresholds 0 and 1. The thresholds plus one
    sum to MAX_DISTANCE + 1 in each row; the sum of candidates and probe costs is least.
    """
    rows, parts, _ = estimates.shape
    budget = MAX_DISTANCE + 1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((rows, parts, budget + 1), np.int8)
    for i in range(parts):
        cost = np.stack([np.zeros(rows), estimates[:, i, 0] + PROBE_COST, estimates[:, i, 1] + PROBE_COST * (1 + widths[i])], axis=1)
        options = np.full((rows, budget + 1, 3), np.inf)
        for e in range(3):
            options[:, e:, e] = best[:, : budget + 1 - e] + cost[:, e : e + 1]
        picks[:, i] = options.argmin(axis=2)
        best = options.min(axis=2)
    thresholds = np.zeros((rows, parts), np.int64)
    left = np.full(rows, budget)
    for i in reversed(range(parts)):
        e = picks[np.arange(rows), i, left]
        thresholds[:, i] = e - 1
        left = left - e
    return thresholds


_PROBE_SCHEMA = "part int, value bigint, fp bigint, away int"


def _probe_rows(fps: np.ndarray, groups: list[list[int]], tables: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """away 0: the fingerprint has the value; 1: it probes a value one bit from its own."""
    bits = _bits(fps)
    values = [_values(bits, g) for g in groups]
    estimates = np.zeros((len(fps), len(groups), 2))
    for i in range(len(groups)):
        low, high = (tables[2 * i + k][:, values[i] >> _HALF if k else values[i] & ((1 << _HALF) - 1)] for k in (0, 1))
        estimates[:, i, 0] = low[0] * high[0] / n
        estimates[:, i, 1] = (low[0] * (high[0] + high[1]) + low[1] * high[0]) / n
    thresholds = allocate(estimates, [len(g) for g in groups])
    for i, g in enumerate(groups):
        yield _batch(i, values[i], fps, 0)
        wide = thresholds[:, i] == 1
        if wide.any():
            flips = np.int64(1) << np.arange(len(g), dtype=np.int64)
            yield _batch(i, (values[i][wide][:, None] ^ flips).ravel(), np.repeat(fps[wide], len(g)), 1)


def _batch(part: int, values: np.ndarray, fps: np.ndarray, away: int) -> pa.RecordBatch:
    const = lambda x: pa.array(np.full(len(values), x, np.int32))
    return pa.RecordBatch.from_arrays([const(part), pa.array(values), pa.array(fps), const(away)], names=["part", "value", "fp", "away"])


def _linked_within(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links (fingerprint, smallest of its class) among the verified pairs of one bucket."""
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= MAX_DISTANCE
    label = fps.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label != fps
    return list(zip(fps[moved].tolist(), label[moved].tolist()))


def _verified(buckets: pa.Array) -> pa.Array:
    out = []
    values, offsets = buckets.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False)))
    for a, b in zip(offsets, offsets[1:]):
        out.append([{"fp": x, "to": y} for x, y in _linked_within(values[a:b])])
    return pa.array(out, pa.list_(pa.struct([("fp", pa.int64()), ("to", pa.int64())])))


def _dealt_again(groups: list[list[int]]):
    """Rows of large buckets by the values within one bit of the remaining bits."""
    masks = [sum(1 << b for b in g) for g in groups]
    singles = [np.array([1 << b for b in range(64) if not m >> b & 1], np.uint64).view(np.int64) for m in masks]
    rest = [np.array([~m & (1 << 64) - 1], np.uint64).view(np.int64)[0] for m in masks]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, value, fp, away = (_longs(b, i) for i in range(4))
            for i in range(len(groups)):
                for own in (0, 1):
                    at = (part == i) & (away == own)
                    if not at.any():
                        continue
                    residual = (fp[at] & rest[i])[:, None]
                    keys = residual if own else np.hstack([residual, residual ^ singles[i]])
                    k = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, i, np.int32)), pa.array(np.repeat(value[at], k)), pa.array(keys.ravel()), pa.array(np.repeat(fp[at], k))], names=["part", "value", "residual", "fp"])

    return deal


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (fp, to) that span the classes of a table of distinct fingerprints, column fp, already stored."""
    cells = {r.cell: r.n for r in fps.mapInArrow(_bit_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # 4097 rows
    n = cells.get(4096, 0)
    groups = bit_groups(np.array([cells.get(i, 0) for i in range(4096)], float).reshape(64, 64), n)
    halves = _halves(groups)

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << len(h), np.int64) for h in halves]
        for b in batches:
            bits = _bits(_longs(b))
            for s, h in zip(sums, halves):
                s += np.bincount(_values(bits, h), minlength=len(s))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(at * 8 + i), pa.array(s[at])], names=["cell", "n"])

    tables = [np.zeros(1 << len(h)) for h in halves]
    for r in fps.mapInArrow(histograms, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 6 x 2^11 rows
        tables[r.cell % 8][r.cell // 8] = r.n
    tables = [near_counts(t, len(h)) for t, h in zip(tables, halves)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _probe_rows(_longs(b), groups, tables, max(n, 1))

    probes = fps.mapInArrow(probe, _PROBE_SCHEMA)
    key = ["part", "value"]
    sizes = probes.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("away").alias("own")).filter("rows > 1 and own = 0")
    held = probes.join(sizes.select(*key, "rows"), key)
    small = held.filter(F.col("rows") <= bucket).groupBy(*key).agg(F.collect_list("fp").alias("fps"))  # at most `bucket` rows each
    verify = F.arrow_udf(_verified, "array<struct<fp:bigint,to:bigint>>").asNondeterministic()
    paired = small.select(F.inline(verify("fps")))
    again = held.filter(F.col("rows") > bucket).select("part", "value", "fp", "away").mapInArrow(_dealt_again(groups), "part int, value bigint, residual bigint, fp bigint")
    # distinct fingerprints within one bit of a value: at most 1 + 64 of them
    stars = again.groupBy("part", "value", "residual").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("to")).filter(F.size("fps") > 1)
    starred = stars.select(F.explode("fps").alias("fp"), "to").filter("fp <> to")
    return paired.union(starred)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Every document's stored fingerprint (doc_id, fp), and each fingerprint's class (fp, component_id)."""
    bare, fp = fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width=width)
    own = stored(bare.select("doc_id", F.col(fp).alias("fp")))
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct.select("fp"), bucket), "fp", "to")
    joined = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return own, joined.join(least, "component").select("fp", "component_id")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    own, by_fp = _classes(docs, id_col, text_col, width, bucket)
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def clustered(docs: DataFrame, text_col: str = "text", width: int = 3, bucket: int = BUCKET, out: str = "cluster") -> tuple[DataFrame, str]:
    """docs, stored without the text, with a long that says each row's class (its least fingerprint); and that column's name."""
    out = unused(docs, out)
    marked, fp = fingerprints(docs, text_col, width, unused(docs, "_fp"))
    own = stored(marked.drop(text_col))
    distinct = stored(own.select(F.col(fp).alias("fp")).distinct())
    found = components(links(distinct, bucket), "fp", "to").select(F.col("node").alias(fp), F.col("component").alias(out))
    return own.join(found, fp, "left").withColumn(out, F.coalesce(out, fp)).drop(fp), out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = near_copies.WIDTH) -> DataFrame:
    """One row of each class of near copies: the one of smallest id (null ids last), ties by a digest of the text, then of the row.

    Classes are those of near_copies: candidates by SimHash (``links``) and by minimum hashes, each verified on shingles; not those of ``classes``. Rows that are equal
    in all columns are one; so each class keeps exactly one row, whatever its ids. Columns of maps don't enter the digest.
    """
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    first, second = unused(docs, "_first"), unused(docs, "_second")
    marked = docs.withColumn(first, F.xxhash64(*plain)).withColumn(second, F.xxhash64(F.lit(1), *plain))
    texts = marked.select(F.col(f"`{id_col}`").alias("id"), F.col(first).alias("first"), F.col(second).alias("second"), utf8(text_col).alias("text"))
    own, by_key = near_copies.classes(texts.withColumn("digest", F.xxhash64("text")), width, near=links)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("digest"), F.col("first"), F.col("second"))
    by_set = own.groupBy("key").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("rows"))
    least = by_set.join(by_key, "key").groupBy("component").agg(F.min("place").alias("place"))
    keep = stored(least.select(F.col("place.first").alias(first), F.col("place.second").alias(second)))
    kept = marked.join(keep, [first, second], "left_semi")
    twice = own.groupBy(F.col("first").alias(first), F.col("second").alias(second)).count().filter("count > 1")
    if keep.join(twice, [first, second], "left_semi").limit(1).count():  # equal rows: any of them is the same row
        kept = kept.dropDuplicates([first, second])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
