"""Near copies by exact similarity of word shingles.

Two texts are linked where the Jaccard similarity of their sets of WIDTH-word shingles is at least
SIMILAR. To find the links without comparing all pairs:

1. Texts of equal sets are one. Each set gets BANDS values, each made of ROWS minimum hashes. Two sets
   of similarity s share a value with probability 1 - (1 - s^ROWS)^BANDS, 0.9993 at 0.8.
2. Sets that share a value are candidates: all pairs of up to BUCKET sets. So are sets whose SimHash fingerprints are
   equal or linked by ``near`` (simhash.links: two bits or fewer, by the generalised pigeonhole principle), each with its class's pivot.
   Those alone are not enough: sets of similarity 0.8 are expected to differ in some 10 of 64 bits.
3. Candidates are verified on the sets themselves, and components of the links give the classes.
4. In a larger bucket only links between different classes matter. Each set is first a candidate with the
   bucket's pivot; then, round by round, the sets outside the bucket's largest class are candidates with PIVOTS to
   twice as many new pivots, as long as that halves their number; those that are left are compared with the whole bucket,
   blocks of sets with blocks of sets, each pair in the first of its buckets only, by a sketch of a byte of each
   minimum hash; pairs that agree in a share of at least AGREE are verified at once (a pair at 0.8 falls below it with
   probability 1e-9), and only links leave a block. So no link between classes is lost in a bucket of any size,
   and no task holds a bucket.

A shingle is known by its 64-bit hash, and so is a set.

Defined cases: a null or empty text, or one of white space only, has the empty set; all of those are copies.
Fewer words than a shingle: the whole sequence is one shingle. A very long text is read in slices. Similarity
of exactly 0.8 links. Ids play no part, so null and repeated ids do no harm. No rows give no classes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import binaries, stored, utf8, word_slices
from claimloom.llm.components import components

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 6
#: Larger buckets go by pivots and blocks.
BUCKET = 64
PIVOTS = 8
AGREE = 0.6
SEED = 42
_PART = 1 << 12
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    parts, carry = [np.zeros(0, np.uint64)], []
    for words in word_slices(text.lower()):
        words = carry + words
        parts.append(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(width)]))], np.uint64))
        carry = words[-(width - 1) :] if width > 1 else []
    if not any(map(len, parts)) and carry:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64))
    return np.unique(np.concatenate(parts))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _PART):
        np.minimum(least, (hashes[at : at + _PART, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """The values by which a set meets its candidates."""
    return [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def sketch(least: np.ndarray) -> bytes:
    """A byte of each minimum hash."""
    return least.view(np.uint8)[3::8].tobytes()


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set: the bits that more than half of its hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        ones += np.unpackbits(hashes[at : at + _PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(rows: list) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketched(text: pa.Array, width: int) -> pa.Array:
    keys, prints, values, sketches = [], [], [], []
    for x in binaries(text):
        s = shingles(x, width)
        least = least_hashes(s)
        keys.append(_key(s))
        prints.append(fingerprint(s))
        values.append(bands(least) if len(s) else [])
        sketches.append(sketch(least))
    return pa.StructArray.from_arrays([_signed(keys), _signed(prints), _lists(values), pa.array(sketches, pa.binary())], names=["key", "fp", "bands", "sketch"])


def _hashed(text: pa.Array, width: int) -> pa.Array:
    sets = [shingles(x, width) for x in binaries(text)]
    return pa.StructArray.from_arrays([_signed([_key(s) for s in sets]), _lists(sets)], names=["key", "hashes"])


def _udf(of, kind: str, width: int):
    return F.arrow_udf(lambda text: of(text, width), kind).asNondeterministic()


def _pairs_of(keys: Column) -> Column:
    """All pairs (a, b) of a short sorted array."""
    return F.flatten(F.transform(keys, lambda a, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b")


def _pivot(turn: int) -> Column:
    """The key of smallest hash; the same in most buckets of a group, so that candidates repeat and are verified once."""
    return F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), F.col("key").alias("key"))


def by_fingerprint(distinct: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates (a, b) by SimHash: the sets of a fingerprint with their pivot, and the pivots of fingerprints that near links."""
    of = stored(distinct.groupBy("fp").agg(F.min(_pivot(0))["key"].alias("pivot")))
    same = distinct.select("key", "fp").join(of, "fp")
    other = of.select(F.col("fp").alias("to"), F.col("pivot").alias("other"))
    return _ordered(same, "key", "pivot").union(_ordered(near(of.select("fp")).join(of, "fp").join(other, "to"), "pivot", "other"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""
    a, b = (sets.select(F.col("key").alias(x), F.col("hashes").alias(f"in_{x}")) for x in "ab")
    both = F.size(F.array_intersect("in_a", "in_b"))
    alike = both >= F.lit(SIMILAR) * (F.size("in_a") + F.size("in_b") - both)
    return pairs.join(a, "a").join(b, "b").filter(alike).select("a", "b")


def _across(table: pa.Table) -> pa.Table:
    """The links between two blocks of a bucket: for each set outside the largest class, one to every other class that it is similar to."""
    sides = []
    for side in (True, False):
        t = table.filter(pc.equal(table.column("outer"), side))
        longs = [t.column(c).to_numpy() for c in ("key", "label")]
        bands_of = np.array(t.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        sides.append((*longs, bands_of, sketches, [np.array(x, np.int64) for x in t.column("hashes").to_pylist()]))
    (keys, labels, own, sketches, sets), (others, their, bands_of, seen, other_sets) = sides
    value, out = table.column("value")[0].as_py(), []
    for i in range(len(keys)):
        common = own[i] == bands_of
        first = own[i][common.argmax(axis=1)]
        share = (sketches[i] == seen).mean(axis=1)
        at = np.flatnonzero((first == value) & (their != labels[i]) & (share >= AGREE))
        found: set[int] = set()
        for j in at[np.argsort(-share[at], kind="stable")].tolist():
            if int(their[j]) not in found:
                both = len(np.intersect1d(sets[i], other_sets[j], assume_unique=True))
                if both >= SIMILAR * (len(sets[i]) + len(other_sets[j]) - both):
                    found.add(int(their[j]))
                    out.append((int(min(keys[i], others[j])), int(max(keys[i], others[j]))))
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(key: int, n: Column) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(key)), n).cast("int")


def _between_blocks(unsettled: DataFrame, distinct: DataFrame, sets: DataFrame, bucket: int) -> DataFrame:
    """Links (a, b) of the sets outside their bucket's largest class with all others of the bucket, by pairs of blocks of about ``bucket`` sets."""
    n_outer, n_every = (F.ceil(F.col(c) / bucket) for c in ("outside", "rows"))
    held = unsettled.withColumns({"outer": F.col("label") != F.col("main"), "n_outer": n_outer, "n_every": n_every})
    columns = ["value", "key", "label"]
    # a set lies in one block and goes to each block of the other side
    one = held.filter("outer").select(*columns, F.lit(True).alias("outer"), _dealt(8, F.col("n_outer")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("n_every").cast("int") - 1)).alias("y"))
    two = held.select(*columns, F.lit(False).alias("outer"), _dealt(7, F.col("n_every")).alias("y"), F.explode(F.sequence(F.lit(0), F.col("n_outer").cast("int") - 1)).alias("x"))
    rows = one.unionByName(two).join(distinct.select("key", "bands", "sketch"), "key").join(sets, "key")
    return rows.groupBy("value", "x", "y").applyInArrow(_across, "a bigint, b bigint").distinct()


def _joined_classes(links: DataFrame, large: DataFrame, sets: DataFrame, distinct: DataFrame, bucket: int) -> DataFrame:
    """(node, component) of the links and of those that larger buckets hold besides."""
    last, turn = None, 0
    while True:
        labels = components(links, "a", "b")
        at = large.join(labels.withColumnRenamed("node", "key"), "key", "left").select("value", "key", F.coalesce("component", "key").alias("label"))
        sizes = at.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("value").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).filter("labels > 1")
        unsettled = stored(at.join(main.select("value", F.col("m.label").alias("main"), "rows", (F.col("rows") - F.col("m.n")).alias("outside")), "value"))
        rest = unsettled.filter("label <> main")
        n = rest.count()
        if not n:
            return labels
        if last is not None and 2 * n > last:
            break
        last, turn = n, turn + 1
        # by a power of two, so that buckets of a group share their pivots and candidates repeat
        every = F.pow(F.lit(2), F.greatest(F.floor(F.log2(F.col("rows") / PIVOTS)), F.lit(0))).cast("bigint")
        pivots = unsettled.filter(F.pmod(F.xxhash64("key", F.lit(turn)), every) == 0).select("value", F.col("key").alias("pivot"), F.col("label").alias("other"))
        asked = rest.join(pivots, "value").filter("label <> other")
        links = stored(links.union(_linked(_ordered(asked, "key", "pivot").distinct(), sets)))
    return components(stored(links.union(_between_blocks(unsettled, distinct, sets, bucket))), "a", "b")


def classes(texts: DataFrame, width: int = WIDTH, bucket: int = BUCKET, near: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of texts (column ``text``, binary, and others), stored with the key of their set instead of the text; and (key, component).

    ``near`` links a table of distinct fingerprints, column fp, as simhash.links does.
    """
    at = F.xxhash64("text")
    described = texts.withColumn("_at", at).withColumn("_s", _udf(_sketched, "struct<key:bigint,fp:bigint,bands:array<bigint>,sketch:binary>", width)("text"))
    own = stored(described.select(*[c for c in texts.columns if c != "text"], "_at", "_s.*"))
    distinct = stored(own.groupBy("key").agg(F.min(F.struct("_at", "fp", "bands", "sketch")).alias("s")).select("key", "s.*"))
    probes = distinct.select("key", F.explode("bands").alias("value"))
    sizes = probes.groupBy("value").agg(F.count(F.lit(1)).alias("rows"), F.min(_pivot(0))["key"].alias("pivot")).filter("rows > 1")
    held = probes.join(sizes, "value")
    small = held.filter(F.col("rows") <= bucket).groupBy("value").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # at most `bucket` each
    large = stored(held.filter(F.col("rows") > bucket).select("value", "key", "pivot"))
    pairs = small.select(F.explode(_pairs_of(F.col("keys"))).alias("p")).select("p.*").union(_ordered(large, "key", "pivot"))
    if near:
        pairs = pairs.union(by_fingerprint(distinct, near))
    pairs = stored(pairs.distinct())
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = distinct.join(keys, "key", "left_semi").select("_at")
    some = texts.select("text").withColumn("_at", at).join(wanted, "_at", "left_semi").select("text")
    sets = some.select(_udf(_hashed, "struct<key:bigint,hashes:array<bigint>>", width)("text").alias("s")).select("s.*")
    sets = stored(sets.dropDuplicates(["key"]))
    links = stored(_linked(pairs, sets))
    found = _joined_classes(links, large.select("value", "key"), sets, distinct, bucket)
    joined = distinct.select("key").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    return own.drop("fp", "bands", "sketch", "_at"), joined
