"""A quality classifier from weak labels: heuristics vote, EM weighs them, posteriors train a scorer.

1. Overlapping heuristic labellers look at a whole text once and vote unfit, fit or nothing, for two
   questions: low quality and toxicity. A document's votes are one small integer per question, stored
   with its hashed features; nothing reads the texts again.
2. The votes of all documents are counted by pattern (at most 3^labellers rows reach the driver)
   and expectation-maximisation estimates the prior and each labeller's rates of each vote among
   fit and unfit documents, hence a posterior for every pattern.
3. A linear scorer over hashed words and shape marks is fitted by logistic regression to the
   posteriors of at most TRAIN_ROWS distinct texts per class, those of smallest hash.
4. Each document gets its posteriors and the scorer's probability; it is rejected where the mean of
   the posterior that it is unfit and the scorer's probability reaches one half.

The words that the toxicity labellers look for are learnt, with no built-in list, from a bounded sample of
labelled rows: at most LABELLED_ROWS toxic ones and four times as many others, by smallest hash of the id,
texts of any length, near copies taken once. Words, and beginnings of words, that mark toxic texts there by
more than chance over all words looked at form two lists. Nothing else uses given labels; without labels
no text is held toxic. Equal texts get equal results whatever the partitioning.

Defined cases: a null or empty text gets no votes, the posterior of that pattern and a score from
no words. A very long text is read in slices. Of texts of equal hash at the sample's edge, all are one text.
Of a labelled id that repeats, the text of smallest digest is looked at. Null ids, repeated rows and further
columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import binaries, dropped, stored, unused, utf8, word_slices, workspace
from claimloom.llm.quality_rules import measure

ABSTAIN, FIT, UNFIT = 0, 1, 2
TRAIN_ROWS = 1500
LABELLED_ROWS = 2500
#: Bytes of a word's beginning.
STEM = 6
#: Bits of evidence that a learned word needs beyond one for each doubling of the words looked at.
SPARE_BITS = 7
BITS = 14
_SHAPES = 64
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@dataclass(frozen=True)
class Looks:
    """What the labellers see of a text."""

    words: int
    chars: int
    symbols: int
    duplicate_lines: int
    repeated: int
    lines: int
    upper: int
    letters: int
    distinct: int
    marks: int
    shouts: int
    ends: int
    learned: int
    uses: int
    stems: int


@dataclass(frozen=True)
class Lexicon:
    """Words and beginnings of words that mark toxic texts."""

    words: frozenset[bytes] = frozenset()
    stems: frozenset[bytes] = frozenset()


def look(text: bytes, lexicon: Lexicon = Lexicon()) -> tuple[Looks, set[bytes]]:
    """What there is to see, and the text's distinct lower-case words of letters."""
    lower = text.lower().translate(_LETTERS)
    kinds: set[bytes] = set()
    uses = 0
    for words in word_slices(lower):
        new = set(words)
        kinds |= new
        if not new.isdisjoint(lexicon.words):
            uses += sum(w in lexicon.words for w in words)
    m = measure(text)
    marks = len(text) - len(text.translate(None, _MARKS))
    return Looks(*m, len(kinds), marks, text.count(b"!"), text.count(b". ") + text.count(b".\n") + text.endswith(b"."), len(lexicon.words & kinds), uses, sum(w[:STEM] in lexicon.stems for w in kinds) if lexicon.stems else 0), kinds


#: (name, unfit where, fit where); the order fixes the digits of a pattern.
QUALITY_LABELLERS = (
    ("symbols", lambda x: 10 * x.symbols > x.words, None),
    ("marks", lambda x: x.words >= 20 and 10 * x.marks > 8 * x.words, lambda x: x.words >= 20 and 10 * x.marks < 3 * x.words),
    ("repeats", lambda x: 100 * x.repeated > 40 * x.words, None),
    ("variety", lambda x: x.words >= 50 and 100 * x.distinct < 25 * x.words and x.words < 5000, None),
    ("upper", lambda x: x.letters >= 20 and 100 * x.upper > 50 * x.letters, None),
    ("shouts", lambda x: 100 * x.shouts > 20 * x.words, None),
    ("prose", None, lambda x: 10 * x.symbols <= x.words if x.words < 20 else x.ends and x.words < 60 * x.ends and 100 * x.upper < 20 * x.letters and 25 * x.symbols < x.words),
)
TOXIC_LABELLERS = (
    ("words", lambda x: x.learned > 0, None),
    ("several", lambda x: x.learned > 1, None),
    ("often", lambda x: x.uses > 2 or 100 * x.uses > x.words, None),
    ("stems", lambda x: x.stems > 0, None),
    ("mild", None, lambda x: not x.learned and not x.stems),
)


def pattern(looks: Looks, labellers) -> int:
    """The votes as digits to base 3, the first labeller's lowest."""
    p = 0
    for _, unfit, fit in reversed(labellers):
        p = 3 * p + (UNFIT if unfit and unfit(looks) else FIT if fit and fit(looks) else ABSTAIN)
    return p


def votes(patterns: np.ndarray, n: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(n) % 3


@dataclass
class VoteModel:
    """prior: share of unfit documents; rates[c, j, v]: how often labeller j votes v among class c (0 fit, 1 unfit)."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = votes(patterns, self.rates.shape[1])
        log = np.log(self.rates)[:, np.arange(v.shape[1]), v].sum(axis=2)
        odds = np.log(self.prior / (1 - self.prior)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, n: int, rounds: int = 100, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over counted patterns, from the start that any unfit vote is right nine times in ten."""
    v = votes(patterns, n)
    unfit = np.where((v == UNFIT).any(axis=1), 0.9, 0.05)
    model = VoteModel(0.1, np.full((2, n, 3), 1 / 3))
    total = counts.sum()
    if not total:
        return model
    smooth = np.array([[0.5, 0.5, 0.05], [0.5, 0.05, 0.5]])  # fit documents are rarely voted unfit, and the reverse
    for _ in range(rounds):
        rates = np.empty((2, n, 3))
        for c, w in enumerate((counts * (1 - unfit), counts * unfit)):
            for value in range(3):
                rates[c, :, value] = (w[:, None] * (v == value)).sum(axis=0) + smooth[c, value]
        rates /= rates.sum(axis=2, keepdims=True)
        prior = ((counts * unfit).sum() + 1) / (total + 10)
        model = VoteModel(float(prior), rates)
        new = model.posterior(patterns)
        done = np.abs(new - unfit).max() < tolerance
        unfit = new
        if done:
            break
    return model


def features(looks: Looks, kinds: set[bytes]) -> np.ndarray:
    """The distinct hashed features of a text, ascending: shape marks below _SHAPES, words above."""
    level = lambda a, b: min(7, int(np.ceil(np.log2(1 + 64 * a / b)))) if b else 0
    shapes = [8 * i + level(a, b) for i, (a, b) in enumerate(((looks.symbols, looks.words), (looks.marks, 4 * looks.words), (looks.repeated, looks.words), (looks.upper, looks.letters), (looks.shouts, looks.words), (looks.duplicate_lines, looks.lines), (looks.learned + looks.stems, 1), (looks.ends, looks.words)))]
    room = (1 << BITS) - _SHAPES
    return np.array(sorted({*shapes, *(_SHAPES + zlib.crc32(w) % room for w in kinds)}), np.uint16)


def fit_scorer(rows: list[np.ndarray], target: np.ndarray, rounds: int = 150, decay: float = 2e-4) -> np.ndarray:
    """Weights, the bias last: logistic regression to soft targets by accelerated full-batch steps, classes weighed alike."""
    size = 1 << BITS
    if not rows:
        return np.zeros(size + 1)
    at = np.concatenate(rows).astype(np.int64)
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))[own]
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(rows)
    w = np.zeros(size + 1)
    square, step = np.full(size + 1, 1e-8), 0.3
    for _ in range(rounds):
        z = np.bincount(own, w[at] * scale, len(rows)) + w[-1]
        gap = (1 / (1 + np.exp(-z)) - target) * weight
        grad = np.append(np.bincount(at, gap[own] * scale, size), gap.sum()) + decay * w
        square += grad * grad
        w -= step * grad / np.sqrt(square)
    return w


def score(row: np.ndarray, w: np.ndarray) -> float:
    z = float(w[row].sum() / np.sqrt(max(len(row), 1)) + w[-1])
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


@dataclass
class Classifier:
    quality: VoteModel
    toxic: VoteModel
    weights: np.ndarray
    lexicon: Lexicon = Lexicon()

    def unfit(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.quality.posterior(q), self.toxic.posterior(t)
        return a, b, 1 - (1 - a) * (1 - b)


_SKETCH = 32


def sketched(words: Iterable[bytes]) -> list[int]:
    return sorted(map(zlib.crc32, words))[:_SKETCH]


def no_copies(rows: Iterable[tuple[list[int], int]]) -> list[bool]:
    """For (sketch, toxic) rows: False where half of a row's rare words among those of smallest hash are in an earlier row of its label."""
    holders: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, (sketch, toxic) in enumerate(rows):
        rare = [h for h in sketch if len(holders.get((h, toxic), ())) < _SKETCH]
        shared: dict[int, int] = {}
        for h in rare:
            for j in holders.get((h, toxic), ()):
                shared[j] = shared.get(j, 0) + 1
        out.append(not rare or 2 * max(shared.values(), default=0) < len(rare))
        if out[-1]:
            for h in sketch:
                holders.setdefault((h, toxic), []).append(i)
    return out


def telling(toxic: np.ndarray, other: np.ndarray, often: int, share: float) -> np.ndarray:
    """Of words with their numbers of toxic and other texts, those that have nine times fewer others, beyond chance.

    The binomial bound on a word's counts, by the share of toxic rows, must leave less than 2^-SPARE_BITS of
    the ``often`` words looked at to chance.
    """
    p = toxic / np.maximum(toxic + other, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = toxic * np.log2(p / share) + np.where(other > 0, other * np.log2((1 - p) / (1 - share)), 0)
    return (9 * other <= toxic) & (p > share) & (bits >= np.log2(max(1, often)) + SPARE_BITS)


_SEEN = "sketch array<bigint>, marks array<binary>"


def _seen(text: pa.Array) -> pa.Array:
    """A text's sketch, and its distinct words ("w" before each) and their beginnings ("s" before each)."""
    sketches, marks = [], []
    for x in binaries(text):
        kinds = look(x)[1]
        sketches.append(sketched(kinds))
        marks.append(sorted({b"w" + w for w in kinds} | {b"s" + w[:STEM] for w in kinds if len(w) >= STEM}))
    return pa.StructArray.from_arrays([pa.array(sketches, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.binary()))], names=["sketch", "marks"])


def learn_lexicon(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = LABELLED_ROWS, least: int = 5) -> Lexicon:
    """The toxic words of a bounded sample of labelled documents; labels has the id and ``toxic``. Words need ``least`` toxic texts."""
    spark, folder = docs.sparkSession, workspace(docs.sparkSession)
    picked: list[tuple] = []
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    for toxic in (1, 0):
        picked += known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(rows if toxic else 4 * rows).collect()
    if not picked:
        return Lexicon()
    sample = F.broadcast(spark.createDataFrame(picked, known.schema))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    seen = stored(texts.select("id", "toxic", F.xxhash64("text").alias("digest"), F.arrow_udf(_seen, _SEEN).asNondeterministic()(utf8("text")).alias("s")).select("id", "toxic", "digest", "s.*"), folder)
    first = seen.groupBy("id", "toxic").agg(F.min("digest").alias("digest"))
    chosen = seen.join(first, ["id", "toxic", "digest"]).dropDuplicates(["id", "toxic"])
    sketches = chosen.select("id", "toxic", "sketch").orderBy("id", "toxic").collect()  # at most 5 * rows, 32 numbers each
    kept = [(r.id, r.toxic) for r, keep in zip(sketches, no_copies((r.sketch, r.toxic) for r in sketches)) if keep]
    n = [sum(t == toxic for _, t in kept) for toxic in (0, 1)]
    found: dict[bytes, list[bytes]] = {b"w": [], b"s": []}
    if all(n):
        each = chosen.join(F.broadcast(spark.createDataFrame(kept, known.schema)), ["id", "toxic"]).select("toxic", F.explode("marks").alias("mark"))
        counts = each.groupBy("mark").agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_other")).filter(F.col("n_toxic") >= least)
        kind = F.substring("mark", 1, 1).alias("kind")
        often = {bytes(r.kind): r["count"] for r in counts.groupBy(kind).count().collect()}
        for r in counts.filter("9 * n_other <= n_toxic").collect():  # words of five toxic texts that hardly any other has
            if telling(np.array([r.n_toxic]), np.array([r.n_other]), often[bytes(r.mark[:1])], n[1] / sum(n))[0]:
                found[bytes(r.mark[:1])].append(bytes(r.mark[1:]))
    dropped(spark, folder)
    return Lexicon(frozenset(found[b"w"]), frozenset(found[b"s"]))


def _looked(lexicon: Lexicon):
    def of(text: pa.Array) -> pa.Array:
        rows = []
        for x in binaries(text):  # the words of one text at a time
            seen, kinds = look(x, lexicon)
            rows.append((pattern(seen, QUALITY_LABELLERS), pattern(seen, TOXIC_LABELLERS), features(seen, kinds).tobytes()))
        q, t, f = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(q, pa.int32()), pa.array(t, pa.int32()), pa.array(f, pa.binary())], names=["q", "t", "f"])

    return F.arrow_udf(of, "q int, t int, f binary").asNondeterministic()


def fit(looked: DataFrame, key: str, looks: str, train_rows: int = TRAIN_ROWS) -> Classifier:
    """A classifier from a stored table with a text hash and the looks (q, t, f): all documents' votes, and at most 2 * train_rows texts for the scorer."""
    spark = looked.sparkSession
    slim = looked.select(F.col(key).alias("key"), F.col(looks)["q"].alias("q"), F.col(looks)["t"].alias("t"))
    counted = slim.groupBy("q", "t").count().collect()  # at most one row for each pattern of votes
    q, t, n = (np.array([r[i] for r in counted], np.int64) for i in range(3))
    model = Classifier(fit_votes(q, n, len(QUALITY_LABELLERS)), fit_votes(t, n, len(TOXIC_LABELLERS)), np.zeros((1 << BITS) + 1))
    unfit = model.unfit(q, t)[2]
    known = spark.createDataFrame([(int(a), int(b), float(u)) for a, b, u in zip(q, t, unfit)], "q int, t int, unfit double")
    posterior = slim.distinct().join(F.broadcast(known), ["q", "t"])
    sample = {r.key: r.unfit for side in ("unfit > 0.5", "unfit <= 0.5") for r in posterior.filter(side).orderBy("key").limit(train_rows).collect()}
    if sample:
        keys = spark.createDataFrame([(k,) for k in sample], "key bigint")
        texts = looked.select(F.col(key).alias("key"), F.col(looks)["f"].alias("f")).join(F.broadcast(keys), "key").groupBy("key").agg(F.min("f").alias("f"))
        rows = sorted(texts.collect())  # at most 2^BITS features of two bytes each
        model.weights = fit_scorer([np.frombuffer(r.f, np.uint16) for r in rows], np.array([sample[r.key] for r in rows]))
    return model


def classified(docs: DataFrame, text_col: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id", out: str = "quality", keep_text: bool = True) -> tuple[DataFrame, str]:
    """docs, stored, with a struct column (low_quality, toxic, score, unfit, kept); and that column's name."""
    out, key = unused(docs, out), unused(docs, "_key")
    lexicon = learn_lexicon(docs, labels, text_col, id_col) if labels is not None else Lexicon()
    seen = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn(out, _looked(lexicon)(utf8(text_col)))
    looked = stored(seen if keep_text else seen.drop(text_col))
    model = fit(looked, key, out)
    model.lexicon = lexicon
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(q: pa.Array, t: pa.Array, f: pa.Array) -> pa.Array:
        m = shared.value
        scores = np.array([score(np.frombuffer(x, np.uint16), m.weights) for x in f.to_pylist()], float)
        low, toxic, unfit = m.unfit(q.to_numpy(zero_copy_only=False).astype(np.int64), t.to_numpy(zero_copy_only=False).astype(np.int64))
        both = (unfit + scores) / 2
        return pa.StructArray.from_arrays([pa.array(low), pa.array(toxic), pa.array(scores), pa.array(both), pa.array(both < 0.5)], names=["low_quality", "toxic", "score", "unfit", "kept"])

    udf = F.arrow_udf(judge, "low_quality double, toxic double, score double, unfit double, kept boolean").asNondeterministic()
    return looked.withColumn(out, udf(F.col(out)["q"], F.col(out)["t"], F.col(out)["f"])).drop(key), out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, low_quality, toxic (posteriors), score, unfit, kept."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = None if labels is None else labels.withColumnRenamed(id_col, "doc_id")
    df, c = classified(bare, labels=labels, keep_text=False)
    return df.select("doc_id", f"{c}.*")


def kept_documents(docs: DataFrame, text_col: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns as they are."""
    df, c = classified(docs, text_col, labels, id_col)
    return df.filter(F.col(c)["kept"]).select(*[F.col(f"`{x}`") for x in docs.columns])
