import itertools

import numpy as np
import pytest

from claimloom.llm import quality_classifier as q
from claimloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held_out = {r.doc_id: (r.quality, r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()}
    return [(r, held_out.get(r.doc_id)) for r in q.classify(docs, labels=labels.filter("doc_id % 2 = 0")).collect()]


def test_held_out_accuracy(judged):
    """The labels of odd ids are never read by the classifier."""
    assert len(judged) == 10_000
    known = [(r, x) for r, x in judged if x]
    clean = [r.kept for r, x in known if x == (1, 0)]
    bad = [not r.kept for r, x in known if x[0] == 0]
    toxic = [not r.kept for r, x in known if x[1] == 1]
    print(len(clean), np.mean(clean), len(bad), np.mean(bad), len(toxic), np.mean(toxic))
    assert np.mean(clean) >= 0.99 and np.mean(bad) >= 0.97 and np.mean(toxic) >= 0.9


def words_learned(spark, rows):
    docs = spark.createDataFrame([(i, b" ".join(sorted(w)).decode()) for i, (w, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, toxic int")
    return q.learn_lexicon(docs, labels)


LETTERS = [bytes([a, b]) for a in range(97, 123) for b in range(97, 123)]


def test_learned_words_skip_near_copies(spark):
    copies = [(frozenset(b"a b c d e f g h".split() + [b"xx" + LETTERS[i]]), 1) for i in range(20)]
    others = [(frozenset([b"badworder", b"t" + x, b"u" + x, b"v" + x]), 1) for x in LETTERS[:12]] + [(frozenset([b"w" + x]), 0) for x in LETTERS[:90]]
    got = words_learned(spark, copies + others)
    assert got.words == {b"badworder"} and got.stems == {b"badwor"}


def test_no_words_are_learned_from_chance(spark):
    """Labels that have nothing to do with the words teach nothing, however many rows and words there are."""
    rng = np.random.default_rng(8)
    rows = [(frozenset(b"k" + LETTERS[x // 676 % 676] + LETTERS[x % 676] for x in rng.zipf(1.3, 120) % 30_000), int(rng.random() < 0.4)) for _ in range(2500)]
    assert words_learned(spark, rows) == q.Lexicon()


def test_long_texts_and_repeated_ids_teach_too(spark):
    filler = " ".join((LETTERS[i % 676] + LETTERS[i * 7 % 676]).decode() for i in range(30_000))
    own = lambda i: " ".join(f"{c}{LETTERS[i].decode()}" for c in "qrstuv")
    docs = spark.createDataFrame([(i, f"{filler if i == 3 else ''} {'horror' if i < 20 else 'calm'} {own(i)}") for i in range(200)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(200)], "doc_id bigint, toxic int")
    assert b"horror" in q.learn_lexicon(docs, labels).words


def test_query_against_one_process(spark, sf):
    """The query's rows from plain loops over all documents, given the words learnt."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op1_weak_label_quality"](spark, sf)
    assert rows.columns == ["doc_id", "low_quality", "toxic", "score", "unfit", "kept"]
    lexicon = q.learn_lexicon(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    key = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS k").collect()}
    seen = {d: q.look(t, lexicon) for d, t in texts.items()}
    ids = sorted(texts)
    p = [np.array([q.pattern(seen[d][0], k) for d in ids]) for k in (q.QUALITY_LABELLERS, q.TOXIC_LABELLERS)]
    pairs, counts = np.unique(np.stack(p), axis=1, return_counts=True)
    model = q.Classifier(q.fit_votes(pairs[0], counts, len(q.QUALITY_LABELLERS)), q.fit_votes(pairs[1], counts, len(q.TOXIC_LABELLERS)), None, lexicon)
    low, toxic, unfit = model.unfit(*p)
    by_key = {key[d]: (d, u) for d, u in zip(ids, unfit)}
    sample = sorted([k for k in by_key if by_key[k][1] > 0.5])[: q.TRAIN_ROWS] + sorted([k for k in by_key if by_key[k][1] <= 0.5])[: q.TRAIN_ROWS]
    sample.sort()
    w = q.fit_scorer([q.features(*seen[by_key[k][0]]) for k in sample], np.array([by_key[k][1] for k in sample]))
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(ids)
    for d, a, b, u in zip(ids, low, toxic, unfit):
        s = q.score(q.features(*seen[d]), w)
        assert np.allclose([got[d].low_quality, got[d].toxic, got[d].score, got[d].unfit], [a, b, s, (u + s) / 2], atol=1e-6)


def test_em_finds_planted_accuracies():
    """Brute force over all patterns: the posterior is Bayes' rule under the planted rates."""
    rng = np.random.default_rng(5)
    n, labellers = 40_000, 4
    truth = rng.random(n) < 0.3
    rates = np.array([[[0.7, 0.25, 0.05]] * labellers, [[0.3, 0.1, 0.6]] * labellers])
    v = np.array([[rng.choice(3, p=rates[int(c), j]) for j in range(labellers)] for c in truth])
    patterns, counts = np.unique(v @ 3 ** np.arange(labellers), return_counts=True)
    m = q.fit_votes(patterns, counts, labellers)
    assert abs(m.prior - 0.3) < 0.03 and np.abs(m.rates - rates).max() < 0.05
    for p in itertools.product(range(3), repeat=labellers):
        a, b = (np.prod([m.rates[c, j, x] for j, x in enumerate(p)]) for c in (0, 1))
        want = m.prior * b / (m.prior * b + (1 - m.prior) * a)
        assert abs(m.posterior(np.array([sum(x * 3**j for j, x in enumerate(p))]))[0] - want) < 1e-9


def test_scorer_separates():
    rng = np.random.default_rng(1)
    target = (np.arange(200) % 2).astype(float)
    rows = [np.unique(np.append(rng.integers(100, 5000, 50), 70 + int(y))).astype(np.uint16) for y in target]
    w = q.fit_scorer(rows, target)
    assert np.mean([(q.score(r, w) > 0.5) == y for r, y in zip(rows, target)]) > 0.98
    assert (q.fit_scorer([], np.zeros(0)) == 0).all()


def test_edges(spark):
    fine = "The river runs past the town and the mill. People walk there in the evening. " * 3
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, fine, 0), (2, fine, 0), (3, "### $$$ %%% ||| " * 20, 0)], "doc_id bigint, text string, quality int")
    rows = q.classify(docs).collect()
    assert len(rows) == 5 and all(0 <= r.unfit <= 1 for r in rows)
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()].count(2) == 2
    assert q.classify(docs.limit(0)).count() == 0
