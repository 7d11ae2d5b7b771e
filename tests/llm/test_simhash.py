import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import simhash as s
from claimloom.llm.components import components
from claimloom.llm.queries import QUERIES


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    """{fingerprint: smallest fingerprint of its class}, all pairs compared."""
    fps = sorted(set(fps))
    label = {x: x for x in fps}
    changed = True
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_query_against_all_pairs(spark, sf):
    rows = QUERIES["op2_simhash_classes"](spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: brute_fingerprint(t) for d, t in docs.items()}
    label = brute_classes(fp.values())
    least = {}
    for d in sorted(docs):
        least.setdefault(label[fp[d]], d)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == least[label[fp[r.doc_id]]]


def test_fingerprint_of_long_and_short_texts():
    rng = random.Random(1)
    long = " ".join(rng.choice(["ab", "Cé", "dd\n", "e"]) for _ in range(600_000))
    for t in ["", "  ", "One", "one Two", "a b c", "Ä Ö ü x", long]:
        assert s.fingerprint(t.encode()) == brute_fingerprint(t)


def spread(rng, centre, n, flips):
    out = {centre}
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.3 else centre
        for _ in range(rng.randint(1, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return out


def test_links_of_dense_groups(spark):
    """Small and large buckets find the classes that all pairs give."""
    rng = random.Random(3)
    fps = sorted(spread(rng, rng.getrandbits(64), 150, 4) | spread(rng, 0, 100, 3) | {rng.getrandbits(64) for _ in range(200)})
    want = brute_classes(fps)
    groups = {}
    for x, y in want.items():
        groups.setdefault(y, set()).add(signed(x))
    for bucket in (128, 4):
        df = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
        got = {r.node: r.component for r in components(s.links(df, bucket), "fp", "to").collect()}
        for members in groups.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_allocation_keeps_the_budget():
    est = np.random.default_rng(0).exponential(50, (500, 3, 2)).cumsum(axis=2)
    t = s.allocate(est, [22, 21, 21])
    assert ((t + 1).sum(axis=1) == 3).all() and t.min() >= -1 and t.max() <= 1 and len(np.unique(t, axis=0)) > 3


def test_edges(spark):
    docs = spark.createDataFrame([(3, None, 1), (1, "", 1), (None, " \n", 1), (7, "a b c d e", 2), (7, "a b c d e", 2)], "doc_id bigint, text string, fingerprint int")
    rows = sorted(map(tuple, s.classes(docs).collect()), key=repr)
    assert len(rows) == 5 and {r[2] for r in rows if r[1] == "0" * 16} == {1}
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [1, 7]  # the texts without words are one class
    assert s.classes(docs.limit(0)).count() == 0


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(df.filter("a = 5 and b = 5"), "a", "b").count() == 0
    assert components(df.select(F.col("a"), F.col("b")).limit(0), "a", "b").count() == 0
