import random

from claimloom.llm import near_copies as n
from claimloom.llm import simhash


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def survivors(texts, ids):
    """Smallest id of each class, all pairs compared."""
    s = [sets(t) for t in texts]
    label = list(ids)
    near = [(i, j) for i in range(len(s)) for j in range(i) if similarity(s[i], s[j]) >= 0.8]
    for _ in ids:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return set(label)


def near_texts(rng, copies=40):
    """Bases with copies of which one to eight words are others."""
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(copies):
        base = [rng.choice(words) for _ in range(200)]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(1, 8)):
                copy[at] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_one_of_each_against_all_pairs(spark):
    texts = near_texts(random.Random(5)) + ["one two three", "One  two three", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == survivors(texts, range(len(texts)))


def test_large_buckets(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in rng.sample(range(300), 100)] + near_texts(rng, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == survivors(texts, range(len(texts)))


def chains(rng, n=60):
    """Windows that slide over long runs of words: neighbours are similar, ends of a chain aren't."""
    out = []
    for c in range(3):
        words = [f"c{c}w{i}" for i in range(100 + 10 * n)]
        out += [" ".join(words[9 * i : 9 * i + 100]) for i in range(n)]
    common = [f"k{i}" for i in range(90)]
    out += [" ".join(common + [f"o{rng.random()}" for _ in range(14)]) for _ in range(n)]
    return out


def test_buckets_beyond_the_bound_lose_no_link(spark):
    texts = chains(random.Random(9)) + near_texts(random.Random(3), 8)
    df = spark.createDataFrame([(i, (t or "").encode()) for i, t in enumerate(texts)], "doc_id bigint, text binary")
    results = []
    for bucket in (2, 8, 10**6):
        own, by_key = n.classes(df, bucket=bucket)
        groups = {}
        for r in own.join(by_key, "key").collect():
            groups.setdefault(r.component, set()).add(r.doc_id)
        results.append(sorted(map(sorted, groups.values())))
    assert results[0] == results[1] == results[2]
    assert {g[0] for g in results[0]} == survivors(texts, range(len(texts)))


A, B, C = ("alpha beta gamma delta one", "other words stand here now", "third text of five words")


def test_repeated_and_null_ids_keep_one_row_of_each_class(spark):
    rows = [(3, B, "x"), (5, A, "x"), (5, B, "x"), (6, C, "x"), (None, A, "y"), (None, C, "z"), (None, C, "z"), (None, "only here", "q"), (7, "twice the same row", "s"), (7, "twice the same row", "s"), (8, A, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first string")
    want = [(3, B, "x"), (5, A, "x"), (6, C, "x"), (7, "twice the same row", "s"), (None, "only here", "q")]
    for parts in (1, 4, 7):
        got = simhash.one_of_each(df.repartition(parts))
        assert got.columns == df.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    both = spark.createDataFrame([(5, A, "x"), (5, B, "x")], df.schema)
    assert simhash.one_of_each(both).count() == 2 and simhash.one_of_each(both.limit(0)).count() == 0


def test_candidates_by_fingerprint(spark):
    """Sets of one fingerprint meet, and fingerprints of two bits' distance or less."""
    f = 0x0123456789ABCDEF
    rows = [(1, f), (2, f), (3, f ^ 1), (4, f ^ 0b11 << 40), (5, f ^ 0b111), (6, ~f), (7, ~f)]
    pairs = {(r.a, r.b) for r in n.by_fingerprint(spark.createDataFrame(rows, "key bigint, fp bigint"), simhash.links).collect()}
    label = {k: k for k, _ in rows}
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}  # 5 by way of 3


def test_one_of_each_goes_by_simhash(spark, monkeypatch):
    """The fingerprints of all sets are linked by simhash.links."""
    asked, links = [], simhash.links

    def seen(fps, *more):
        asked.append({r.fp for r in fps.collect()})
        return links(fps, *more)

    monkeypatch.setattr(simhash, "links", seen)
    texts = near_texts(random.Random(4), 10) + [None, "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == survivors(texts, range(len(texts)))
    want = {simhash.fingerprint((t or "").encode(), n.WIDTH) for t in texts}  # no shingle stands twice in these texts
    assert asked == [{x - (x >> 63 << 64) for x in want}]


def test_shingles_of_long_texts():
    text = " ".join(str(i % 5000) for i in range(400_000)).encode()
    assert len(text) > 1 << 20 and len(n.shingles(text)) == len(sets(text.decode()))
