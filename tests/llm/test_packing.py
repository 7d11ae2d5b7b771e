import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import packing as p
from claimloom.llm.queries import QUERIES
from tests.llm import test_simhash


def brute(sizes, sources, clusters, capacity):
    """Every open bin is looked at for every piece."""
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= sizes[i] and (sources[i] is None or sources[i] not in b["s"]) and (clusters[i] is None or clusters[i] not in b["c"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= sizes[i]
        bins[k]["s"].add(sources[i])
        bins[k]["c"].add(clusters[i])
        out[i] = k
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=40))
def test_against_all_bins(rows):
    columns = [list(c) for c in zip(*rows)] or [[], [], []]
    assert p.best_fit(*columns, 20) == brute(*columns, 20)


def test_hot_source_and_cluster():
    rng = random.Random(2)
    rows = [(rng.randint(1, 900), "hot" if rng.random() < 0.35 else f"s{rng.randrange(19)}", 7 if rng.random() < 0.33 else i) for i in range(1500)]
    columns = [list(c) for c in zip(*rows)]
    assert p.best_fit(*columns, 1000) == brute(*columns, 1000)


def check(rows, docs, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin].append(r)
    for d, text in docs.items():
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.length for r in pieces) == len((text or "").encode()) + 1
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in pieces:
            assert r.bin_offset == end
            end += r.length
        assert end <= capacity
        for key in ("source", "cluster"):
            values = [getattr(r, key) for r in pieces if getattr(r, key) is not None]
            assert len(values) == len(set(values))


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, p.CAPACITY)
    assert p.efficiency(p.packed(docs)).first().filled > 0.7


def test_query_against_all_bins(spark, sf):
    """One packer holds all of this table: its bins are those of the search over all open bins, with op2's classes by all pairs."""
    docs = sorted((r.doc_id, r.source, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert len(docs) <= p.PACKER_ROWS
    fps = [test_simhash.brute_fingerprint(t) for _, _, t in docs]
    label = test_simhash.brute_classes(fps)
    costs = [len(t.encode()) + 1 for _, _, t in docs]
    full = [(c - 1) // p.CAPACITY for c in costs]
    bins = brute([c - f * p.CAPACITY for c, f in zip(costs, full)], [s for _, s, _ in docs], [label[f] for f in fps], p.CAPACITY)
    got = {(r.doc_id, r.piece): r.bin for r in QUERIES["op9_best_fit_packing"](spark, sf).collect()}
    assert {d: got[d, f] for (d, _, _), f in zip(docs, full)} == {d: b for (d, _, _), b in zip(docs, bins)}
    assert len(got) == len(docs) + sum(full) and len({b for (d, k), b in got.items() if k < dict(zip((d for d, _, _ in docs), full))[d]}) == sum(full)


def test_same_rows_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = ({tuple(r) for r in p.packed(d, packer_rows=100).collect()} for d in (docs, docs.repartition(7)))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (None, "", "s", 0), (2, "x" * 20_000, "s", 0), (2, "x" * 20_000, "s", 0)], "doc_id bigint, text string, source string, bin int")
    rows = p.packed(docs).collect()
    assert len(rows) == 8 and sum(r.length for r in rows) == 2 + 2 * 20_001
    assert p.packed(docs.limit(0)).count() == 0
    exact = spark.createDataFrame([(1, "y" * 8191, "s"), (2, "z" * 8192, "s")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.length) for r in p.packed(exact).collect()) == [(1, 8192), (2, 1), (2, 8192)]
