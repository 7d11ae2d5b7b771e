import corpus_pipeline as c
from claimloom.llm import packing, quality_classifier, quality_rules
from claimloom.llm import pii
from tests.llm import test_near_copies, test_packing, test_pii
from tests.llm.test_hard_tables import hard  # noqa: F401


def marked(text, spans):
    """The text with plain string operations; overlapping spans are one."""
    rows = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, at = "", 0
    for a, b, k in rows:
        if a >= at:
            out += text[at:a] + pii.MARKS[k]
        at = max(at, -b)
    return out + text[at:]


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fit = {r.doc_id for r in quality_classifier.classify(docs, labels=labels).collect() if r.kept}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in fit}
    ruled = {r.doc_id for r in quality_rules.ledger(docs).collect() if r.kept}
    rows = {d: r for d, r in rows.items() if d in ruled}
    ids = sorted(rows)
    left = sorted(test_near_copies.survivors([rows[d].text for d in ids], ids))
    texts = [rows[d].text for d in left]
    clean = {d: marked(t, s) for d, t, s in zip(left, texts, test_pii.brute(texts))}
    got = c.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(clean)
    test_packing.check(got, clean, packing.CAPACITY)
    assert all(r.source == rows[r.doc_id].source for r in got)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert c.STAGES[-1][1](spark, docs, sf).count() > 0


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_hard_table(spark, sf, hard):  # noqa: F811
    """Nulls, repeated ids and clashing names go through all stages; the last one's rows come from those that were kept."""
    docs = hard
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == hard.columns and docs.dtypes == hard.dtypes, name
    kept = docs.collect()
    pieces = c.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.length for r in pieces) == sum(len((r.text or "").encode()) + 1 for r in kept)


def test_near_duplicates_of_repeated_ids(spark, sf):
    rows = [(1, "one text of quite a few words here"), (1, "and another text of the same id here"), (None, "one text of quite a few words here"), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = dict(c.STAGES)["simhash"](spark, df, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[1], rows[3]]))
