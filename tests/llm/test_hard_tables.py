"""Every operator over one table with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, language_model, media, packing, pii, quality_classifier, quality_rules, sharding, simhash, token_files

LONG = "Ein sehr langer Text, mit 4111 1111 1111 1111 und a@b.example.org drin. " * 15_000  # 1 MB
NAMES = ["fingerprint", "kept", "score", "ids", "shard", "key", "measures", "quality", "media", "mentions", "bin", "component_id", "_chunk", "size"]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (None, " \t\n ", "en", "s"), (3, LONG, "de", "s"), (4, "same words here", "en", "s"), (4, "same words here", "en", "s"), (5, "same words here", "en", "t"), (None, None, None, None), (6, "x" * 1_500_000, "en", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({n: F.lit(n) for n in NAMES}).repartition(3).cache()


RUNS = {
    "quality_classifier": lambda d: quality_classifier.classify(d),
    "simhash": lambda d: simhash.classes(d),
    "quality_rules": lambda d: quality_rules.ledger(d),
    "bpe": lambda d: bpe.round_trip(d, bpe.default_path()),
    "token_files": lambda d: token_files.token_index(d),
    "language_model": lambda d: language_model.scores(d),
    "media": lambda d: media.described(d),
    "sharding": lambda d: sharding.sharded(d),
    "pii": lambda d: pii.spans(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each(hard, name):
    rows = RUNS[name](hard).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in hard.select("doc_id").collect())


@pytest.mark.parametrize("name", RUNS)
def test_empty(hard, name):
    assert RUNS[name](hard.limit(0)).count() == 0


def test_packing(hard):
    rows = packing.packed(hard).collect()
    assert sum(r.length for r in rows) == sum(len((r.text or "").encode()) + 1 for r in hard.select("text").collect())


STAGES = {"quality_classifier": quality_classifier.kept_documents, "quality_rules": quality_rules.kept_documents, "simhash": simhash.one_of_each, "pii": pii.sanitised}


@pytest.mark.parametrize("name", STAGES)
def test_filters_keep_columns(hard, name):
    got = STAGES[name](hard)
    assert got.columns == hard.columns and got.dtypes == hard.dtypes
    rows = got.collect()
    assert all(r.kept == "kept" and r.shard == "shard" for r in rows)
    if name == "pii":
        assert len(rows) == 9 and "4111" not in next(r.text for r in rows if r.doc_id == 3)
    if name == "simhash":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "6"]  # the texts without words are one class
