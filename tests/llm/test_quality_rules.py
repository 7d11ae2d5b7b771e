import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.llm import quality_rules as q
from claimloom.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same


def test_against_sql(spark, sf):
    assert assert_same(QUERIES["op3_rule_ledger"](spark, sf), ORACLES["op3_rule_ledger"], sf) == 1000


def brute(text):
    w = (text or "").encode().split()
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(3)})


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c a b c", "a a a a", "x a b c y a b c z", "a b a b a b", "\x85a b c a b c d"])
def test_repeat_words(text):
    raw = text.encode()
    assert q.measure(raw)[4] == brute(text) == q._repeat_words_long(raw)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "word " * 60, "z"), (2, "word " * 60, "z")], "doc_id bigint, text string, measures string")
    rows = q.ledger(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [0, 0, 60, 60] and not any(r.kept for r in rows)
    assert q.ledger(docs.limit(0)).count() == 0
    assert q.kept_documents(docs).columns == docs.columns


def test_policies_and_ablation(spark, sf):
    rows = q.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    for policy in q.POLICIES.values():
        by_rule = {r.rule: r for r in q.ablation(rows, policy).collect()}
        base = {r.fail_bits for r in rows.collect()}
        assert base
        for i, rule in enumerate(q.RULES):
            if policy.mask >> i & 1:
                assert by_rule[rule.name].n_failed == rows.filter(F.expr(rule.fails)).count()


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.ledger(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    good = got.filter("quality = 1 and not base_failed")
    assert good.filter("not kept").count() <= 0.01 * good.count()
    bad = got.filter("quality = 0")
    assert bad.filter("not kept").count() >= 0.8 * bad.count()
