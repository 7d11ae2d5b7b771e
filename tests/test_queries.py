"""Every query of the library against its SQL twin."""

import duckdb
import pytest

from claimloom.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    assert_same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


ODD = [None, "", " both ends ", "\ttab\t", "a\rb", "a\r\nb", "\r\n", "\n", '"', '""', 'say "x"', "back\\slash", "end\\", '\\"', "a,b", "#", "é日\U0001f926\U0001f3fc", "\u00a0x\u2028", "\\N", "null", "\ufefftop"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """documents with null, empty and odd fields and keys, each text under keys of every remainder by 4."""
    rows = [(4 * k + d, x, ["en", None, "", "fr"][(k + d) % 4], ["web", "", None, 'a"b\\,\r\n '][k % 4], d if k % 3 else None) for k, x in enumerate(ODD) for d in range(4)]
    rows += [(-3, "minus", "en", "web", 5), (-1, "", "en", "web", 0), (-4, None, "en", "web", 1), (None, "no key", "en", "web", 6), (None, None, None, None, None)]
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    con.execute("CREATE TABLE d AS SELECT unnest(?)::BIGINT AS doc_id, unnest(?)::VARCHAR AS text, unnest(?)::VARCHAR AS lang, unnest(?)::VARCHAR AS source, unnest(?)::BIGINT AS n_chars", [list(x) for x in zip(*rows)])
    con.execute(f"COPY d TO '{folder}/documents.parquet'")
    return str(folder)


def assert_as_sql(df, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_annotator_fanout_on_odd_documents(spark, odd):
    assert_as_sql(catalog.QUERIES["annotator_fanout"](spark, odd), "annotator_fanout", odd)


def test_combined_text_on_odd_documents(spark, odd):
    assert_as_sql(catalog.QUERIES["combined_text"](spark, odd), "combined_text", odd)


def test_flat_export_on_odd_documents(spark, odd):
    assert_as_sql(catalog.QUERIES["flat_export"](spark, odd), "flat_export", odd)
