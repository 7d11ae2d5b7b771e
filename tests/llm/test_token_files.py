import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from claimloom.llm import token_files as t
from claimloom.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=300), max_size=6), st.integers(0, 100))
def test_round_trip(docs, percentile):
    ids = np.array([x for d in docs for x in d], np.uint32)
    r = t.Reader(t.pack([None if i == 1 else i for i in range(len(docs))], [len(d) for d in docs], ids, percentile))
    assert r.doc_ids == [None if i == 1 else i for i in range(len(docs))]
    assert [r.document(i).tolist() for i in range(len(docs))] == docs


def test_width_of_every_size():
    rng = np.random.default_rng(0)
    for w in range(33):
        ids = rng.integers(0, 1 << w, 1000, np.uint64).astype(np.uint32)
        assert (t.Reader(t.pack([1], [1000], ids)).document(0) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[::64] = 4_000_000_000
    data = t.pack([1], [1280], ids)
    assert len(data) < 400 and (t.Reader(data).document(0) == ids).all()
    with pytest.raises(ValueError):
        t.Reader(data[:-1])


def brute(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for d, x in rows:
        ids = tok.encode(x or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op5_pfor_token_files"](spark, sf).collect())
    assert got == brute(rows)


def test_edges_and_small_files(spark):
    docs = spark.createDataFrame([(5, "a b", 1), (None, "null id", 1), (2, None, 1), (2, "", 1), (9, "zz " * 500, 2), (5, "a b", 1)], "doc_id bigint, text string, start int")
    want = brute([(None, "null id"), (2, ""), (2, ""), (5, "a b"), (5, "a b"), (9, "zz " * 500)])
    got = sorted((tuple(r) for r in t.token_index(docs, ids_per_file=3).collect()), key=lambda r: r[1])
    assert got == want
    empty = t.token_index(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
