import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import bpe
from claimloom.llm.queries import QUERIES

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def want():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(texts):
    return [memoryview(x).cast("I").tolist() for x in bpe.encoder(PATH).encode(texts)]


CASES = ["", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "it's we'll 'S", "x y  z", "été ça 日本語 テスト", "🙂🙃 👩‍👩‍👧 x", "a" * 5000, "<|endoftext|> hi", "1234 5678.90", "\x00\x01\x1c\x1d \x1e", "é ᠎ ​﻿", "tab\there \r\n mixed  \n\n  end  "]


@pytest.mark.parametrize("text", CASES)
def test_cases(want, text):
    assert ids_of([text]) == [want.encode_ordinary(text)]


RANKED = tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'sé日a1!")), max_size=60), max_size=4))
def test_any_text(texts):
    assert ids_of(texts) == [RANKED.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, bpe.encoder(PATH).encode(texts)):
        assert bpe.decode(ids, PATH) == t.encode()
        assert "".join(bpe.decode_stream(memoryview(ids).cast("I"), PATH)) == t


def test_byte_table():
    assert len(set(bpe.byte_table().values())) == 256
    assert bpe.unspelt(bpe.spelt(bytes(range(256)))) == bytes(range(256))


def test_offsets():
    text = "né 日本 🙂"
    (ids,) = bpe.encoder(PATH).encode([text])
    spans = bpe.offsets(ids, PATH)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    whole = bpe.from_ranks(PATH).encode(text, add_special_tokens=False)
    assert whole.offsets == [tuple(x) for x in spans.tolist()]


def test_split_characters(want):
    text = "𓀀"
    (ids,) = bpe.encoder(PATH).encode([text])
    assert bpe._split_characters(ids, PATH) == len(ids) // 4 - 1 > 0
    assert "".join(bpe.decode_stream(memoryview(ids).cast("I"), PATH)) == text


def test_query_against_ranks(spark, sf, want):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_byte_bpe_round_trip"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = want.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "hi there", "z"), (2, "hi there", "z")], "doc_id bigint, text string, ids string")
    rows = bpe.round_trip(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in rows[:2]] == [0, 0] and rows[0].ids_sha256 == rows[1].decoded_sha256 == empty and rows[2] == rows[3]
    df, name = bpe.encoded(docs, PATH)
    assert name != "ids" and "ids" in df.columns
    back, text = bpe.decoded(df, PATH, name)
    assert [bytes(r[text]) for r in back.collect()] == [b"", b"", b"hi there", b"hi there"]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
