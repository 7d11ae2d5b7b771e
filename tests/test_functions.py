"""Expressions against plain Python."""

import hashlib
import json
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import jsonladder as j
from claimloom.functions import text as t


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first().x


TEXT = st.text(alphabet=st.sampled_from("ab é/_-~*+%&.#\t 日"), max_size=12)


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_slugs_and_quoting(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").coalesce(1)
    for r in df.select("i", t.slug(F.col("c")).alias("s"), t.url_quoted(F.col("c")).alias("q"), t.instance_uri("http://x#", "A b/", F.col("c")).alias("u"), t.md5_id(F.col("c"), F.lit("z")).alias("m")).collect():
        c = texts[r.i]
        import re

        assert r.s == re.sub(r"\s+", "_", c)
        assert r.q == quote(c, safe="_")
        assert r.u == "http://x/A_b/" + c.strip("/").replace(" ", "_")
        assert r.m == hashlib.md5((c + "z").encode()).hexdigest()


@pytest.mark.parametrize(("date", "want"), [("2024-01-05 10:00:00+00:00", "2024-01-05T10:00:00+00:00"), ("2024-01-05T10:00:00Z", "2024-01-05T10:00:00Z"), ("a b c", "aTb c"), ("xT y", "xT y"), ("2024", "2024"), (None, None)])
def test_rfc3339(spark, date, want):
    assert one(spark, t.rfc3339(F.col("d")), d=date) == want


@pytest.mark.parametrize(("time", "ymd", "dmy"), [("+1825-01-01T00:00:00Z", "1825-01-01", "1/1/1825"), ("+2007-00-00T00:00:00Z", "2007-00-00", "//2007"), ("+0987-10-20T00:00:00Z", "0987-10-20", "20/10/987"), ("+2007", "2007", None), (None, None, None)])
def test_kb_dates(spark, time, ymd, dmy):
    assert one(spark, t.kb_date(F.col("d")), d=time) == ymd
    assert one(spark, t.kb_date_short(F.col("d")), d=time) == dmy


def test_small_expressions(spark):
    assert one(spark, t.utterance_class(F.col("c")), c="Partially-Direct") == "partiallyDirectUtterance"
    assert one(spark, t.utterance_class(F.col("c")), c="other") is None
    assert one(spark, t.organization_class(F.col("c")), c="Political Party") == "PoliticalParty"
    assert one(spark, t.organization_class(F.col("c")), c="Workers Union") == "Organization"
    assert one(spark, t.first_topic(F.col("c")), c="1_us_politics_climate_change") == "ClimateChange"
    assert one(spark, t.first_topic(F.col("c")), c="1_sports") is None
    assert one(spark, t.article_id(F.col("c")), c="file:/d/climate/12.json") == "12_climate"
    assert one(spark, t.safe_filename(F.col("c")), c="a/b..c") == "article_a_b_c.json"
    assert one(spark, t.clean_label(F.col("c")), c=" **Expert** ") == "Expert"
    assert one(spark, t.combined_text(F.col("c"), F.col("d")), c="", d="x") == ". x"
    assert one(spark, t.name_or_raw(F.col("c"), F.col("d")), c="", d="raw") == "raw"
    assert one(spark, t.media_url(F.col("c"), 300), c="") is None
    h = hashlib.md5(b"a_b.jpg").hexdigest()
    assert one(spark, t.media_url(F.col("c"), 300, "h"), c="a b.jpg") == f"h/{h[0]}/{h[:2]}/a_b.jpg/300px-a_b.jpg"
    assert one(spark, t.blank(F.col("c")), c="  \n") is True
    assert one(spark, t.prompt("{a}: {b}?", a=F.col("c"), b=F.lit(None).cast("string")), c="x") == "x: ?"
    assert one(spark, t.experiment_name(F.col("c"), F.lit("b"), F.lit("c/1")), c="a.1") == "a_1__b__c-1"


@pytest.mark.parametrize(("broken", "want"), [("cafÃ©", "café"), ("itâ€™s", "it's"), ("Ã¨ → cafÃ©", "è → café"), ("a &lt; b &amp; c", "a < b & c"), ("<p>&amp;</p>", "<p>&amp;</p>"), ("\ufb01ne \u201cq\u201d", 'fine "q"'), ("a\r\nb\rc\u2028d", "a\nb\nc\nd"), ("a\x07\x1b[31mb\ufeff", "ab"), ("e\u0301 \uff21", "é A"), ("fine é", "fine é"), ("", ""), (None, ""), ("Ãx", "Ãx")])
def test_fix_text(spark, broken, want):
    assert one(spark, t.fix_text(F.col("c")), c=broken) == want


CLAIM = {"agent_name": "A", "utterance_type": "direct", "utterance_text": "x", "source_context": "c"}


@pytest.mark.parametrize(
    ("answer", "n"),
    [
        (json.dumps({"results": [CLAIM, CLAIM]}), 2),
        (json.dumps([CLAIM]), 1),
        (json.dumps({"other": [CLAIM]}), 0),
        ("Sure! " + json.dumps({"results": [CLAIM]}) + " Done.", 1),
        ("one " + json.dumps(CLAIM) + " two " + json.dumps(CLAIM) + ' three {"agent_name": broken}', 2),
        ("nothing", 0),
        ("", 0),
    ],
)
def test_first_version(spark, answer, n):
    assert len(one(spark, j.first_version_claims(F.col("a")), a=answer)) == n


@pytest.mark.parametrize(
    ("answer", "n"),
    [("text ```json\n" + json.dumps({"claims": [1, 2]}) + "\n``` end", 2), ("x " + json.dumps({"claims": [1]}) + " y", 1), ('{"claims": [1, 2,],}', 2), ("{'claims': [3]}", 1), ("{claims: [3]}", 1), (json.dumps([1]), None), (json.dumps({"other": [1]}), None), ("none", None)],
)
def test_second_version(spark, answer, n):
    got = one(spark, F.to_json(j.second_version_value(F.col("a"), "claims")), a=answer)
    assert (None if got is None else len(json.loads(got))) == n


@pytest.mark.parametrize(("answer", "want"), [('{"a": 1}', {"a": 1}), ("```json\n{\"a\": 1}\n```", {"a": 1}), ('so {"a": 1} ok', {"a": 1}), ("{a: 1,}", {"a": 1}), ("{'a': 1}", {"a": 1}), ("[1]", None), ("no", None), (None, None)])
def test_answer(spark, answer, want):
    got = one(spark, F.to_json(j.answer(F.col("a"))), a=answer)
    assert (None if got is None else json.loads(got)) == want


@pytest.mark.parametrize(("answer", "want"), [('[{"a": 1}]', [{"a": 1}]), ('{"results": [1]}', [1]), ('{"claims": [1, 2]}', [1, 2]), ('{"a": 1}', [{"a": 1}]), ('[{"a": 1},]', [{"a": 1}]), ("x", None)])
def test_list_under(spark, answer, want):
    got = one(spark, F.to_json(j.list_under(F.col("a"), "results")), a=answer)
    assert (None if got is None else json.loads(got)) == want
