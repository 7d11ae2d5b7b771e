"""Readers and writers round trip."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import annotators, graph
from claimloom.sources import articles, checkpoints, prompts, rdf
from claimloom.streaming.checkpoints import process_new


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "climate").mkdir()
    full = {"title": "cafÃ©", "body": "Body", "published_at": "2024-01-01 00:00:00+00:00", "summary": {"sentences": ["a", "b"]}, "author": {"name": "Ann"}, "links": {"permalink": "http://x"}, "source": {"name": "S", "domain": "s.org", "locations": [{"city": "Rome"}]}}
    (tmp_path / "climate" / "1.json").write_text(json.dumps(full))
    (tmp_path / "climate" / "2.json").write_text('{"body": null}')
    (tmp_path / "climate" / "3.json").write_text('{"title": "broken')
    (tmp_path / "climate" / "skip.txt").write_text("no")
    return str(tmp_path)


def test_articles(spark, corpus, tmp_path):
    rows = {r.article_id: r for r in articles.load_articles(spark, corpus).collect()}
    assert set(rows) == {"1_climate", "2_climate"}
    assert rows["1_climate"].title == "café" and rows["1_climate"].source_info.locations[0].city == "Rome" and rows["1_climate"].summary == ["a", "b"]
    assert (rows["2_climate"].title, rows["2_climate"].body, rows["2_climate"].author, rows["2_climate"].source) == ("No Title", "", "Unknown", "Unknown")
    store = str(tmp_path / "store")
    for _ in range(2):  # built, then loaded
        a, v = articles.load_or_build(spark, corpus, store, annotators.hashing_encoder(8))
        assert a.count() == 2 and {r.kind for r in v.select("kind").distinct().collect()} == {"combined", "title", "body"}
    n, names = articles.export_csv(a, str(tmp_path / "csv"))
    assert n == 2 and "title" in names and spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 2


def test_checkpoints(spark, tmp_path):
    claim = {"agent_name": "Ann", "agent_type": "person", "utterance_type": "direct", "utterance_text": "t", "source_context": "c"}
    doc = {"article_id": "1_x", "title": "T", "claims": [claim], "agents_info": {"Ann": {"type_of_agent": "person", "wikidata_info": {"wikidata_id": "Q9"}, "taxonomy_info": {"classification": "Expert"}, "match_evaluation": "YES", "extraction_history": [{"event": "e", "details": {"n": 1}}]}}, "timestamp": "2", "status": "success"}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps(doc | {"article_id": "2_x", "status": "error", "claims": None}))
    (tmp_path / "c.json").write_text("{broken")
    df = checkpoints.read_json(spark, f"{tmp_path}/*.json")
    assert df.count() == 2
    folder = str(tmp_path / "table")
    checkpoints.append(df, folder)
    checkpoints.append(df.filter("article_id = '1_x'").withColumn("timestamp", F.lit("3")).withColumn("status", F.lit("error")), folder)
    from claimloom.operators.lookup import resumable

    assert [r.article_id for r in resumable(df).collect()] == ["1_x"] and resumable(checkpoints.read(spark, folder)).count() == 0
    agent = checkpoints.agent_rows(df.filter("status = 'success'")).first()
    assert (agent.agent_name, agent.entity_id, agent.classification) == ("Ann", "Q9", "Expert")
    assert checkpoints.claim_rows(df).count() == 1


TURTLE = r'''@prefix ex: <http://e.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
@base <http://base.org/> .
# a comment
ex:A a owl:Class ; rdfs:label "A \"q\" é"@en, 'B' ; rdfs:comment """two
lines""" ; ex:n 1, 2.5, 3e4, true ; ex:d "2024"^^<http://www.w3.org/2001/XMLSchema#gYear> .
<rel> ex:list ( ex:x "y" ) ; ex:r [ a owl:Restriction ; owl:onProperty ex:p ] .
_:b1 ex:to ex:v1.2 .
'''


def test_turtle(spark, tmp_path):
    triples, names = rdf.parse_turtle(TURTLE)
    assert names["ex"] == "http://e.org/" and len(triples) == 9 + 2 + 4 + 2 + 1
    assert ("http://e.org/A", graph.LABEL, 'A "q" é', "literal", None, "en") in triples
    assert any(t[0] == "http://base.org/rel" for t in triples) and any(t[2] == "http://e.org/v1.2" for t in triples)
    with pytest.raises(ValueError):
        rdf.parse_turtle("ex:a ex:b")
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "broken.ttl").write_text("<a> <b>")
    df = rdf.read_turtle(spark, str(tmp_path / "a.ttl"), str(tmp_path / "broken.ttl"), str(tmp_path / "absent.ttl"))
    assert df.count() == len(triples)


@pytest.mark.parametrize("form", ["turtle", "nt"])
def test_sinks_read_back(spark, tmp_path, form):
    df = spark.createDataFrame([t for t in rdf.parse_turtle(TURTLE)[0] if not t[0].startswith("_:") and not t[2].startswith("_:")], graph.TRIPLE)
    rdf.write(df, str(tmp_path / form), form)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / form), wholetext=True).collect())
    assert set(rdf.parse_turtle(text)[0]) == {tuple(r) for r in df.collect()}


def test_other_forms(spark, tmp_path):
    df = spark.createDataFrame([t for t in rdf.parse_turtle(TURTLE)[0] if not t[0].startswith("_:") and not t[2].startswith("_:")], graph.TRIPLE)
    objects = [json.loads(r.value) for r in rdf.json_ld(df).collect()]
    assert sum(len(v) for o in objects for k, v in o.items() if k != "@id") == df.count()
    (tmp_path / "g.rdf").write_text(rdf.xml_document([r.value for r in rdf.rdf_xml(df).collect()]))
    back = rdf.read_rdf_xml(spark, str(tmp_path / "g.rdf"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_prompts():
    text = "# head\n- name: Extractor\n  role: system\n  content: |\n    Line one: {x}\n\n    - item\n  user_prompt: 'Do it'\n- name: Other\n  content: >-\n    folded\n    text\n"
    p = prompts.parse(text)
    assert p["Extractor"]["content"] == "Line one: {x}\n\n- item\n" and p["Extractor"]["user_prompt"] == "Do it" and p["Other"]["content"] == "folded text"
    assert prompts.required(p, ["Other"]) is p and prompts.named(p, "none") is None
    with pytest.raises(KeyError):
        prompts.required(p, ["Missing"])


def test_stream_resumes(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        process_new(spark, source, "id bigint", lambda df: df.withColumn("twice", df.id * 2), sink, mark).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 8


def test_flat_export_keeps_every_character(spark, tmp_path):
    texts = [None, "", " a ", "\t", "a\rb", "\r\n", "\n", '"', '""', "\\", '\\"', 'x"\n,"y', "\\N", "null", "#", "\x00", "\u00a0"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    folder = str(tmp_path / "flat")
    articles.export_csv(df, folder)
    assert [r.text for r in sorted(articles.read_csv(spark, folder, df.columns).collect(), key=lambda r: int(r.id))] == texts
