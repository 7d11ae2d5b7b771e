"""Operators on small fixtures."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from claimloom.operators import annotators, claims, evaluation, graph, kb, linking, lookup, ontology, pipeline, vector


def test_search_kinds_and_zero_vectors(spark):
    store = spark.createDataFrame([("a", "title", [1.0, 0.0]), ("b", "title", [0.0, 0.0]), ("a", "combined", [0.0, 1.0])], "article_id string, kind string, embedding array<float>")
    hits = vector.search(store, [1.0, 0.0], None, "title", ("title", "combined"))
    assert [(r.article_id, round(r.similarity_score, 4), r.search_type) for r in hits.collect()] == [("a", 1.0, "title"), ("b", 0.99, "title")]
    assert vector.search(store, [0.0, 1.0], 9, "body", ("title", "combined")).first().search_type == "combined"
    by_cosine = vector.search(store, [1.0, 0.0], 5, "title", ("title",), metric="cosine").collect()
    assert [r.similarity_score for r in by_cosine] == [1.0, None]
    with pytest.raises(ValueError):
        vector.top_k(store, [1.0], metric="dot")


def test_by_ids_keeps_order_and_last_rows(spark):
    a = spark.createDataFrame([("x", "old", 0), ("x", "new", 1), ("y", "why", 2)], "article_id string, title string, _row int")
    ids = lookup.id_list(spark, ["y", "x", "z", "y"])
    assert [(r.pos, r.title) for r in lookup.by_ids(a, ids).collect()] == [(0, "why"), (1, "new"), (3, "why")]
    assert [r.id for r in lookup.missing_ids(a, ids).collect()] == ["z"]


CONSENSUS = [("k1", "A", "x"), ("k1", "B", "y"), ("k1", "C", "y"), ("k2", "A", "x"), ("k2", "B", "z"), ("k3", "C", "q"), ("k4", "A", "1"), ("k4", "B", "2"), ("k4", "C", "3")]


def test_consensus_majority_and_ties(spark):
    df = spark.createDataFrame(CONSENSUS, "key string, annotator string, v string")
    got = {r.key: (r.annotators, r.v) for r in claims.consensus(df, ["key"], ["v"]).collect()}
    assert got == {"k1": (3, "y"), "k2": (2, "x"), "k4": (3, "1")}
    s = claims.statistics(df, claims.consensus(df, ["key"], ["v"])).first()
    assert (s.llm_A_claims, s.llm_B_claims, s.llm_C_claims, s.final_claims, round(s.retention_rate, 2)) == (3, 3, 3, 3, 33.33)
    none = claims.statistics(df.limit(0), df.limit(0)).first()
    assert none.retention_rate == 0.0 and none.total_extracted == 0


def test_near_contexts(spark):
    df = spark.createDataFrame([(1, "He said the tax is too high"), (1, "He said the tax is too  high!"), (1, "Something else entirely"), (2, "He said the tax is too high")], "article_id int, source_context string")
    keys = [(r.article_id, r.context_key) for r in claims.near_contexts(df).collect()]
    assert len(set(keys)) == 3


def test_near_contexts_beyond_first_words(spark):
    df = spark.createDataFrame([(1, "The tax is too high for all of us here, they said"), (1, "A tax is too high for all of us here, they said"), (1, "Those who pay it think nothing of that"), (2, "The tax is too high for all of us here, they said"), (None, "x"), (2, None)], "article_id int, source_context string")
    rows = sorted(((r.article_id or 0, r.source_context or "", r.context_key) for r in claims.near_contexts(df).collect()), key=repr)
    a, the, those = "a tax is too high for all of us here, they said", "the tax is too high for all of us here, they said", "those who pay it think nothing of that"
    assert [(i, k) for i, _, k in rows] == [(0, None), (1, a), (1, a), (1, those), (2, None), (2, the)]


def _edited(r, s):
    for _ in range(r.randrange(9)):
        p = r.randrange(len(s) + 1)
        s = s[:p] + r.choice(["", "a", "é", "日", " "]) + s[p + r.randrange(2) :]
    return s


@pytest.mark.parametrize("limit", [8000, 9])
def test_near_contexts_as_all_pairs(spark, limit):
    r = random.Random(limit)
    rows = []
    for article in range(5):
        base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(150))) for _ in range(3)]
        rows += [(article, k, _edited(r, _edited(r, r.choice(base)))) for k in range(30)]
    df = spark.createDataFrame(rows, "article_id int, pos int, source_context string")
    con = duckdb.connect()
    con.execute("CREATE TABLE x AS SELECT unnest(?) AS a, unnest(?) AS pos, unnest(?) AS c", [list(x) for x in zip(*rows)])
    want = con.execute("WITH k AS (SELECT a, pos, lower(regexp_replace(trim(c), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM x) SELECT o.a, o.pos, min(p.t) FROM k o JOIN k p ON o.a = p.a AND levenshtein(o.t, p.t) <= greatest(length(o.t), length(p.t)) * 0.15 GROUP BY 1, 2").fetchall()
    got = [(x.article_id, x.pos, x.context_key) for x in claims.near_contexts(df, limit=limit).collect()]
    assert sorted(got) == sorted(want)


def test_valid_items_and_shape(spark):
    rows = [{"agent_name": "A", "agent_description": "", "agent_type": "person", "utterance_type": "direct", "utterance_text": "t", "source_context": "c"}]
    bad = [rows[0] | {"agent_type": "Person"}, rows[0] | {"agent_name": " "}, rows[0] | {"source_context": None}]
    df = spark.createDataFrame([(json.dumps(rows + bad),)], "j string").select(F.from_json("j", "array<struct<agent_name:string,agent_description:string,agent_type:string,utterance_type:string,utterance_text:string,source_context:string>>").alias("c"))
    assert df.select(F.size(claims.valid_items(F.col("c"))).alias("n")).first().n == 1
    assert df.select(claims.first_version_shape(F.col("c")).alias("c")).first().c is None


ENTITY = "entity_id string, labels map<string,string>, aliases map<string,array<string>>, instance_of array<string>"


def test_candidates_and_second_chance(spark):
    e = spark.createDataFrame([("Q9", {"en": "Ann Lee"}, {}, ["Q5"]), ("Q8", {"en": "Ann Lee"}, {}, ["Q5"]), ("Q7", {"en": "Acme"}, {"en": ["ACME Ltd"]}, ["Q783794"])], ENTITY)
    a = spark.createDataFrame([(1, "ann lee ", "person", None), (2, "acme ltd", "Organization", None), (3, "acme", "person", None), (4, "Dr Ann Lee", "person", "Ann Lee"), (5, "  ", "person", "Nobody"), (6, "Ann Lee", "ghost", None)], "agent_id int, agent_name string, type_of_agent string, ner_name string")
    got = {r.agent_id: (r.candidates, r.route, r.processed_name) for r in linking.second_chance(linking.candidates(a, e), e).collect()}
    assert got[1] == (["Q8", "Q9"], "multiple", "ann lee ") and got[2] == (["Q7"], "one", "acme ltd")
    assert got[3][:2] == ([], "none") and got[4] == (["Q8", "Q9"], "multiple", "Ann Lee") and got[5] == ([], "none", "Nobody") and got[6][1] == "none"


def test_classified(spark):
    rows = [(1, "person", 1, "**Expert**", "HIGH", "e", None), (2, "person", 1, "NGO", "LOW", "e", None), (2, "person", 2, "Spy", "LOW", "e", None), (3, "organization", 1, "bad", "LOW", "e", None), (3, "organization", 2, None, None, None, "timeout"), (4, "organization", 1, None, None, None, "x"), (4, "organization", 2, "NGO", "HIGH", "fine", None)]
    df = spark.createDataFrame(rows, "agent_id int, type_of_agent string, attempt int, answer string, confidence string, explanation string, error string")
    got = {r.agent_id: (r.classification, r.confidence) for r in linking.classified(df).collect()}
    assert got == {1: ("Expert", "HIGH"), 2: ("Other", "LOW"), 3: ("Unknown", "NONE"), 4: ("NGO", "HIGH")}


def test_kb_records(spark):
    c = lambda p, o, **v: (p, o, v.get("id"), v.get("time"), v.get("s"), v.get("start"), v.get("end"), v.get("of"))
    rows = [
        ("P1", {"en": "Ann"}, {}, {"en": "a person"}, [c("P39", 0, id="L1", start="+2001-01-01T0", end="+2004-01-01T0"), c("P39", 1, id="L2", start="+2005-01-01T0", of="L1"), c("P39", 2, id="nope"), c("P569", 0, time="+1960-02-03T00:00:00Z"), c("P18", 0, s="Ann Lee.jpg"), c("P106", 0, id="L1"), c("P106", 1, id="L2", end="+1999-01-01T0")]),
        ("L1", {"en": "mayor"}, {}, {}, []),
        ("L2", {"it": "ministro", "en": "minister"}, {}, {}, []),
    ]
    e = spark.createDataFrame(rows, f"entity_id string, labels map<string,string>, aliases map<string,array<string>>, descriptions map<string,string>, claims array<{kb.CLAIM}>")
    p = kb.persons(e).filter("entity_id = 'P1'").first()
    assert [(x.name, x.start_date, x.organization) for x in p.position_held] == [("minister", "2005-01-01", "mayor"), ("mayor", "2001-01-01", None)]
    assert p.birth_date == "1960-02-03" and p.occupation == ["mayor", "minister"] and "300px-Ann_Lee.jpg" in p.image_url and p.religion == []


def test_graph_is_a_set_and_compat(spark):
    art = spark.createDataFrame([("1_us_politics", "T", "B", "2024-01-01 00:00:00Z", "u", "Pub", "d.org"), (None, "x", "x", None, None, None, None)], "article_id string, title string, body string, date string, source_link string, publisher string, domain string")
    ag = spark.createDataFrame([("1_us_politics", "Acme Co", "organization", "NGO", "Q1")], "article_id string, agent_name string, type_of_agent string, classification string, entity_id string")
    cl = spark.createDataFrame([("1_us_politics", i, n, "text", "ctx", k) for i, n, k in [(0, "Acme Co", "direct"), (1, "Acme Co", "indirect"), (2, "Ghost", "odd")]], "article_id string, pos int, agent_name string, utterance_text string, source_context string, utterance_type string")
    e = graph.Emitter()
    g = e.graph(art, ag, cl)
    twice = e.graph(art.union(art), ag.union(ag), cl.union(cl))
    assert g.count() == twice.count() and g.exceptAll(twice).count() == 0
    n = {r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1]: r.n for r in graph.predicate_counts(g).collect()}
    assert n["hasUtterance"] == 2 and n["hasAgentComponent"] == 1 and n["hasUtteranceType"] == 1 and n["concernsTopic"] == 2
    types = lambda g: {r.o.rsplit("/", 1)[-1] for r in graph.type_counts(g).collect()}
    assert "Organization" in types(g) and "Person" not in types(g) and "Person" in types(graph.Emitter(compat=True).graph(art, ag, cl))
    assert graph.cardinality_violations(g, e.term("hasUtterance"), subject_type=e.term("Claim")).count() == 0
    assert graph.cardinality_violations(g, e.term("hasAgentComponent"), subject_type=e.term("Claim")).count() == 1


def test_closure_and_merge(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("d", "a")], "child string, parent string")
    assert {r.node: r.level for r in ontology.closure(edges, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}
    empty = spark.createDataFrame([], graph.TRIPLE)
    once = ontology.merge(empty, ontology.fallback(spark), graph.VOCABULARY)
    again = ontology.merge(once, ontology.fallback(spark), graph.VOCABULARY)
    assert once.count() == again.count() == 4 * 7 + 2
    h = {r.name: r for r in ontology.hierarchy(once).collect()}
    assert len(h) == 7 and len(h["Organization"].children) == 6
    new = ontology.replaced(once, ontology.ORGANIZATION, graph.LABEL, "Body")
    assert new.filter((F.col("s") == ontology.ORGANIZATION) & (F.col("p") == graph.LABEL)).first().o == "Body"


def test_retry_and_backoff():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "yes"

    assert annotators.retried(flaky, bool, 3, 1.5, waits.append) == ("yes", 3, None) and waits == [1.5, 1.5]
    assert annotators.retried(lambda: "", bool, 2, 0)[2] == "refused"
    replies = iter([(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, "body")])
    waits.clear()
    assert annotators.backoff(lambda: next(replies), sleep=waits.append) == "body" and waits == [7.0, 2]
    assert annotators.backoff(lambda: (404, {}, "")) is None


def test_names(spark):
    names = [("Dr. Ann Lee, minister", "person", "Ann Lee"), ("Acme Ltd", "person", None), ("Acme Ltd", "organization", "Acme Ltd"), ("a source", "person", None), (None, "person", None), ("Sir Bob (UK)", "Person", "Bob"), ("Ann", None, None)]
    df = spark.createDataFrame(names, "n string, k string, want string").select(annotators.ner("n", "k").alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.parametrize("version", [1, 2])
def test_pipeline(spark, version):
    text = 'the mayor Ann Lee said: "The tax is far too high." and then Bob Roy said, "We disagree on that."'
    art = spark.createDataFrame([("1_us_politics", "Title", text), ("2_x", "No quotes", "Nothing here")], "article_id string, title string, body string")
    e = spark.createDataFrame([("Q9", {"en": "Ann Lee"}, {}, ["Q5"])], ENTITY)
    out = pipeline.run(art, e, pipeline.Settings(version=version))
    assert out["totals"].first().asDict() == {"num_articles": 2, "num_claims": 2, "num_agents": 2}
    assert {r.agent_name: r.match_evaluation for r in out["agents"].collect()} == {"Ann Lee": "YES", "Bob Roy": "NO"}
    assert out["graph"].filter(F.col("p").endswith("sameAs")).count() == 1
    ids = pipeline.found(art, ids=["2_x"])
    assert [r.article_id for r in ids.collect()] == ["2_x"] and pipeline.found(art, ids=[]).count() == 0
    with pytest.raises(ValueError):
        pipeline.found(art)


def test_scores(spark):
    p = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    s = evaluation.precision_recall(p, "a", "b").first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall, s.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluation.precision_recall(p.limit(0), "a", "b").first().f1 is None


def test_augmented_search(spark):
    store = spark.createDataFrame([("a", "combined", [1.0, 0.0]), ("b", "combined", [0.0, 1.0])], "article_id string, kind string, embedding array<float>")
    art = spark.createDataFrame([("a", "", "content a"), ("b", "text b", "")], "article_id string, text string, content string")
    got = vector.augmented(art, store, [0.9, 0.1]).collect()
    assert [(r.article_id, r.current_article) for r in got] == [("a", "content a"), ("b", "content a")]
    assert {r.current_article for r in vector.augmented(art.drop("text", "content"), store, [0.0, 1.0]).collect()} == {""}


def test_history(spark):
    df = spark.createDataFrame([(1, 1, "late", "{}"), (1, 0, "early", '{"n": 1}'), (2, 0, "x", None)], "agent_id int, pos int, event string, details string")
    assert {r.agent_id: [x.event for x in r.history] for r in lookup.history(df, "agent_id").collect()} == {1: ["early", "late"], 2: ["x"]}


def test_taxonomy_source(spark, tmp_path):
    assert ontology.organization_taxonomy(spark, str(tmp_path / "absent.rdf")).count() == 7
    (tmp_path / "v.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><rdfs:Class rdf:about="https://schema.org/Bank"><rdfs:label>Bank</rdfs:label><rdfs:subClassOf rdf:resource="https://schema.org/Organization"/></rdfs:Class></rdf:RDF>')
    assert {r.name for r in ontology.organization_taxonomy(spark, str(tmp_path / "v.rdf")).collect()} == {"Bank", "Organization"}


def test_first_list(spark):
    from claimloom.functions import jsonladder as j

    one = '[{"agent_name": "A", "utterance_text": "t"}]'
    df = spark.createDataFrame([(f'{{"results": {one}}}',), (f'{{"claims": {one}, "results": []}}',), ('{"claims": "no"}',), ("{}",)], "a string")
    got = [len(r.c) for r in df.select(j.first_list(F.try_parse_json("a"), ("claims", "results", "final_claims")).alias("c")).collect()]
    assert got == [1, 1, 0, 0]
