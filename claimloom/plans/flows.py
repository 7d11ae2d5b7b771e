"""Readers, writers, answers and whole runs, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import jsonladder as j
from claimloom.functions import text as t
from claimloom.operators import annotators, claims as c, graph, kb, linking, lookup, ontology, pipeline, vector
from claimloom.plans import graph as graphs
from claimloom.plans.claims import claim_table
from claimloom.plans.linking import agents, entities
from claimloom.plans.ontology import catalog_graph
from claimloom.sources import articles as store
from claimloom.sources import checkpoints, prompts, rdf
from claimloom.sources.tables import cut, table, workspace


def _md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


# ---- answers


def _claim_json() -> Column:
    return F.to_json(F.struct(F.col("role").alias("agent_name"), F.lit("someone").alias("agent_description"), F.lit("person").alias("agent_type"), F.lit("direct").alias("utterance_type"), F.col("text").alias("utterance_text"), F.col("text").alias("source_context")))


def _claim_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, k = _claim_json(), F.col("turn") % 7
    listed = F.concat(F.lit('{"results": ['), x, F.lit(", "), x, F.lit("]}"))
    answer = (
        F.when(k == 0, listed)
        .when(k == 1, F.concat(F.lit("["), x, F.lit("]")))
        .when(k == 2, F.concat(F.lit("Here you are:\n```json\n"), listed, F.lit("\n```\nThat is all.")))
        .when(k == 3, F.concat(F.lit("first "), x, F.lit(" then "), x, F.lit(" and {no more")))
        .when(k == 4, F.lit('{"findings": []}'))
        .when(k == 5, F.concat(F.lit('{"results": ['), x, F.lit(", "), x, F.lit(", {cut off")))
        .otherwise("I found nothing.")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


def claims_first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version's ladder over seven forms of answers."""
    found = c.first_version_shape(j.first_version_claims(F.col("answer")))
    return _claim_answers(spark, sf_dir).select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", F.size("f").alias("n"), F.get("f", 0)["agent_name"].alias("agent"), _md5(F.get("f", -1 + F.size("f"))["utterance_text"]).alias("last_md5"))


def claims_second_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version's reading: a fenced or the widest block under a key; null is a failed try."""
    v = j.second_version_value(F.col("answer"), "results")
    found = c.valid_items(F.try_variant_get(v, "$", j.CLAIMS))
    return _claim_answers(spark, sf_dir).select("conv_id", "turn", v.isNotNull().alias("read"), F.size(found).alias("n"))


def claims_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several result keys that holds a list."""
    x, k = _claim_json(), F.col("turn") % 3
    answer = F.when(k == 0, F.concat(F.lit('{"claims": ['), x, F.lit("]}"))).when(k == 1, F.concat(F.lit('{"claims": "none", "results": ['), x, F.lit(","), x, F.lit("]}"))).otherwise(F.lit('{"other": [1]}'))
    found = j.first_list(F.try_parse_json(answer), ("claims", "results"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).alias("n"))


def first_version_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose claims all have the first version's four fields."""
    k = F.col("turn") % 2 == 0
    claim = F.struct(F.col("role").alias("agent_name"), F.lit("direct").alias("utterance_type"), F.col("text").alias("utterance_text"), F.when(k, F.col("text")).alias("source_context"))
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(claim).alias("claims"))
    return by.select("conv_id", c.first_version_shape(F.col("claims")).isNotNull().alias("whole"))


def answer_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tries at an answer with a reasoning; the first complete one counts."""
    k = F.col("c_custkey") % 4
    good = lambda n: F.concat(F.lit('{"answer": "Q'), F.col("c_custkey").cast("string"), F.lit(f'", "reasoning": "try {n}"}}'))
    tries = [F.when(k == 0, good(1)).otherwise('{"answer": "Q1"}'), F.when(k == 1, good(2)).otherwise('{"answer": "Q1", "reasoning": "  "}'), F.when(k == 2, F.concat(F.lit("Sure: "), good(3))).otherwise("no")]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("attempt"), x.alias("answer")) for i, x in enumerate(tries, 1)])))
    return linking.accepted_answers(rows)


def near_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of three annotators that differ by a few edits, brought under the least of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array("text", F.concat("text", F.lit("!")), F.concat("text", F.lit("  AND MUCH MORE THAN ANYBODY SAID IN THE WHOLE ARTICLE AND IN ALL OTHERS OF THAT DAY AND THE NEXT")).alias("x"))).alias("source_context"))
    return c.near_contexts(turns, "conv_id").filter("context_key is not null").select("conv_id", "turn", _md5(F.col("source_context")).alias("context_md5"), _md5(F.col("context_key")).alias("key_md5"))


def annotators_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with at least one claim of an assistant, which alone go on to the vote."""
    return c.with_any(claim_table(spark, sf_dir).filter("agent_name = 'assistant'"))


# ---- corpora and checkpoints


def article_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as article files in topic folders, read back, built into a store, saved and loaded; broken files are left out."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 5
    there = F.struct(F.when(k != 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("title"), F.col("url").alias("body"), F.struct(F.when(k != 1, "Ann Writer").alias("name")).alias("author"), F.struct(F.col("url").alias("permalink")).alias("links"), F.when(k != 2, F.lit("2024-01-05")).alias("published_at"))
    rows = p.select(F.concat(F.lit("topic"), (F.col("page_id") % 3).cast("string")).alias("topic"), F.col("page_id").cast("string").alias("name"), F.when(k == 4, F.lit('{"title": "broken')).otherwise(F.to_json(there)).alias("json"))
    folder = workspace(spark)
    store.write_raw(rows, f"{folder}/raw")
    encoder = annotators.hashing_encoder(16)
    found, vectors = store.load_or_build(spark, f"{folder}/raw", f"{folder}/store", encoder)
    again, _ = store.load_or_build(spark, f"{folder}/none", f"{folder}/store", encoder)  # the stored one, nothing is read anew
    kinds = vectors.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return again.join(found.select("article_id"), "article_id", "left_semi").join(kinds, "article_id").select("article_id", "title", "body", "author", "date", "source", "source_link", "kinds")


def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a nested column exported flat and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.struct("lang", "source").alias("info"))
    folder = workspace(spark)
    rows, columns = store.export_csv(docs, folder)
    back = store.read_csv(spark, folder, columns)
    info = F.from_json("info", "lang string, source string")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("length"), info["lang"].alias("lang"), info["source"].alias("source"), F.lit(rows).cast("bigint").alias("n_rows"), F.lit(",".join(columns)).alias("columns"))


def checkpoint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes and failures appended to the checkpoint table and written as files; the latest row decides what is done."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "doc_id", "lang", F.col("source").alias("title"))
    claim = F.struct(*[F.lit(x).alias(x) for x in c.FIELDS])
    done = docs.filter("doc_id % 3 = 0").withColumn("claims", F.array(claim))
    folder = workspace(spark)
    checkpoints.append(checkpoints.successes(done, F.lit("2026-01-02")), f"{folder}/table")
    checkpoints.append(checkpoints.failures(docs.filter("doc_id % 6 <> 1"), F.lit("timeout"), F.when(F.col("doc_id") % 2 == 0, "2026-01-03").otherwise("2026-01-01")), f"{folder}/table")
    rows = checkpoints.read(spark, f"{folder}/table")
    checkpoints.write_files(rows.filter("status = 'success'"), folder)
    files = checkpoints.read_json(spark, f"{folder}/files/*.json").select("article_id").distinct()
    use = lookup.resumable(rows).select("article_id")
    latest = rows.groupBy("article_id").agg(F.max_by("error", "timestamp").alias("error"))
    state = docs.select("article_id").join(use.withColumn("state", F.lit("done")), "article_id", "left")
    return state.join(latest, "article_id", "left").join(files.withColumn("file", F.lit(True)), "article_id", "left").select("article_id", F.coalesce("state", F.lit("todo")).alias("state"), "error", F.coalesce("file", F.lit(False)).alias("has_file"))


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condensed summary written as JSON and read back."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source")
    rows = claim_table(spark, sf_dir)
    infos = c.unique_agents(rows).select("article_id", "agent_name", F.struct("agent_type").alias("info"))
    folder = workspace(spark)
    store.write_summary(lookup.condensed(articles, rows.select("article_id", "pos", F.struct("agent_name", "utterance_text").alias("claim")), infos), folder)
    back = spark.read.schema("article_id bigint, source string, claims array<struct<agent_name:string,utterance_text:string>>, agents_info map<string,struct<agent_type:string>>").json(folder)
    return back.select("article_id", "source", F.size("claims").alias("n_claims"), _md5(F.get("claims", 0)["utterance_text"]).alias("first_md5"), F.size("agents_info").alias("n_agents"))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order, as an array."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("event"), F.col("props").alias("details"))
    h = F.col("history")
    return lookup.history(rows, "user_id").select("user_id", F.size(h).alias("n"), F.array_join(F.transform(h, lambda x: x["event"]), ",").alias("events"), _md5(F.array_join(F.transform(h, lambda x: x["details"]), "|")).alias("details_md5"))


# ---- prompts

PROMPTS = """
- name: ask
  role: system
  content: "You read about {lang}."
  user_prompt: |
    Text {id}:
    {text}
- name: plain
  content: Nothing here
"""


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue's prompt filled from every document."""
    entry = prompts.named(prompts.required(prompts.parse(PROMPTS), ["ask", "plain"]), "ask")
    docs = table(spark, sf_dir, "documents")
    user = t.prompt(entry["user_prompt"], id=F.col("doc_id").cast("string"), text=F.col("text"))
    return docs.select("doc_id", t.prompt(entry["content"], lang=F.col("lang")).alias("system"), _md5(user).alias("user_md5"))


# ---- triples


def _some_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_graph(spark, sf_dir)


def rdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue graph written as Turtle with bound prefixes, N-Triples and RDF/XML and read back, counted by predicate."""
    g, folder = cut(_some_triples(spark, sf_dir)), workspace(spark)
    rdf.write(g, f"{folder}/turtle", "turtle", {"rdfs": graph.RDFS, "owl": graph.OWL, "schema": graph.SCHEMA})
    rdf.write(g.coalesce(1), f"{folder}/nt", "nt")
    lines = rdf.rdf_xml(g).coalesce(1).agg(F.array_sort(F.collect_list("value")).alias("v"))  # an ontology
    lines.select(F.concat(F.lit(rdf.xml_document([]).split("\n</rdf:RDF>")[0] + "\n"), F.array_join("v", "\n"), F.lit("\n</rdf:RDF>\n")).alias("value")).write.text(f"{folder}/xml")
    rdf.write(g, f"{folder}/jsonld", "json-ld")
    back = {"turtle": rdf.read_turtle(spark, f"{folder}/turtle/part-*"), "nt": rdf.read_turtle(spark, f"{folder}/nt"), "xml": rdf.read_rdf_xml(spark, f"{folder}/xml")}
    out = None
    for form, rows in back.items():
        same = rows.select("s", "p", "o", "o_kind").distinct().withColumn("form", F.lit(form)).join(g.select("s", "p", "o", "o_kind"), ["s", "p", "o", "o_kind"], "left_semi")
        out = same if out is None else out.unionByName(same)
    subjects = spark.read.text(f"{folder}/jsonld").select(F.get_json_object("value", "$.@id").alias("s"), F.lit("json-ld").alias("p"), F.lit("").alias("o"), F.lit("").alias("o_kind"), F.lit("json-ld").alias("form"))
    return out.unionByName(subjects).groupBy("form", "p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def tbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's triples and the claims' triples as one set."""
    news = graphs.EMITTER.about_articles(graphs.articles(spark, sf_dir))
    return graph.predicate_counts(graph.merged(_some_triples(spark, sf_dir), news, news))


def fallback_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in classes, as the vocabulary's file isn't there."""
    found = ontology.organization_taxonomy(spark, f"{sf_dir}/no_such_vocabulary.rdf")
    return found.select("name", F.array_join("parents", ",").alias("parents"), F.size("children").alias("n_children"))


def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without an id have no triples; blank agent names find no candidates."""
    rows = graphs.articles(spark, sf_dir).withColumn("article_id", F.when(F.length("title") % 2 == 0, F.col("article_id")).when(F.length("title") % 3 == 0, ""))
    n = graphs.EMITTER.news_items(rows).agg(F.count_distinct("s").alias("n")).withColumn("what", F.lit("subjects"))
    blank = agents(spark, sf_dir).withColumn("agent_name", F.when(F.col("agent_id") % 2 == 0, F.lit("  ")).otherwise(F.col("agent_name")))
    found = linking.candidates(blank, entities(spark, sf_dir)).filter(F.size("candidates") > 0).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("linked"))
    return n.unionByName(found).select("what", "n")


# ---- search and whole runs


def state_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best articles of a query, and the text of the very best."""
    e = table(spark, sf_dir, "embeddings")
    query = e.filter("vec_id = 0").select("embedding").first()[0]  # one vector, as a caller gives it
    vectors = e.select(F.col("vec_id").alias("article_id"), F.lit("combined").alias("kind"), "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return vector.augmented(docs, vectors, query, 5).select("article_id", _md5(F.col("current_article")).alias("current_md5"))


def ids_before_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's articles: ids win over the query, in their order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "lang")
    return pipeline.found(docs, query=[0.0], ids=[9, 3, 10**12, 4]).select("pos", "article_id", "lang")


class _Turn:
    """An annotator that gives the article's first line as the claim of a minister or a company."""

    def annotate(self, text: str) -> str:
        import json

        title = text.split(". ")[0].strip()
        kind = "person" if len(text) % 2 else "organization"
        name = "Ann Minister" if kind == "person" else "Acme Ltd"
        return json.dumps({"results": [{"agent_name": name, "agent_description": "", "agent_type": kind, "utterance_type": "direct", "utterance_text": title, "source_context": title}]})


def _run(spark: SparkSession, sf_dir: str, version: int) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("article_id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"))
    named = spark.createDataFrame([("Q1", {"en": "Ann Minister"}, {}, ["Q5"]), ("Q2", {"en": "Acme Ltd"}, {}, ["Q43229"]), ("Q3", {"en": "acme ltd"}, {}, ["Q43229"])], "entity_id string, labels map<string,string>, aliases map<string,array<string>>, instance_of array<string>")
    return pipeline.run(docs, named, pipeline.Settings((_Turn,), version))


def pipeline_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole first-version run over all documents: agents with their entity and class; all agents are classified."""
    return _run(spark, sf_dir, 1)["agents"].select("article_id", "agent_name", "route", "entity_id", "match_evaluation", "classification")


def pipeline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a first-version and a second-version run; three equal annotators agree on everything."""
    return _run(spark, sf_dir, 1)["totals"].withColumn("version", F.lit(1)).unionByName(_run(spark, sf_dir, 2)["totals"].withColumn("version", F.lit(2)))


# ---- knowledge base


def _statement(value: Column, **qualifiers: Column) -> Column:
    """A statement of an entity document; value is a JSON value."""
    q = [F.concat(F.lit(f'"{p}":[{{"datavalue":{{"value":'), v, F.lit("}}]")) for p, v in qualifiers.items()]
    return F.concat(F.lit('{"mainsnak":{"datavalue":{"value":'), value, F.lit('}},"qualifiers":{'), F.concat_ws(",", *q), F.lit("}}"))


def _id(x: Column) -> Column:
    return F.concat(F.lit('{"id":"'), x, F.lit('"}'))


def _time(x: Column) -> Column:
    return F.concat(F.lit('{"time":"+'), x, F.lit('T00:00:00Z"}'))


def _nation(shift: int, key: str) -> Column:
    return _id(F.concat(F.lit("N"), ((F.col(key) + shift) % 25).cast("string")))


def _document(ident: Column, name: Column, described: Column, claims: dict[str, list[Column]], alias: Column | None = None) -> Column:
    listed = [F.concat(F.lit(f'"{p}":['), F.concat_ws(",", *vs), F.lit("]")) for p, vs in claims.items()]
    aliases = F.lit("") if alias is None else F.concat(F.lit('"en":[{"value":"'), alias, F.lit('"},{"value":"zz"}]'))
    return F.concat(F.lit('{"id":"'), ident, F.lit('","labels":{"en":{"value":"'), name, F.lit('"}},"descriptions":{"en":{"value":"'), described, F.lit('"}},"aliases":{'), aliases, F.lit('},"claims":{'), F.concat_ws(",", *listed), F.lit("}}"))


def _kb(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Entity documents of rows (json) and of all nations, read from JSON."""
    n = table(spark, sf_dir, "nation").select(_document(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.lit("a nation"), {}).alias("json"))
    return rows.select("json").union(n).select(kb.from_json(F.col("json")).alias("e")).select("e.*")


def kb_person_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a person, from the knowledge base's JSON, for every customer."""
    key = F.col("c_custkey")
    year = lambda a: F.concat(F.lit(a), F.lpad((key % 100).cast("string"), 2, "0"))
    k = "c_custkey"
    claims = {
        "P569": [_statement(_time(F.concat(year("18"), F.lit("-05-07"))))],
        "P570": [_statement(_time(F.concat(year("19"), F.lit("-00-00"))))],
        "P19": [_statement(_nation(0, k))],
        "P21": [_statement(_nation(1, k))],
        "P102": [_statement(_nation(2, k), P580=_time(F.lit("1900-01-01")), P582=_time(F.lit("1910-01-01"))), _statement(_nation(3, k), P580=_time(F.lit("1911-01-01")))],
        "P140": [_statement(_nation(4, k)), _statement(_nation(5, k))],
        "P1142": [_statement(_nation(6, k))],
        "P106": [_statement(_nation(7, k)), _statement(_nation(8, k))],
        "P39": [_statement(_nation(9, k), P580=_time(F.lit("1950-02-03")), P642=_nation(10, k))],
        "P101": [_statement(_nation(11, k))],
        "P18": [_statement(F.concat(F.lit('"Pic '), F.col("c_custkey").cast("string"), F.lit('.jpg"')))],
    }
    rows = table(spark, sf_dir, "customer").select(_document(F.concat(F.lit("C"), key.cast("string")), F.col("c_name"), F.col("c_mktsegment"), claims).alias("json"))
    p = kb.persons(_kb(spark, sf_dir, rows)).filter(F.col("entity_id").startswith("C"))
    held = F.get("position_held", 0)
    shown = lambda x: F.array_join(x, ",")
    return p.select("entity_id", "name", "birth_date", "death_date", "birth_place", "gender", shown(F.transform("political_party", lambda x: x["name"])).alias("parties"), F.get("political_party", 1)["end_date"].alias("first_party_end"), shown(F.col("religion")).alias("religion"), shown(F.col("political_ideology")).alias("ideology"), shown(F.sort_array("occupation")).alias("occupation"), F.size("occupation_details").alias("n_occupation_details"), held["name"].alias("held"), held["start_date"].alias("held_start"), held["organization"].alias("held_at"), shown(F.col("field_of_work")).alias("field_of_work"), "image_url", "description")


def kb_organization_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of an organisation, from the knowledge base's JSON, for every supplier."""
    k = "s_suppkey"
    claims = {
        "P31": [_statement(_nation(0, k))],
        "P571": [_statement(_time(F.lit("1901-02-03")))],
        "P576": [_statement(_time(F.lit("1999-00-00")))],
        "P159": [_statement(_nation(1, k))],
        "P17": [_statement(_nation(2, k))],
        "P856": [_statement(F.concat(F.lit('"https://s'), F.col(k).cast("string"), F.lit('.example.org"')))],
        "P749": [_statement(_nation(3, k))],
        "P355": [_statement(_nation(4, k)), _statement(_nation(5, k))],
        "P452": [_statement(_nation(6, k))],
        "P488": [_statement(_nation(7, k))],
        "P169": [_statement(_nation(8, k))],
        "P18": [_statement(F.concat(F.lit('"Logo '), F.col(k).cast("string"), F.lit('.png"')))],
    }
    rows = table(spark, sf_dir, "supplier").select(_document(F.concat(F.lit("S"), F.col(k).cast("string")), F.col("s_name"), F.lit("a supplier"), claims, F.lit("aa")).alias("json"))
    o = kb.organizations(_kb(spark, sf_dir, rows)).filter(F.col("entity_id").startswith("S"))
    shown = lambda x: F.array_join(x, ",")
    return o.select("entity_id", "name", "alias", "found", "type", "inception_date", "dissolution_date", "headquarters", "country", "official_website", "parent_organization", shown("subsidiaries").alias("subsidiaries"), shown("industry").alias("industry"), shown("key_people").alias("key_people"), "image_url", "description")


def _nat(shift: int, key: str) -> str:
    return f"(SELECT n_name FROM nation WHERE n_nationkey = ({key} + {shift}) % 25)"


def _media_sql(name: str, width: int) -> str:
    return f"'https://media.example.org/thumb/' || left(md5({name}), 1) || '/' || left(md5({name}), 2) || '/' || {name} || '/{width}px-' || {name}"


_PIC, _LOGO = "('Pic_' || c_custkey || '.jpg')", "('Logo_' || s_suppkey || '.png')"
_ODD = "length('T' || doc_id || '. ' || text) % 2 = 1"
_FORMS = f"SELECT DISTINCT s, p, o, o_kind FROM ({{graph}})"

QUERIES = {f.__name__: f for f in (claims_first_version, claims_second_version, claims_first_key, first_version_shape, answer_retry, near_contexts, annotators_any, article_corpus, flat_export, checkpoint_store, summary_sink, event_history, prompt_render, rdf_round_trip, tbox_union, fallback_taxonomy, skipped_rows, state_augment, ids_before_query, pipeline_agents, pipeline_totals, kb_person_fields, kb_organization_fields)}


def _oracles() -> dict[str, str]:
    from claimloom.plans import ontology as ontology_plans

    catalog = ontology_plans._GRAPH
    news = " UNION ALL ".join(f"({graphs._SQL[k]})" for k in ("kg_news", "kg_sources", "kg_topics"))
    a = "doc_id || '_' || CASE lang WHEN 'en' THEN 'us_politics' WHEN 'fr' THEN 'climate_change' WHEN 'de' THEN 'ukraine_war' ELSE 'misc' END"
    odd = "length(split_part(text, chr(10), 1)) % 2 = 0"
    hit = "SELECT a.c_custkey FROM (SELECT c_custkey, 'party ' || c_nationkey || '-' || (CAST(floor(c_acctbal / 500) AS BIGINT)) AS name FROM customer WHERE c_custkey % 2 = 1) a"
    from claimloom.plans.linking import _NAMED

    return {
        "claims_first_version": "SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS n, CASE WHEN turn % 7 IN (0, 1, 2, 3, 5) THEN role END AS agent, CASE WHEN turn % 7 IN (0, 1, 2, 3, 5) THEN md5(text) END AS last_md5 FROM conversations",
        "claims_second_version": r"SELECT conv_id, turn, turn % 7 IN (0, 2) AS read, CASE WHEN turn % 7 IN (0, 2) THEN CASE WHEN regexp_replace(text, '\s', '', 'g') <> '' AND regexp_replace(role, '\s', '', 'g') <> '' THEN 2 ELSE 0 END END AS n FROM conversations",
        "claims_first_key": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n FROM conversations",
        "first_version_shape": "SELECT conv_id, bool_and(turn % 2 = 0) AS whole FROM conversations GROUP BY 1",
        "answer_retry": "SELECT c_custkey AS agent_id, CAST(CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 4 + 1 END AS INTEGER) AS attempt, CASE WHEN c_custkey % 4 < 3 THEN 'Q' || c_custkey END AS answer, CASE WHEN c_custkey % 4 < 3 THEN 'try ' || (c_custkey % 4 + 1) END AS reasoning FROM customer",
        "near_contexts": "WITH x AS (SELECT conv_id, turn, unnest([text, text || '!', text || '  AND MUCH MORE THAN ANYBODY SAID IN THE WHOLE ARTICLE AND IN ALL OTHERS OF THAT DAY AND THE NEXT']) AS c FROM conversations), k AS (SELECT *, lower(regexp_replace(trim(c), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM x), o AS (SELECT DISTINCT conv_id, t FROM k), n AS (SELECT o.conv_id, o.t, min(p.t) AS key FROM o JOIN o p ON p.conv_id = o.conv_id AND levenshtein(o.t, p.t) <= greatest(length(o.t), length(p.t)) * 0.15 GROUP BY 1, 2) SELECT k.conv_id, turn, md5(c) AS context_md5, md5(key) AS key_md5 FROM k JOIN n ON n.conv_id = k.conv_id AND n.t = k.t",
        "annotators_any": "SELECT DISTINCT conv_id AS article_id FROM conversations WHERE role = 'assistant'",
        "article_corpus": "SELECT page_id || '_topic' || page_id % 3 AS article_id, CASE WHEN page_id % 5 = 0 THEN 'No Title' ELSE 'Page ' || page_id END AS title, url AS body, CASE WHEN page_id % 5 = 1 THEN 'Unknown' ELSE 'Ann Writer' END AS author, CASE WHEN page_id % 5 = 2 THEN '' ELSE '2024-01-05' END AS date, 'Unknown' AS source, url AS source_link, 'body,combined,title' AS kinds FROM pages WHERE page_id % 5 <> 4",
        "flat_export": "SELECT doc_id, length(text) AS length, lang, source, (SELECT count(*) FROM documents) AS n_rows, 'doc_id,text,info' AS columns FROM documents",
        "checkpoint_store": "SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN doc_id % 3 = 0 AND NOT (doc_id % 2 = 0 AND doc_id % 6 <> 1) THEN 'done' ELSE 'todo' END AS state, CASE WHEN doc_id % 6 = 1 THEN NULL WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN NULL ELSE 'timeout' END AS error, doc_id % 3 = 0 AS has_file FROM documents",
        "summary_sink": "SELECT doc_id AS article_id, source, CAST(coalesce(n, 0) AS INTEGER) AS n_claims, md5(first) AS first_md5, CAST(coalesce(k, 0) AS INTEGER) AS n_agents FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first, count(DISTINCT role) FILTER (role <> '') AS k FROM conversations GROUP BY 1) ON conv_id = doc_id",
        "event_history": "SELECT user_id, CAST(count(*) AS INTEGER) AS n, string_agg(event_type, ',' ORDER BY event_id) AS events, md5(string_agg(props, '|' ORDER BY event_id)) AS details_md5 FROM events GROUP BY 1",
        "prompt_render": "SELECT doc_id, 'You read about ' || lang || '.' AS system, md5('Text ' || doc_id || ':' || chr(10) || text || chr(10)) AS user_md5 FROM documents",
        "rdf_round_trip": f"WITH g AS ({_FORMS.format(graph=catalog)}) SELECT form, p, count(*) AS n, count(DISTINCT s) AS subjects FROM g, (VALUES ('turtle'), ('nt'), ('xml')) f(form) GROUP BY 1, 2 UNION ALL SELECT 'json-ld', 'json-ld', count(DISTINCT s), count(DISTINCT s) FROM g",
        "tbox_union": f"SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o, o_kind, datatype, lang FROM (SELECT s, p, o, o_kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang FROM ({_FORMS.format(graph=catalog)}) UNION ALL SELECT s, p, o, o_kind, datatype, lang FROM ({news}))) GROUP BY 1",
        "fallback_taxonomy": "SELECT * FROM (VALUES ('Organization', 'https://schema.org/Thing', 6), " + ", ".join(f"('{n}', 'https://schema.org/Organization', 0)" for n, _, _ in ontology.FALLBACK[1:]) + ") v(name, parents, n_children)",
        "skipped_rows": f"SELECT 'subjects' AS what, count(DISTINCT {a}) + count(DISTINCT CASE WHEN doc_id % 3 <> 0 THEN {a} END) AS n FROM documents WHERE {odd} UNION ALL SELECT 'linked', count(DISTINCT a.c_custkey) FROM ({hit}) a0 JOIN customer a ON a.c_custkey = a0.c_custkey JOIN ({_NAMED}) n ON n.name = 'party ' || a.c_nationkey || '-' || (CAST(floor(a.c_acctbal / 500) AS BIGINT)) AND n.s_suppkey % 3 = 1",
        "state_augment": "WITH h AS (SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0 LIMIT 1) q ORDER BY d, e.vec_id LIMIT 5), r AS (SELECT doc_id, text, d FROM h JOIN documents ON doc_id = vec_id) SELECT doc_id AS article_id, md5((SELECT coalesce(text, '') FROM r ORDER BY d, doc_id LIMIT 1)) AS current_md5 FROM r",
        "ids_before_query": "SELECT CAST(pos AS INTEGER) AS pos, doc_id AS article_id, lang FROM (VALUES (0, 9), (1, 3), (3, 4)) v(pos, id) JOIN documents ON doc_id = id",
        "pipeline_agents": f"SELECT 'a' || doc_id AS article_id, CASE WHEN {_ODD} THEN 'Ann Minister' ELSE 'Acme Ltd' END AS agent_name, CASE WHEN {_ODD} THEN 'one' ELSE 'multiple' END AS route, CASE WHEN {_ODD} THEN 'Q1' END AS entity_id, CASE WHEN {_ODD} THEN 'YES' ELSE 'NO' END AS match_evaluation, CASE WHEN {_ODD} THEN 'Politician' ELSE 'Corporation' END AS classification FROM documents",
        "pipeline_totals": "SELECT v AS version, count(*) AS num_articles, count(*) AS num_claims, count(*) AS num_agents FROM documents, (VALUES (1), (2)) x(v) GROUP BY 1",
        "kb_person_fields": f"SELECT 'C' || c_custkey AS entity_id, c_name AS name, '18' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-05-07' AS birth_date, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-00-00' AS death_date, {_nat(0, 'c_custkey')} AS birth_place, {_nat(1, 'c_custkey')} AS gender, {_nat(3, 'c_custkey')} || ',' || {_nat(2, 'c_custkey')} AS parties, '1910-01-01' AS first_party_end, {_nat(4, 'c_custkey')} || ',' || {_nat(5, 'c_custkey')} AS religion, {_nat(6, 'c_custkey')} AS ideology, least({_nat(7, 'c_custkey')}, {_nat(8, 'c_custkey')}) || ',' || greatest({_nat(7, 'c_custkey')}, {_nat(8, 'c_custkey')}) AS occupation, 2 AS n_occupation_details, {_nat(9, 'c_custkey')} AS held, '1950-02-03' AS held_start, {_nat(10, 'c_custkey')} AS held_at, {_nat(11, 'c_custkey')} AS field_of_work, {_media_sql(_PIC, 300)} AS image_url, c_mktsegment AS description FROM customer",
        "kb_organization_fields": f"SELECT 'S' || s_suppkey AS entity_id, s_name AS name, 'aa' AS alias, true AS found, {_nat(0, 's_suppkey')} AS type, '3/2/1901' AS inception_date, '//1999' AS dissolution_date, {_nat(1, 's_suppkey')} AS headquarters, {_nat(2, 's_suppkey')} AS country, 'https://s' || s_suppkey || '.example.org' AS official_website, {_nat(3, 's_suppkey')} AS parent_organization, {_nat(4, 's_suppkey')} || ',' || {_nat(5, 's_suppkey')} AS subsidiaries, {_nat(6, 's_suppkey')} AS industry, {_nat(8, 's_suppkey')} || ',' || {_nat(7, 's_suppkey')} AS key_people, {_media_sql(_LOGO, 800)} AS image_url, 'a supplier' AS description FROM supplier",
    }


ORACLES = _oracles()
