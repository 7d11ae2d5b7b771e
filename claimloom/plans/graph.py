"""The claim graph and its checks, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import graph as g
from claimloom.operators.claims import unique_agents
from claimloom.plans.claims import claim_table
from claimloom.sources.tables import table

EMITTER = g.Emitter()
_TOPIC = {"en": "us_politics", "fr": "climate_change", "de": "ukraine_war"}


def _article_id(ident: str, lang=None):
    place = F.lit("uk immigration") if lang is None else F.coalesce(*[F.when(F.col(lang) == k, F.lit(v)) for k, v in _TOPIC.items()], F.lit("misc"))
    return F.concat_ws("_", F.col(ident).cast("string"), place)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: topic by language, publisher by source, several publishers to a domain."""
    return table(spark, sf_dir, "documents").select(
        _article_id("doc_id", "lang").alias("article_id"),
        F.get(F.split("text", "\n", 2), 0).alias("title"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 3 != 0, F.lit("2024-01-05 10:00:00+00:00")).alias("date"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_link"),
        F.concat(F.lit("Press of "), "source").alias("publisher"),
        F.when(F.col("lang") != "es", F.concat("lang", F.lit(".example.org"))).alias("domain"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_table(spark, sf_dir).withColumn("article_id", _article_id("article_id"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as agents: persons, organisations, and none known."""
    rows = unique_agents(claims(spark, sf_dir))
    kind = F.when(F.col("agent_type") != "robot", F.col("agent_type"))
    said = F.when(F.col("agent_name") == "assistant", "NGO").when(F.col("agent_name") == "user", "Ordinary Citizen")
    return rows.filter("agent_name <> 'system'").select("article_id", "agent_name", kind.alias("type_of_agent"), said.alias("classification"), F.when(F.col("agent_name") == "user", "Q42").alias("entity_id"))


def kg_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of articles."""
    return g.merged(EMITTER.news_items(articles(spark, sf_dir)))


def kg_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of publishers and news sources."""
    return g.merged(EMITTER.sources(articles(spark, sf_dir)))


def kg_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of topics."""
    return g.merged(EMITTER.topics(articles(spark, sf_dir)))


def kg_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of agents."""
    return g.merged(EMITTER.agents(agents(spark, sf_dir)))


def kg_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of claims."""
    return g.merged(EMITTER.claims(claims(spark, sf_dir)))


def kg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of agents in their roles."""
    return g.merged(EMITTER.components(claims(spark, sf_dir), agents(spark, sf_dir)))


def kg_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of utterances."""
    return g.merged(EMITTER.utterances(claims(spark, sf_dir)))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EMITTER.graph(articles(spark, sf_dir), agents(spark, sf_dir), claims(spark, sf_dir))


def kg_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the whole graph."""
    return _graph(spark, sf_dir).agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"))


def kg_predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples by predicate."""
    return g.predicate_counts(_graph(spark, sf_dir))


def kg_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances by class."""
    return g.type_counts(_graph(spark, sf_dir))


def kg_cardinality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News sources without exactly one publisher."""
    return g.cardinality_violations(EMITTER.sources(articles(spark, sf_dir)), EMITTER.term("hasPublisher"), subject_type=EMITTER.term("NewsSource"))


_V, _T, _X = g.VOCABULARY, g.RDF_TYPE, g.XSD


def _union(source: str, rows: list[tuple]) -> str:
    """SQL for triples (subject, predicate, object, literal's datatype or None, where)."""
    parts = []
    for s, p, o, literal, where in rows:
        kind = "'iri'" if literal is None else "'literal'"
        parts.append(f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {kind} AS o_kind, {f"'{literal}'" if literal else 'CAST(NULL AS VARCHAR)'} AS datatype, CAST(NULL AS VARCHAR) AS lang FROM ({source}) WHERE {where or 'true'}")
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE s <> '' AND o <> ''"


_ART = f"SELECT *, '{_V}NewsItem/' || id AS a, '{_V}Instant/' || id AS i, doc_id % 3 <> 0 AS dated, 'Press of ' || source AS pub, CASE WHEN lang <> 'es' THEN lang || '.example.org' END AS dom, CASE lang WHEN 'en' THEN 'USPolitics' WHEN 'fr' THEN 'ClimateChange' WHEN 'de' THEN 'UkraineWar' END AS t, CASE lang WHEN 'en' THEN 'US Politics' WHEN 'fr' THEN 'Climate Change' WHEN 'de' THEN 'Ukraine War' END AS tl FROM (SELECT *, doc_id || '_' || CASE lang WHEN 'en' THEN 'us_politics' WHEN 'fr' THEN 'climate_change' WHEN 'de' THEN 'ukraine_war' ELSE 'misc' END AS id FROM documents)"
_CL = f"SELECT *, '{_V}Claim/' || md5(text || a || role) AS c FROM (SELECT *, conv_id || '_uk immigration' AS id, '{_V}NewsItem/' || conv_id || '_uk_immigration' AS a FROM conversations)"
_CL1 = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM (SELECT id, a, c, text, role, min(turn) AS pos, arg_min(role || ': ' || text, turn) AS ctx, arg_min(turn % 3, turn) AS k FROM ({_CL}) GROUP BY ALL)"
_AG = f"SELECT *, CASE WHEN role = 'assistant' THEN '{_V}Organization/assistant' ELSE '{_V}Person/' || role END AS ag, CASE role WHEN 'assistant' THEN 'NGO' WHEN 'user' THEN 'Ordinary Citizen' ELSE 'AgentRole' END AS r FROM ({_CL}) WHERE role NOT IN ('', 'system')"
_K = f"'{_V}AgentComponent/' || role || '_' || replace(r, ' ', '_')"
_R = f"'{_V}AgentRole/' || replace(r, ' ', '_')"
_U = f"'{_V}Utterance/' || md5(ctx || c)"

_SQL = {
    "kg_news": _union(_ART, [("a", _T, f"'{_V}NewsItem'", None, ""), ("a", f"{_V}hasTitle", "split_part(text, chr(10), 1)", "", ""), ("a", g.LABEL, "split_part(text, chr(10), 1)", "", ""), ("a", f"{_V}hasText", "text", "", ""), ("a", f"{_V}hasURL", "'https://example.org/' || doc_id", f"{_X}anyURI", ""), ("i", _T, f"'{g.TIME}Instant'", None, "dated"), ("i", f"{g.TIME}inXSDDateTimeStamp", "'2024-01-05T10:00:00+00:00'", f"{_X}dateTimeStamp", "dated"), ("a", f"{g.TIME}hasTime", "i", None, "dated")]),
    "kg_sources": _union(f"SELECT *, '{_V}Publisher/' || replace(pub, ' ', '_') AS p, '{_V}NewsSource/' || dom AS n FROM ({_ART}) WHERE dom IS NOT NULL", [("p", _T, f"'{_V}Publisher'", None, ""), ("p", _T, f"'{_V}Organization'", None, ""), ("p", g.LABEL, "pub", "", ""), ("n", _T, f"'{_V}NewsSource'", None, ""), ("n", g.LABEL, "'News Source: ' || dom", "", ""), ("n", f"{_V}hasPublisher", "p", None, ""), ("a", f"{_V}hasNewsSource", "n", None, "")]),
    "kg_topics": _union(f"SELECT *, '{_V}Topic/' || t AS tu FROM ({_ART}) WHERE t IS NOT NULL", [("tu", _T, f"'{_V}Topic'", None, ""), ("tu", g.PREF_LABEL, "tl", "", ""), ("a", f"{_V}hasTopic", "tu", None, ""), ("tu", f"{_V}topicInNewsItem", "a", None, "")]),
    "kg_agents": _union(_AG, [("ag", _T, f"'{_V}Person'", None, "role <> 'assistant'"), ("ag", _T, f"'{_V}Organization'", None, "role = 'assistant'"), ("ag", _T, f"'{g.SCHEMA}NGO'", None, "role = 'assistant'"), ("ag", _T, f"'{_V}Agent'", None, ""), ("ag", g.LABEL, "role", "", ""), ("ag", f"{g.OWL}sameAs", "'https://www.wikidata.org/entity/Q42'", None, "role = 'user'")]),
    "kg_claims": _union(_CL1, [("c", _T, f"'{_V}Claim'", None, ""), ("c", g.LABEL, "'Claim ' || n || ' in ' || id", "", ""), ("c", f"{_V}claimInNewsItem", "a", None, ""), ("a", f"{_V}hasClaim", "c", None, "")]),
    "kg_components": _union(f"SELECT *, {_K} AS k, {_R} AS ru FROM ({_AG})", [("k", _T, f"'{_V}AgentComponent'", None, ""), ("k", f"{_V}hasAgent", "ag", None, ""), ("k", g.LABEL, "role || ' as ' || r", "", ""), ("ru", _T, f"'{_V}AgentRole'", None, ""), ("ru", g.LABEL, "r", "", ""), ("k", f"{_V}hasAgentRole", "ru", None, ""), ("ag", f"{_V}hasAgentRole", "ru", None, ""), ("c", f"{_V}hasAgentComponent", "k", None, "")]),
    "kg_utterances": _union(f"SELECT *, {_U} AS u FROM ({_CL1})", [("u", _T, f"'{_V}Utterance'", None, ""), ("u", f"{_V}hasText", "text", "", ""), ("u", f"{_V}hasTextContext", "ctx", "", ""), ("u", f"{_V}hasUtteranceType", f"'{_V}directUtterance'", None, "k = 0"), ("u", f"{_V}hasUtteranceType", f"'{_V}indirectUtterance'", None, "k = 1"), ("c", f"{_V}hasUtterance", "u", None, "")]),
}
_ALL = f"SELECT DISTINCT * FROM ({' UNION ALL '.join(f'({x})' for x in _SQL.values())})"

QUERIES = {f.__name__: f for f in (kg_news, kg_sources, kg_topics, kg_agents, kg_claims, kg_components, kg_utterances, kg_full, kg_predicate_counts, kg_type_counts, kg_cardinality_violations)}
ORACLES = _SQL | {
    "kg_full": f"SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates FROM ({_ALL})",
    "kg_predicate_counts": f"SELECT p, count(*) AS n FROM ({_ALL}) GROUP BY 1",
    "kg_type_counts": f"SELECT o, count(DISTINCT s) AS n FROM ({_ALL}) WHERE p = '{_T}' GROUP BY 1",
    "kg_cardinality_violations": f"SELECT '{_V}NewsSource/' || dom AS s, count(DISTINCT pub) AS n FROM ({_ART}) WHERE dom IS NOT NULL GROUP BY 1 HAVING count(DISTINCT pub) <> 1",
}
