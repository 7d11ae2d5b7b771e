"""The claim graph as a table of triples: s, p, o, o_kind (iri or literal), datatype, lang."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import first_topic, instance_uri, md5_id, organization_class, rfc3339, slug, url_quoted, utterance_class

#: The vocabularies' addresses, and the label texts "News Source: " and "Claim n in article" below.
VOCABULARY = "http://example.org/claims/"
TIME = "http://www.w3.org/2006/time#"
SCHEMA = "https://schema.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
LABEL, SUB_CLASS, COMMENT = f"{RDFS}label", f"{RDFS}subClassOf", f"{RDFS}comment"
OWL = "http://www.w3.org/2002/07/owl#"
PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
XSD = "http://www.w3.org/2001/XMLSchema#"
COLUMNS = ("s", "p", "o", "o_kind", "datatype", "lang")
TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>"


def iri(s: Column, p: str, o: Column | str) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(s.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))


def literal(s: Column, p: str, o: Column, datatype: str | None = None) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def emitted(df: DataFrame, *triples: Column) -> DataFrame:
    """The triples of each row whose subject and object are neither null nor empty."""
    return df.select(F.inline(F.array(*triples))).filter((F.col("s") != "") & (F.col("o") != ""))


def merged(*graphs: DataFrame) -> DataFrame:
    """The set of all triples."""
    return reduce(DataFrame.unionByName, graphs).select(*COLUMNS).distinct()


class Emitter:
    """Triple emitters for one vocabulary namespace.

    ``compat`` takes every agent for a person, as graphs without a type of agent do.
    """

    def __init__(self, vocabulary: str = VOCABULARY, compat: bool = False):
        self.vocabulary, self.compat = vocabulary, compat

    def term(self, name: str) -> str:
        return f"{self.vocabulary}{name}"

    def uri(self, kind: str, ident: Column) -> Column:
        return instance_uri(self.vocabulary, kind, ident)

    def article(self, ident: Column) -> Column:
        return self.uri("NewsItem", url_quoted(slug(ident)))

    def topic(self, ident: Column) -> Column:
        name = first_topic(ident)
        return F.when(name.isNotNull(), self.uri("Topic", name))

    def agent(self, name: Column, kind: Column) -> Column:
        person, organization = self.uri("Person", slug(name)), self.uri("Organization", slug(name))
        return person if self.compat else F.when(F.coalesce(kind, F.lit("person")) == "person", person).otherwise(organization)

    def claim(self, text: Column, article: Column, name: Column) -> Column:
        return self.uri("Claim", md5_id(text, article, name))

    def _news(self) -> list[Column]:
        s = self.article(F.col("article_id"))
        instant = self.uri("Instant", url_quoted(slug(F.col("article_id"))))
        dated = F.when(F.col("date") != "", instant)
        return [
            iri(s, RDF_TYPE, self.term("NewsItem")),
            literal(s, self.term("hasTitle"), F.col("title")),
            literal(s, LABEL, F.col("title")),
            literal(s, self.term("hasText"), F.col("body")),
            literal(s, self.term("hasURL"), F.col("source_link"), f"{XSD}anyURI"),
            iri(dated, RDF_TYPE, f"{TIME}Instant"),
            literal(dated, f"{TIME}inXSDDateTimeStamp", rfc3339(F.col("date")), f"{XSD}dateTimeStamp"),
            iri(F.when(F.col("date") != "", s), f"{TIME}hasTime", instant),
        ]

    def _sources(self) -> list[Column]:
        given = (F.col("publisher") != "") & (F.col("domain") != "")
        p, n = (F.when(given, self.uri(kind, slug(F.col(c)))) for kind, c in (("Publisher", "publisher"), ("NewsSource", "domain")))
        return [
            iri(p, RDF_TYPE, self.term("Publisher")),
            iri(p, RDF_TYPE, self.term("Organization")),
            literal(p, LABEL, F.col("publisher")),
            iri(n, RDF_TYPE, self.term("NewsSource")),
            literal(n, LABEL, F.concat(F.lit("News Source: "), F.col("domain"))),
            iri(n, self.term("hasPublisher"), p),
            iri(self.article(F.col("article_id")), self.term("hasNewsSource"), n),
        ]

    def _topics(self) -> list[Column]:
        t, s = self.topic(F.col("article_id")), self.article(F.col("article_id"))
        return [
            iri(t, RDF_TYPE, self.term("Topic")),
            literal(t, PREF_LABEL, first_topic(F.col("article_id"), part=1)),
            iri(F.when(t.isNotNull(), s), self.term("hasTopic"), t),
            iri(t, self.term("topicInNewsItem"), s),
        ]

    def news_items(self, articles: DataFrame) -> DataFrame:
        """Type, title, text, address and time of each article; a row without article_id has none."""
        return emitted(articles.filter(F.col("article_id") != ""), *self._news())

    def sources(self, articles: DataFrame) -> DataFrame:
        """Publishers and news sources, where name and domain are given; every pair is linked."""
        return emitted(articles.filter(F.col("article_id") != ""), *self._sources())

    def topics(self, articles: DataFrame) -> DataFrame:
        return emitted(articles.filter(F.col("article_id") != ""), *self._topics())

    def about_articles(self, articles: DataFrame) -> DataFrame:
        """News items, sources and topics in one pass."""
        return emitted(articles.filter(F.col("article_id") != ""), *self._news(), *self._sources(), *self._topics())

    def agents(self, agents: DataFrame) -> DataFrame:
        """agents: agent_name, type_of_agent, classification, entity_id."""
        a = self.agent(F.col("agent_name"), F.col("type_of_agent"))
        person = F.lit(True) if self.compat else F.coalesce("type_of_agent", F.lit("person")) == "person"
        return emitted(
            agents.filter(F.col("agent_name") != ""),
            iri(F.when(person, a), RDF_TYPE, self.term("Person")),
            iri(F.when(~person, a), RDF_TYPE, self.term("Organization")),
            iri(F.when(~person, a), RDF_TYPE, F.concat(F.lit(SCHEMA), organization_class(F.coalesce("classification", F.lit("Role"))))),
            iri(a, RDF_TYPE, self.term("Agent")),
            literal(a, LABEL, F.col("agent_name")),
            iri(a, f"{OWL}sameAs", F.when(F.col("entity_id") != "", F.concat(F.lit("https://www.wikidata.org/entity/"), F.col("entity_id")))),
        )

    @staticmethod
    def _once(claims: DataFrame) -> DataFrame:
        """Each distinct claim of an article: its number by first appearance, and its first utterance."""
        rows = claims.filter(F.col("article_id") != "").withColumns({c: F.coalesce(c, F.lit("")) for c in ("utterance_text", "agent_name")})
        place = F.struct("pos", "source_context", "utterance_type")
        once = rows.groupBy("article_id", "utterance_text", "agent_name").agg(F.min(place).alias("u"))
        return once.withColumn("n", F.row_number().over(Window.partitionBy("article_id").orderBy("u.pos", "utterance_text", "agent_name")))

    def _claims(self) -> list[Column]:
        s = self.article(F.col("article_id"))
        c, t = self.claim(F.col("utterance_text"), s, F.col("agent_name")), self.topic(F.col("article_id"))
        return [
            iri(c, RDF_TYPE, self.term("Claim")),
            literal(c, LABEL, F.concat(F.lit("Claim "), F.col("n").cast("string"), F.lit(" in "), F.col("article_id"))),
            iri(c, self.term("claimInNewsItem"), s),
            iri(s, self.term("hasClaim"), c),
            iri(F.when(t.isNotNull(), c), self.term("concernsTopic"), t),
        ]

    def _utterances(self) -> list[Column]:
        c = self.claim(F.col("utterance_text"), self.article(F.col("article_id")), F.col("agent_name"))
        u = self.uri("Utterance", md5_id(F.col("u.source_context"), c))
        kind = utterance_class(F.col("u.utterance_type"))
        return [
            iri(u, RDF_TYPE, self.term("Utterance")),
            literal(u, self.term("hasText"), F.col("utterance_text")),
            literal(u, self.term("hasTextContext"), F.col("u.source_context")),
            iri(u, self.term("hasUtteranceType"), F.when(kind.isNotNull(), F.concat(F.lit(self.vocabulary), kind))),
            iri(c, self.term("hasUtterance"), u),
        ]

    def claims(self, claims: DataFrame) -> DataFrame:
        """claims: article_id, pos, agent_name, utterance_text, ...; claims are numbered by first appearance in their article."""
        return emitted(self._once(claims), *self._claims())

    def utterances(self, claims: DataFrame) -> DataFrame:
        """The first utterance of each distinct claim."""
        return emitted(self._once(claims), *self._utterances())

    def about_claims(self, claims: DataFrame) -> DataFrame:
        """Claims and utterances in one pass."""
        return emitted(self._once(claims), *self._claims(), *self._utterances())

    def components(self, claims: DataFrame, agents: DataFrame) -> DataFrame:
        """Agents in their roles, linked to their claims; a claim whose agent isn't among its article's agents has none."""
        known = agents.select("article_id", "agent_name", "type_of_agent", F.coalesce("classification", F.lit("AgentRole")).alias("role"))
        known = known.groupBy("article_id", "agent_name").agg(F.min(F.struct("type_of_agent", "role")).alias("k")).select("article_id", "agent_name", "k.*")
        rows = claims.join(known, ["article_id", "agent_name"])
        a, r = self.agent(F.col("agent_name"), F.col("type_of_agent")), self.uri("AgentRole", slug(F.col("role")))
        k = self.uri("AgentComponent", slug(F.concat_ws("_", "agent_name", "role")))
        c = self.claim(F.col("utterance_text"), self.article(F.col("article_id")), F.col("agent_name"))
        return emitted(
            rows,
            iri(k, RDF_TYPE, self.term("AgentComponent")),
            iri(k, self.term("hasAgent"), a),
            literal(k, LABEL, F.concat_ws(" as ", "agent_name", "role")),
            iri(r, RDF_TYPE, self.term("AgentRole")),
            literal(r, LABEL, F.col("role")),
            iri(k, self.term("hasAgentRole"), r),
            iri(a, self.term("hasAgentRole"), r),
            iri(c, self.term("hasAgentComponent"), k),
        )

    def graph(self, articles: DataFrame, agents: DataFrame, claims: DataFrame) -> DataFrame:
        """All triples about the articles, each once."""
        return merged(self.about_articles(articles), self.agents(agents), self.about_claims(claims), self.components(claims, agents))


def cardinality_violations(graph: DataFrame, predicate: str, least: int = 1, most: int = 1, subject_type: str | None = None) -> DataFrame:
    """(s, n): subjects (of a type) with fewer or more than the allowed objects of a predicate."""
    graph = merged(graph)
    n = graph.filter(F.col("p") == predicate).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    if subject_type is not None:
        n = graph.filter((F.col("p") == RDF_TYPE) & (F.col("o") == subject_type)).select("s").distinct().join(n, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.filter(~F.col("n").between(least, most))


def predicate_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def type_counts(graph: DataFrame) -> DataFrame:
    return graph.filter(F.col("p") == RDF_TYPE).groupBy("o").agg(F.count_distinct("s").alias("n"))
