"""The whole way from articles to graph, as one chain of lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import jsonladder
from claimloom.operators import annotators, claims as claim_ops, graph, linking, lookup, vector


@dataclass(frozen=True)
class Settings:
    """version 1 takes the first annotator; version 2 takes three, the last repeated where fewer are given."""

    factories: Sequence[Callable] = (annotators.QuoteAnnotator,)
    version: int = 1
    vocabulary: str = graph.VOCABULARY
    compat: bool = False
    names: tuple[str, ...] = field(default=claim_ops.ANNOTATORS)

    def chosen(self) -> dict[str, Callable]:
        if self.version == 1:
            return {"A": self.factories[0]}
        given = [*self.factories, *[self.factories[-1]] * 3][:3]
        return dict(zip(self.names, given))


def found(articles: DataFrame, vectors: DataFrame | None = None, query: Sequence[float] | None = None, k: int | None = 5, ids: Sequence | None = None, kind: str = "combined") -> DataFrame:
    """The articles of a run: ids, even an empty list, take precedence over the query."""
    if ids is not None:
        return lookup.by_ids(articles, lookup.id_list(articles.sparkSession, list(ids) or [""]))
    if query is None or vectors is None:
        raise ValueError("either ids or a query and vectors are needed")
    hits = vector.search(vectors, query, k, kind).select("article_id", "similarity_score", "search_type")
    return articles.join(F.broadcast(hits), "article_id").orderBy(F.col("similarity_score").desc(), "article_id")


def extracted(articles: DataFrame, settings: Settings) -> DataFrame:
    """Claims (article_id, pos, fields) by version 1 or by the consensus of version 2."""
    text = articles.select("article_id", F.concat_ws(". ", "title", "body").alias("text"))
    answers = annotators.annotated(text, settings.chosen(), attempts=2 if settings.version == 1 else 3)
    if settings.version == 1:
        parsed = claim_ops.first_version_shape(jsonladder.first_version_claims(F.coalesce("answer", F.lit(""))))
        return answers.select("article_id", F.posexplode(parsed).alias("pos", "c")).select("article_id", "pos", "c.*")
    value = jsonladder.second_version_value(F.coalesce("answer", F.lit("")), "results")
    parsed = claim_ops.valid_items(F.coalesce(F.try_variant_get(value, "$", jsonladder.CLAIMS), F.array().cast(jsonladder.CLAIMS)))
    rows = answers.select("article_id", "annotator", F.posexplode(parsed).alias("pos", "c")).select("article_id", "annotator", "pos", "c.*")
    key = ["article_id", "source_context"]
    fields = [f for f in claim_ops.FIELDS if f != "source_context"]
    agreed = claim_ops.consensus(claim_ops.per_annotator(rows, key, fields), key, fields)
    place = rows.groupBy(*key).agg(F.min("pos").alias("pos"))
    return agreed.drop("annotators").join(place, key)


def ruled_classes(agents: DataFrame) -> DataFrame:
    """One attempt at a class for each agent, by words of its name and description: a rule in place of a model."""
    said = F.lower(F.concat_ws(" ", "agent_name", "agent_description"))
    person = F.when(said.rlike("minister|president|senator|politician"), "Politician").when(said.contains("journalist"), "Journalist").when(said.rlike("spokes(wo)?man|spokesperson"), "Spokesperson").when(said.rlike("professor|expert"), "Expert").otherwise("OrdinaryCitizen")
    organization = F.when(said.contains("party"), "PoliticalParty").when(said.rlike("university|school"), "EducationalOrganization").when(said.rlike("ministry|government|agency|council"), "GovernmentOrganization").when(said.rlike("ltd|inc|corp"), "Corporation").otherwise("NGO")
    answer = F.when(F.lower("type_of_agent") == "person", person).otherwise(organization)
    return agents.select("agent_id", "type_of_agent", F.lit(1).alias("attempt"), answer.alias("answer"), F.lit("MEDIUM").alias("confidence"), F.lit("by rule").alias("explanation"), F.lit(None).cast("string").alias("error"))


def linked(claims: DataFrame, entities: DataFrame, verify: Callable | None = None, classify: Callable = ruled_classes) -> DataFrame:
    """Agents of each article with entity_id, match_evaluation and classification; all agents are classified, linked or not.

    ``verify`` turns the routed agents into a table (agent_id, answer); without it a single candidate is
    taken and several are not. ``classify`` turns agents into attempts at a class (see linking.classified).
    """
    agents = claim_ops.unique_agents(claims).withColumn("agent_id", F.concat_ws("|", "article_id", "agent_name")).withColumnRenamed("agent_type", "type_of_agent")
    routed = linking.second_chance(linking.candidates(agents.withColumn("ner_name", annotators.ner("agent_name", "type_of_agent")), entities), entities)
    if verify is None:
        answered = routed.withColumn("answer", F.when(F.col("route") == "one", "YES"))
    else:
        answered = routed.join(verify(routed), "agent_id", "left")
    one = linking.verified(F.col("answer"), F.get("candidates", 0))
    entity = F.when(F.col("route") == "one", one).when(F.col("route") == "multiple", linking.selected(F.col("answer"), F.col("candidates")))
    classes = linking.classified(classify(agents)).select("agent_id", "classification", "confidence")
    return answered.withColumn("entity_id", entity).withColumn("match_evaluation", linking.matched(entity)).join(classes, "agent_id", "left")


def run(articles: DataFrame, entities: DataFrame, settings: Settings | None = None, verify: Callable | None = None, classify: Callable = ruled_classes) -> dict[str, DataFrame]:
    """The named tables of a run: claims, agents, summary, totals, graph. articles also needs publisher and domain for sources."""
    settings = settings or Settings()
    claims = extracted(articles, settings)
    agents = linked(claims, entities, verify, classify)
    for name in ("publisher", "domain", "date", "source_link"):
        if name not in articles.columns:
            articles = articles.withColumn(name, F.lit(None).cast("string"))
    infos = agents.select("article_id", "agent_name", F.struct("type_of_agent", "classification", "entity_id", "match_evaluation").alias("info"))
    summary = lookup.condensed(articles, claims.select("article_id", "pos", F.struct(*claim_ops.FIELDS).alias("claim")), infos)
    triples = graph.Emitter(settings.vocabulary, settings.compat).graph(articles, agents, claims)
    return {"claims": claims, "agents": agents, "summary": summary, "totals": lookup.totals(summary), "graph": triples}
