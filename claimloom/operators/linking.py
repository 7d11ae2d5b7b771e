"""Agents and knowledge-base entities: candidates, routing, verification, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import jsonladder
from claimloom.functions.text import blank, clean_label, name_or_raw

HUMAN = "Q5"
#: Classes whose instances count as organisations.
ORGANIZATION_IDS = (
    "Q43229", "Q4830453", "Q783794", "Q6881511", "Q891723", "Q7210356", "Q41487", "Q327333", "Q20857065", "Q15911314",
    "Q5341295", "Q847017", "Q212198", "Q7188", "Q262166", "Q31855", "Q3918", "Q4287745", "Q163740", "Q1660397",
    "Q1110684", "Q1114515", "Q15343039", "Q1664720", "Q748019", "Q3152824", "Q2659904", "Q5633421", "Q1194951", "Q1752939",
    "Q178790", "Q2385804", "Q4671277", "Q1298668", "Q622659", "Q2178147", "Q2061186", "Q1616075", "Q1137809", "Q6256",
    "Q3624078",
)
#: The classes of persons and of organisations who speak.
PERSON_CLASSES = ("Politician", "PublicOfficial", "Expert", "BusinessRepresentative", "UnionRepresentative", "Journalist", "Activist", "Celebrity", "OrdinaryCitizen", "AnonymousSource", "Spokesperson", "Other")
ORGANIZATION_CLASSES = (
    "Airline", "Consortium", "Cooperative", "Corporation", "EducationalOrganization", "FundingScheme", "GovernmentOrganization",
    "LibrarySystem", "LocalBusiness", "MedicalOrganization", "NGO", "NewsMediaOrganization", "OnlineBusiness", "PerformingGroup",
    "PoliticalParty", "Project", "ResearchOrganization", "SearchRescueOrganization", "SportsOrganization", "WorkersUnion", "Other",
)


def is_human(instance_of: Column) -> Column:
    return F.exists(instance_of, lambda x: x == HUMAN)


def is_organization(instance_of: Column) -> Column:
    return F.arrays_overlap(instance_of, F.array(*[F.lit(x) for x in ORGANIZATION_IDS]))


def names_of(entities: DataFrame) -> DataFrame:
    """(name, entity_id): every label and alias, lower case, once."""
    labels = entities.select("entity_id", F.explode(F.map_values("labels")).alias("name"))
    aliases = entities.select("entity_id", F.explode(F.flatten(F.map_values("aliases"))).alias("name"))
    return labels.union(aliases).select(F.lower(F.trim("name")).alias("name"), "entity_id").distinct()


def candidates(agents: DataFrame, entities: DataFrame, name: str = "agent_name", kind: str = "type_of_agent") -> DataFrame:
    """agents with ``candidates``, the ids (ascending) of entities of the right kind that bear the name.

    A blank name or an unknown kind finds none. agents has the columns agent_id, ``name`` and ``kind``.
    """
    allowed = entities.select("entity_id", is_human("instance_of").alias("human"), is_organization("instance_of").alias("organization"))
    ids = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("entity_id"))))
    # one row for each name before the agents come in, so an agent meets one row
    by_name = names_of(entities).join(allowed, "entity_id").groupBy("name").agg(ids("human").alias("_humans"), ids("organization").alias("_organizations"))
    # blank names find nothing; each gets a key of its own, so they don't meet in one task
    key = F.when(blank(F.col(name)), F.concat(F.lit("\n"), F.col("agent_id").cast("string"))).otherwise(F.lower(F.trim(name)))
    met = agents.withColumn("_name", key).join(by_name.withColumnRenamed("name", "_name"), "_name", "left")
    found = F.when(F.lower(kind) == "person", F.col("_humans")).when(F.lower(kind) == "organization", F.col("_organizations"))
    return met.withColumn("candidates", F.coalesce(found, F.array().cast("array<string>"))).drop("_name", "_humans", "_organizations")


def accepted_answers(attempts: DataFrame, key: str = "agent_id") -> DataFrame:
    """(key, attempt, answer, reasoning) of the first attempt with both fields, from (key, attempt, answer); null where none has.

    An answer that isn't an object with a filled ``answer`` and ``reasoning`` is a failed try, and the next one counts.
    """
    v = jsonladder.answer(F.col("answer"))
    ok = jsonladder.complete(v)
    told = F.struct("attempt", F.try_variant_get(v, "$.answer", "string").alias("answer"), F.try_variant_get(v, "$.reasoning", "string").alias("reasoning"))
    return attempts.groupBy(key).agg(F.min(F.when(ok, told)).alias("t")).select(key, "t.*")


def route(n: Column) -> Column:
    """Where an agent with n candidates goes."""
    return F.when(n > 1, "multiple").when(n == 1, "one").otherwise("none")


def second_chance(first: DataFrame, entities: DataFrame, recognised: str = "ner_name") -> DataFrame:
    """Agents without candidates are searched again by the recognised name, where there is one.

    Adds ``route`` and ``processed_name``: the recognised name replaces the raw one even if it finds nothing.
    """
    empty = F.size("candidates") == 0
    hit = first.filter(~empty).withColumn("processed_name", F.col("agent_name"))
    missed = first.filter(empty).drop("candidates")
    again = candidates(missed, entities, recognised).withColumn("processed_name", name_or_raw(F.col(recognised), F.col("agent_name")))
    return hit.unionByName(again).withColumn("route", route(F.size("candidates")))


def verified(answer: Column, candidate: Column) -> Column:
    """The candidate where the answer is YES (case and outer spaces aside), else null."""
    return F.when(F.upper(F.trim(answer)) == "YES", candidate)


def selected(answer: Column, candidate_ids: Column) -> Column:
    """The answered id where it is a candidate, else null."""
    return F.when(F.array_contains(candidate_ids, F.trim(answer)), F.trim(answer))


def matched(linked: Column) -> Column:
    return F.when(linked.isNotNull(), "YES").otherwise("NO")


def classified(attempts: DataFrame, key: str = "agent_id", kind: str = "type_of_agent") -> DataFrame:
    """Per agent: classification, confidence, explanation from its attempts (attempt, answer, confidence, explanation, error).

    The first attempt with a known class wins. Else the last attempt decides: a hard error gives
    Unknown with confidence NONE, an unknown class gives Other with a rewritten explanation.
    """
    label = clean_label(F.col("answer"))
    known = F.when(F.lower(kind) == "person", label.isin(*PERSON_CLASSES)).otherwise(label.isin(*ORGANIZATION_CLASSES))
    ok = F.coalesce(known & F.col("error").isNull(), F.lit(False))
    told = F.struct(label.alias("classification"), F.col("confidence"), F.col("explanation"))
    last = F.max_by(F.struct("error", label.alias("label"), "confidence"), "attempt")
    by = attempts.groupBy(key).agg(F.min_by(F.when(ok, told), F.when(ok, F.col("attempt"))).alias("first_ok"), last.alias("last"))
    failed = F.struct(F.lit("Unknown").alias("classification"), F.lit("NONE").alias("confidence"), F.lit("Taxonomy classification failed after all attempts.").alias("explanation"))
    other = F.struct(F.lit("Other").alias("classification"), F.coalesce(F.col("last.confidence"), F.lit("LOW")).alias("confidence"), F.concat(F.lit("Not a known class: "), F.coalesce(F.col("last.label"), F.lit(""))).alias("explanation"))
    result = F.when(F.col("first_ok").isNotNull(), F.col("first_ok")).when(F.col("last.error").isNotNull(), failed).otherwise(other)
    return by.select(key, result.alias("r")).select(key, "r.*")


def known_or_other(label: Column, classes: tuple[str, ...]) -> Column:
    return F.when(clean_label(label).isin(*classes), clean_label(label)).otherwise("Other")


def challenge_group(n: Column, linkable: Column) -> Column:
    """How hard an agent is to link, by the number of candidates and whether it can be linked at all."""
    many = F.when(n > 1, ">1").otherwise(n.cast("string"))
    return F.concat_ws(" ", F.when(linkable, "linkable").otherwise("unlinkable"), many)
