"""Candidates, routing, classification and knowledge-base records, over customers, suppliers, parts, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import organization_class
from claimloom.operators import kb, linking
from claimloom.sources.tables import table


def _bucket(nation: str, balance: str, shift: int = 0):
    return F.concat_ws("-", F.col(nation).cast("string"), (F.floor(F.col(balance) / 500) + shift).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities; a third are persons, a third organisations; the name is nation and balance class."""
    third = F.col("s_suppkey") % 3
    kind = F.when(third == 0, F.array(F.lit("Q5"))).when(third == 1, F.array(F.lit("Q1"), F.lit("Q43229"))).otherwise(F.array(F.lit("Q1")))
    names = F.create_map(F.lit("en"), F.concat(F.lit("Party "), _bucket("s_nationkey", "s_acctbal")))
    alias = F.create_map(F.lit("en"), F.array(F.concat(F.lit("party "), _bucket("s_nationkey", "s_acctbal", 1))))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), names.alias("labels"), alias.alias("aliases"), kind.alias("instance_of"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents; the recognised name is one balance class above, for two of three."""
    half = F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("Organization")
    seen = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("party "), _bucket("c_nationkey", "c_acctbal", 1)))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), F.concat(F.lit("PARTY "), _bucket("c_nationkey", "c_acctbal")).alias("agent_name"), half.alias("type_of_agent"), seen.alias("ner_name"))


def candidate_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by name or alias and the right kind, and where the agent goes."""
    found = linking.candidates(agents(spark, sf_dir), entities(spark, sf_dir))
    return found.select("agent_id", F.size("candidates").alias("n"), F.array_join("candidates", ",").alias("candidates"), linking.route(F.size("candidates")).alias("route"))


def second_chance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search again by the recognised name for agents without candidates."""
    e = entities(spark, sf_dir)
    found = linking.second_chance(linking.candidates(agents(spark, sf_dir), e), e)
    return found.select("agent_id", "processed_name", F.size("candidates").alias("n"), "route")


def link_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate needs YES, several need one of their ids; all else is NO."""
    found = linking.candidates(agents(spark, sf_dir), entities(spark, sf_dir))
    k, c = F.col("agent_id") % 4, F.col("candidates")
    answer = F.when(F.size(c) == 1, F.when(k == 0, " yes ").otherwise("NO")).when(F.size(c) > 1, F.when(k == 1, F.get(c, 1)).when(k == 2, "NONE").otherwise("Q0"))
    linked = F.when(F.size(c) == 1, linking.verified(answer, F.get(c, 0))).when(F.size(c) > 1, linking.selected(answer, c))
    return found.select("agent_id", linked.alias("entity_id"), linking.matched(linked).alias("match_evaluation"))


def challenge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents by how hard they are to link."""
    found = linking.candidates(agents(spark, sf_dir), entities(spark, sf_dir))
    group = linking.challenge_group(F.size("candidates"), F.col("agent_id") % 2 == 0)
    return found.groupBy(group.alias("challenge")).agg(F.count(F.lit(1)).alias("n"))


def type_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Humans and organisations among parts that play entities."""
    k = F.col("p_size") % 4
    kind = F.when(k == 0, F.array(F.lit("Q5"), F.lit("Q2"))).when(k == 1, F.array(F.lit("Q2"), F.lit("Q7188"))).when(k == 2, F.array(F.lit("Q3918"), F.lit("Q5"))).otherwise(F.array(F.lit("Q2")))
    df = table(spark, sf_dir, "part").select("p_brand", linking.is_human(kind).alias("h"), linking.is_organization(kind).alias("o"))
    return df.groupBy("p_brand").agg(F.count_if("h").alias("humans"), F.count_if("o").alias("organizations"))


def taxonomy_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts at a class: the first known one, else Other, else Unknown after a hard error."""
    k = F.col("c_custkey") % 5
    person = F.col("c_custkey") % 2 == 0
    good = F.when(person, "**Expert**").otherwise("NGO ")
    one = F.struct(F.lit(1).alias("attempt"), F.when(k == 0, good).otherwise("Wizard").alias("answer"), F.lit("HIGH").alias("confidence"), F.lit("one").alias("explanation"), F.when(k == 4, "timeout").alias("error"))
    two = F.struct(F.lit(2).alias("attempt"), F.when(k.isin(1, 4), good).otherwise("Bard").alias("answer"), F.lit("MEDIUM").alias("confidence"), F.lit("two").alias("explanation"), F.when(k == 3, "timeout").alias("error"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), F.when(person, "person").otherwise("organization").alias("type_of_agent"), F.inline(F.array(one, two)))
    return linking.classified(rows)


def taxonomy_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the vocabulary become Other."""
    label = F.concat(F.lit("**"), "p_type", F.lit("** "))
    return table(spark, sf_dir, "part").groupBy(linking.known_or_other(label, ("ECONOMY", "SMALL", "PROMO")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def org_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema classes of organisations."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("Political Party", "NGO", "airline", "Unheard Of", "Business Representative")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", organization_class(said).alias("schema_class"))


def _claim(prop: str, ord_col, **values):
    fields = ("value_id", "value_time", "value_string", "start_time", "end_time", "of_id")
    return F.struct(F.lit(prop).alias("property"), ord_col.cast("int").alias("ord"), *[values.get(f, F.lit(None)).cast("string").alias(f) for f in fields])


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as entities with labels and without claims."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).alias("en"), F.lower("n_name").alias("it"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("entity_id"), F.col("r_name").alias("en"), F.lit(None).cast("string").alias("it"))
    u = n.union(r)
    labels = F.map_from_entries(F.filter(F.array(F.struct(F.lit("en").alias("k"), F.col("en").alias("v")), F.struct(F.lit("it").alias("k"), F.col("it").alias("v"))), lambda x: x["v"].isNotNull()))
    return u.select("entity_id", labels.alias("labels"), *_no_more())


def _no_more():
    return [F.create_map().cast("map<string,array<string>>").alias("aliases"), F.create_map().cast("map<string,string>").alias("descriptions"), F.array().cast(f"array<{kb.CLAIM}>").alias("claims")]


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of property values, joined once; nations without an English label have none."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"), F.create_map(F.lit("en"), F.col("c_name")).alias("labels"), *_no_more()[:2], F.array(_claim("P17", F.lit(0), value_id=F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), of_id=F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")))).alias("claims"))
    return kb.labelled(c.unionByName(_places(spark, sf_dir))).select("entity_id", "property", "value_label", "of_label")


def kb_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons whose orders are positions: the latest first, with labels of nations."""
    time = lambda c: F.concat(F.lit("+"), F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    held = _claim("P39", F.col("o_orderkey"), value_id=F.concat(F.lit("N"), (F.col("o_orderkey") % 25).cast("string")), start_time=time("o_orderdate"), end_time=F.when(F.col("o_orderstatus") != "O", time("o_orderdate")))
    held_all = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(held).alias("held"))
    born = _claim("P569", F.lit(0), value_time=F.concat(F.lit("+19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-05-07T00:00:00Z")))
    c = table(spark, sf_dir, "customer").join(held_all, "c_custkey", "left")
    claims = F.concat(F.array(born), F.coalesce("held", F.array().cast(f"array<{kb.CLAIM}>")))
    people = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"), F.create_map(F.lit("en"), F.col("c_name")).alias("labels"), *_no_more()[:2], claims.alias("claims"))
    out = kb.persons(people.unionByName(_places(spark, sf_dir))).filter(F.col("entity_id").startswith("C"))
    return out.select("entity_id", "name", "birth_date", F.size("position_held").alias("n_held"), F.get("position_held", 0)["name"].alias("held_first"), F.get("position_held", 0)["start_date"].alias("held_start"), "image_url")


def kb_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as organisations: type, dates, key people in property order."""
    key = F.col("s_suppkey")
    nation = lambda shift: F.concat(F.lit("N"), ((key + shift) % 25).cast("string"))
    claims = F.array(_claim("P31", F.lit(0), value_id=F.lit("N99")), _claim("P31", F.lit(1), value_id=nation(0)), _claim("P571", F.lit(0), value_time=F.lit("+0987-04-00T00:00:00Z")), _claim("P1075", F.lit(0), value_id=nation(1)), _claim("P169", F.lit(1), value_id=nation(2)), _claim("P169", F.lit(0), value_id=nation(3)), _claim("P856", F.lit(0), value_string=F.concat(F.lit("https://"), F.col("s_name"))))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), key.cast("string")).alias("entity_id"), F.create_map(F.lit("it"), F.col("s_name")).alias("labels"), F.create_map(F.lit("it"), F.array(F.lit("zeta"), F.lit("alfa"))).alias("aliases"), _no_more()[1], claims.alias("claims"))
    out = kb.organizations(s.unionByName(_places(spark, sf_dir))).filter(F.col("entity_id").startswith("S"))
    return out.select("entity_id", "name", "alias", "type", "inception_date", "official_website", F.array_join("key_people", ",").alias("key_people"), F.size("subsidiaries").alias("n_subsidiaries"))


def multi_value_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a property in source order, as one string."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("P1").alias("property"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("value_label"))
    df = rows.groupBy("l_orderkey").agg(kb._all("P1", F.col("value_label")).alias("v"))
    return df.select("l_orderkey", F.array_join("v", ",").alias("parts"))


_B = "s_nationkey || '-' || (CAST(floor(s_acctbal / 500) AS BIGINT) + {k})"
_NAMED = f"SELECT DISTINCT lower('party ' || {_B.format(k=0)}) AS name, s_suppkey FROM supplier UNION SELECT DISTINCT lower('party ' || {_B.format(k=1)}), s_suppkey FROM supplier"
_AGENT = "SELECT c_custkey, 'party ' || c_nationkey || '-' || (CAST(floor(c_acctbal / 500) AS BIGINT)) AS name, CASE WHEN c_custkey % 3 > 0 THEN 'party ' || c_nationkey || '-' || (CAST(floor(c_acctbal / 500) AS BIGINT) + 1) END AS seen FROM customer"
_HIT = "n.s_suppkey % 3 = CASE WHEN a.c_custkey % 2 = 0 THEN 0 ELSE 1 END"
_CAND = f"SELECT a.c_custkey, count(n.s_suppkey) AS n, coalesce(string_agg(CAST(n.s_suppkey AS VARCHAR), ',' ORDER BY CAST(n.s_suppkey AS VARCHAR)), '') AS c FROM ({_AGENT}) a LEFT JOIN ({_NAMED}) n ON n.name = a.name AND {_HIT} GROUP BY 1"
_ROUTE = "CASE WHEN n > 1 THEN 'multiple' WHEN n = 1 THEN 'one' ELSE 'none' END"
_AGAIN = f"SELECT a.c_custkey, count(n.s_suppkey) AS n FROM ({_AGENT}) a LEFT JOIN ({_NAMED}) n ON n.name = a.seen AND {_HIT} GROUP BY 1"
_LINKED = "CASE WHEN n = 1 AND c_custkey % 4 = 0 THEN c WHEN n > 1 AND c_custkey % 4 = 1 THEN string_split(c, ',')[2] END"
_NLABEL = "CASE WHEN n_nationkey % 6 <> 0 THEN n_name END"
_NBOTH = "CASE WHEN n_nationkey % 6 <> 0 THEN n_name ELSE lower(n_name) END"

QUERIES = {f.__name__: f for f in (candidate_route, second_chance_search, link_decision, challenge_buckets, type_semi_filter, taxonomy_retry, taxonomy_other, org_type_map, label_join, kb_persons, kb_organizations, multi_value_collect)}
ORACLES = {
    "candidate_route": f"SELECT c_custkey AS agent_id, CAST(n AS INTEGER) AS n, c AS candidates, {_ROUTE} AS route FROM ({_CAND})",
    "second_chance_search": f"SELECT agent_id, processed_name, CAST(n AS INTEGER) AS n, {_ROUTE} AS route FROM (SELECT f.c_custkey AS agent_id, CASE WHEN f.n > 0 THEN 'PARTY' || substr(a.name, 6) ELSE coalesce(a.seen, 'PARTY' || substr(a.name, 6)) END AS processed_name, CASE WHEN f.n > 0 THEN f.n ELSE g.n END AS n FROM ({_CAND}) f JOIN ({_AGAIN}) g ON g.c_custkey = f.c_custkey JOIN ({_AGENT}) a ON a.c_custkey = f.c_custkey)",
    "link_decision": f"SELECT c_custkey AS agent_id, {_LINKED} AS entity_id, CASE WHEN {_LINKED} IS NULL THEN 'NO' ELSE 'YES' END AS match_evaluation FROM ({_CAND})",
    "challenge_buckets": f"SELECT CASE WHEN c_custkey % 2 = 0 THEN 'linkable ' ELSE 'unlinkable ' END || CASE WHEN n > 1 THEN '>1' ELSE CAST(n AS VARCHAR) END AS challenge, count(*) AS n FROM ({_CAND}) GROUP BY 1",
    "type_semi_filter": "SELECT p_brand, count(*) FILTER (p_size % 4 IN (0, 2)) AS humans, count(*) FILTER (p_size % 4 IN (1, 2)) AS organizations FROM part GROUP BY 1",
    "taxonomy_retry": "SELECT c_custkey AS agent_id, CASE WHEN k IN (0, 1, 4) THEN CASE WHEN c_custkey % 2 = 0 THEN 'Expert' ELSE 'NGO' END WHEN k = 3 THEN 'Unknown' ELSE 'Other' END AS classification, CASE k WHEN 0 THEN 'HIGH' WHEN 3 THEN 'NONE' ELSE 'MEDIUM' END AS confidence, CASE k WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 4 THEN 'two' WHEN 3 THEN 'Taxonomy classification failed after all attempts.' ELSE 'Not a known class: Bard' END AS explanation FROM (SELECT *, c_custkey % 5 AS k FROM customer)",
    "taxonomy_other": "SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'PROMO') THEN p_type ELSE 'Other' END AS classification, count(*) AS n FROM part GROUP BY 1",
    "org_type_map": "SELECT s_suppkey, ['PoliticalParty', 'NGO', 'Airline', 'Organization', 'Corporation'][s_suppkey % 5 + 1] AS schema_class FROM supplier",
    "label_join": f"SELECT 'C' || c_custkey AS entity_id, 'P17' AS property, {_NLABEL} AS value_label, r_name AS of_label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = c_nationkey % 5",
    "kb_persons": f"SELECT 'C' || c_custkey AS entity_id, c_name AS name, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-05-07' AS birth_date, CAST(coalesce(n_held, 0) AS INTEGER) AS n_held, held_first, held_start, CAST(NULL AS VARCHAR) AS image_url FROM customer LEFT JOIN (SELECT o_custkey, any_value(n) AS n_held, any_value(label) AS held_first, any_value(d) AS held_start FROM (SELECT o_custkey, {_NLABEL} AS label, strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999-99-99' END DESC, o_orderdate DESC, o_orderkey) AS r FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE n_nationkey % 6 <> 0) WHERE r = 1 GROUP BY 1) ON o_custkey = c_custkey",
    "kb_organizations": f"WITH l AS (SELECT n_nationkey AS k, {_NBOTH} AS v FROM nation) SELECT 'S' || s_suppkey AS entity_id, s_name AS name, 'zeta' AS alias, a.v AS type, '/4/987' AS inception_date, 'https://' || s_name AS official_website, d.v || ',' || c.v || ',' || b.v AS key_people, 0 AS n_subsidiaries FROM supplier JOIN l a ON a.k = s_suppkey % 25 JOIN l b ON b.k = (s_suppkey + 1) % 25 JOIN l c ON c.k = (s_suppkey + 2) % 25 JOIN l d ON d.k = (s_suppkey + 3) % 25",
    "multi_value_collect": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS parts FROM lineitem GROUP BY 1",
}
