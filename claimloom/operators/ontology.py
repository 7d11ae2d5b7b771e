"""Catalogue queries, class hierarchies and merges over a table of triples."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from claimloom.operators.graph import COLUMNS, COMMENT, LABEL, OWL, RDF_TYPE, RDFS, SCHEMA, SUB_CLASS
from claimloom.sources.tables import cut

ORGANIZATION = f"{SCHEMA}Organization"
DEEPEST = 10
#: The hierarchy that is used where the vocabulary can't be read.
FALLBACK = (
    ("Organization", "Thing", "An organization such as a school, NGO, corporation, club, etc."),
    ("Corporation", "Organization", "A business corporation."),
    ("EducationalOrganization", "Organization", "An educational organization."),
    ("GovernmentOrganization", "Organization", "A governmental organization or agency."),
    ("LocalBusiness", "Organization", "A particular physical business or branch of an organization."),
    ("NGO", "Organization", "Non-governmental organization."),
    ("NewsMediaOrganization", "Organization", "A news media organization."),
)


def local_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _of_types(graph: DataFrame, types: tuple[str, ...], prefix: str | None) -> DataFrame:
    rows = graph.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(*types) & ~F.col("s").startswith("_:"))
    if prefix is not None:
        rows = rows.filter(F.col("s").startswith(prefix))
    return rows.select(F.col("s").alias("uri")).distinct().orderBy("uri")


def list_classes(graph: DataFrame, prefix: str | None = None) -> DataFrame:
    return _of_types(graph, (f"{OWL}Class", f"{RDFS}Class"), prefix)


def list_object_properties(graph: DataFrame, prefix: str | None = None) -> DataFrame:
    return _of_types(graph, (f"{OWL}ObjectProperty",), prefix)


def list_datatype_properties(graph: DataFrame, prefix: str | None = None) -> DataFrame:
    return _of_types(graph, (f"{OWL}DatatypeProperty",), prefix)


def _objects(predicate: str, iris_only: bool = False) -> Column:
    hit = F.col("p") == predicate
    return F.array_sort(F.collect_set(F.when(hit & (F.col("o_kind") == "iri") if iris_only else hit, F.col("o"))))


def property_details(graph: DataFrame) -> DataFrame:
    """(uri, domain, range) of every subject that has either."""
    rows = graph.filter(F.col("p").isin(f"{RDFS}domain", f"{RDFS}range"))
    return rows.groupBy(F.col("s").alias("uri")).agg(_objects(f"{RDFS}domain").alias("domain"), _objects(f"{RDFS}range").alias("range"))


def class_details(graph: DataFrame) -> DataFrame:
    """(uri, superclasses, labels, comments); superclasses that are blank nodes are left out."""
    rows = graph.filter(F.col("p").isin(SUB_CLASS, LABEL, COMMENT))
    return rows.groupBy(F.col("s").alias("uri")).agg(_objects(SUB_CLASS, True).alias("superclasses"), _objects(LABEL).alias("labels"), _objects(COMMENT).alias("comments"))


def closure(edges: DataFrame, root: str, deepest: int | None = None) -> DataFrame:
    """(node, level): nodes that reach the root by child-parent edges, and the fewest steps; the root is level 0.

    A frontier is joined with the edges until nothing is new, so cycles end; ``deepest`` stops earlier.
    Each frontier is checkpointed, so no plan holds the levels before it.
    """
    spark = edges.sparkSession
    edges = edges.select("child", "parent").distinct()
    frontier = spark.createDataFrame([(root, 0)], "node string, level int")
    found = frontier
    for level in count(1) if deepest is None else range(1, deepest + 1):
        step = edges.join(frontier.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node"), F.lit(level).alias("level")).distinct()
        frontier = cut(step.join(found.select("node"), "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        found = found.union(frontier)
    return found


def closure_sql(spark: SparkSession, edges: DataFrame, root: str, deepest: int = DEEPEST) -> DataFrame:
    """The same by a recursive query."""
    view = f"edges_{abs(hash((root, deepest))) % 10**9}"
    edges.createOrReplaceTempView(view)
    return spark.sql(
        f"""WITH RECURSIVE up(node, level) AS (
          SELECT CAST('{root}' AS STRING), 0
          UNION ALL SELECT e.child, level + 1 FROM {view} e JOIN up ON e.parent = up.node WHERE level < {deepest})
        SELECT node, min(level) AS level FROM up GROUP BY node"""
    )


def hierarchy(graph: DataFrame, root: str = ORGANIZATION, prefix: str = SCHEMA) -> DataFrame:
    """Classes at or below the root that have a parent: uri, name, parents, children, label, comment.

    A class without a label gets its name; the root is always there.
    """
    edges = graph.filter((F.col("p") == SUB_CLASS) & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    below = closure(edges, root).select(F.col("node").alias("child")).filter(F.col("child").startswith(prefix))
    own = edges.join(below, "child").distinct()
    told = graph.filter(F.col("p").isin(LABEL, COMMENT)).groupBy(F.col("s").alias("child")).agg(F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("label"), F.min(F.when(F.col("p") == COMMENT, F.col("o"))).alias("comment"))
    parents = own.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    if not parents.filter(F.col("child") == root).limit(1).count():
        parents = parents.unionByName(graph.sparkSession.createDataFrame([(root, [f"{SCHEMA}Thing"])], parents.schema))
    children = own.groupBy(F.col("parent").alias("child")).agg(F.array_sort(F.collect_set(local_name(F.col("child")))).alias("children"))
    rows = parents.join(told, "child", "left").join(children, "child", "left")
    name = local_name(F.col("child"))
    return rows.select(F.col("child").alias("uri"), name.alias("name"), "parents", F.coalesce("children", F.array().cast("array<string>")).alias("children"), F.coalesce("label", name).alias("label"), F.coalesce("comment", F.lit("")).alias("comment"))


def level_histogram(levels: DataFrame) -> DataFrame:
    """(level, n): classes by their distance to the root, the root left out."""
    return levels.filter("level > 0").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def fallback(spark: SparkSession) -> DataFrame:
    """The hierarchy table of the built-in classes."""
    names = [n for n, _, _ in FALLBACK]
    rows = [(f"{SCHEMA}{n}", n, [f"{SCHEMA}{p}"], [c for c in names if (c, n) in {(x, y) for x, y, _ in FALLBACK}], n, text) for n, p, text in FALLBACK]
    return spark.createDataFrame(rows, "uri string, name string, parents array<string>, children array<string>, label string, comment string")


def _triples(df: DataFrame, s: str, p: str, o: Column, kind: str = "iri", lang: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.col(s).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("datatype"), F.lit(lang).cast("string").alias("lang")).filter(F.col("o") != "")


def merge(graph: DataFrame, classes: DataFrame, vocabulary: str, removed: DataFrame | None = None) -> DataFrame:
    """graph with a hierarchy's classes: declared with label and comment where new, all parents, two ties to the vocabulary.

    ``removed`` (s, p, o) are taken out at the end.
    """
    have = graph.filter((F.col("p") == RDF_TYPE) & (F.col("o") == f"{OWL}Class")).select(F.col("s").alias("uri"))
    new = classes.join(have, "uri", "left_anti")
    ties = {"Organization": (f"{OWL}equivalentClass", f"{vocabulary}Organization"), "NewsMediaOrganization": (SUB_CLASS, f"{vocabulary}Publisher")}
    parts = [
        graph.select(*COLUMNS),
        _triples(new, "uri", RDF_TYPE, F.lit(f"{OWL}Class")),
        _triples(new, "uri", LABEL, F.col("label"), "literal", "en"),
        _triples(new, "uri", COMMENT, F.col("comment"), "literal", "en"),
        _triples(classes.select("uri", F.explode("parents").alias("parent")), "uri", SUB_CLASS, F.col("parent")),
        *[_triples(classes.filter(F.col("name") == n), "uri", p, F.lit(o)) for n, (p, o) in ties.items()],
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.distinct()
    return out if removed is None else out.join(removed.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(*COLUMNS)


def replaced(graph: DataFrame, subject: str, predicate: str, value: str) -> DataFrame:
    """graph with all values of a subject's predicate replaced by one literal."""
    kept = graph.filter(~((F.col("s") == subject) & (F.col("p") == predicate))).select(*COLUMNS)
    return kept.union(graph.sparkSession.createDataFrame([(subject, predicate, value, "literal", None, None)], kept.schema))


def organization_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """The hierarchy of an RDF/XML vocabulary file, or the built-in one where the file can't be read or holds no class of it."""
    from claimloom.sources.rdf import read_rdf_xml

    try:
        graph = read_rdf_xml(spark, path)
        if graph.filter((F.col("p") == SUB_CLASS) & (F.col("o") == ORGANIZATION)).limit(1).count():
            return hierarchy(graph)
    except Exception as error:  # noqa: BLE001 - any failure means the built-in classes
        spark._jvm.org.apache.log4j.LogManager.getLogger("claimloom").warn(f"{path}: {str(error)[:200]}")
    return fallback(spark)
