"""Catalogue queries and hierarchies, over parts, regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import graph as g
from claimloom.operators import ontology as o
from claimloom.sources.tables import table

_NS = "https://schema.org/"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under nations under regions under one root, and a cycle that leads back to a region."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("ALL").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return r.union(n).union(c).union(r.filter("child = 'R1'").select("child", F.lit("N1")))


def catalog_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes under part types, with labels and comments; sizes as properties."""
    p = table(spark, sf_dir, "part")
    brand, kind = F.concat(F.lit(_NS), F.replace("p_brand", F.lit("#"), F.lit(""))), F.concat(F.lit("http://example.org/types/"), "p_type")
    size = F.concat(F.lit(_NS), F.lit("size"), F.col("p_size").cast("string"))
    odd = F.col("p_size") % 2 == 1
    return g.merged(
        g.emitted(
            p,
            g.iri(brand, g.RDF_TYPE, f"{g.OWL}Class"),
            g.iri(kind, g.RDF_TYPE, f"{g.RDFS}Class"),
            g.iri(brand, g.SUB_CLASS, kind),
            g.literal(brand, g.LABEL, F.col("p_brand")),
            g.literal(F.when(F.col("p_size") == 7, brand), g.COMMENT, F.col("p_type")),
            g.iri(F.when(odd, size), g.RDF_TYPE, f"{g.OWL}ObjectProperty"),
            g.iri(F.when(~odd, size), g.RDF_TYPE, f"{g.OWL}DatatypeProperty"),
            g.iri(size, f"{g.RDFS}domain", brand),
            g.iri(F.when(odd, size), f"{g.RDFS}range", kind),
        )
    )


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a namespace."""
    return o.list_classes(catalog_graph(spark, sf_dir), _NS)


def object_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object properties."""
    return o.list_object_properties(catalog_graph(spark, sf_dir))


def datatype_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datatype properties."""
    return o.list_datatype_properties(catalog_graph(spark, sf_dir))


def property_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and ranges of properties, joined."""
    return o.property_details(catalog_graph(spark, sf_dir)).select("uri", F.array_join("domain", ",").alias("domain"), F.array_join("range", ",").alias("range"))


def class_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superclasses, labels and comments of classes, joined."""
    return o.class_details(catalog_graph(spark, sf_dir)).select("uri", *[F.array_join(c, ",").alias(c) for c in ("superclasses", "labels", "comments")])


def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below the root and its depth, by a frontier loop that a cycle doesn't trap."""
    return o.closure(_edges(spark, sf_dir), "ALL")


def subclass_closure_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a recursive query, without the cycle."""
    return o.closure_sql(spark, _edges(spark, sf_dir).filter("NOT (child = 'R1' AND parent = 'N1')"), "ALL")


def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie at each depth."""
    return o.level_histogram(o.closure(_edges(spark, sf_dir), "ALL", o.DEEPEST))


def taxonomy_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class map below a root: parents and children by name."""
    rows = o.hierarchy(catalog_graph(spark, sf_dir), "http://example.org/types/SMALL")
    return rows.select("uri", "name", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"), "label", "comment")


def taxonomy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in hierarchy merged into the catalogue graph; one class declaration is taken out."""
    graph = catalog_graph(spark, sf_dir)
    gone = spark.createDataFrame([(f"{_NS}Brand1", g.RDF_TYPE, f"{g.OWL}Class")], "s string, p string, o string")
    return o.merge(graph, o.fallback(spark), g.VOCABULARY, gone)


_BRAND, _KIND, _SIZE = f"'{_NS}' || replace(p_brand, '#', '')", "'http://example.org/types/' || p_type", f"'{_NS}size' || p_size"
_NODES = "WITH RECURSIVE e AS (SELECT 'R' || r_regionkey AS child, 'ALL' AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer), up(node, level) AS (SELECT 'ALL', 0 UNION ALL SELECT child, level + 1 FROM e JOIN up ON parent = node WHERE level < 10), l AS (SELECT node, CAST(min(level) AS INTEGER) AS level FROM up GROUP BY 1)"
_ROWS = [(_BRAND, g.RDF_TYPE, f"'{g.OWL}Class'", 0, "true"), (_KIND, g.RDF_TYPE, f"'{g.RDFS}Class'", 0, "true"), (_BRAND, g.SUB_CLASS, _KIND, 0, "true"), (_BRAND, g.LABEL, "p_brand", 1, "true"), (_BRAND, g.COMMENT, "p_type", 1, "p_size = 7"), (_SIZE, g.RDF_TYPE, f"'{g.OWL}ObjectProperty'", 0, "p_size % 2 = 1"), (_SIZE, g.RDF_TYPE, f"'{g.OWL}DatatypeProperty'", 0, "p_size % 2 = 0"), (_SIZE, f"{g.RDFS}domain", _BRAND, 0, "true"), (_SIZE, f"{g.RDFS}range", _KIND, 0, "p_size % 2 = 1")]
_GRAPH = "SELECT DISTINCT *, CAST(NULL AS VARCHAR) AS datatype FROM (" + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {x} AS o, '{'literal' if lit else 'iri'}' AS o_kind, CAST(NULL AS VARCHAR) AS lang FROM part WHERE {w}" for s, p, x, lit, w in _ROWS) + ")"
_LIST = "SELECT DISTINCT s AS uri FROM ({graph}) WHERE p = '{t}' AND o IN ({types}) {more}"


def _joined(p: str) -> str:
    return f"coalesce(string_agg(DISTINCT o, ',' ORDER BY o) FILTER (p = '{p}'), '')"


def _fallback_sql() -> str:
    rows = []
    for n, parent, text in o.FALLBACK:
        u = f"{_NS}{n}"
        rows += [(u, g.RDF_TYPE, f"{g.OWL}Class", "iri", None), (u, g.LABEL, n, "literal", "en"), (u, g.COMMENT, text, "literal", "en"), (u, g.SUB_CLASS, f"{_NS}{parent}", "iri", None)]
    rows += [(f"{_NS}Organization", f"{g.OWL}equivalentClass", f"{g.VOCABULARY}Organization", "iri", None), (f"{_NS}NewsMediaOrganization", g.SUB_CLASS, f"{g.VOCABULARY}Publisher", "iri", None)]
    return " UNION ALL ".join("SELECT " + ", ".join(f"{'CAST(NULL AS VARCHAR)' if v is None else repr(v)} AS {c}" for c, v in zip(("s", "p", "o", "o_kind", "lang"), r)) + ", CAST(NULL AS VARCHAR) AS datatype" for r in rows)


_SMALL = f"SELECT DISTINCT s FROM ({_GRAPH}) WHERE p = '{g.SUB_CLASS}' AND o = 'http://example.org/types/SMALL'"

QUERIES = {f.__name__: f for f in (class_list, object_properties, datatype_properties, property_details, class_details, subclass_closure, subclass_closure_sql, level_histogram, taxonomy_hierarchy, taxonomy_merge)}
ORACLES = {
    "class_list": _LIST.format(graph=_GRAPH, t=g.RDF_TYPE, types=f"'{g.OWL}Class', '{g.RDFS}Class'", more=f"AND s LIKE '{_NS}%'"),
    "object_properties": _LIST.format(graph=_GRAPH, t=g.RDF_TYPE, types=f"'{g.OWL}ObjectProperty'", more=""),
    "datatype_properties": _LIST.format(graph=_GRAPH, t=g.RDF_TYPE, types=f"'{g.OWL}DatatypeProperty'", more=""),
    "property_details": f"SELECT s AS uri, {_joined(f'{g.RDFS}domain')} AS domain, {_joined(f'{g.RDFS}range')} AS range FROM ({_GRAPH}) WHERE p IN ('{g.RDFS}domain', '{g.RDFS}range') GROUP BY 1",
    "class_details": f"SELECT s AS uri, {_joined(g.SUB_CLASS)} AS superclasses, {_joined(g.LABEL)} AS labels, {_joined(g.COMMENT)} AS comments FROM ({_GRAPH}) WHERE p IN ('{g.SUB_CLASS}', '{g.LABEL}', '{g.COMMENT}') GROUP BY 1",
    "subclass_closure": f"{_NODES} SELECT node, level FROM l",
    "subclass_closure_sql": f"{_NODES} SELECT node, level FROM l",
    "level_histogram": f"{_NODES} SELECT level, count(*) AS n FROM l WHERE level > 0 GROUP BY 1",
    "taxonomy_hierarchy": f"SELECT s AS uri, string_split(s, '/')[-1] AS name, {_joined(g.SUB_CLASS)} AS parents, '' AS children, min(o) FILTER (p = '{g.LABEL}') AS label, coalesce(min(o) FILTER (p = '{g.COMMENT}'), '') AS comment FROM ({_GRAPH}) WHERE s IN ({_SMALL}) GROUP BY 1 UNION ALL SELECT 'http://example.org/types/SMALL', 'SMALL', '{_NS}Thing', (SELECT string_agg(string_split(s, '/')[-1], ',' ORDER BY string_split(s, '/')[-1]) FROM ({_SMALL})), 'SMALL', ''",
    "taxonomy_merge": f"SELECT DISTINCT s, p, o, o_kind, datatype, lang FROM (SELECT s, p, o, o_kind, datatype, lang FROM ({_GRAPH}) UNION ALL SELECT s, p, o, o_kind, datatype, lang FROM ({_fallback_sql()})) WHERE NOT (s = '{_NS}Brand1' AND p = '{g.RDF_TYPE}' AND o = '{g.OWL}Class')",
}
