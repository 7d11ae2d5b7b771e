"""Triples in and out: Turtle and N-Triples files, RDF/XML, JSON-LD."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.graph import RDF_TYPE, TRIPLE

_RDF = RDF_TYPE[: -len("type")]
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
  |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<iri><[^<>"{}|^`\\\s]*>)
  |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<type>\^\^)
  |(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?))
  |(?P<blank>_:[\w.-]*[\w-])
  |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%-]|\\.|[.:](?=[\w%:.-]*[\w%-]))*|true\b|false\b|a(?=\s))
  |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s)


class _Turtle:
    """A recursive-descent reader of one Turtle document; blank nodes are numbered within ``mark``."""

    def __init__(self, text: str, mark: str):
        self.tokens = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"Turtle: unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at, self.base, self.prefixes, self.triples, self.mark, self.blanks = 0, "", {}, [], mark, 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, value=None):
        kind, token = self.peek()
        if kind is None or value is not None and token != value:
            raise ValueError(f"Turtle: expected {value!r}, found {token!r}")
        self.at += 1
        return kind, token

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.mark}{self.blanks}"

    def iri(self, kind, token) -> str:
        if kind == "iri":
            value = _plain(token[1:-1])
            return value if re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value
        prefix, _, local = token.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"Turtle: unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node(self):
        kind, token = self.take()
        if kind == "iri" or kind == "name" and ":" in token:
            return self.iri(kind, token), "iri", None, None
        if kind == "blank":
            return f"_:{self.mark}-{token[2:]}", "blank", None, None
        if token == "[":
            b = self.fresh()
            if self.peek()[1] != "]":
                self.properties(b)
            self.take("]")
            return b, "blank", None, None
        if token == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            head = f"{_RDF}nil"
            for item in reversed(items):
                b = self.fresh()
                self.triples += [(b, f"{_RDF}first", *item), (b, f"{_RDF}rest", head, "blank" if head.startswith("_:") else "iri", None, None)]
                head = b
            return head, "blank" if head.startswith("_:") else "iri", None, None
        if kind in ("string", "long"):
            value = _plain(token[3:-3] if kind == "long" else token[1:-1])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.take()[1][1:]
            if self.peek()[0] == "type":
                self.take()
                return value, "literal", self.iri(*self.take()), None
            return value, "literal", None, None
        if kind == "number":
            return token, "literal", _XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None
        if token in ("true", "false"):
            return token, "literal", f"{_XSD}boolean", None
        raise ValueError(f"Turtle: unexpected {token!r}")

    def properties(self, s: str) -> None:
        while True:
            kind, token = self.take()
            p = RDF_TYPE if token == "a" else self.iri(kind, token)
            while True:
                self.triples.append((s, p, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", None):
                return

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, token = self.peek()
            if kind == "directive":
                self.take()
                if token.lower().strip("@") == "prefix":
                    name = self.take()[1][:-1]
                    self.prefixes[name] = self.iri(*self.take())
                else:
                    self.base = self.iri(*self.take())
                if token.startswith("@"):
                    self.take(".")
                continue
            subject = self.node()[0]
            if self.peek()[1] != ".":
                self.properties(subject)
            self.take(".")
        return self.triples


def parse_turtle(text: str, mark: str = "b") -> tuple[list[tuple], dict[str, str]]:
    """(triples, prefixes) of a Turtle document; a triple is s, p, o, o_kind, datatype, lang."""
    t = _Turtle(text, mark)
    return t.read(), t.prefixes


def read_turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of small Turtle files, read by Spark; a missing or broken file adds nothing."""
    triples: list[tuple] = []
    for i, path in enumerate(paths):
        try:
            rows = spark.read.text(path, wholetext=True).collect()  # ontologies: small files
            triples += [t for r in rows for t in parse_turtle(r.value, f"f{i}b")[0]]
        except Exception as error:  # noqa: BLE001 - a graph is built without what can't be read
            spark._jvm.org.apache.log4j.LogManager.getLogger("claimloom").warn(f"{path}: {str(error)[:200]}")
    return spark.createDataFrame([tuple(t) for t in dict.fromkeys(triples)], TRIPLE)


def prefixes(text: str) -> dict[str, str]:
    return parse_turtle(text)[1]


def _escaped(c):
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def _resource(c):
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def _short(c, prefixes: dict[str, str] | None):
    """A resource, by its prefix where what follows the namespace is a plain name."""
    out = _resource(c)
    for name, space in (prefixes or {}).items():
        rest = F.substring(c, F.lit(len(space) + 1), F.length(c))
        out = F.when(c.startswith(space) & rest.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit(f"{name}:"), rest)).otherwise(out)
    return out


def _object(prefixes: dict[str, str] | None = None):
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang"))).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))).otherwise("")
    return F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(_short(F.col("o"), prefixes))


def n_triples(graph: DataFrame) -> DataFrame:
    """(value): a line per triple."""
    return graph.select(F.concat_ws(" ", _resource(F.col("s")), _resource(F.col("p")), _object(), F.lit(".")).alias("value"))


def turtle(graph: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): a statement per subject; the triples of one subject are gathered, so subjects must be of bounded size.

    ``prefixes`` (name to namespace) are bound at the head of each partition, as every part is a document of its own.
    """
    rows = graph.select(_short(F.col("s"), prefixes).alias("s"), F.concat_ws(" ", _short(F.col("p"), prefixes), _object(prefixes)).alias("po"))
    out = rows.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("po")), " ;\n    ").alias("po")).select(F.concat("s", F.lit(" "), "po", F.lit(" .")).alias("value"))
    head = "\n".join(f"@prefix {name}: <{space}> ." for name, space in (prefixes or {}).items())

    def bound(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        yield from batches

    return out.mapInArrow(bound, "value string") if prefixes else out


def json_ld(graph: DataFrame) -> DataFrame:
    """(value): a JSON object per subject in expanded form."""
    o = F.when(F.col("o_kind") == "literal", F.to_json(F.struct(F.col("o").alias("@value"), F.col("datatype").alias("@type"), F.col("lang").alias("@language")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    by = graph.groupBy("s", "p").agg(F.array_sort(F.collect_set(o)).alias("os"))
    quoted = lambda c: F.concat(F.lit('"'), _escaped(c), F.lit('"'))
    key = F.concat(quoted(F.col("p")), F.lit(":["), F.array_join("os", ","), F.lit("]"))
    return by.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("kv")).select(F.concat(F.lit('{"@id":'), quoted(F.col("s")), F.lit(","), "kv", F.lit("}")).alias("value"))


def _xml(c):
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def rdf_xml(graph: DataFrame) -> DataFrame:
    """(value): an rdf:Description per triple; the file needs the root element around it (see write)."""
    local = F.regexp_extract("p", r"([^/#]+)$", 1)
    space = F.substring(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    about = F.when(F.col("s").startswith("_:"), F.concat(F.lit(' rdf:nodeID="'), F.substring(F.col("s"), F.lit(3), F.length("s")), F.lit('"'))).otherwise(F.concat(F.lit(' rdf:about="'), _xml(F.col("s")), F.lit('"')))
    kind = F.when(F.col("lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("lang"), F.lit('"'))).when(F.col("datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), F.col("datatype"), F.lit('"'))).otherwise("")
    inner = F.when(F.col("o_kind") == "literal", F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), _xml(space), F.lit('"'), kind, F.lit(">"), _xml(F.col("o")), F.lit("</n:"), local, F.lit(">"))).otherwise(
        F.concat(F.lit("<n:"), local, F.lit(' xmlns:n="'), _xml(space), F.lit('" '), F.when(F.col("o").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substring(F.col("o"), F.lit(3), F.length("o")))).otherwise(F.concat(F.lit('rdf:resource="'), _xml(F.col("o")))), F.lit('"/>'))
    )
    return graph.select(F.concat(F.lit("<rdf:Description"), about, F.lit(">"), inner, F.lit("</rdf:Description>")).alias("value"))


FORMATS = {"turtle": turtle, "nt": n_triples, "json-ld": json_ld, "xml": rdf_xml}


def write(graph: DataFrame, folder: str, form: str = "turtle", prefixes: dict[str, str] | None = None) -> None:
    """A folder of text parts. xml: each part's lines go between the root's tags; json-ld: one object a line. Turtle binds ``prefixes``."""
    rows = turtle(graph, prefixes) if form == "turtle" else FORMATS[form](graph)
    rows.write.mode("overwrite").text(folder)


def xml_document(lines: list[str]) -> str:
    """A whole RDF/XML document from lines of rdf_xml."""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{_RDF}">\n' + "\n".join(lines) + "\n</rdf:RDF>\n"


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a small RDF/XML file of descriptions and typed nodes with flat properties."""
    import xml.etree.ElementTree as tree

    (row,) = spark.read.text(path, wholetext=True).collect()
    rdf = f"{{{_RDF}}}"
    out = []
    for i, node in enumerate(tree.fromstring(row.value)):
        s = node.get(f"{rdf}about") or f"_:{node.get(f'{rdf}nodeID', f'x{i}')}"
        if node.tag != f"{rdf}Description":
            out.append((s, RDF_TYPE, node.tag[1:].replace("}", ""), "iri", None, None))
        for child in node:
            p = child.tag[1:].replace("}", "")
            resource, blank = child.get(f"{rdf}resource"), child.get(f"{rdf}nodeID")
            if resource is not None or blank is not None:
                out.append((s, p, resource if resource is not None else f"_:{blank}", "iri" if resource is not None else "blank", None, None))
            else:
                out.append((s, p, child.text or "", "literal", child.get(f"{rdf}datatype"), child.get("{http://www.w3.org/XML/1998/namespace}lang")))
    return spark.createDataFrame(list(dict.fromkeys(out)), TRIPLE)
