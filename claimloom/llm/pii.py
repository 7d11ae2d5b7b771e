"""Personal data: identifiers by pattern, and the terms around them that give them away.

Built from DataFrame and SQL functions only.

1. Identifiers (email, ip, card, phone) are the leftmost non-overlapping matches of each kind's
   pattern that pass its test; positions are sums of the lengths of gaps and matches.
2. A term is a run of three or more letters that touches no letter, digit or character of addresses. Over all
   documents, n(e) have the identifier e, n(t) have the term t, and n(e, t) have both, wherever they stand.
   The information that t gives on e is PMI = log2(n(e, t) N / (n(e) n(t))), at most the information
   content IC = log2(N / n(e)) of e itself. Identifiers that stand in the same texts have the same counts
   and are counted as one.
3. Where PMI / IC is at least GENERALISE, t is generalised wherever it stands in the texts that hold e; from
   REMOVE on it is removed there. One text is enough: an identifier that stands in a single one is disclosed
   by every rare term of it.

``spans`` gives all spans of a document, ``sanitised`` rewrites the texts. Work grows with a text's terms by sorting,
with its identifiers to the power 1.5 at most, and with the terms of each text times the groups of its identifiers.

Defined cases: a null text has no spans and stays null. Null ids, repeated rows and further columns are
kept: results are joined by a digest of the text, never by id. Equal texts get equal spans. An
identifier in every document has no information content and no disclosing terms. A very long text is one expression's
work, in time by sorting. Terms that disclose several identifiers take the highest share; a term at GENERALISE or REMOVE
exactly is generalised or removed. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import stored, unused

GENERALISE, REMOVE = 0.75, 0.9
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "remove")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "remove": ""}

# A match starts where a run of its first class starts or where the last match ended, so the rest of
# the run need not be tried; possessive loops take what greedy ones would and never go back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators that have 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}(?![\p{L}\p{N}@_%+-])(?!\.[A-Za-z0-9])"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _over_blocks(values: Column, i: Column, step: Column, blocks: Column, fold) -> Column:
    """fold of the i values before place i, given the folds of blocks of ``step`` values."""
    whole = F.floor(i / step).cast("int")
    return fold(F.concat(F.slice(blocks, F.lit(1), whole), F.slice(values, whole * step + 1, (i % step).cast("int"))))


def _blocks(values: Column, step: Column, fold) -> Column:
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: fold(F.slice(values, b * step + 1, step)))


def _step(values: Column) -> Column:
    return F.ceil(F.sqrt(F.size(values))).cast("int")


def _bound(x: Column, of) -> Column:
    """of(x) with x evaluated once; of gives an array."""
    return F.flatten(F.transform(F.array(x), of))


LOCATED = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str, matches: Column) -> Column:
    """A pattern's matches, given as strings, with code-point places.

    Sums before a match are taken by blocks of about the square root of the number of matches.
    """
    gaps = F.split(text, pattern, -1)

    def each(x: Column) -> Column:
        step = _step(x["m"])

        def one(m: Column, i: Column) -> Column:
            start = (_over_blocks(x["s"], i, step, x["b"], _sum) + F.char_length(F.get(x["g"], i))).cast("int")
            return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("value"))

        return F.transform(x["m"], one)

    def sized(x: Column) -> Column:
        sizes = F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: F.char_length(m) + F.char_length(g))
        return _bound(F.struct(x["m"].alias("m"), x["g"].alias("g"), sizes.alias("s")), blocked)

    def blocked(x: Column) -> Column:
        return _bound(F.struct(x["m"].alias("m"), x["g"].alias("g"), x["s"].alias("s"), _blocks(x["s"], _step(x["m"]), _sum).alias("b")), each)

    # every part is bound before it is used: an expression inside a lambda would be worked out for each element
    found = _bound(matches, lambda m: F.when(F.size(m) > 0, _bound(F.struct(m.alias("m"), gaps.alias("g")), sized)).otherwise(F.array().cast(LOCATED)))
    return F.coalesce(found, F.array().cast(LOCATED))



def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a string of digits whose Luhn sum is a multiple of ten."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def identified(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """docs with a column of located identifiers for each kind, under the given names."""
    none = F.array().cast("array<string>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = {k: F.when(text.contains(_NEEDS[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) if _NEEDS[k] else F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    df = docs.withColumns({names[k]: c for k, c in found.items()})
    df = df.withColumns({names[k]: located(text, p, F.col(names[k])) for k, p in PATTERNS.items()})
    return df.withColumns({names[k]: F.filter(names[k], lambda x: _PASSES[k](x["value"])) for k in BASE})


def _mentions(names: dict[str, str]) -> Column:
    """array<struct<kind, start, end, entity>> in the order of BASE, then of start."""
    plain = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits}

    def of(k: str):
        return lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(F.lit(k), plain[k](x["value"])).alias("entity"))

    return F.concat(*[F.transform(names[k], of(k)) for k in BASE])


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _placed(texts: DataFrame) -> DataFrame:
    """(key, term, start, end): every term of every text, columns key and text; keys are distinct."""
    cut = texts.select("key", _terms(F.col("text")).alias("m"), F.split("text", TERM, -1).alias("g"))
    each = cut.select("key", F.posexplode(F.zip_with("m", F.slice("g", 1, F.size("m")), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("gap")))).alias("i", "x"))
    upto = F.sum(F.col("x.gap") + F.char_length("x.m")).over(Window.partitionBy("key").orderBy("i")).cast("int")
    return each.select("key", F.lower("x.m").alias("term"), (upto - F.char_length("x.m")).alias("start"), upto.alias("end"))


@dataclass(frozen=True)
class Detected:
    """rows: every document (doc_id, kinds' spans, key where it has identifiers); added: spans of disclosing terms by key."""

    rows: DataFrame
    added: DataFrame
    disclosing: DataFrame


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detected:
    """Identifiers of all documents, and the disclosing terms of the texts that hold them."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = {k: k for k in BASE}
    df = identified(bare, "text", names).withColumn("mentions", _mentions(names))
    held = lambda c: F.when(F.size("mentions") > 0, c)
    slim = df.select("doc_id", *[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in BASE], held(F.md5(F.col("text").cast("binary"))).alias("key"), held(F.array_distinct(F.transform("mentions", lambda m: m["entity"]))).alias("entities"), held(F.col("text")).alias("text"))
    rows = stored(slim)
    total = rows.count()
    having = rows.filter(F.col("key").isNotNull())
    # copies are one text with a number of documents
    texts = stored(having.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"), F.min("entities").alias("entities")))
    places = stored(_placed(texts.select("key", "text")))
    holders = texts.select("key", "n", F.explode("entities").alias("entity"))
    # the same texts: equal numbers and equal sums of two hashes
    sums = [F.sum(F.xxhash64("key", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (0, 1)]
    entities = holders.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"), *sums)
    entities = entities.select("entity", "n_entity", F.xxhash64("texts", "s0", "s1").alias("group"))
    held_by = stored(holders.join(entities, "entity").select("key", "n", "group", "n_entity").distinct())
    within = places.select("key", "term").distinct()
    pairs = stored(within.join(held_by, "key").groupBy("group", "n_entity", "term").agg(F.sum("n").alias("n_both")))
    every = bare.select(F.explode(F.array_distinct(F.transform(_terms(F.col("text")), F.lower))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_term = every.join(pairs.select("term").distinct(), "term")
    known = pairs.join(n_term, "term")
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    pmi = content + F.log2(F.col("n_both") / F.col("n_term"))
    ratio = F.when(F.col("n_entity") < total, pmi / content)
    disclosing = stored(known.withColumn("disclosure", ratio).filter(F.col("disclosure") >= GENERALISE).select("group", "term", "n_both", "n_entity", "n_term", "disclosure"))
    by_term = within.join(held_by, "key").join(disclosing.select("group", "term", "disclosure"), ["group", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("d"))
    by_place = places.join(by_term, ["key", "term"])
    # at most the terms of one text
    added = stored(by_place.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.when(F.col("d") >= REMOVE, "remove").otherwise("general").alias("kind")))).alias("added")))
    return Detected(rows, added, disclosing)


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_general, n_remove."""
    found = detect(docs, id_col, text_col)
    columns = ["doc_id", *BASE]
    clean = found.rows.filter(F.col("key").isNull()).select(*columns).withColumn("added", F.lit(None).cast(found.added.schema["added"].dataType))
    marked = found.rows.filter(F.col("key").isNotNull()).join(found.added, "key", "left").select(*columns, "added")
    df = marked.union(clean)
    by_kind = {k: F.coalesce(F.filter("added", lambda x: x["kind"] == k), F.array().cast(found.added.schema["added"].dataType)) for k in ("general", "remove")}
    base = F.concat_ws(",", *[_listed(k, F.col(k)) for k in BASE])
    every = F.concat_ws(",", *[_listed(k, F.col(k)) for k in BASE], *[_listed(k, c) for k, c in by_kind.items()])
    return df.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        every.alias("spans"),
        *[F.size(c).cast("bigint").alias(f"n_{k}") for k, c in by_kind.items()],
    )


def rewritten(text: Column, all_spans: Column) -> Column:
    """text with a mark for each span; overlapping spans are one, marked as the first (the longest of those that start together).

    all_spans: array<struct<start, less (minus end), kind>>, sorted and not empty. The text is cut as
    fixed-width code points, so a piece costs its own length.
    """
    marks = F.create_map(*[F.lit(x) for k in KINDS for x in (k, MARKS[k])])
    furthest = lambda ends: F.coalesce(F.array_max(ends), F.lit(0))

    def pieces(x: Column) -> Column:
        step = _step(x["s"])
        placed = F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), _over_blocks(x["e"], i, step, x["b"], furthest).alias("before")))
        heads = F.filter(placed, lambda h: h["start"] >= h["before"])
        piece = lambda a, b: F.decode(F.substring(x["t"], a * 4 + 1, (b - a) * 4), "UTF-32")
        shown = F.transform(heads, lambda h: F.concat(piece(h["before"], h["start"]), F.element_at(marks, h["kind"])))
        return F.concat(shown, F.array(piece(furthest(x["e"]), F.char_length(text))))

    def ended(s: Column) -> Column:
        return _bound(F.struct(s.alias("s"), F.transform(s, lambda y: -y["less"]).alias("e"), F.encode(text, "UTF-32").alias("t")), blocked)

    def blocked(x: Column) -> Column:
        return _bound(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), _blocks(x["e"], _step(x["s"]), furthest).alias("b")), pieces)

    return F.array_join(_bound(all_spans, ended), "")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with identifiers replaced by marks, disclosing terms generalised or removed; other columns as they are.

    A column ``n_chars`` of whole numbers is set to the new length.
    """
    found = detect(docs, id_col, text_col)
    names = {k: unused(docs, f"_pii_{k}") for k in BASE}
    key, added, mentions = (unused(docs, f"_pii_{x}") for x in ("key", "added", "mentions"))
    df = identified(docs, text_col, names).withColumn(mentions, _mentions(names))
    # rows without identifiers meet nothing; their keys differ with their ids, so null texts and copies are spread
    df = df.withColumn(key, F.when(F.size(mentions) > 0, F.md5(F.col(text_col).cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64(id_col, text_col).cast("string"))))
    df = df.join(found.added.select(F.col("key").alias(key), F.col("added").alias(added)), key, "left")
    item = lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"))
    every = F.array_sort(F.concat(F.transform(mentions, item), F.coalesce(F.transform(added, item), F.array().cast("array<struct<start:int,less:int,kind:string>>"))))
    text = F.when(F.size(every) > 0, rewritten(F.col(text_col), every)).otherwise(F.col(text_col))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    df = df.withColumn(mentions, text)
    columns[text_col] = F.col(mentions).alias(text_col)
    if "n_chars" in columns and dict(docs.dtypes)["n_chars"] in ("int", "bigint"):
        columns["n_chars"] = F.char_length(mentions).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return df.select(*columns.values())
