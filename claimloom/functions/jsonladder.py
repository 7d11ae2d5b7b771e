"""Reading JSON out of annotators' answers: strict first, then cut out, then repaired.

Accepted faults: a fence, prose around the value, trailing commas, unquoted keys, single quotes. A repair
works on the marks of the text, so what stands in a string is never touched. Anything else is refused (null).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(c: Column) -> Column:
    """The value as a variant; null where the string isn't JSON."""
    return F.try_parse_json(c)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def unfenced(c: Column) -> Column:
    """Without a fence around the whole answer."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def fenced_or_widest(c: Column) -> Column:
    """The first fenced block, else the widest object or list in the text; empty without one."""
    fence = F.regexp_extract(c, r"(?s)```json\s*(.+?)\s*```", 1)
    return F.when(fence != "", fence).otherwise(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1))


def outer_braces(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


#: Strings of either quote, runs of letters and digits, and single other characters; white space between them is dropped.
_MARK = r"""(?s)"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\w+|\S"""


def repaired(c: Column) -> Column:
    """The marks joined again: strings in double quotes, bare keys quoted, commas before a closing bracket left out."""

    def mended(marks: Column) -> Column:
        def one(mark: Column, i: Column) -> Column:
            before, after = F.get(marks, i - 1), F.get(marks, i + 1)
            inner = F.replace(F.replace(F.substring(mark, F.lit(2), F.length(mark) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
            single = mark.startswith("'") & (F.length(mark) > 1)
            key = mark.rlike(r"^\w+$") & (after == ":") & before.isin("{", ",")
            return F.when(single, F.concat(F.lit('"'), inner, F.lit('"'))).when(key, F.concat(F.lit('"'), mark, F.lit('"'))).when((mark == ",") & after.isin("}", "]"), "").otherwise(mark)

        return F.array_join(F.transform(marks, one), "")

    return F.get(F.transform(F.array(F.regexp_extract_all(c, F.lit(_MARK), F.lit(0))), mended), 0)


def _values_in(text: str | None) -> list[str]:
    """The JSON objects and lists in a text, the outermost that can be read, in order."""
    out, at, read = [], 0, json.JSONDecoder().raw_decode
    text = text or ""
    while True:
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            return out
        try:
            value, at = read(text, min(starts))
            out.append(json.dumps(value, ensure_ascii=False))
        except (ValueError, RecursionError):
            at = min(starts) + 1


def values_in(c: Column) -> Column:
    """array<string>: the JSON objects and lists that stand in a text."""
    return F.arrow_udf(lambda x: pa.array([_values_in(t) for t in x.to_pylist()], pa.list_(pa.string())), "array<string>")(c)


def answer(c: Column) -> Column:
    """An object by the ladder strict, outer braces, repaired; null for anything but an object."""
    text = unfenced(c)
    found = F.coalesce(strict(text), strict(outer_braces(text)), strict(repaired(text)))
    return F.when(is_object(found), found)


def rung(c: Column) -> Column:
    """Which rung of ``answer`` reads the string: 1, 2, 3, or 0 for none."""
    text = unfenced(c)
    return F.when(strict(text).isNotNull(), 1).when(strict(outer_braces(text)).isNotNull(), 2).when(strict(repaired(text)).isNotNull(), 3).otherwise(0)


CLAIM = "struct<agent_name:string,agent_description:string,agent_type:string,utterance_type:string,utterance_text:string,source_context:string>"
CLAIMS = f"array<{CLAIM}>"


def _claims(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, CLAIMS)


def first_version_claims(c: Column) -> Column:
    """Claims of a first-version answer.

    Whole JSON: the list under ``results`` or a bare list; an object without ``results`` has none. Only
    where that fails: the list of the first object with ``results`` in the text, else every
    object with an agent's name that can be read alone.
    """
    whole, none = strict(c), F.array().cast(CLAIMS)
    listed = F.coalesce(_claims(whole, "$.results"), F.when(is_list(whole), _claims(whole)))
    inside = values_in(F.when(whole.isNull(), c))
    lists = F.filter(F.transform(inside, lambda x: _claims(strict(x), "$.results")), lambda x: x.isNotNull())
    loose = F.filter(F.transform(inside, lambda x: F.from_json(x, CLAIM)), lambda x: x["agent_name"].isNotNull())
    return F.when(whole.isNotNull(), F.coalesce(listed, none)).otherwise(F.coalesce(F.get(lists, 0), loose, none))


def second_version_value(c: Column, key: str | None) -> Column:
    """The variant under a key of a second-version answer (``None``: the whole); null is a failed try. Bare lists have no keys."""
    block = fenced_or_widest(c)
    found = F.when(block != "", F.coalesce(strict(block), strict(repaired(block))))
    return found if key is None else F.when(is_object(found), F.try_variant_get(found, f"$.{key}", "variant"))


def list_under(c: Column, key: str) -> Column:
    """Root repair: a bare list, a single object or another root key as the list under ``key``, as a variant."""
    v = F.coalesce(strict(unfenced(c)), strict(repaired(unfenced(c))))
    own = F.try_variant_get(v, f"$.{key}", "variant")
    as_json = F.to_json(v)
    other = F.regexp_extract(as_json, r'(?s)^\{"[^"]*":(\[.*\])\}$', 1)
    return F.when(is_list(v), v).when(is_object(v), F.coalesce(own, F.when(other != "", strict(other)), strict(F.concat(F.lit("["), as_json, F.lit("]")))))


def first_list(v: Column, keys: tuple[str, ...]) -> Column:
    """The claims under the first of several keys that holds a list, else none."""
    return F.coalesce(*[_claims(v, f"$.{k}") for k in keys], F.array().cast(CLAIMS))


def complete(v: Column, keys: tuple[str, ...] = ("answer", "reasoning")) -> Column:
    """True for an object whose fields under all keys are there and not blank."""
    out = is_object(v)
    for k in keys:
        out = out & (F.trim(F.try_variant_get(v, f"$.{k}", "string")) != "")
    return F.coalesce(out, F.lit(False))
