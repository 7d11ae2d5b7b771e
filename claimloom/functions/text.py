"""Scalar expressions over article, agent and claim strings."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Python's white space inside the Basic Multilingual Plane, which ``\\s`` alone is not in Java.
SPACES = r"(?U)\s+"


def blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit("")) == ""


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(c, F.lit(default))


def combined_text(title: Column, body: Column) -> Column:
    """``title. body``; an empty title still leaves the full stop."""
    return F.concat(or_default(title, ""), F.lit(". "), or_default(body, ""))


def body_or_rest(body: Column, content: Column, rest: Sequence[Column]) -> Column:
    """The body, else the content, else the remaining scalar fields joined by spaces."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(body), filled(content), F.concat_ws(" ", *[c.cast("string") for c in rest]))


def article_id(path: Column) -> Column:
    """``<file>_<folder>`` of ``.../<folder>/<file>.json``."""
    return F.concat_ws("_", F.regexp_extract(path, r"([^/]+)\.json$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def slug(c: Column) -> Column:
    """Each run of white space as one underscore."""
    return F.regexp_replace(c, SPACES, "_")


def url_quoted(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``_.-~``; spaces become %20."""
    e = F.url_encode(c)
    for written, meant in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(written), F.lit(meant))
    return e


def instance_uri(namespace: str, kind: str, ident: Column) -> Column:
    """``namespace/kind/id``: a trailing # becomes /, outer slashes go, spaces become underscores."""
    base = f"{namespace[:-1]}/" if namespace.endswith("#") else namespace
    return F.concat(F.lit(f"{base}{kind.strip('/').replace(' ', '_')}/"), F.replace(F.btrim(ident, F.lit("/")), F.lit(" "), F.lit("_")))


def md5_id(*parts: Column) -> Column:
    return F.md5(F.concat(*[or_default(p, "") for p in parts]).cast("binary"))


def rfc3339(date: Column) -> Column:
    """The first space becomes T unless the part before it has one already."""
    return F.when(date.contains(" ") & ~F.split_part(date, F.lit(" "), F.lit(1)).contains("T"), F.regexp_replace(date, "^([^ ]*) ", "$1T")).otherwise(date)


#: Utterance types and their classes.
UTTERANCE_TYPES = {"direct": "directUtterance", "indirect": "indirectUtterance", "partially_direct": "partiallyDirectUtterance"}


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """The table's value for a key; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def utterance_class(c: Column) -> Column:
    return lookup(UTTERANCE_TYPES, F.translate(F.lower(c), "-", "_"))


#: Speaker classes (lower case, no spaces) and their schema classes; all others are Organization.
ORGANIZATION_CLASSES = {
    "airline": "Airline",
    "corporation": "Corporation",
    "educationalorganization": "EducationalOrganization",
    "fundingscheme": "FundingScheme",
    "governmentorganization": "GovernmentOrganization",
    "librarysystem": "LibrarySystem",
    "localbusiness": "LocalBusiness",
    "medicalorganization": "MedicalOrganization",
    "ngo": "NGO",
    "newsmediaorganization": "NewsMediaOrganization",
    "performinggroup": "PerformingGroup",
    "politicalparty": "PoliticalParty",
    "researchorganization": "ResearchOrganization",
    "sportsorganization": "SportsOrganization",
    "businessrepresentative": "Corporation",
}


def organization_class(classification: Column) -> Column:
    return F.coalesce(lookup(ORGANIZATION_CLASSES, F.lower(F.replace(classification, F.lit(" "), F.lit("")))), F.lit("Organization"))


#: Topics by a piece of the article id, in order of precedence.
TOPICS = {
    "climate_change": ("ClimateChange", "Climate Change"),
    "uk_immigration": ("UKImmigration", "UK Immigration"),
    "ukraine_war": ("UkraineWar", "Ukraine War"),
    "us_politics": ("USPolitics", "US Politics"),
}


def first_topic(c: Column, topics: Mapping[str, tuple[str, str]] = TOPICS, part: int = 0) -> Column:
    """The name (part 0) or label (1) of the first topic whose key the string contains; else null."""
    out = F.lit(None).cast("string")
    for key, names in reversed(topics.items()):
        out = F.when(c.contains(key), F.lit(names[part])).otherwise(out)
    return out


def kb_date(time: Column) -> Column:
    """``+YYYY-MM-DDT...`` as YYYY-MM-DD."""
    return F.split_part(F.regexp_replace(time, r"^\+", ""), F.lit("T"), F.lit(1))


def kb_date_short(time: Column) -> Column:
    """``+YYYY-MM-DDT...`` as D/M/YYYY without leading zeros; an unknown part 00 is empty; null below three parts."""
    parts = F.split(kb_date(time), "-")
    plain = lambda i: F.ltrim(F.get(parts, i), F.lit("0"))
    return F.when(F.size(parts) >= 3, F.concat(plain(2), F.lit("/"), plain(1), F.lit("/"), plain(0)))


def media_url(filename: Column, width: int, host: str = "https://media.example.org/thumb") -> Column:
    """The hashed thumbnail path of a media file; null for null or empty."""
    name = F.replace(filename, F.lit(" "), F.lit("_"))
    h = F.md5(name.cast("binary"))
    url = F.concat(F.lit(f"{host}/"), F.substring(h, 1, 1), F.lit("/"), F.substring(h, 1, 2), F.lit("/"), name, F.lit(f"/{width}px-"), name)
    return F.when(filename != "", url)


def in_languages(labels: Column, languages: Sequence[str]) -> Column:
    """The value of the first language that a map has."""
    return F.coalesce(*[F.try_element_at(labels, F.lit(x)) for x in languages])


def first_alias(aliases: Column, languages: Sequence[str] = ("en", "it")) -> Column:
    """The first alias over languages in order; null without any."""
    none = F.array().cast("array<string>")
    return F.try_element_at(F.concat(*[F.coalesce(F.try_element_at(aliases, F.lit(x)), none) for x in languages]), F.lit(1))


def model_name(c: Column) -> Column:
    return F.translate(c, "./", "_-")


def experiment_name(a: Column, b: Column, c: Column) -> Column:
    return F.concat_ws("__", model_name(a), model_name(b), model_name(c))


def safe_filename(ident: Column) -> Column:
    return F.concat(F.lit("article_"), F.replace(F.replace(ident, F.lit("/"), F.lit("_")), F.lit(".."), F.lit("_")), F.lit(".json"))


def clean_label(c: Column) -> Column:
    """Without bold marks and outer white space."""
    return F.trim(F.replace(c, F.lit("**"), F.lit("")))


def name_or_raw(processed: Column, raw: Column) -> Column:
    return F.coalesce(F.when(processed != "", processed), raw)


def prompt(template: str, **values: Column) -> Column:
    """A template with ``{name}`` filled from columns; structs and arrays as JSON."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), or_default(c, ""))
    return out


_MOJIBAKE = ("Ã", "Â", "â€", "Å", "ðŸ")


_CONTINUED = "".join(dict.fromkeys(c for b in range(0x80, 0xC0) for c in (bytes([b]).decode("cp1252", "ignore"), chr(b)) if c))
#: A character that was read byte by byte: its first byte and as many more as that one says.
_RUN = re.compile(f"[Â-Å][{re.escape(_CONTINUED)}]|â[{re.escape(_CONTINUED)}]{{2}}|ð[{re.escape(_CONTINUED)}]{{3}}")
#: Straight quotes, letters for ligatures, one kind of line end; control characters and stray marks of order go.
_PLAIN = str.maketrans(
    {q: "'" for q in "\u2018\u2019\u201a\u201b\u02bc"}
    | {q: '"' for q in "\u201c\u201d\u201e\u201f"}
    | {x: unicodedata.normalize("NFKC", x) for x in "\u0132\u0133\u0149\u01f1\u01f2\u01f3\u01c4\u01c5\u01c6\u01c7\u01c8\u01c9\u01ca\u01cb\u01cc\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06"}
    | {x: "\n" for x in "\u2028\u2029\x85"}
    | {x: None for x in [*map(chr, [*range(9), 11, *range(14, 32), 127]), "\ufeff", "\u206a", "\u206b", "\u206c", "\u206d", "\u206e", "\u206f", "\ufff9", "\ufffa", "\ufffb"]}
)
_TERMINAL = re.compile("\x1b\\[((?:\\d|;)*)([a-zA-Z])")


def _read_again(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again: the whole text, else the runs that are whole characters."""
    for codec in ("cp1252", "latin-1"):
        try:
            return text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue

    def one(m: re.Match) -> str:
        raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in m[0])
        try:
            return raw.decode("utf-8")
        except UnicodeError:
            return m[0]

    return _RUN.sub(one, text)


def repaired(text: str | None) -> str:
    """A text as it was meant; null is empty.

    In this order: HTML entities where the text has no ``<``, terminal escapes, wrong code pages (up to three times), full-width
    letters, ligatures, curly quotes, line ends, control characters, and composed characters (NFC).
    """
    text = text or ""
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    text = _TERMINAL.sub("", text)
    for _ in range(3):
        if not any(m in text for m in _MOJIBAKE):
            break
        again = _read_again(text)
        if again == text:
            break
        text = again
    text = "".join(unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uff5e" or c == "\u3000" else c for c in text) if _WIDE.search(text) else text
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").translate(_PLAIN))


_WIDE = re.compile("[\uff01-\uff5e\u3000]")


@F.arrow_udf(StringType())
def fix_text(text: pa.Array) -> pa.Array:
    return pa.array([repaired(x) for x in text.to_pylist()], pa.string())
