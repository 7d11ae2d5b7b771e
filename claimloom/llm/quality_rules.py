"""Quality rules as a ledger: every rule is evaluated once into a failure bit, policies are bit masks.

``measured`` adds one struct of measurements (Arrow, one pass over each text). ``ledger`` turns
them into failure bits. ``verdict`` applies a policy: a version, a mask of enforced rules and the
number of failures it tolerates, so a new version needs no new pass over the texts. ``ablation``
counts, per rule, what each rule rejects, alone and together, from the bits only.

Defined cases: a null text has no words and fails ``few_words``; so does an empty one. A very long text is measured
in slices, with the same results. Limits are met, not passed, at equality: exactly 50 words are enough. A null id,
repeated rows and further columns are kept as they are; measurements go to one struct column
whose name is chosen so that it clashes with none. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import binaries, unused, utf8, word_slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
_SPACE_OR_TAIL = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
#: Above this many bytes the windows of a text are counted as numbers in numpy, which takes less memory; the counts are the same.
LONG_TEXT = 1 << 23


def _repeat_words(windows: list) -> int:
    """Words in windows of three that occur twice or more."""
    if len(set(windows)) == len(windows):
        return 0
    many = Counter(windows)
    n, upto = 0, 0
    for i, w in enumerate(windows):
        if many[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def _repeat_words_long(text: bytes) -> int:
    """The same, over the numbers of words, pairs and windows."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    h = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in word_slices(text)]])
    if len(h) < 3:
        return 0
    pairs = np.unique(h[:-1] * len(number) + h[1:], return_inverse=True)[1]
    _, back, many = np.unique(pairs[:-1] * len(number) + h[2:], return_inverse=True, return_counts=True)
    hit = many[back] > 1
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : len(h) - 2 + k] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text."""
    if len(text) > LONG_TEXT:
        n, repeats = sum(map(len, word_slices(text))), _repeat_words_long(text)
    else:
        words = text.split()
        n, repeats = len(words), _repeat_words(list(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    size = len(text)
    upper = size - len(text.translate(None, _UPPER))
    return (
        n,
        len(text.translate(None, _SPACE_OR_TAIL)),
        size - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        upper,
        upper + size - len(text.translate(None, _LOWER)),
    )


def _measures(text: pa.Array) -> pa.Array:
    rows = [measure(x) for x in binaries(text)]
    columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measured(docs: DataFrame, text_col: str = "text", out: str = "measures") -> tuple[DataFrame, str]:
    """docs with one more column, a struct of MEASURES; and that column's name."""
    out = unused(docs, out)
    udf = F.arrow_udf(_measures, ", ".join(f"{m} bigint" for m in MEASURES)).asNondeterministic()
    return docs.withColumn(out, udf(utf8(text_col))), out


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: Position in this tuple is the rule's bit for ever; new rules are appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("upper_case", "100 * n_upper > 50 * n_letters"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """Rejects a document with more than ``tolerated`` failures among the rules of ``mask``, or any among BASE."""

    version: int
    mask: int
    tolerated: int = 0


POLICIES = {1: Policy(1, 0b000111), 2: Policy(2, 0b111111)}
CURRENT = POLICIES[2]


def fail_bits(measures: str) -> Column:
    """The failure bits of a struct column of measurements."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES):
        with_struct = rule.fails
        for m in MEASURES:
            with_struct = with_struct.replace(m, f"`{measures}`.{m}")
        bits = bits.bitwiseOR(F.when(F.expr(with_struct), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def verdict(bits: Column, policy: Policy = CURRENT) -> Column:
    """True for a document that the policy keeps."""
    masked = F.bit_count(bits.bitwiseAND(F.lit(policy.mask)))
    return (bits.bitwiseAND(F.lit(BASE)) == 0) & (masked <= policy.tolerated)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """One row per document: id, measurements, fail_bits, policy_version, base_failed, kept."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    df, m = measured(bare)
    df = df.select("doc_id", m, fail_bits(m).alias("fail_bits"))
    return df.select(
        "doc_id",
        f"{m}.*",
        "fail_bits",
        F.lit(policy.version).alias("policy_version"),
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        verdict(F.col("fail_bits"), policy).alias("kept"),
    )


def ablation(ledger_rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, fail it alone, and would be kept without it."""
    bits = F.col("fail_bits")
    by_bits = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))  # at most 2^rules rows
    parts = []
    for i, rule in enumerate(RULES):
        if policy.mask >> i & 1:
            without = Policy(policy.version, policy.mask & ~(1 << i), policy.tolerated)
            others = bits.bitwiseAND(F.lit(policy.mask & ~(1 << i)))
            hit = bits.bitwiseAND(F.lit(1 << i)) != 0
            freed = ~verdict(bits, policy) & (others.bitwiseAND(F.lit(BASE)) == 0) & (F.bit_count(others) <= without.tolerated)
            parts.append(F.struct(F.lit(rule.name).alias("rule"), hit.alias("hit"), (hit & (others == 0)).alias("alone"), freed.alias("freed")))
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return by_bits.select("n", F.inline(F.array(*parts))).groupBy("rule").agg(total("hit").alias("n_failed"), total("alone").alias("n_alone"), total("freed").alias("n_kept_without"))


def kept_documents(docs: DataFrame, text_col: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with their columns as they are."""
    df, m = measured(docs, text_col)
    return df.filter(verdict(fail_bits(m), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, n_upper, n_letters
  FROM base b LEFT JOIN cover ON b.doc_id IS NOT DISTINCT FROM cover.doc_id),
f AS (
  SELECT *, CAST(""" + " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES)) + rf""" AS BIGINT) AS fail_bits FROM m)
SELECT *, {CURRENT.version} AS policy_version, fail_bits & {BASE} <> 0 AS base_failed,
  fail_bits & {BASE} = 0 AND bit_count(fail_bits & {CURRENT.mask}) <= {CURRENT.tolerated} AS kept
FROM f"""
