import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.llm import pii as p
from claimloom.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        s = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end(), m.group()) for k, r in BASE.items() for m in re.finditer(r, text or "") if passes(k, m.group())]


L = r"[^\W\d_]"
TERM = re.compile(rf"(?<![\w@.%+-]){L}{{3,}}(?![\w@%+-])(?!\.[A-Za-z0-9])")


def entity(kind, v):
    return kind, v.lower() if kind == "email" else v if kind == "ip" else re.sub("[^0-9]", "", v)


def brute(docs):
    """[spans string] by plain loops over all documents, every identifier by itself, terms of whole documents."""
    base = [base_spans(t) for t in docs]
    held = [{entity(k, v) for k, _, _, v in b} for b in base]
    terms = [{m.group().lower() for m in TERM.finditer(t or "")} for t in docs]
    n_e, n_t, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for es, ws in zip(held, terms):
        for w in ws:
            n_t[w] += 1
        for e in es:
            n_e[e] += 1
            for w in ws:
                both[e, w] += 1
    out = []
    for t, b, es, ws in zip(docs, base, held, terms):
        best = {}
        for e in es:
            ic = math.log2(len(docs) / n_e[e])
            for w in ws if ic else ():
                best[w] = max(best.get(w, 0), (ic + math.log2(both[e, w] / n_t[w])) / ic)
        added = [("general" if best[m.group().lower()] < 0.9 else "remove", m.start(), m.end()) for m in TERM.finditer(t or "") if best.get(m.group().lower(), 0) >= 0.75]
        order = {k: i for i, k in enumerate(p.KINDS)}
        every = sorted([x[:3] for x in b] + added, key=lambda x: (order[x[0]], x[1]))
        out.append(",".join(":".join(map(str, x)) for x in every))
    return out


def test_query_against_loops(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op10_information_theoretic_pii"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for (d, text), want in zip(docs, brute([t for _, t in docs])):
        found = base_spans(text)
        r = rows[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in found) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found).encode()).hexdigest()
        assert r.spans == want


def planted():
    docs = [f"Nice day {i} said amber falcon near a.b@mail.example.com under quiet bridge tonight number {i}" for i in range(8)]
    docs += [f"ordinary words about quiet rivers and the bridge {i}" for i in range(60)] + [None, "", "no one"]
    return docs


def test_disclosing_terms(spark):
    docs = planted()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = [r.spans for r in p.spans(df).orderBy("doc_id").collect()]
    assert got == brute(docs) and "remove" in got[0] and not any(got[8:])
    clean = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert "[EMAIL]" in clean[0] and "falcon" not in clean[0] and clean[10] == docs[10] and clean[68] is None


CHARS = st.text(alphabet="a1.2@+- ()5é🙂%_\n", max_size=40)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(CHARS, CHARS.map(lambda x: f"{x}4111-1111 1111 1111{x}+1 (415) 555-2671{x}a@b.c{x}1.2.3.4.5")), min_size=30, max_size=60))
def test_base_of_any_text(spark, texts):
    names = {k: k for k in p.BASE}
    df = p.identified(spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1), "text", names)
    for r in df.collect():
        assert [(k, x.start, x.end, x.value) for k in p.BASE for x in r[k]] == base_spans(texts[r.id])


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "+" * 100_000, "a." * 20_000 + "@b", "a@b" + ".c" * 100_000, "x@y.zz " * 20_000, "+1(" * 50_000])
def test_long_texts(spark, text):
    got = p.identified(spark.createDataFrame([(text,)], "text string"), "text", {k: k for k in p.BASE}).first()
    assert [(k, x.start, x.end) for k in p.BASE for x in got[k]][:5000] == [x[:3] for x in (base_spans(text) if len(set(text)) > 2 or "@" in text else [])][:5000]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "mail me: x@y.zz now", 1), (2, "mail me: x@y.zz now", 2), (2, "mail me: x@y.zz now", 2)], "doc_id bigint, text string, key int")
    rows = p.spans(docs).collect()
    assert sorted(r.spans for r in rows) == ["", *["email:9:15,remove:0:4,remove:16:19"] * 3]
    clean = p.sanitised(docs)
    assert clean.columns == docs.columns and sorted(str(r.text) for r in clean.collect()) == [*[" me: [EMAIL] "] * 3, "None"]
    assert p.spans(docs.limit(0)).count() == 0 and p.sanitised(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    df = p.spans(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_luhn(spark):
    got = spark.createDataFrame([("4111111111111111",), ("4111111111111112",)], "d string").select(p.luhn(F.col("d")).alias("x")).collect()
    assert [r.x for r in got] == [True, False]
