from claimloom.llm import pii as p


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")


ORDINARY = [f"ordinary words about quiet rivers and the bridge {i}" for i in range(60)]


def test_an_identifier_of_one_text_is_disclosed(spark):
    df = frame(spark, ["the words of falcon at a.b@mail.example.com and the rivers", *ORDINARY])
    rows = p.spans(df).orderBy("doc_id").collect()
    assert rows[0].spans == "email:23:43,remove:13:19" and [rows[0].n_general, rows[0].n_remove] == [0, 1]
    assert not any(r.spans for r in rows[1:])
    clean = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert clean[0] == "the words of  at [EMAIL] and the rivers" and clean[1] == ORDINARY[0]


def test_terms_far_from_the_identifier_are_marked_everywhere(spark):
    far = "the words about quiet rivers and the bridge " * 4
    df = frame(spark, [f"falcon {far}a.b@mail.example.com {far}Falcon said so"] * 2 + [f"falcon {far}a.b@mail.example.com"] + ORDINARY)
    rows = p.spans(df).orderBy("doc_id").collect()
    first = len(f"falcon {far}")
    again = first + len(f"a.b@mail.example.com {far}")
    assert rows[0].spans == rows[1].spans
    spans = rows[0].spans.split(",")
    assert "remove:0:6" in spans and f"remove:{again}:{again + 6}" in spans and "remove:0:6" in rows[2].spans.split(",")
    clean = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert not any("falcon" in clean[i].lower() for i in range(3)) and "rivers" in clean[0]


def brute(docs):
    """{row: {(start, end, kind)}} of added spans, every identifier by itself."""
    import math
    import re

    from tests.llm.test_pii import TERM, base_spans

    value = lambda k, v: (k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))
    held = [{value(k, v) for k, _, _, v in base_spans(t)} for t in docs]
    terms = [{m.group().lower() for m in TERM.finditer(t or "")} for t in docs]
    out = []
    for t, es, ws in zip(docs, held, terms):
        kinds = {}
        for e in es:
            n_e = sum(e in x for x in held)
            ic = math.log2(len(docs) / n_e)
            for w in ws if ic else ():
                n_t, both = sum(w in x for x in terms), sum(e in x and w in y for x, y in zip(held, terms))
                kinds[w] = max(kinds.get(w, 0), (ic + math.log2(both / n_t)) / ic)
        out.append(sorted((m.start(), m.end(), "remove" if kinds[m.group().lower()] >= 0.9 else "general") for m in TERM.finditer(t or "") if kinds.get(m.group().lower(), 0) >= 0.75))
    return out


def test_against_loops(spark, sf):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    docs += [f"Ask {n} at {n}@ex.org or +1 (415) 555-26{i % 3}1 about amber {i}" for i in range(12) for n in ("kim", "lee")]
    rows = p.spans(frame(spark, docs)).orderBy("doc_id").collect()
    for r, want in zip(rows, brute(docs)):
        got = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k in ("general", "remove"))
        assert got == want
