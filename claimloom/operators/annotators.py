"""Services behind one interface: annotators, encoders, recognisers, knowledge-base fetchers.

An annotator turns a text into an answer string. It is made once per task by a factory, so a model is
loaded once per worker and never pickled. A failing call gives an empty answer and an error, not a
failed job. The defaults are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Annotator(Protocol):
    def annotate(self, text: str) -> str: ...


class QuoteAnnotator:
    """A rule in place of a model: quoted passages with the words before ``said`` or a colon as their agent."""

    PATTERN = re.compile(r"(?P<agent>[A-Z][\w.-]*(?: [A-Z][\w.-]*){0,3})(?: said)?[:,]? [\"“](?P<text>[^\"”]{3,})[\"”]")

    def __init__(self, agent_type: str = "person"):
        self.agent_type = agent_type

    def annotate(self, text: str) -> str:
        claims = [{"agent_name": m["agent"], "agent_description": "", "agent_type": self.agent_type, "utterance_type": "direct", "utterance_text": m["text"], "source_context": m[0]} for m in self.PATTERN.finditer(text)]
        return json.dumps({"results": claims}, ensure_ascii=False)


def retried(call: Callable[[], str], accept: Callable[[str], bool], attempts: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(answer, attempts made, last error): calls until an answer is accepted, pausing between tries."""
    error = None
    for n in range(1, attempts + 1):
        try:
            answer = call()
            if accept(answer):
                return answer, n, None
            error = "refused"
        except Exception as e:  # noqa: BLE001 - a failing service must not fail the job
            error = f"{type(e).__name__}: {e}"
        if n < attempts and pause:
            sleep(pause)
    return None, attempts, error


def backoff(call: Callable[[], tuple[int, dict, str]], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """A service's body: 429 waits as long as it says, 5xx and network errors wait 1, 2, 4, ... seconds; other failures give None."""
    for n in range(attempts):
        try:
            status, headers, body = call()
        except OSError:
            sleep(2**n)
            continue
        if status == 200:
            return body
        if status == 429:
            sleep(float(headers.get("Retry-After", 2**n)))
        elif status >= 500:
            sleep(2**n)
        else:
            return None
    return None


_ANSWERS = "annotator string, answer string, attempts int, error string, refused string"


def annotated(texts: DataFrame, factories: dict[str, Callable[[], Annotator]], id_col: str = "article_id", text_col: str = "text", attempts: int = 3, pause: float = 0.0, accept: Callable[[str], bool] = bool) -> DataFrame:
    """(id, annotator, answer, attempts, error, refused): every text by every annotator; a failing one gives null and its error.

    ``refused`` is the last answer where none was accepted. A null text has no answer and takes one attempt, which calls nobody.
    Texts are fanned out to annotators by a small array, so each call may run in another task.
    """
    kind = dict(texts.dtypes)[id_col]
    wide = texts.select(id_col, text_col, F.explode(F.array(*[F.lit(n) for n in factories])).alias("annotator"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Annotator] = {}
        for b in batches:
            names = b.column("annotator").to_pylist()
            out = []
            for text, name in zip(b.column(text_col).to_pylist(), names):
                if text is None:
                    out.append((None, 1, "no text", None))
                    continue
                if name not in made:
                    made[name] = factories[name]()
                last: list[str] = []

                def call(text=text, made=made[name], last=last) -> str:
                    last.clear()
                    last.append(made.annotate(text))
                    return last[0]

                answer, tries, error = retried(call, accept, attempts, pause)
                out.append((answer, tries, error, last[0] if error == "refused" and last else None))
            answer, tries, error, refused = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(names, pa.string()), pa.array(answer, pa.string()), pa.array(tries, pa.int32()), pa.array(error, pa.string()), pa.array(refused, pa.string())], names=[id_col, "annotator", "answer", "attempts", "error", "refused"])

    return wide.mapInArrow(run, f"{id_col} {kind}, {_ANSWERS}")


def hashing_encoder(dimensions: int = 64) -> Callable[[Column], Column]:
    """A vectorised UDF: unit vectors of hashed words, the same everywhere; a text without words gives zeros.

    A word's MD5 says its dimension (first four bytes, little-endian) and its sign (odd fifth byte: plus). Words
    are those between ASCII white space, with A-Z in lower case; each distinct word of a batch is hashed once.
    """

    def batch(text: pa.Array) -> pa.Array:
        rows = [x.lower().split() for x in pc.fill_null(text.cast(pa.binary()), b"").to_pylist()]
        place: defaultdict[bytes, int] = defaultdict(count().__next__)
        at = np.fromiter((place[w] for r in rows for w in r), np.int64, sum(map(len, rows)))
        digests = np.frombuffer(b"".join(hashlib.md5(w).digest() for w in place), np.uint8).reshape(-1, 16)
        where = (np.ascontiguousarray(digests[:, :4]).view("<u4")[:, 0] % dimensions).astype(np.int64)
        sign = np.where(digests[:, 4] & 1, 1.0, -1.0)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        v = np.bincount(owner * dimensions + where[at], sign[at], len(rows) * dimensions).reshape(-1, dimensions)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimensions), pa.array(v.astype(np.float32).ravel()))

    return F.arrow_udf(batch, "array<float>")


_TITLES = r"(?i)^(?:(?:mr|mrs|ms|dr|prof|president|minister|senator|sir|lord|lady|pm|mp)\.?\s+)+"
_COMPANY = r"(?i)\b(?:inc|ltd|llc|corp|plc|gmbh|university|council|party|agency|union|institute|ministry|office|group|committee)\b"


def ner(name: Column | str, kind: Column | str) -> Column:
    """The named entity in an agent's name, by rules: titles and what follows a comma or bracket go; null where the kind doesn't fit."""
    name, kind = (F.col(c) if isinstance(c, str) else c for c in (name, kind))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_extract(name, r"^[^,(]*", 0)), _TITLES, ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))
    company = bare.rlike(_COMPANY)
    fits = F.when(F.lower(kind) == "organization", company).when(F.lower(kind) == "person", ~company)
    return F.when(fits & (F.size(words) > 0), F.array_join(words, " "))
