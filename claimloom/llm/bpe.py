"""Byte-level BPE with the tokenizers library over Arrow batches, and the way back to bytes.

A tokenizer is built from a rank file: every byte gets a printable character (the byte table), each
token is spelt in those characters, and each way to join two tokens into a third is a merge with the
third's rank. Splitting by the pattern, then merging by rank, gives what rank-based encoders give.

Texts are cut at single spaces between two characters that aren't white space, which no match of the
pattern crosses; equal fragments of a batch are encoded once, and the first REMEMBERED ones are kept.
Decoding looks up each token's bytes through the reversed byte table; a character that is split over
tokens comes out whole, as bytes are joined before they are read as UTF-8, and ``decode_stream``
holds back an unfinished character until its last byte.

Defined cases: a null text is encoded as an empty one, without tokens. Strings of special tokens
are ordinary text in rank files. Ids outside the table raise KeyError. A very long text is encoded whole, fragment by
fragment, so its tokens don't depend on its neighbours in a batch. Merges of equal rank go from the left. Repeated rows,
null ids and further columns are kept; added columns get names that clash with none. No rows give no rows.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import binaries, unused, utf8

MULTI = "byte_bpe_multi_50k.tiktoken"
#: Fragments that an encoder remembers, and the longest of them.
REMEMBERED, LONGEST = 700_000, 48
#: Characters of text encoded at a time.
_AT_ONCE = 1 << 21


@functools.cache
def byte_table() -> dict[int, str]:
    """byte -> character: printable Latin-1 stands for itself, the rest for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def reversed_byte_table() -> dict[str, int]:
    return {c: b for b, c in byte_table().items()}


def spelt(token: bytes) -> str:
    table = byte_table()
    return "".join(table[b] for b in token)


def unspelt(token: str) -> bytes:
    table = reversed_byte_table()
    return bytes(table[c] for c in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def from_ranks(path: str, pattern: str = public_tokenizers.PATTERN):
    """A tokenizers.Tokenizer that follows a rank file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((spelt(token[:i]), spelt(token[i:])))
    built = Tokenizer(models.BPE(vocab={spelt(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    built.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return built


@functools.cache
def from_json(path: str):
    """A tokenizers.Tokenizer from its own file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, fragment by fragment."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self._lengths = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
        for spelling, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self._lengths[i] = len(spelling)  # a character for each byte
        for i, added in tokenizer.get_added_tokens_decoder().items():
            self._lengths[i] = len(added.content.encode())
        # remembered fragments: where each one's ids are in one array
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _fragments(self, fragments: list[str], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of fragments with a space before each, and the number of each one's ids: encoded together, then cut where their bytes end."""
        for i in range(0, len(fragments), 2048):
            (ids,) = self._encode([f" {' '.join(fragments[i : i + 2048])}"])
            ends = np.cumsum(self._lengths[ids])
            own = np.cumsum(1 + sizes[i : i + 2048])
            cuts = np.searchsorted(ends, own)
            if not np.array_equal(ends[cuts], own):
                raise ValueError("a token spans two fragments")
            yield ids, np.diff(cuts, prepend=-1)

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Fragments again, joined wherever a space is not single or stands beside white space."""
        out, now = [], parts[0]
        for p in parts[1:]:
            if now and p and not now[-1].isspace() and not p[0].isspace():
                out.append(now)
                now = p
            else:
                now = f"{now} {p}"
        out.append(now)
        return out

    def _resolved(self, flat: pa.Array, cuts: np.ndarray) -> list[bytes]:
        """The ids of each text, given the fragments of all texts in a row and where each text's begin."""
        coded = flat.dictionary_encode()
        own, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        names, get = own.to_pylist(), self.known.get
        at = np.fromiter((get(x, -1) for x in names), np.int64, len(names))
        loose = pc.not_equal(pc.utf8_rtrim_whitespace(own), own).to_numpy(zero_copy_only=False)  # the last of texts that end in white space
        joint, single = np.flatnonzero((at < 0) & ~loose), np.flatnonzero((at < 0) & loose)
        length = pc.binary_length(own).to_numpy(zero_copy_only=False)
        fresh_names = [names[i] for i in joint.tolist()]
        new = [*self._fragments(fresh_names, length[joint])]
        alone = [*self._encode([f" {names[i]}" for i in single.tolist()])]
        heads = [*self._encode(flat.take(pa.array(cuts[:-1])).to_pylist())]
        more = [x for x, _ in new]
        sizes = np.concatenate([*[n for _, n in new], [len(x) for x in alone], [len(x) for x in heads], np.zeros(0, np.int64)]).astype(np.int64)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        table = np.concatenate([self.ids, *more, *alone, *heads])
        start, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        known, fresh = at >= 0, np.append(joint, single)
        start[known], size[known] = self.starts[at[known]], self.sizes[at[known]]
        start[fresh], size[fresh] = starts[: len(fresh)], sizes[: len(fresh)]
        if len(self.known) < REMEMBERED:
            keep = np.flatnonzero(length[joint] <= LONGEST)
            self.known.update(zip((fresh_names[i] for i in keep.tolist()), range(len(self.known), len(self.known) + len(keep))))
            self.starts, self.sizes = np.append(self.starts, starts[keep]), np.append(self.sizes, sizes[keep])
            self.ids = np.concatenate([self.ids, *more])
        s, n = start[index], size[index]
        s[cuts[:-1]], n[cuts[:-1]] = starts[len(fresh) :], sizes[len(fresh) :]
        end = np.append(0, np.cumsum(n))
        out = table[np.arange(end[-1]) + np.repeat(s - end[:-1], n)]
        return [out[a:b].tobytes() for a, b in zip(end[cuts[:-1]], end[cuts[1:]])]

    def _batch(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        cuts, flat = split.offsets.to_numpy().astype(np.int64), split.values
        trimmed = pc.utf8_trim_whitespace(flat)
        odd = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.not_equal(trimmed, flat)).to_numpy(zero_copy_only=False)
        rare = np.add.reduceat(odd, cuts[:-1], dtype=np.int64) > 0
        if not rare.any():
            return self._resolved(flat, cuts)
        out: list[bytes] = [b""] * len(texts)
        plain, rest = np.flatnonzero(~rare), np.flatnonzero(rare)
        if len(plain):
            own = split.take(pa.array(plain))
            for i, ids in zip(plain, self._resolved(own.flatten(), np.append(0, np.cumsum(np.diff(cuts)[plain])))):
                out[i] = ids
        joined = [self._joined(texts[i].split(" ")) for i in rest]
        for i, ids in zip(rest, self._resolved(pa.array(chain.from_iterable(joined), pa.large_string()), np.append(0, np.cumsum([len(j) for j in joined])))):
            out[i] = ids
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= _AT_ONCE:
                yield from self._batch(batch)
                batch, size = [], 0
        if batch:
            yield from self._batch(batch)


@functools.cache
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    return Encoder(from_json(path) if path.endswith(".json") else from_ranks(path, pattern))


@functools.cache
def token_bytes(path: str) -> tuple[bytes, ...]:
    """Each id's bytes, by id, through the reversed byte table."""
    spellings = from_ranks(path).get_vocab()
    table = [b""] * (max(spellings.values()) + 1)
    for s, i in spellings.items():
        table[i] = unspelt(s)
    return tuple(table)


def decode(ids: bytes, path: str) -> bytes:
    """The bytes that ids (little-endian unsigned 32-bit) stand for."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_stream(ids: Iterable[int], path: str) -> Iterator[str]:
    """Text token by token; a token that ends inside a character gives what is whole so far. Broken bytes become U+FFFD."""
    table, unfinished = token_bytes(path), codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield unfinished.decode(table[i])
    yield unfinished.decode(b"", final=True)


def offsets(ids: bytes, path: str) -> np.ndarray:
    """(tokens, 2) code-point offsets, end exclusive; tokens that share a split character both cover it."""
    table = token_bytes(path)
    pieces = [table[i] for i in np.frombuffer(ids, "<u4").tolist()]
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    at = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.append(0, ends[:-1])
    return np.stack([at[starts], at[ends - 1] + 1], axis=1) if len(pieces) else np.zeros((0, 2), int)


def _split_characters(ids: bytes, path: str) -> int:
    """Tokens that start inside a character."""
    return sum(map(_inner(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _inner(path: str) -> tuple[bool, ...]:
    return tuple(len(t) > 0 and t[0] & 0xC0 == 0x80 for t in token_bytes(path))


def encoded(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> tuple[DataFrame, str]:
    """docs with the ids of a text, a binary column of little-endian unsigned 32-bit integers; and its name."""
    out = unused(docs, out)

    def ids(text: pa.Array) -> pa.Array:
        return pa.array(list(encoder(path).encode(x.decode("utf-8", "replace") for x in binaries(text))), pa.binary())

    return docs.withColumn(out, F.arrow_udf(ids, "binary").asNondeterministic()(utf8(text_col))), out


def decoded(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> tuple[DataFrame, str]:
    """df with the decoded bytes of an ids column; and that column's name."""
    out = unused(df, out)

    def text(ids: pa.Array) -> pa.Array:
        return pa.array([decode(x, path) for x in binaries(ids)], pa.binary())

    return df.withColumn(out, F.arrow_udf(text, "binary").asNondeterministic()(F.col(ids_col))), out


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that start inside a character).

    Encoding and decoding run in one pass over a batch; only the digests leave it.
    """

    def digests(text: pa.Array) -> pa.Array:
        rows = []
        for ids in encoder(path).encode(x.decode("utf-8", "replace") for x in binaries(text)):
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest(), _split_characters(ids, path)))
        a, b, c, d = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=["n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    udf = F.arrow_udf(digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint").asNondeterministic()
    return docs.select(F.col(id_col).alias("doc_id"), udf(utf8(text_col)).alias("d")).select("doc_id", "d.*")


def default_path() -> str:
    return public_tokenizers.path(MULTI)
