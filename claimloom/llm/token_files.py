"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of BLOCK ids. A block
keeps its minimum, the others less that minimum packed at the width that holds a percentile of
them, and an exception list of positions and high parts for those that need more. The start of
each block and of each document is indexed, so one document is read without the rest.

    header   magic "PFOR0001", then little-endian unsigned 64-bit: documents, ids, blocks, percentile
    index    document ids (signed 64-bit), which are null (bytes), document starts (documents + 1), block starts (blocks + 1)
    blocks   minimum (4 bytes), width (1), exceptions (1), packed ids (16 x width), positions (1 each), high parts (4 each)
    footer   crc32 of everything before (4 bytes)

``write`` deals documents by ranges of their id (nulls first, ties by a digest of the text, so null and
repeated ids are dealt too), sorts each range, and
writes a file for about IDS_PER_FILE ids with the tokens encoded on the way; files appear under
their final name only when whole, so a task that runs twice does no harm. ``read`` gets the files
back through Spark's binary reader, checks them, and adds each document's start in the whole corpus.

Defined cases: a null text is empty; each document ends with END, so none has no ids. Null ids
come first. Repeated rows are written as often as they come. A very long text is encoded in one piece, in a file that
then holds more than IDS_PER_FILE ids. Further columns aren't read, whatever their names. No documents, no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.bpe import encoder
from claimloom.llm.common import binaries, qualified, stored, utf8, workspace

MAGIC = b"PFOR0001"
BLOCK = 128
PERCENTILE = 90
END = 0
IDS_PER_FILE = 1 << 20
#: Rows of an Arrow batch that are held as Python values at a time.
_ROWS = 512
_BLOCKS_AT_ONCE = 1 << 13
_HEAD = struct.Struct("<8s4Q")


def _packed(rest: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values below 2**width as (blocks, 2 * width) 64-bit words."""
    words = np.zeros((2 * width, len(rest)), np.uint64)
    columns = np.ascontiguousarray(rest.T)
    for half in range(2):
        for i in range(64):
            at, shift = half * width + (i * width >> 6), np.uint64(i * width & 63)
            words[at] |= columns[half * 64 + i] << shift
            if (i * width & 63) + width > 64:
                words[at + 1] |= columns[half * 64 + i] >> np.uint64(64 - (i * width & 63))
    return np.ascontiguousarray(words.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The way back: (blocks, 2 * width) words as (blocks, 128) values."""
    out = np.zeros((BLOCK, len(words)), np.uint64)
    columns, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for half in range(2):
        for i in range(64):
            at, shift = half * width + (i * width >> 6), i * width & 63
            value = columns[at] >> np.uint64(shift)
            if shift + width > 64:
                value = value | columns[at + 1] << np.uint64(64 - shift)
            out[half * 64 + i] = value & mask
    return out.T


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _blocks(ids: np.ndarray, percentile: int) -> list[bytes]:
    """The bytes of each block; a short last block is filled up with its minimum."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    rows = np.append(ids, np.full(short, ids[len(ids) - len(ids) % BLOCK :].min() if short else 0, np.uint32)).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    rest = (rows - least[:, None]).astype(np.uint64)
    need = _widths(rest)
    width = np.sort(need, axis=1)[:, (BLOCK - 1) * percentile // 100]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        over = need[at] > w
        packed = _packed(rest[at] & np.uint64((1 << w) - 1), w) if w else np.zeros((len(at), 0), np.uint64)
        counts = over.sum(axis=1)
        r, c = np.nonzero(over)
        places, high = c.astype(np.uint8).tobytes(), (rest[at][r, c] >> np.uint64(w)).astype("<u4").tobytes()
        ends = np.cumsum(counts).tolist()
        body, size, start = packed.tobytes(), 16 * w, 0
        for k, (i, m, n, e) in enumerate(zip(at.tolist(), least[at].tolist(), counts.tolist(), ends)):
            out[i] = struct.pack("<IBB", m, w, n) + body[k * size : (k + 1) * size] + places[start:e] + high[4 * start : 4 * e]
            start = e
    return out


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One file's bytes: documents with their lengths, and the ids of all of them in order."""
    blocks: list[bytes] = []
    for i in range(0, len(ids), BLOCK * _BLOCKS_AT_ONCE):
        blocks += _blocks(ids[i : i + BLOCK * _BLOCKS_AT_ONCE].astype(np.uint32), percentile)
    starts = np.append(0, np.cumsum(lengths, dtype=np.int64)).astype("<u8")
    at = np.append(0, np.cumsum([len(b) for b in blocks], dtype=np.int64)).astype("<u8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = bytes(d is None for d in doc_ids)
    out = b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), percentile), names.tobytes(), null, starts.tobytes(), at.tobytes(), *blocks])
    return out + struct.pack("<I", zlib.crc32(out))


class Reader:
    """A file's bytes, checked; ids by position or by document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
            raise ValueError("not a whole PFOR0001 file")
        _, docs, self.n_ids, blocks, _ = _HEAD.unpack_from(data)
        at = _HEAD.size
        names = np.frombuffer(data, "<i8", docs, at).tolist()
        null = data[at + 8 * docs : at + 9 * docs]
        self.doc_ids = [None if x else d for d, x in zip(names, null)]
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        at += 9 * docs + 8 * (docs + 1)
        self._at = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64) + at + 8 * (blocks + 1)
        self._bytes = np.frombuffer(data, np.uint8)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end, from their blocks alone."""
        first, last = start // BLOCK, -(-end // BLOCK)
        if end <= start:
            return np.zeros(0, np.uint32)
        parts = [self._read(self._at[b : min(b + _BLOCKS_AT_ONCE, last)]) for b in range(first, last, _BLOCKS_AT_ONCE)]
        return np.concatenate(parts)[start - first * BLOCK : end - first * BLOCK]

    def _read(self, at: np.ndarray) -> np.ndarray:
        raw = self._bytes
        least = np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
        width, n = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.uint64)
        for w in np.unique(width).tolist():
            if w:
                own = np.flatnonzero(width == w)
                out[own] = _unpacked(np.ascontiguousarray(raw[at[own][:, None] + 6 + np.arange(16 * w)]).view("<u8"), w)
        block = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
        positions = at + 6 + 16 * width
        high = raw[((positions + n)[block] + 4 * place)[:, None] + np.arange(4)]
        out[block, raw[positions[block] + place]] |= np.ascontiguousarray(high).view("<u4")[:, 0].astype(np.uint64) << width[block].astype(np.uint64)
        return (out + least[:, None].astype(np.uint64)).astype(np.uint32).ravel()

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(folder: str):
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file that appears under its name only when it is whole."""
    store, base = _filesystem(folder)
    part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
    store.create_dir(base, recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{base}/{name}")


def _writer(folder: str, tokenizer: str, percentile: int, ids_per_file: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        names: list = []
        data: list[bytes] = []
        files: list[tuple] = []

        def flush() -> None:
            ids = np.frombuffer(b"".join(data), "<u4")
            name = f"part-{part:06d}-{len(files):06d}.pfor"
            packed = pack(names, [len(d) // 4 for d in data], ids, percentile)
            _put(folder, name, packed)
            files.append((name, part, len(files), len(names), len(ids), len(packed)))
            names.clear()
            data.clear()

        held = 0
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            for d, ids in zip(b.column(0).to_pylist(), encode(x.decode("utf-8", "replace") for x in binaries(b.column(1)))):
                names.append(d)
                data.append(ids + end)
                held += len(data[-1]) // 4
                if held >= ids_per_file:
                    flush()
                    held = 0
        if names:
            flush()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], names=["name", "part", "seq", "docs", "ids", "bytes"])

    return write


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, percentile: int = PERCENTILE, ids_per_file: int = IDS_PER_FILE, partitions: int | None = None) -> DataFrame:
    """Writes the files into a shared folder. Returns the manifest, a row per file with the ids before it (``base``)."""
    spark, folder = docs.sparkSession, qualified(docs.sparkSession, folder)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("digest"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("digest")
    run = _writer(folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), percentile, ids_per_file)
    files = stored(rows.mapInArrow(run, "name string, part bigint, seq bigint, docs bigint, ids bigint, bytes bigint"), f"{folder}/_manifest")
    # one row per partition, then one per file: neither grows with the documents of a file
    parts = files.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")
    return files.withColumn("inside", inside).join(parts.select("part", "before"), "part").select("name", "docs", "ids", "bytes", (F.col("before") + F.col("inside")).alias("base"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, data in zip(b.column(0).to_pylist(), b.column(1)):
            r = Reader(data.as_py())
            for i in range(0, len(r.doc_ids), 1024):
                j = min(i + 1024, len(r.doc_ids))
                ids = r.ids(int(r.starts[i]), int(r.starts[j])).astype("<u4")
                cuts = (r.starts[i : j + 1] - r.starts[i]).tolist()
                crc = [zlib.crc32(ids[a:c].tobytes()) for a, c in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * (j - i)), pa.array(r.doc_ids[i:j], pa.int64()), pa.array(r.starts[i:j]), pa.array(np.diff(r.starts[i : j + 1])), pa.array(crc, pa.int64())], names=["name", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "part-*.pfor").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(_documents, "name string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(manifest.select("name", "base"), "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Writes docs' token files and reads them back."""
    folder = folder or workspace(docs.sparkSession)
    manifest = stored(write(docs, folder, id_col, text_col, tokenizer, ids_per_file=ids_per_file), f"{folder}/_bases")
    if manifest.limit(1).count() == 0:
        return manifest.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("base").alias("start"), F.col("ids").alias("n_tokens"), F.col("docs").alias("ids_crc32"))
    return read(docs.sparkSession, folder, manifest)
