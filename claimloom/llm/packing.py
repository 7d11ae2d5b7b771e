"""Best-fit packing of documents into sequences, under conflicts of source and of duplicate cluster.

A document costs its UTF-8 bytes plus one end mark. What exceeds the capacity is cut into full
pieces, each a bin of its own, and a rest. Rests are packed best-fit, largest first: the open bins
lie in order of their residual, each with a bitmap of its sources and one of its duplicate
clusters, and the search goes from the least residual that holds the piece to its successors until
a bin has neither the piece's source nor its cluster; that is the tightest compatible bin. Only
if there is none is a bin opened.

Documents are dealt to packers by hash of their id and text, about PACKER_ROWS each, so each packer
sees a like mix, no packer holds an unbounded group, and the cost is linear in the corpus. A source or
cluster with a third of all rows is dealt evenly like the rest; its pieces just open more bins.

Defined cases: a null text is an empty one and costs the end mark. A very long text fills as many bins as it needs.
Pieces of equal size go in order of id, cluster and source; of bins of equal residual the one opened first is taken. A null source conflicts with
none; a null id packs like any other. Copies share a cluster, so repeated rows fall into
different bins. Further columns do no harm. No documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
PACKER_ROWS = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, numbered from 0 in order of opening; sizes are 1 to capacity."""
    bit_of: dict = {}
    group_of: dict = {}
    bins: list[int] = [-1] * len(sizes)
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        source = 0 if sources[i] is None else 1 << bit_of.setdefault(sources[i], len(bit_of))
        cluster = 0 if clusters[i] is None else 1 << group_of.setdefault(clusters[i], len(group_of))
        at = bisect_left(open_bins, (sizes[i], -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not source_bits[b] & source and not cluster_bits[b] & cluster:
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= source
        cluster_bits[b] |= cluster
        bins[i] = b
        if residual > sizes[i]:
            insort(open_bins, (residual - sizes[i], b))
    return bins


_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, bin bigint, bin_offset bigint, source string, cluster bigint"


def _packer(capacity: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "cluster", "source", "cost")])
        ids, cost, sources, clusters = (table.column(c).to_pylist() for c in ("doc_id", "cost", "source", "cluster"))
        n = len(ids)
        full = [(c - 1) // capacity for c in cost]  # whole pieces before the rest
        rest = [c - f * capacity for c, f in zip(cost, full)]
        bins = best_fit(rest, sources, clusters, capacity)
        count = max(bins, default=-1) + 1
        # full pieces, each a bin of its own after the shared ones
        owner = np.repeat(np.arange(n), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) if n else owner
        filled: dict[int, int] = {}
        offset = []
        for b, size in zip(bins, rest):
            offset.append(filled.get(b, 0))
            filled[b] = offset[-1] + size
        own = np.append(owner, np.arange(n)).astype(np.int64)
        pieces = np.append(piece, full).astype(np.int32)
        starts = pieces.astype(np.int64) * capacity
        lengths = np.append(np.full(len(owner), capacity), rest).astype(np.int64)
        base = int(key[0].as_py()) << 32
        bin_ids = base + np.append(count + np.arange(len(owner)), bins).astype(np.int64)
        offsets = np.append(np.zeros(len(owner)), offset).astype(np.int64)
        take = pa.array(own)
        columns = [table.column("doc_id").take(take), pa.array(pieces), pa.array(starts), pa.array(lengths), pa.array(bin_ids), pa.array(offsets), table.column("source").take(take), table.column("cluster").take(take)]
        return pa.Table.from_arrays(columns, names=["doc_id", "piece", "start", "length", "bin", "bin_offset", "source", "cluster"])

    return pack


def packed(docs: DataFrame, capacity: int = CAPACITY, packer_rows: int = PACKER_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, cost_col: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start and length in the document, bin, bin_offset, source, cluster.

    ``cluster_col`` names a column of duplicate-cluster ids (long); else equal texts form a cluster. ``cost_col``
    names a column of costs (1 or more), in place of the text. Only lengths and hashes of the texts are shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")
    cluster = F.col(cluster_col).cast("bigint") if cluster_col else F.xxhash64(text)
    cost = F.col(cost_col) if cost_col else F.octet_length(text) + F.lit(1)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), cost.cast("bigint").alias("cost"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))
    packers = max(1, -(-docs.count() // packer_rows))
    dealt = rows.withColumn("packer", F.pmod(F.xxhash64("doc_id", "cluster", F.lit(9)), F.lit(packers)))
    return dealt.groupBy("packer").applyInArrow(_packer(capacity), _SCHEMA)


def efficiency(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, pieces, bytes and the share of the bins' room that is filled."""
    return pieces.agg(F.countDistinct("bin").alias("bins"), F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("bytes")).withColumn("filled", F.try_divide(F.col("bytes"), F.col("bins") * F.lit(capacity)))
