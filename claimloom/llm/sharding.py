"""Shards by balanced label propagation: copies move together, shard sizes stay equal.

Built from DataFrame and SQL functions only. Documents with equal texts are linked. The law is
``rows``: the shards' counts differ by one at most.

The state is a table of cells: how many documents of a linked group lie in each shard (documents
of a group are interchangeable, so a group of any size has at most one row per shard). Documents
start where a hash of their id puts them. In each round

* every group picks as targets its fullest shards with room, as many as its documents outside full shards need;
* its other cells ask to move there; requests are granted, small ones first, while the target has
  room, by sums before each request taken over chunks; a granted part of a cell moves.

Rounds end when nothing moves. They do end: a part only moves to a cell of its group that is at least as large, so
the sum of the squares of all cells grows with every grant. Shards over their quota then give up what is over it, and that and
all unlinked documents fill the shards to their quotas exactly. Cells are written to the shared
folder after each round; the driver sees one number per shard.

A document's slot is its cell's first slot plus its rank in the cell. Ranks of a large group are taken
over salted parts, so no task holds a group; the groups that hold more than a WIDEST-th of all documents, fewer than
WIDEST of them, are broadcast to their documents. Sums before a row go over chunks of rows, and over blocks of
chunks where there are many, so no task sorts more than a chunk or a block. Equal input gives equal shards whatever
the partitioning.

Defined cases: a null text counts as an empty one. Rows with equal id and text are interchangeable.
Null ids share a start and are ranked first. A very long text is hashed and counted, never moved. Requests of
equal size go by hash and key. Further columns aren't read, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import dropped, stored, workspace

SHARDS = 24
KEY = ["hash", "text_crc32", "size"]
#: Rows of a group that are ranked together.
PART = 512
#: Groups that hold more than one row in WIDEST are broadcast.
WIDEST = 1024
_CHUNK_ROWS = 4096
#: Chunks whose sums are added up together.
_CHUNKS_AT_ONCE = 4096


def _pick(values: list[int], i: Column) -> Column:
    """values[i] for a small list held as a literal."""
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (i + 1).cast("int"))


def before(df: DataFrame, part: list[str], chunk: Column, chunks: int, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of ``value`` before each row, within ``part``, in order of chunk (0 to ``chunks`` - 1) and then of ``order``.

    Sums go over blocks of chunks first where there are many chunks, then over chunks, then over the rows of a chunk.
    """
    df = df.withColumn("_chunk", chunk)
    key = [*part, "_chunk"]
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*key).agg(F.sum(value).alias("_sum"))
    if chunks > _CHUNKS_AT_ONCE:
        sums = sums.withColumn("_block", F.floor(F.col("_chunk") / _CHUNKS_AT_ONCE))
        blocks = sums.groupBy(*part, "_block").agg(F.sum("_sum").alias("_all"))
        blocks = blocks.withColumn("_over", F.sum("_all").over(upto(*part).orderBy("_block")) - F.col("_all")).drop("_all")
        sums = sums.withColumn("_within", F.sum("_sum").over(upto(*part, "_block").orderBy("_chunk")) - F.col("_sum"))
        sums = sums.join(blocks, [*part, "_block"]).select(*key, (F.col("_over") + F.col("_within")).alias("_base"))
    else:
        sums = sums.withColumn("_base", F.sum("_sum").over(upto(*part).orderBy("_chunk")) - F.col("_sum")).drop("_sum")
    return df.join(sums, key).withColumn(out, F.col("_base") + F.sum(value).over(upto(*key).orderBy(*order)) - F.col(value)).drop("_chunk", "_base")


def _n_chunks(rows: int) -> int:
    return max(1, -(-rows // _CHUNK_ROWS))


def _chunks(rows: int) -> Column:
    return F.pmod(F.xxhash64(*KEY, F.lit(3)), F.lit(_n_chunks(rows)))


def _requests(cells: DataFrame, full: list[int], quota: int) -> DataFrame:
    """(KEY, shard, to, n): cells that ask for another shard of their group."""
    found = F.struct(_pick(full, F.col("shard")).alias("full"), (-F.col("n")).alias("less"), F.xxhash64(*KEY, "shard").alias("tie"), F.col("shard"), F.col("n"))
    groups = cells.groupBy(*KEY).agg(F.array_sort(F.collect_list(found)).alias("c"))  # at most a row per shard
    n_open = F.size(F.filter("c", lambda x: x["full"] == 0))
    movable = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["full"] == 0, x["n"]).otherwise(F.lit(0)))
    groups = groups.withColumn("m", F.least(F.ceil(movable / quota).cast("int"), n_open)).filter("m > 0")

    def ask(x: Column, i: Column) -> Column:
        target = F.get("c", i % F.col("m"))
        return F.struct(x["shard"].alias("shard"), F.when((i >= F.col("m")) & (x["n"] <= target["n"]), target["shard"]).otherwise(x["shard"]).alias("to"), x["n"].alias("n"))

    return groups.select(*KEY, F.inline(F.transform("c", ask))).filter("to <> shard")


def _moved(cells: DataFrame, count: int, loads: list[int], quotas: list[int]) -> DataFrame:
    """The cells after one round; count: of the cells."""
    full = [int(a >= b) for a, b in zip(loads, quotas)]
    asked = _requests(cells, full, max(1, min(quotas)))
    # small requests first, by powers of two
    wide = max(64, _n_chunks(count // len(quotas)))
    chunk = F.floor(F.log2("n")).cast("bigint") * wide + F.pmod(F.xxhash64(*KEY, "shard"), F.lit(wide))
    placed = before(asked, ["to"], chunk, wide * max(1, max(quotas)).bit_length(), [*KEY, "shard"], "n", "ahead")
    room = _pick([max(0, b - a) for a, b in zip(loads, quotas)], F.col("to"))
    granted = placed.withColumn("granted", F.greatest(F.lit(0), F.least("n", room - F.col("ahead")))).filter("granted > 0")
    change = granted.select(*KEY, F.inline(F.array(F.struct(F.col("shard"), (-F.col("granted")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("granted").alias("n")))))
    return cells.select(*KEY, "shard", "n").union(change).groupBy(*KEY, "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def _loads(cells: DataFrame, shards: int) -> list[int]:
    by = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [by.get(s, 0) for s in range(shards)]


def _sum(cells: DataFrame) -> tuple:
    return tuple(cells.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEY, "shard", "n").cast("decimal(20,0)"))).first())


def propagate(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """Cells of linked groups after balanced label propagation, stored."""
    spark, folder = cells.sparkSession, workspace(cells.sparkSession)
    cells = stored(cells, folder)
    state = _sum(cells)
    while state[0]:
        to = workspace(spark)
        new = stored(_moved(cells, state[0], _loads(cells, len(quotas)), quotas), to)
        dropped(spark, folder)
        cells, folder, last, state = new, to, state, _sum(new)
        if state == last:
            break
    return cells


def assigned(slim: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(KEY, shard, n) for all documents of a stored table (doc_id, KEY): counts per shard differ by one at most."""
    total = slim.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")
    first = slim.groupBy(*KEY, start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(first.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("c"), F.sum("n").alias("total")))  # at most a row per shard
    linked = propagate(groups.filter("total > 1").select(*KEY, F.inline("c")), quotas)
    placed = before(linked, ["shard"], _chunks(total // shards), _n_chunks(total // shards), KEY, "n", "ahead")
    placed = stored(placed.withColumn("kept", F.greatest(F.lit(0), F.least("n", _pick(quotas, F.col("shard")) - F.col("ahead")))))
    kept = placed.filter("kept > 0").select(*KEY, "shard", F.col("kept").alias("n"))
    room = [q - n for q, n in zip(quotas, _loads(kept, shards))]
    pool = placed.filter("kept < n").groupBy(*KEY).agg(F.sum(F.col("n") - F.col("kept")).alias("n")).union(groups.filter("total = 1").select(*KEY, F.col("total").alias("n")))
    ends = [sum(room[: i + 1]) for i in range(shards)]
    pool = before(pool.withColumn("all", F.lit(0)), ["all"], _chunks(total), _n_chunks(total), KEY, "n", "ahead")
    spread = F.filter(F.transform(F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(e - r).cast("bigint").alias("a"), F.lit(e).cast("bigint").alias("b")) for i, (e, r) in enumerate(zip(ends, room))]), lambda x: F.struct(x["shard"].alias("shard"), (F.least(x["b"], F.col("ahead") + F.col("n")) - F.greatest(x["a"], F.col("ahead"))).alias("n"))), lambda x: x["n"] > 0)
    dealt = pool.select(*KEY, F.inline(spread))
    return kept.union(dealt).groupBy(*KEY, "shard").agg(F.sum("n").alias("n"))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")))
    total = slim.count()
    cells = before(assigned(slim, shards), ["shard"], _chunks(total // shards), _n_chunks(total // shards), KEY, "n", "first")
    in_order = F.array_sort(F.collect_list(F.struct("shard", "n", "first")))
    groups = stored(cells.groupBy(*KEY).agg(in_order.alias("c"), F.sum("n").alias("total")))  # at most a row per shard
    hot = groups.filter((F.col("total") > PART) & (F.col("total") > F.lit(total // WIDEST)))  # fewer than WIDEST groups
    others = slim.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")
    df = others.join(groups, KEY).unionByName(slim.join(F.broadcast(hot), KEY))
    # dealt anew by part: else the window below would keep the join's partitions, with a whole group in one
    df = df.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil(F.col("total") / PART))).repartition(*KEY, "part")
    parts = df.filter(F.col("total") > PART).groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("base", F.sum("n").over(above) - F.col("n")).drop("n")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY, "part").orderBy(F.col("doc_id").asc_nulls_first())) - 1)
    df = df.join(parts, [*KEY, "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("base", F.lit(0)))
    # the cell whose ranks hold this one: its shard, and how far into the cell
    walk = F.aggregate("c", F.struct(F.col("rank").alias("left"), F.lit(-1).alias("shard"), F.lit(0).cast("bigint").alias("slot")), lambda a, x: F.when(a["shard"] >= 0, a).when(a["left"] < x["n"], F.struct(a["left"], x["shard"].alias("shard"), (x["first"] + a["left"]).alias("slot"))).otherwise(F.struct((a["left"] - x["n"]).alias("left"), a["shard"], a["slot"])))
    df = df.withColumn("at", walk)
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded_rows: DataFrame) -> DataFrame:
    """One row: linked documents, and those that aren't in their group's main shard."""
    cells = sharded_rows.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("text_crc32", "size").agg(F.sum("n").alias("total"), F.max("n").alias("main")).filter("total > 1")
    return groups.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("total") - F.col("main")), F.lit(0)).alias("cut"))
