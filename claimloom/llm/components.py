"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a combinable minimum per node and one join back, so a hub costs no task more than
its share; the links are written to the shared folder after each round. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import dropped, stored, workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the node's smallest neighbour (or itself)."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node of a link, the smallest node reachable from it.

    Self-links and repeated links do no harm; a link with a null end is ignored; no links, no rows.
    """
    spark = links.sparkSession
    now = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    folder = workspace(spark)
    now = stored(now.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), folder)
    before = _sum(now)
    while before[0]:
        to = workspace(spark)
        now = stored(_small_star(_large_star(now)), to)
        dropped(spark, folder)
        folder, after = to, _sum(now)
        if after == before:
            break
        before = after
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    return rooted.union(roots.select("node", F.col("node").alias("component")))
