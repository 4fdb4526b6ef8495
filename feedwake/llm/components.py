"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.storage import write_table


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for all nodes of edges (``u``, ``v``), both long.

    Large star: a node hands its larger neighbours to the smallest one. Small star: it hands its smaller ones and itself to the
    smallest. Both keep the components, and repeated in turn they end in stars after a number of rounds that grows with the
    logarithm of the nodes. Minima combine before the shuffle, so a node with very many neighbours is no hot group, and each
    round is written to the shared folder, so lineage stays short.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low"))

    def large(pairs: DataFrame) -> DataFrame:
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        low = smallest(both).select(F.col("u"), F.least("u", "low").alias("low"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()

    def small(pairs: DataFrame) -> DataFrame:
        low = smallest(pairs)
        moved = pairs.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        return moved.union(low.select("u", F.col("low").alias("v"))).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    pairs = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(pairs)
    while seen[0]:
        pairs = write_table(small(large(pairs)))
        now = state(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
