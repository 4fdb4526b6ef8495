"""Keep-first, top-n and deterministic samples that do not gather a hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake.operators.timeline import ranked
from feedwake.storage import write_table

GROUPS = 64  # of tasks, whose smallest hashes are taken first
SLICES = (3, 7)  # leading hash digits: 4,096 slices of a stratum, then 65,536 of the slice in which its quota ends


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``. A minimum combines before the shuffle, unlike a row number."""
    rest = [c for c in df.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row tables side by side."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key with their rank; Spark trims each group to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def sequence_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1..n within each key over all rows, cut by range so that a large key is numbered in parallel."""
    return ranked(df, keys, order, name)


def smallest(df: DataFrame, strata: Sequence[str], order: Sequence[str], k: int | Column) -> DataFrame:
    """Rows that can be among the ``k`` first of their stratum: the ``k`` first of each group of tasks."""
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    window = Window.partitionBy(*strata, "_group").orderBy(*order)
    found = df.withColumn("_group", group).withColumn("_place", F.row_number().over(window))
    return found.where(F.col("_place") <= k).drop("_group", "_place")


def stable_sample(df: DataFrame, strata: Sequence[str], log_key: Column, salt: Column | str, quota: Column | int,
                  ties: Sequence[str]) -> DataFrame:
    """The ``quota`` rows of each stratum with the smallest sha256(salt|key).

    The source is read once: every group of tasks keeps its ``quota`` smallest hashes of a stratum, as none of the others can be drawn
    (a fixed quota trims each task before the shuffle), and what they keep is written. Rows of that are counted per slice of the
    hash range. Slices that the quota cannot reach are dropped, the slices it covers are kept whole, and the slice in which it ends is cut
    again; what is left to rank is one part in 268 million of a stratum.
    """
    salted = F.concat(salt if isinstance(salt, Column) else F.lit(salt), F.lit("|"), log_key)
    wanted = quota if isinstance(quota, Column) else F.lit(quota)
    pool = df.withColumn("_hash", F.sha2(salted, 256)).withColumn("_quota", wanted.cast("long"))
    hashed = write_table(smallest(pool, strata, ["_hash", *ties], quota if isinstance(quota, int) else F.col("_quota")))
    earlier = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    helpers = ["_hash", "_quota", "_slice", "_n", "_before"]
    edge, parts = hashed, []
    for digits in SLICES:
        edge = edge.withColumn("_slice", F.substring("_hash", 1, digits))
        sizes = edge.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        placed = edge.join(sizes, [*strata, "_slice"]).where(F.col("_before") < F.col("_quota"))
        reached = F.col("_before") + F.col("_n") <= F.col("_quota")
        parts.append(placed.where(reached).drop(*helpers))
        left = (F.col("_quota") - F.col("_before")).alias("_quota")
        edge = placed.where(~reached).select(*[c for c in placed.columns if c not in ("_quota", "_n", "_before", "_slice")], left)
    inside = Window.partitionBy(*strata).orderBy("_hash", *ties)
    edge = edge.withColumn("_at", F.row_number().over(inside)).where(F.col("_at") <= F.col("_quota"))
    kept = edge.drop("_at", "_hash", "_quota")
    for part in parts:
        kept = kept.unionByName(part)
    return kept
