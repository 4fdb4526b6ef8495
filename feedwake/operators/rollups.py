"""Stored rollups of activity that grow by merging: one row per chain, period and scope class with mergeable sketches.

A period's logs are read once. Distinct transactions and contracts are kept as sketches, so coarser rows (years, all chains) and later
periods come from the stored rows. A sketch of 2 ** ``lg_k`` buckets estimates a distinct count with a standard error of
1.04 / sqrt(2 ** lg_k) of it (0.016 for 12), however the rows were dealt out; small counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
DIMENSIONS = {"txs": "tx_hash", "contracts": "contract_address"}
GRAIN = ["chain", "year", "scope_class", "period"]


def standard_error(lg_k: int = LG_K) -> float:
    """Of an estimate, as a share of the count."""
    return 1.04 / math.sqrt(1 << lg_k)


def period_sketches(logs: DataFrame, rules: DataFrame, period: Column | None = None, lg_k: int = LG_K) -> DataFrame:
    """``logs`` count and sketches ``txs`` and ``contracts`` per chain, year, scope class and ``period`` (default the month, ``yyyy-MM``).

    Sketches combine before the shuffle: a task sends one row for each group, whatever its logs.
    """
    at = F.date_format("block_date", "yyyy-MM") if period is None else period
    scoped = logs.join(rules.where(~F.col("contextual_only")), "topic0").select(
        F.col("blockchain").alias("chain"), F.year("block_date").cast("long").alias("year"), "scope_class", at.alias("period"), *DIMENSIONS.values()
    )
    return scoped.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("logs"), *[F.hll_sketch_agg(column, F.lit(lg_k)).alias(name) for name, column in DIMENSIONS.items()]
    )


def store_periods(sketches: DataFrame, path: str) -> None:
    """Write whole periods; a period that is there is replaced, so a repeated run changes nothing."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def merged(rows: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of stored rows at coarser ``levels`` (grouping sets of chain, year, scope class and period) by merging their sketches."""
    names = [c for c in GRAIN if any(c in level for level in levels)]
    counted = rows.groupingSets([list(level) for level in levels], *names)
    estimates = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"{name}_estimate") for name in DIMENSIONS]
    return counted.agg(F.grouping_id().alias("level"), F.sum("logs").alias("logs"), *estimates)
