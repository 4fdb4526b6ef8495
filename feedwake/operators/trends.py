"""Monthly and cumulative activity of boundary events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.operators.closure import in_chains, in_dates

ALL_CHAINS = "all_active_case_chains"
SCOPE_COLUMNS = {
    "s1_price_reporting_log_count": R.S1, "s2_feed_binding_log_count": R.S2, "s3_route_config_log_count": R.S3,
    "s4_governance_config_log_count": R.S4, "s5_contextual_wiring_log_count": R.S5,
}


def _scoped(logs: DataFrame, rules: DataFrame, chains, start, end) -> DataFrame:
    kept = in_dates(in_chains(logs, chains), start, end).join(rules.where(~F.col("contextual_only")), "topic0")
    return kept.select(
        F.col("blockchain").alias("chain"), F.date_trunc("MONTH", "block_date").cast("date").alias("month"), "scope_class", "tx_hash", "contract_address")


def monthly_trend(logs: DataFrame, rules: DataFrame, chains=None, start=None, end=None, exact: bool = False) -> DataFrame:
    """Logs, transactions and contracts per chain and month, one count per scope, and an all-chains row."""
    rows = _scoped(logs, rules, chains, start, end)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counted = rows.groupingSets([["chain", "month"], ["month"]], "chain", "month").agg(
        F.grouping("chain").alias("_all"), F.count(F.lit(1)).alias("oracle_log_count"), distinct("tx_hash").alias("oracle_tx_count"),
        distinct("contract_address").alias("oracle_contract_count"),
        *[F.count_if(F.col("scope_class") == scope).alias(name) for name, scope in SCOPE_COLUMNS.items()])
    return counted.withColumn("chain", F.when(F.col("_all") == 1, F.lit(ALL_CHAINS)).otherwise(F.col("chain"))).drop("_all")


def trend_summary(monthly: DataFrame) -> DataFrame:
    """Per chain: first, latest and peak month and the slope of logs and contracts per month (one row per month goes in)."""
    place = F.row_number().over(Window.partitionBy("chain").orderBy("month")) - 1
    rows = monthly.withColumn("_x", place.cast("double"))
    slope = lambda c: F.coalesce(F.regr_slope(F.col(c).cast("double"), F.col("_x")), F.lit(0.0))
    return rows.groupBy("chain").agg(
        F.min("month").alias("first_month"), F.max("month").alias("latest_month"),
        F.min_by("month", F.struct(-F.col("oracle_log_count"), F.col("month"))).alias("peak_month"), F.max("oracle_log_count").alias("peak_log_count"),
        slope("oracle_log_count").alias("log_slope"), slope("oracle_contract_count").alias("contract_slope"))


def cumulative_trend(logs: DataFrame, rules: DataFrame, chains=None, start=None, end=None) -> DataFrame:
    """Monthly logs and first-seen contracts with their running totals, per chain and over all chains."""
    rows = _scoped(logs, rules, chains, start, end)
    contracts = rows.groupBy("chain", "contract_address", "month").agg(F.count(F.lit(1)).alias("logs"))
    first = contracts.groupBy("chain", "contract_address").agg(F.min("month").alias("month"))
    per_month = contracts.groupBy("chain", "month").agg(F.sum("logs").alias("logs")).join(
        first.groupBy("chain", "month").agg(F.count(F.lit(1)).alias("fresh")), ["chain", "month"], "left")
    leveled = per_month.groupingSets([["chain", "month"], ["month"]], "chain", "month").agg(
        F.grouping("chain").alias("_all"), F.sum("logs").alias("monthly_oracle_log_count"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("monthly_new_contract_count"))
    named = leveled.withColumn("chain", F.when(F.col("_all") == 1, F.lit(ALL_CHAINS)).otherwise(F.col("chain"))).drop("_all")
    so_far = Window.partitionBy("chain").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return named.withColumn("cumulative_oracle_log_count", F.sum("monthly_oracle_log_count").over(so_far)).withColumn(
        "cumulative_unique_contract_count", F.sum("monthly_new_contract_count").over(so_far))
