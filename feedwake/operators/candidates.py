"""Exported candidate rows: typing, deduplication, the download queue and its summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import text as T
from feedwake.operators.dedupe import keep_first, one_row, sequence_within

REQUIRED = (
    "chain", "failure_class", "trigger_tx", "trigger_time", "evidence_tier", "has_trigger", "has_oracle_anomaly", "has_lending_impact",
    "has_actor", "has_temporal_order", "has_replayable_constraint", "impact_tx_count", "impact_usd_known", "source_quality_rank",
)
FLAGS = ("has_trigger", "has_oracle_anomaly", "has_lending_impact", "has_actor", "has_temporal_order", "has_replayable_constraint")
EXTRA_FLAGS = ("asset_identity_observed", "feed_identity_observed", "identity_mismatch_hint")
EXTRA_TEXT = ("protocol_cluster_id", "feed_label", "feed_identity", "feed_identity_source")
# Longest trigger-to-impact gap in seconds that tier B rows may have, by class.
QUEUE_WINDOWS = {R.FEED_BINDING: 86_400, R.COMPOSITION: 86_400, R.FRESHNESS: 86_400}
# Receipts and ABI lookups planned per candidate: (trigger receipts, impact receipts, ABI lookups).
REQUEST_CAPS = {R.FEED_BINDING: (1, 1, 2), R.COMPOSITION: (1, 2, 3), R.FRESHNESS: (1, 2, 2)}
DEFAULT_CAPS = (1, 5, 2)
FAR_AWAY = 10**12


def _by_class(table: dict, default: object) -> Column:
    return reduce(lambda rest, item: F.when(F.col("failure_class") == item[0], F.lit(item[1])).otherwise(rest), table.items(), F.lit(default))


def normalize_candidates(rows: DataFrame) -> DataFrame:
    """Typed, deduplicated candidates from text columns with ``source_file`` and ``source_row``.

    The first row of each (chain, class, trigger, asset) in file order is kept; ids number the input rows.
    """
    missing = sorted(c for c in REQUIRED if c not in rows.columns)
    if missing:
        raise ValueError(f"candidate rows lack required fields {missing}")
    have = set(rows.columns)
    text = lambda c, default="": F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default)) if c in have else F.lit(default)
    number = lambda c, default: T.to_long(F.col(c), default) if c in have else F.lit(default).cast("long")
    flag = lambda c: T.to_bool(F.col(c)) if c in have else F.lit(False)
    numbered = sequence_within(rows.withColumn("source_row", F.col("source_row").cast("long")), [], ["source_file", "source_row"], "_n")
    when = T.parse_time_or_epoch(F.col("trigger_time"))
    typed = numbered.select(
        F.col("_n").alias("input_ord"),
        F.format_string("broad-%06d", F.col("_n")).alias("candidate_id"),
        text("dataset_layer", "remote_candidate").alias("dataset_layer"), flag("already_materialized").alias("already_materialized"),
        text("chain").alias("chain"), text("protocol", "unknown_protocol").alias("protocol"), text("failure_class").alias("failure_class"),
        text("trigger_tx").alias("trigger_tx"), number("trigger_block", 0).alias("trigger_block"), when.alias("trigger_time"),
        F.year(when).cast("long").alias("trigger_year"), text("affected_asset").alias("affected_asset"), text("evidence_tier").alias("evidence_tier"),
        text("closure_reason").alias("closure_reason"), *[flag(c).alias(c) for c in FLAGS],
        number("trigger_to_impact_seconds", 0).alias("trigger_to_impact_seconds"), number("impact_tx_count", 0).alias("impact_tx_count"),
        T.to_double(F.col("impact_usd_known"), 0.0).alias("impact_usd_known"), text("source_quality").alias("source_quality"),
        number("source_quality_rank", 99).alias("source_quality_rank"), text("remote_query_id").alias("remote_query_id"),
        (T.text_list(F.col("impact_txs")) if "impact_txs" in have else F.array().cast("array<string>")).alias("impact_txs"),
        "source_file", "source_row", *[flag(c).alias(c) for c in EXTRA_FLAGS if c in have], *[text(c).alias(c) for c in EXTRA_TEXT if c in have],
    )
    keyed = typed.withColumn("_tx", F.lower("trigger_tx")).withColumn("_asset", F.lower("affected_asset"))
    return keep_first(keyed, ["chain", "failure_class", "_tx", "_asset"], ["input_ord"]).drop("_tx", "_asset")


def queue_gate(windows: dict[str, int] | None = None) -> Column:
    """Tier A, or tier B with impact, order, good sources and a short gap; neither seeds nor rows already downloaded."""
    limit = _by_class(windows or QUEUE_WINDOWS, 86_400)
    fresh = ~F.col("already_materialized") & (F.col("dataset_layer") != "seed_evaluation")
    closed = (
        (F.col("evidence_tier") == R.TIER_B) & F.col("has_lending_impact") & F.col("has_temporal_order") & (F.col("source_quality_rank") <= 2)
        & (F.col("impact_tx_count") > 0) & (F.col("trigger_to_impact_seconds") >= 0) & (F.col("trigger_to_impact_seconds") <= limit)
    )
    return fresh & ((F.col("evidence_tier") == R.TIER_A) | closed)


def materialization_queue(candidates: DataFrame, windows: dict[str, int] | None = None) -> DataFrame:
    """Gated candidates with their place in the queue of their class and the requests they need."""
    gated = candidates.where(queue_gate(windows))
    tier = F.when(F.col("evidence_tier") == R.TIER_A, 1).when(F.col("evidence_tier") == R.TIER_B, 2).otherwise(9)
    gap = F.when(F.col("trigger_to_impact_seconds") >= 0, F.col("trigger_to_impact_seconds")).otherwise(F.lit(FAR_AWAY))
    keys = {
        "_1": tier, "_2": -F.col("has_replayable_constraint").cast("int"), "_3": -F.col("has_actor").cast("int"), "_4": gap,
        "_5": -F.col("impact_usd_known"), "_6": -F.col("impact_tx_count"), "_7": F.col("source_quality_rank"),
    }
    ordered = sequence_within(
        gated.withColumns(keys), ["failure_class"], [*keys, "chain", "trigger_year", "trigger_tx", "input_ord"], "gate_sequence"
    ).drop(*keys)
    cap = lambda i: _by_class({k: v[i] for k, v in REQUEST_CAPS.items()}, DEFAULT_CAPS[i]).cast("long")
    receipts = F.least(F.col("impact_tx_count"), cap(1))
    return ordered.select(
        "*", F.lit("download_minimal_causal_trace").alias("materialization_action"), cap(0).alias("estimated_trigger_receipts"),
        receipts.alias("estimated_impact_receipts"), cap(2).alias("estimated_abi_requests"), (cap(0) + receipts).alias("estimated_total_rpc_requests"),
    )


def candidate_cubes(candidates: DataFrame, queue: DataFrame) -> DataFrame:
    """Counts by chain, year, class and tier; by class and tier; by source quality; value and queue length by class."""
    rows = candidates.withColumn("source_quality", F.coalesce(F.nullif("source_quality", F.lit("")), F.lit("unknown")))
    columns = ["chain", "trigger_year", "failure_class", "evidence_tier", "source_quality"]
    sets = [["chain", "trigger_year", "failure_class", "evidence_tier"], ["failure_class", "evidence_tier"], ["source_quality"], ["failure_class"]]
    cube = rows.groupingSets(sets, *columns).agg(
        F.grouping_id(*columns).alias("_level"), F.count(F.lit(1)).alias("candidate_count"), F.sum("impact_usd_known").alias("impact_usd_known")
    )
    names = {1: "chain_year_class_tier", 25: "class_tier", 30: "source_quality", 27: "class"}
    level = reduce(lambda rest, item: F.when(F.col("_level") == item[0], F.lit(item[1])).otherwise(rest), names.items(), F.lit(None))
    queued = queue.groupBy("failure_class").agg(F.count(F.lit(1)).alias("candidate_count"), F.sum("impact_usd_known").alias("impact_usd_known"))
    queued = queued.select(
        F.lit("queue_class").alias("level"), F.lit(None).cast("string").alias("chain"), F.lit(None).cast("long").alias("trigger_year"), "failure_class",
        F.lit(None).cast("string").alias("evidence_tier"), F.lit(None).cast("string").alias("source_quality"), "candidate_count", "impact_usd_known",
    )
    return cube.select(level.alias("level"), *columns, "candidate_count", "impact_usd_known").unionByName(queued)


def queue_estimate(queue: DataFrame) -> DataFrame:
    """Receipts, remote calls (three per receipt bundle) and ABI lookups that a queue needs."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return queue.agg(
        F.count(F.lit(1)).alias("queue_count"), total("estimated_total_rpc_requests").alias("receipt_bundles"),
        (total("estimated_total_rpc_requests") * 3).alias("rpc_requests"), total("estimated_abi_requests").alias("abi_requests"),
    )


def candidate_txs(rows: DataFrame) -> DataFrame:
    """(candidate_id, tx): trigger and impact transactions of each candidate, lower case."""
    every = F.concat(F.array("trigger_tx"), "impact_txs")
    listed = rows.select("candidate_id", F.explode(F.transform(every, lambda x: F.lower(F.trim(x)))).alias("tx"))
    return listed.where(F.coalesce("tx", F.lit("")) != "").distinct()


def download_scope(candidates: DataFrame, queue: DataFrame, known: DataFrame, target_bundles: int | None = None) -> DataFrame:
    """One row: queue size, overlap with known transactions (case, tx_hash) and whether the budget holds."""
    eligible = queue.where(
        F.col("evidence_tier").isin(R.TIER_A, R.TIER_B) & ~F.col("already_materialized") & (F.col("dataset_layer") != "seed_evaluation")
    )
    known_txs = known.select(F.lower("tx_hash").alias("tx")).distinct()
    hits = candidate_txs(eligible).join(known_txs, "tx", "left_semi")
    sizes = queue_estimate(eligible).withColumnRenamed("queue_count", "eligible_queue_candidate_count")
    overlap = hits.agg(F.count_distinct("candidate_id").alias("overlap_candidate_count"), F.count_distinct("tx").alias("overlap_tx_count"))
    scale = candidates.agg(
        F.count(F.lit(1)).alias("candidate_count"), F.sum(F.size("impact_txs") + 1).cast("long").alias("candidate_tx_reference_count")
    )
    unique = candidate_txs(candidates).agg(F.count_distinct("tx").alias("unique_candidate_tx_count"))
    reference = known_txs.agg(F.count(F.lit(1)).alias("known_tx_count"))
    row = one_row(sizes, overlap, scale, unique, reference)
    exceeded = F.lit(False) if target_bundles is None else F.col("receipt_bundles") > F.lit(target_bundles)
    return row.withColumn("target_local_bundles_exceeded", exceeded)


def download_scope_by_case(queue: DataFrame, known: DataFrame) -> DataFrame:
    """Per case: known transactions, overlapping candidates and what downloading them costs."""
    txs = known.select("case", F.lower("tx_hash").alias("tx")).distinct()
    eligible = queue.where(
        F.col("evidence_tier").isin(R.TIER_A, R.TIER_B) & ~F.col("already_materialized") & (F.col("dataset_layer") != "seed_evaluation")
    )
    hits = candidate_txs(eligible).join(txs, "tx")
    per_candidate = hits.select("case", "candidate_id").distinct().join(eligible.select("candidate_id", "estimated_total_rpc_requests"), "candidate_id")
    costs = per_candidate.groupBy("case").agg(
        F.count(F.lit(1)).alias("overlap_candidate_count"), F.sum("estimated_total_rpc_requests").alias("receipt_bundles")
    )
    overlap = hits.groupBy("case").agg(F.count_distinct("tx").alias("overlap_tx_count"))
    base = txs.groupBy("case").agg(F.count(F.lit(1)).alias("known_tx_count"))
    joined = base.join(costs, "case", "left").join(overlap, "case", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("case", "known_tx_count", zero("overlap_candidate_count"), zero("receipt_bundles"), zero("overlap_tx_count"))


def download_order(queue: DataFrame, known: DataFrame) -> DataFrame:
    """Queue with ``known_overlap``; sort by it descending, then value descending, gate sequence and id."""
    known_txs = known.select(F.lower("tx_hash").alias("tx")).distinct()
    overlap = candidate_txs(queue).join(known_txs, "tx", "left_semi").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("known_overlap"))
    return queue.join(overlap, "candidate_id", "left").withColumn("known_overlap", F.coalesce("known_overlap", F.lit(0)))
