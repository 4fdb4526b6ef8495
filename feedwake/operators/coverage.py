"""Index coverage: raw and suspicious counts, known-transaction hits, seed candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.functions import words as W
from feedwake.operators.closure import in_chains, in_dates
from feedwake.operators.dedupe import keep_first

# Patterns of lending tokens and of calls.
RAW_LENDING_TOKEN = (
    "(aave|compound|venus|moonwell|blizz|ploutos|benqi|morpho|radiant|silo|granary|lodestar|geist|cream|euler|"
    "^c[a-z0-9]+|^v[a-z0-9]+|^m[a-z0-9]+|^b[a-z0-9]+|^a[a-z0-9]+)"
)
COMPOSITION_CALL = "(oracle|price|feed|source|ratio|rate|exchange|wrapper|govern|execute|cbeth|wsteth|wrseth|reth|ohm)"


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(F.col(column)) if exact else F.approx_count_distinct(column)


def raw_coverage_counts(transactions: DataFrame, logs: DataFrame, chains=None, start=None, end=None, exact: bool = False) -> DataFrame:
    """Transactions, logs and contracts per chain and year; a side that is missing counts as 0."""
    sent = in_dates(in_chains(transactions, chains), start, end).groupBy("blockchain", F.year("block_date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("tx_count"), _distinct("to", exact).alias("_to"))
    seen = in_dates(in_chains(logs, chains), start, end).groupBy("blockchain", F.year("block_date").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("log_count"), _distinct("contract_address", exact).alias("_contracts"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sent.join(seen, ["blockchain", "year"], "full_outer").select(
        F.col("blockchain").alias("chain"), "year", zero("tx_count").alias("tx_count"), zero("log_count").alias("log_count"),
        F.greatest(zero("_to"), zero("_contracts")).alias("unique_contract_count"), F.lit("raw_index_coverage").alias("coverage_layer"),
    )


def story_scope_counts(logs: DataFrame, transactions: DataFrame, chains: Sequence[str], start=None, end=None) -> DataFrame:
    """Log and transaction counts of each named chain; chains without rows show 0."""
    spine = R.inline(logs.sparkSession, [(c,) for c in chains], "chain string")
    seen = in_dates(in_chains(logs, chains), start, end).groupBy(F.col("blockchain").alias("chain")).agg(
        F.count(F.lit(1)).alias("raw_log_count"), F.count_distinct("tx_hash").alias("tx_with_logs_count"),
        F.count_distinct("contract_address").alias("log_contract_count"))
    sent = in_dates(in_chains(transactions, chains), start, end).groupBy(F.col("blockchain").alias("chain")).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_distinct("to").alias("touched_contract_count"))
    counts = ["raw_log_count", "tx_with_logs_count", "log_contract_count", "transaction_count", "touched_contract_count"]
    return spine.join(seen, "chain", "left").join(sent, "chain", "left").select("chain", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def _suspicious(rows: DataFrame, failure_class: str, exact: bool) -> DataFrame:
    return rows.groupBy("chain", "year").agg(
        F.count_distinct("tx_hash").alias("suspicious_tx_count"), F.count_distinct("log_key").alias("suspicious_log_count"),
        _distinct("actor", exact).alias("candidate_actor_count"), _distinct("market_contract", exact).alias("candidate_market_count"),
    ).select(
        "chain", "year", F.lit(failure_class).alias("failure_class"), "suspicious_tx_count", "suspicious_log_count", "candidate_actor_count",
        "candidate_market_count", F.lit("rule_suspicious_coverage").alias("coverage_layer"),
    )


def _sent(transactions: DataFrame, chains, start, end) -> DataFrame:
    kept = in_dates(in_chains(transactions, chains), start, end).where("success")
    return kept.select(
        F.col("blockchain").alias("chain"), F.year("block_date").cast("long").alias("year"), F.col("hash").alias("tx_hash"), F.col("from").alias("actor"),
        F.col("to").alias("market_contract"), "data",
    )


def _with_logs(rows: DataFrame, logs: DataFrame, chains, start, end) -> DataFrame:
    """Adds the key of each log of a suspicious transaction; distinct transactions meet the logs."""
    found = in_dates(in_chains(logs, chains), start, end).select(
        F.col("blockchain").alias("chain"), "tx_hash", T.log_key(F.col("tx_hash"), F.col("log_index")).alias("log_key"))
    return rows.select("chain", "year", "tx_hash", "actor", "market_contract").distinct().join(found, ["chain", "tx_hash"], "left")


def feed_binding_suspicious(transactions, traces, tokens, logs, chains=None, start=None, end=None, exact: bool = False) -> DataFrame:
    """Yearly counts of calls that touch price bindings, or lend on a market-like token."""
    label = F.lower(F.concat(F.coalesce("symbol", F.lit("")), F.lit(" "), F.coalesce("name", F.lit(""))))
    markets = in_chains(tokens, chains).where(label.rlike(RAW_LENDING_TOKEN)).select(
        F.col("blockchain").alias("chain"), F.col("contract_address").alias("market_contract"), F.lit(True).alias("_market")).distinct()
    calls = in_dates(in_chains(traces, chains), start, end).select(F.col("blockchain").alias("chain"), "tx_hash", F.lower("function_name").alias("fn"))
    rows = _sent(transactions, chains, start, end).join(calls, ["chain", "tx_hash"]).join(markets, ["chain", "market_contract"], "left")
    fn = F.coalesce("fn", F.lit(""))
    lends = F.coalesce("_market", F.lit(False)) & fn.rlike("(borrow|mint|supply|deposit|liquidat)")
    return _suspicious(_with_logs(rows.where(fn.rlike(ID.BINDING_FUNCTION) | lends), logs, chains, start, end), R.FEED_BINDING, exact)


def composition_suspicious(transactions, traces, logs, chains=None, start=None, end=None, exact: bool = False) -> DataFrame:
    """Yearly counts of calls whose name or data speaks of prices, rates, governance or derivative assets."""
    calls = in_dates(in_chains(traces, chains), start, end).select(F.col("blockchain").alias("chain"), "tx_hash", "function_name")
    rows = _sent(transactions, chains, start, end).join(calls, ["chain", "tx_hash"], "left")
    said = F.lower(F.concat(F.coalesce("function_name", F.lit("")), F.lit(" "), F.regexp_replace(F.coalesce("data", F.lit("")), "^0x", "")))
    return _suspicious(_with_logs(rows.where(said.rlike(COMPOSITION_CALL)), logs, chains, start, end), R.COMPOSITION, exact)


def freshness_suspicious(logs, transfers, tokens, chains=None, start=None, end=None, exact: bool = False, answer: Column | None = None, min_usd: float = 10_000) -> DataFrame:
    """Yearly counts of lower-bound answers and of material outflows of market-like tokens."""
    size = F.abs(W.int_double(F.col("topic1")) / F.lit(1e8)) if answer is None else answer
    low = in_dates(in_chains(logs, chains), start, end).where(F.lower("topic0") == R.ANSWER_UPDATED).where((size > 0) & (size <= 1)).select(
        F.col("blockchain").alias("chain"), F.year("block_date").cast("long").alias("year"), "tx_hash", F.lit(None).cast("string").alias("actor"),
        F.col("contract_address").alias("market_contract"), T.log_key(F.col("tx_hash"), F.col("log_index")).alias("log_key"))
    label = F.lower(F.concat(F.coalesce("symbol", F.lit("")), F.lit(" "), F.coalesce("name", F.lit(""))))
    prefixed = in_chains(tokens, chains).where(label.rlike("(^|[^a-z0-9])(a|b|c|m|v)[a-z0-9]+")).select("blockchain", F.col("contract_address").alias("from")).distinct()
    moved = in_dates(in_chains(transfers, chains), start, end).where((F.col("amount") > 0) & (F.col("amount_usd").isNull() | (F.col("amount_usd") >= min_usd)))
    paid = moved.join(prefixed, ["blockchain", "from"], "left_semi").select(
        F.col("blockchain").alias("chain"), F.year("block_date").cast("long").alias("year"), "tx_hash", F.col("to").alias("actor"),
        F.col("from").alias("market_contract"), T.log_key(F.col("tx_hash"), F.col("evt_index")).alias("log_key"))
    return _suspicious(low.unionByName(paid), R.FRESHNESS, exact)


def attack_tx_manifest(trace: DataFrame, cases: DataFrame) -> DataFrame:
    """Distinct valid impact transactions per case, at their first event in input order.

    ``cases``: case, name, chain, failure_class, impact_events array.
    """
    joined = trace.join(cases, "case").where(F.array_contains("impact_events", F.col("event_type")) & T.is_hash(F.col("tx_hash")))
    stamp = F.coalesce("block_timestamp", F.lit(0).cast("long"))
    broad = F.when(F.col("failure_class") == "price_semantics_mismatch", F.lit(R.COMPOSITION)).otherwise(F.col("failure_class"))
    rows = joined.select(
        "case", F.col("name").alias("case_name"), T.chain_name(F.col("chain")).alias("chain"), F.col("failure_class").alias("original_failure_class"),
        broad.alias("broad_failure_class"), "event_type", F.lower("tx_hash").alias("tx_hash"), F.coalesce("block_number", F.lit(0)).alias("block_number_local"),
        stamp.alias("block_timestamp_local"), F.coalesce("input_ord", F.lit(0)).alias("input_ord"),
    )
    first = keep_first(rows, ["case", "tx_hash"], ["input_ord"]).drop("input_ord")
    return first.withColumn("display_chain", T.chain_display(F.col("chain"))).withColumn(
        "year_local", F.year(F.timestamp_seconds("block_timestamp_local")).cast("long"))


def count_by(rows: DataFrame, *fields: str) -> DataFrame:
    """Row counts by fields; NULL and blank read as empty text."""
    return rows.groupBy(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).agg(F.count(F.lit(1)).alias("count"))


def case_hits(manifest: DataFrame, transactions: DataFrame, start=None, end=None) -> DataFrame:
    """Known attack transactions looked up in the transaction index."""
    index = in_dates(transactions, start, end).select(
        F.col("blockchain").alias("chain"), F.lower("hash").alias("tx_hash"), "block_number", "block_time", "success", F.col("from").alias("tx_from"),
        F.col("to").alias("tx_to"))
    found = F.col("block_number").isNotNull()
    return manifest.join(index, ["chain", "tx_hash"], "left").select(
        F.col("case").alias("case_id"), "case_name", F.col("display_chain").alias("chain"), "original_failure_class",
        F.col("broad_failure_class").alias("expected_broad_failure_class"), "event_type", "tx_hash", "block_number", "block_time", "success", "tx_from", "tx_to",
        found.alias("found_in_index"), F.when(found, F.col("broad_failure_class")).alias("matched_failure_class"),
        F.when(found, F.lit("raw_transaction_in_scope")).otherwise(F.lit("not_found_in_transactions")).alias("matched_rule_stage"),
    )


def case_hit_summary(hits: DataFrame) -> DataFrame:
    """Per case: expected, found and matched transactions, and whether all were found."""
    return hits.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("expected_attack_tx_count"), F.count_if("found_in_index").alias("found_count"),
        F.count("matched_failure_class").alias("rule_matched_count"),
    ).withColumn("all_attack_txs_found", F.col("found_count") == F.col("expected_attack_tx_count")).withColumn(
        "has_representative_rule_match", F.col("rule_matched_count") > 0)


# Source quality noted for a known case by its failure class.
SEED_QUALITY = {
    R.FEED_BINDING: "receipt_flow_decoded", "price_semantics_mismatch": "forum_canonical_tx_list",
    R.COMPOSITION: "dune_decoded_event_plus_receipt", R.FRESHNESS: "dune_or_local_decoded_event",
}
ACTOR_KEYS = ("borrower", "supplier", "account", "liquidator", "actor")


def seed_candidates(trace: DataFrame, cases: DataFrame) -> DataFrame:
    """One candidate per known case: its trigger, its first impact after it, and the evidence flags.

    ``cases``: case, name, chain, failure_class, trigger_event, impact_events array.
    """
    joined = trace.join(cases, "case")
    is_impact = F.array_contains("impact_events", F.col("event_type"))
    stamp = F.coalesce("block_timestamp", F.lit(0).cast("long"))
    event = F.struct(
        stamp.alias("at"), F.coalesce("block_number", F.lit(0)).alias("block"), F.coalesce("tx_hash", F.lit("")).alias("tx"), F.col("decoded.asset").alias("asset"))
    order = F.struct(
        F.coalesce("block_number", F.lit(0)).alias("b"), F.coalesce("transaction_index", F.lit(0)).alias("t"), F.coalesce("log_index", F.lit(0)).alias("l"),
        F.coalesce("input_ord", F.lit(0)).alias("o"))
    triggers = joined.groupBy("case", "name", "chain", "failure_class").agg(
        F.coalesce(
            F.min_by(event, F.when(F.col("event_type") == F.col("trigger_event"), F.coalesce("input_ord", F.lit(0)))),
            F.min_by(event, F.coalesce("input_ord", F.lit(0)))).alias("trigger"),
        F.count_if(is_impact).alias("impacts"),
        F.sum(F.when(F.col("event_type") == R.BORROW, T.loose_amount(F.col("decoded.borrow_amount_usd")))).alias("usd"),
    )
    impacts = joined.where(is_impact).select("case", event.alias("e"), order.alias("o")).join(triggers.select("case", "trigger"), "case")
    firsts = impacts.groupBy("case").agg(
        F.coalesce(F.min_by("e", F.when(F.col("e.at") >= F.col("trigger.at"), F.col("o"))), F.min_by("e", "o")).alias("first"),
        F.count_distinct(F.when(F.col("e.tx") != "", F.col("e.tx"))).alias("impact_tx_count"))
    names = joined.select("case", F.explode(F.array(*[F.lower(F.nullif(F.col(f"decoded.{k}"), F.lit(""))) for k in ACTOR_KEYS])).alias("a"))
    actors = names.groupBy("case").agg(F.count_distinct("a").alias("actor_count"))
    rows = triggers.join(firsts, "case", "left").join(actors, "case", "left")
    quality = F.lit("local_materialized_evidence")
    for name, value in SEED_QUALITY.items():
        quality = F.when(F.col("failure_class") == name, F.lit(value)).otherwise(quality)
    first_at, trigger_at = F.coalesce("first.at", F.lit(0)), F.col("trigger.at")
    ordered = ((first_at > 0) & (first_at >= trigger_at)) | ((F.coalesce("first.block", F.lit(0)) > 0) & (F.col("first.block") >= F.col("trigger.block")))
    has_impact = F.col("impacts") > 0
    return rows.select(
        F.concat(F.lit("seed-"), "case").alias("candidate_id"), F.lit("seed_evaluation").alias("dataset_layer"), F.lit(True).alias("already_materialized"),
        "case", "chain", F.col("name").alias("protocol"), "failure_class", F.col("trigger.tx").alias("trigger_tx"), F.col("trigger.block").alias("trigger_block"),
        F.timestamp_seconds("trigger.at").alias("trigger_time"), F.coalesce("trigger.asset", F.lit("")).alias("affected_asset"),
        F.when(has_impact, F.lit(R.TIER_A)).otherwise(F.lit(R.TIER_B)).alias("evidence_tier"), F.lit(True).alias("has_trigger"),
        has_impact.alias("has_lending_impact"), (F.coalesce("actor_count", F.lit(0)) > 0).alias("has_actor"),
        (has_impact & F.coalesce(ordered, F.lit(False))).alias("has_temporal_order"), F.lit(True).alias("has_replayable_constraint"),
        F.when(first_at > 0, F.greatest(F.lit(0), first_at - trigger_at)).otherwise(F.lit(0)).alias("trigger_to_impact_seconds"),
        F.coalesce("impact_tx_count", F.lit(0)).alias("impact_tx_count"), F.coalesce("usd", F.lit(0.0)).alias("impact_usd_known"),
        F.coalesce("actor_count", F.lit(0)).alias("actor_count"), quality.alias("source_quality"), F.lit(0).cast("long").alias("source_quality_rank"),
    )
