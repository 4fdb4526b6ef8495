"""Quality checks of traces and evidence, and the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import text as T
from feedwake.storage import write_table

# Patterns of addresses, transactions and marker words.
ADDRESS_PATTERN = "(0x[0-9a-fA-F]{40})(?![0-9a-fA-F])"
TX_PATTERN = "(0x[0-9a-fA-F]{64})(?![0-9a-fA-F])"
MARKER_WORDS = "(synthetic|fixture|placeholder)"


def documents(df: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text per row, so that nested fields of any shape can be searched."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in (key, *ignore)])).alias("document"))


def leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """Every scalar inside the JSON texts of ``document`` with its path: ``key``, ``path`` (``$.a.b[2]``) and ``value`` (text).

    Documents are taken apart as variants, a level at a time, so fields of any shape and nested lists are reached; each level is written, and
    the walk ends when none holds an object or a list. A text that is no JSON is a leaf of its own (``$``); JSON nulls are left out.
    """
    spark = df.sparkSession
    level = df.select(key, F.lit("$").alias("path"), F.col(document).alias("document")).where(F.col("document").isNotNull())
    found = None
    while True:
        opened = level.withColumn("v", F.try_parse_json("document"))
        kind = F.coalesce(F.schema_of_variant("v"), F.lit("STRING"))
        holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        text = F.when(F.col("v").isNull(), F.col("document")).otherwise(F.col("v").cast("string"))
        here = opened.where(~holds).select(key, "path", text.alias("value")).where(F.col("value").isNotNull())
        found = here if found is None else found.unionByName(here)
        inside = opened.where(holds).select(F.col(key).alias("_key"), "path", "v")
        parts = inside.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = write_table(parts.select(F.col("_key").alias(key), F.concat("path", step).alias("path"), F.to_json("value").alias("document")))
        if level.isEmpty():
            return found


def placeholder_paths(df: DataFrame, key: str, document: str) -> DataFrame:
    """Where documents hold placeholder addresses and hashes, or call themselves synthetic: ``key``, ``path``, ``kind`` and ``value`` (lower case)."""
    rows = leaves(df, key, document)
    said = lambda pattern: F.transform(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)), F.lower)
    hits = F.concat(
        F.transform(F.filter(said(ADDRESS_PATTERN), T.is_placeholder_address), lambda v: F.struct(F.lit("address").alias("kind"), v.alias("value"))),
        F.transform(F.filter(said(TX_PATTERN), T.is_placeholder_tx), lambda v: F.struct(F.lit("transaction").alias("kind"), v.alias("value"))),
        F.transform(F.regexp_extract_all(F.lower("value"), F.lit(MARKER_WORDS), F.lit(1)), lambda v: F.struct(F.lit("marker").alias("kind"), v.alias("value"))),
    )
    return rows.select(key, "path", F.explode(F.array_distinct(hits)).alias("hit")).select(key, "path", "hit.kind", "hit.value")


def placeholder_values(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct placeholder addresses and hashes in text, per key."""
    found = lambda pattern: F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)), F.lower)
    seen = texts.select(key, F.explode(F.array_distinct(F.concat(found(ADDRESS_PATTERN), found(TX_PATTERN)))).alias("value"))
    return seen.where(T.is_placeholder_address(F.col("value")) | T.is_placeholder_tx(F.col("value"))).distinct()


def synthetic_markers(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct texts that call themselves synthetic, fixture or placeholder, per key."""
    return texts.where(F.lower(column).rlike(MARKER_WORDS)).select(key, F.col(column).alias("marker")).distinct()


def distinct_flow_counts(flows: DataFrame, key: str) -> DataFrame:
    """Distinct transfer flows per key (tx_hash, log_index, token_address, from, to, amount_raw)."""
    fields = ["tx_hash", "log_index", "token_address", "from", "to", "amount_raw"]
    return flows.select(key, *fields).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("transfer_flow_count"))


def nested_flow_counts(df: DataFrame, key: str, flows: str) -> DataFrame:
    """The same from an array column of flow structs."""
    return distinct_flow_counts(df.select(key, F.explode(flows).alias("f")).select(key, "f.*"), key)


def evidence_status() -> Column:
    """Status of a case from its audit counts, most severe first."""
    raw = F.col("raw_receipt_present")
    return (
        F.when((F.col("placeholder_count") > 0) | (F.col("fixture_tx_count") > 0), F.lit("fixture_only"))
        .when(F.col("complete_incident_trace"), F.lit("real_materialized"))
        .when(raw & (F.col("transfer_flow_count") > 0) & F.col("has_real_attacker") & F.col("has_raw_config_log"), F.lit("real_tx_with_receipt_flow_decode"))
        .when(F.col("inferred"), F.lit("real_tx_with_inferred_decode"))
        .when(F.col("locator_exists") & (F.col("trace_records") > 0), F.lit("real_materialized"))
        .when(F.col("trace_records") > 0, F.lit("real_tx_with_inferred_decode")).otherwise(F.lit("fixture_only"))
    )


def audit_dataset(trace: DataFrame, alerts: DataFrame, actors: DataFrame, evidence: DataFrame, minimum_borrows: int = 12) -> DataFrame:
    """Per case: records, alerts, accounts, placeholders, qualities and the status these give.

    ``evidence``: case, raw_receipt_present, has_raw_config_log, locator_exists. Transfer flows are counted from the trace, distinct ones once.
    A trace with a value or implementation fault and enough distinct borrows counts as complete.
    """
    docs = documents(trace.select("case", "tx_hash", "address", "decoded"), "case")
    placeholders = placeholder_values(docs, "case", "document").groupBy("case").agg(F.count(F.lit(1)).alias("placeholder_count"))
    markers = docs.groupBy("case").agg(F.count_if(F.lower("document").rlike(MARKER_WORDS)).alias("synthetic_marker_count"))
    quality = trace.select("case", F.explode(F.array("decoded.evidence_quality", "decoded.source")).alias("q")).where(F.coalesce("q", F.lit("")) != "").distinct()
    qualities = quality.groupBy("case").agg(F.array_join(F.array_sort(F.collect_list("q")), ",").alias("evidence_quality"), F.bool_or(F.contains("q", F.lit("inferred"))).alias("_inferred"))
    borrow_txs = trace.where((F.col("event_type") == R.BORROW) & (F.coalesce("tx_hash", F.lit("")) != "")).select("case", "tx_hash").distinct().groupBy("case").agg(
        F.count(F.lit(1)).alias("borrow_tx_count"))
    counts = trace.groupBy("case").agg(
        F.count(F.lit(1)).alias("trace_records"), F.count_if(T.is_placeholder_tx(F.lower(F.coalesce("tx_hash", F.lit(""))))).alias("fixture_tx_count"),
        F.bool_or(F.col("event_type").isin(R.MALFUNCTION, R.MISMATCH)).alias("_fault"), F.bool_or(F.contains(F.to_json("decoded"), F.lit("unknown"))).alias("_unknown"))
    real = actors.groupBy("case").agg(F.count(F.lit(1)).alias("attacker_candidates"), F.bool_or(~T.is_placeholder_address(F.col("address"))).alias("has_real_attacker"))
    raised = alerts.groupBy("case").agg(F.count(F.lit(1)).alias("alerts"))
    flows = nested_flow_counts(trace.select("case", F.col("decoded.transfer_flow_summary").alias("flows")), "case", "flows")
    table = evidence
    for part in (flows, counts, placeholders, markers, qualities, borrow_txs, real, raised):
        table = table.join(part, "case", "left")
    numbers = ["trace_records", "fixture_tx_count", "placeholder_count", "synthetic_marker_count", "attacker_candidates", "alerts", "borrow_tx_count", "transfer_flow_count"]
    for n in numbers:
        table = table.withColumn(n, F.coalesce(n, F.lit(0)))
    no = F.lit(False)
    table = table.withColumn("has_real_attacker", F.coalesce("has_real_attacker", no)).withColumn("evidence_quality", F.coalesce("evidence_quality", F.lit("")))
    table = table.withColumn("complete_incident_trace", F.coalesce("_fault", no) & (F.col("borrow_tx_count") >= minimum_borrows))
    table = table.withColumn("inferred", (F.col("evidence_quality") != "") & (F.coalesce("_inferred", no) | F.coalesce("_unknown", no)))
    return table.withColumn("status", evidence_status()).drop("_fault", "_unknown", "_inferred", "inferred")


def trigger_tx(alerts: DataFrame, cases: DataFrame, fallbacks: tuple[str, ...]) -> DataFrame:
    """Transaction of the first boundary alert of each case, else the first fallback key of its known transactions."""
    boundary = alerts.where((F.col("record_role") == "oracle_boundary") & (F.coalesce("tx_hash", F.lit("")) != ""))
    first = boundary.groupBy("case").agg(F.min_by("tx_hash", F.struct("pos", "id")).alias("_tx"))
    known = [F.nullif(F.try_element_at("known_txs", F.lit(k)), F.lit("")) for k in fallbacks]
    return cases.join(first, "case", "left").select("case", F.coalesce("_tx", *known, F.lit("")).alias("trigger_tx"))


def case_table(cases: DataFrame, audit: DataFrame, triggers: DataFrame, incidents: DataFrame, coverage: DataFrame) -> DataFrame:
    """Report row per case. ``incidents``: case, impact_tx_count, attacker_count; ``coverage`` from pre-attack logs."""
    joined = cases.join(audit, "case", "left").join(triggers, "case", "left").join(incidents, "case", "left").join(coverage, "case", "left")
    return joined.select(
        "case", "name", "chain", F.col("status").alias("evidence_status"), "trigger_tx", "impact_tx_count",
        F.coalesce("attacker_count", "attacker_candidates").alias("attacker_candidates"), F.coalesce("pre_attack_log_count", F.lit(0)).alias("pre_attack_log_count"),
        F.coalesce("pre_attack_topic_coverage", F.lit("0/0")).alias("pre_attack_topic_coverage"), "trace_records", "alerts")


def closure_table(cases: DataFrame, audit: DataFrame, triggers: DataFrame, state: DataFrame, incidents: DataFrame, coverage: DataFrame) -> DataFrame:
    """Which parts of the evidence chain each case closes."""
    odd = state.groupBy("case").agg(
        F.lit(True).alias("_odd"), F.bool_or(F.col("kind").isin("price_source_outlier", "decimal_semantics_mismatch")).alias("_fault"))
    joined = cases.select("case").join(audit, "case", "left").join(triggers, "case", "left").join(odd, "case", "left").join(incidents, "case", "left").join(coverage, "case", "left")
    no, zero = F.lit(False), F.lit(0)
    return joined.select(
        "case", ((F.coalesce("trigger_tx", F.lit("")) != "") | F.coalesce("_fault", no)).alias("has_trigger"), F.coalesce("_odd", no).alias("has_oracle_anomaly"),
        (F.coalesce("impact_tx_count", zero) > 0).alias("has_lending_impact"), (F.coalesce("attacker_count", "attacker_candidates", zero) > 0).alias("has_actor"),
        (F.coalesce("trace_records", zero) > 0).alias("has_temporal_order"), (F.coalesce("alerts", zero) > 0).alias("has_replayable_constraint"),
        F.coalesce("raw_receipt_present", no).alias("raw_receipt_present"), F.coalesce("transfer_flow_count", zero).alias("transfer_flow_count"),
        (F.coalesce("pre_attack_topic_log_count", zero) > 0).alias("has_pre_attack_topics"), F.col("status").alias("evidence_status"))


def loss_table(cases: DataFrame, losses: DataFrame) -> DataFrame:
    """Loss estimate per case with the share of a public figure where one is known (``public_reference``)."""
    return cases.select("case").join(losses, "case", "left").withColumn("coverage", T.rate(F.col("known_usd_estimate"), F.col("public_reference")))
