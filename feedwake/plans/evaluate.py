"""Detection metrics over replayed traces and benign samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import text as T
from feedwake.operators.dedupe import first_n, one_row
from feedwake.plans.replay import INFLATED, Replay, account_marks, actor_candidates, replay

# Labels that the label score knows.
SEMANTIC_LABELS = (
    "oracle_boundary", "oracle_anomaly", "feed_binding", "price_composition", "freshness", "price_source_outlier",
    "implementation_mismatch", "supply", "borrow", "liquidation", "lending_impact", "actor_field", "temporal_field",
    "replayable_constraint",
)
# Labels that an event type carries.
EVENT_LABELS = {
    R.FEED_SET: ("oracle_boundary", "oracle_anomaly", "feed_binding"),
    R.FORMULA_SET: ("oracle_boundary", "oracle_anomaly", "price_composition"),
    R.ANSWER: ("oracle_boundary", "oracle_anomaly", "freshness"),
    R.STALE_START: ("oracle_boundary", "oracle_anomaly", "freshness"),
    R.MALFUNCTION: ("oracle_boundary", "oracle_anomaly", "price_source_outlier"),
    R.MISMATCH: ("oracle_boundary", "oracle_anomaly", "implementation_mismatch"),
    R.SUPPLY: ("supply", "lending_impact"),
    R.BORROW: ("borrow", "lending_impact"),
    R.LIQUIDATE: ("liquidation", "lending_impact"),
}
# Labels that a constraint type carries.
CONSTRAINT_LABELS = {
    "feed_mismatch": ("oracle_anomaly", "feed_binding", "replayable_constraint"),
    "formula_mismatch": ("oracle_anomaly", "price_composition", "replayable_constraint"),
    "stale_oracle": ("oracle_anomaly", "freshness", "replayable_constraint"),
    "stale_collateral_borrow": ("oracle_anomaly", "freshness", "replayable_constraint"),
    "price_source_outlier": ("oracle_anomaly", "price_source_outlier", "replayable_constraint"),
    "decimal_semantics_mismatch": ("oracle_anomaly", "implementation_mismatch", "replayable_constraint"),
    "borrow_collateralization": ("lending_impact", "replayable_constraint"),
}
ACTOR_FIELDS = ("actor", "account", "borrower", "liquidator", "supplier")
# Alert type that answers each event type (supplies have two).
TARGET_ALERT = {**R.KIND_OF_EVENT, R.BORROW: R.LOCALIZATION, R.LIQUIDATE: R.LOCALIZATION}
# Ablation variants.
FULL, ABI_ONLY, TOPIC_ONLY = "full_replay", "without_log_semantics_abi_only", "topic_only_raw_filter"
BOUNDARY_ONLY, IMPACT_ONLY = "oracle_boundary_without_lending_binding", "impact_only_without_oracle_boundary"
VARIANTS = (FULL, ABI_ONLY, TOPIC_ONLY, BOUNDARY_ONLY, IMPACT_ONLY)


def _lookup(value: Column, table: dict) -> Column:
    """Array of labels for ``value``, empty when it has none."""
    empty = F.array().cast("array<string>")
    return reduce(
        lambda rest, item: F.when(value == item[0], F.array(*[F.lit(x) for x in item[1]])).otherwise(rest), table.items(), empty
    )


def failure_class(constraints: DataFrame) -> DataFrame:
    """Failure class of each case from its constraint types."""
    has = lambda *types: F.bool_or(F.col("type").isin(*types))
    label = (
        F.when(has("feed_mismatch"), F.lit("feed_binding"))
        .when(has("formula_mismatch", "price_source_outlier", "decimal_semantics_mismatch"), F.lit("price_semantics"))
        .when(has("stale_oracle", "stale_collateral_borrow"), F.lit("freshness"))
        .otherwise(F.lit("other"))
    )
    return constraints.groupBy("case").agg(label.alias("failure_class"))


def gold_labels(trace: DataFrame, constraints: DataFrame) -> DataFrame:
    """Distinct (case, label) that the traces and constraints imply."""
    has_actor = reduce(lambda a, b: a | b, [T.strict_address(F.col(f"decoded.{f}")) != "" for f in ACTOR_FIELDS])
    extra = F.array_compact(F.array(
        F.when(F.col("block_timestamp").isNotNull(), F.lit("temporal_field")), F.when(has_actor, F.lit("actor_field"))
    ))
    of_events = trace.select("case", F.explode(F.concat(_lookup(F.col("event_type"), EVENT_LABELS), extra)).alias("label"))
    of_rules = constraints.select("case", F.explode(_lookup(F.col("type"), CONSTRAINT_LABELS)).alias("label"))
    return of_events.unionByName(of_rules).distinct().where(F.col("label").isin(*SEMANTIC_LABELS))


def ir_labels(semantics: DataFrame) -> DataFrame:
    """Distinct (case, label) from mined event semantics (event, event_arguments, transition_tags, freshness_check)."""
    event = F.lower(F.coalesce("event", F.lit("")))
    lowered = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)
    tags, args = lowered("transition_tags"), lowered("event_arguments")
    tagged = lambda *names: F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))
    named = lambda *names: F.arrays_overlap(args, F.array(*[F.lit(n) for n in names]))
    fresh = (event == "answerupdated") | F.coalesce("freshness_check", F.lit(False)) | tagged("freshness-check")
    tests = [
        (event.isin("oraclefeedset", "oracleformulaset", "answerupdated") | tagged("oracle-setter", "oracle-read"), ["oracle_boundary"]),
        (event == "oraclefeedset", ["feed_binding"]),
        (event == "oracleformulaset", ["price_composition"]),
        (fresh, ["freshness"]),
        (event == "supply", ["supply", "lending_impact"]),
        (event == "borrow", ["borrow", "lending_impact"]),
        (event == "liquidate", ["liquidation", "lending_impact"]),
        (named("account", "actor", "borrower", "liquidator"), ["actor_field"]),
        (named("updatedat", "roundid", "blocktimestamp"), ["temporal_field"]),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, labels in tests for label in labels]))
    return semantics.select("case", F.explode(found).alias("label")).distinct()


def _prf(df: DataFrame) -> DataFrame:
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return df.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1)


def label_accuracy(gold: DataFrame, predicted: DataFrame, cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 per case, over all cases and over the cases with mined labels.

    ``cases`` has ``case`` and ``automatic``; where ``automatic`` is false, gold counts as predicted.
    """
    known = gold.join(cases, "case")
    assumed = known.where(~F.col("automatic")).select("case", "label", "automatic")
    given = predicted.join(cases.where("automatic"), "case").select("case", "label", "automatic")
    pairs = known.select("case", "label", "automatic", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        assumed.unionByName(given).select("case", "label", "automatic", F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    per_label = pairs.groupBy("case", "automatic", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    levels = F.array(
        F.concat(F.lit("case:"), F.col("case")), F.lit("all_cases"), F.when(F.col("automatic"), F.lit("automatic_cases"))
    )
    spread = per_label.select(F.explode(F.array_compact(levels)).alias("level"), "g", "p")
    counted = spread.groupBy("level").agg(
        F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("g") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("g") == 1) & (F.col("p") == 0)).alias("fn"),
    )
    return _prf(counted)


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """Struct (lower, upper) of the Wilson score interval, NULL when there is no trial."""
    s, n = successes.cast("double"), F.nullif(total.cast("double"), F.lit(0.0))
    p = s / n
    scale = 1 + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (2 * n)) / scale
    margin = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z * z) / (4 * n)) / n) / scale
    interval = F.struct(F.greatest(F.lit(0.0), center - margin).alias("lower"), F.least(F.lit(1.0), center + margin).alias("upper"))
    return F.when(total > 0, interval)


def _expected_alerts(event: Column) -> Column:
    table = {name: (alert,) for name, alert in TARGET_ALERT.items()}
    table[R.SUPPLY] = R.EARLY_ALERTS
    return _lookup(event, table)


def record_flags(trace: DataFrame, alerts: DataFrame) -> DataFrame:
    """Trace rows with ``direct``, ``blank_tx`` and ``alerted``.

    A record is alerted when an alert of its type names its transaction; a record without a
    transaction when the case has any alert of its type. Types without a target need any alert.
    """
    tx = F.lower(F.coalesce("tx_hash", F.lit("")))
    rows = trace.select(
        "case", "event_type", tx.alias("tx_key"), (tx == "").alias("blank_tx"),
        F.col("event_type").isin(*R.DANGER_TYPES, *R.IMPACT_TYPES).alias("direct"),
        _expected_alerts(F.col("event_type")).alias("expected"),
    )
    raised = alerts.select("case", "type", F.lower(F.coalesce("tx_hash", F.lit(""))).alias("tx_key"))
    # types are few; the sets of a case are made of those of its transactions, so alerts are built once
    per_tx = raised.groupBy("case", "tx_key").agg(F.collect_set("type").alias("tx_types"))
    by_tx = per_tx.where(F.col("tx_key") != "")
    by_case = per_tx.groupBy("case").agg(F.array_distinct(F.flatten(F.collect_set("tx_types"))).alias("case_types"))
    joined = rows.join(by_tx, ["case", "tx_key"], "left").join(by_case, "case", "left")
    on_tx = F.when(F.size("expected") == 0, F.col("tx_types").isNotNull()).otherwise(F.arrays_overlap("expected", "tx_types"))
    on_case = F.arrays_overlap("expected", "case_types")
    return joined.select(
        "case", "event_type", "blank_tx", "direct",
        F.coalesce(F.when(F.col("blank_tx"), on_case).otherwise(on_tx), F.lit(False)).alias("alerted"),
    )


LOG_COUNTS = [
    "all_trace_records", "target_log_records", "detected_target_log_records", "direct_violation_target_log_records",
    "detected_direct_violation_log_records", "early_evidence_target_log_records", "canonical_target_log_records",
    "detected_canonical_target_log_records", "semantic_marker_target_records", "detected_semantic_marker_records",
    "context_log_records", "support_only_context_records",
]


def log_level_metrics(flags: DataFrame) -> DataFrame:
    """Record counts and recalls per case, and over all cases (``case`` NULL), in one pass."""
    target = F.col("direct") | F.col("alerted")
    canonical = target & ~F.col("blank_tx")
    marker = target & F.col("blank_tx")
    counts = [
        F.lit(True), target, target & F.col("alerted"), F.col("direct"), F.col("direct") & F.col("alerted"),
        ~F.col("direct") & F.col("alerted"), canonical, canonical & F.col("alerted"), marker, marker & F.col("alerted"),
        ~F.col("direct"), ~F.col("direct") & ~F.col("alerted"),
    ]
    table = flags.rollup("case").agg(*[F.count_if(c).alias(n) for n, c in zip(LOG_COUNTS, counts, strict=True)])
    rates = {
        "target_recall": ("detected_target_log_records", "target_log_records"),
        "direct_violation_recall": ("detected_direct_violation_log_records", "direct_violation_target_log_records"),
        "canonical_target_recall": ("detected_canonical_target_log_records", "canonical_target_log_records"),
        "incident_log_warning_recall": ("detected_target_log_records", "all_trace_records"),
    }
    for name, (part, whole) in rates.items():
        interval = wilson(F.col(part), F.col(whole))
        table = table.withColumn(name, T.rate(F.col(part), F.col(whole)))
        table = table.withColumn(f"{name}_lower", interval["lower"]).withColumn(f"{name}_upper", interval["upper"])
    return table


def event_type_counts(flags: DataFrame) -> DataFrame:
    """Target and detected target records per case and event type, and over all cases."""
    target = flags.where(F.col("direct") | F.col("alerted"))
    return target.groupingSets([["case", "event_type"], ["event_type"]], "case", "event_type").agg(
        F.count(F.lit(1)).alias("target_records"), F.count_if("alerted").alias("detected_records")
    )


def _status_bucket(status: Column) -> Column:
    return (
        F.when(status.isin(*R.STRICT_STATUSES), F.lit("strict_benign")).when(status.isin(*R.UNKNOWN_STATUSES), F.lit("unknown"))
        .when(status.isin(*R.REVIEW_STATUSES), F.lit("review")).otherwise(F.lit("other"))
    )


def benign_metrics(samples: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Strict, unknown and review counts of benign samples by row and by transaction.

    With the alerts of the replayed samples (``sample_id``), strict false positives are counted too.
    """
    bucket = _status_bucket(F.col("verification_status"))
    rows = samples.select(
        "sample_id", T.first_text(F.col("tx_hash"), F.col("sample_id")).alias("tx"), bucket.alias("bucket")
    )
    if alerts is None:
        rows = rows.withColumn("alerted", F.lit(False))
    else:
        hit = alerts.select("sample_id").distinct().withColumn("alerted", F.lit(True))
        rows = rows.join(hit, "sample_id", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    strict = F.col("bucket") == "strict_benign"
    per_tx = rows.groupBy("tx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(strict).alias("strict"), F.count_if(F.col("bucket") == "unknown").alias("unknown"),
        F.count_if(F.col("bucket") == "review").alias("review"), F.count_if(strict & F.col("alerted")).alias("fp"),
    )
    return per_tx.agg(
        F.sum("n").alias("sample_rows"), F.count(F.lit(1)).alias("unique_txs"), F.sum("strict").alias("strict_benign_rows"),
        F.sum("unknown").alias("unknown_rows"), F.sum("review").alias("review_rows"),
        F.count_if(F.col("strict") == F.col("n")).alias("strict_benign_txs"), F.count_if(F.col("unknown") > 0).alias("unknown_txs"),
        F.count_if(F.col("review") > 0).alias("review_txs"), F.sum("fp").alias("strict_fp_rows"),
        F.count_if(F.col("fp") > 0).alias("strict_fp_txs"),
    )


def combined_precision(log_metrics: DataFrame, benign: DataFrame) -> DataFrame:
    """Strict precision, its interval and the floor that counts review rows as false positives."""
    total = log_metrics.where(F.col("case").isNull()).select("detected_target_log_records", "target_log_records", "all_trace_records")
    both = one_row(total, benign)
    tp, fp, review = F.col("detected_target_log_records"), F.col("strict_fp_rows"), F.col("review_rows")
    return both.select(
        tp.alias("tp_target_logs"), fp.alias("confirmed_strict_fp_logs"), review.alias("review_logs"),
        (F.col("target_log_records") - tp).alias("fn_target_logs"),
        (F.col("all_trace_records") - tp).alias("fn_all_semantic_logs"),
        (F.col("strict_benign_rows") - fp).alias("strict_tn_logs"),
        T.rate(tp, tp + fp).alias("strict_precision"), wilson(tp, tp + fp)["lower"].alias("strict_precision_lower"),
        T.rate(tp, tp + fp + review).alias("conservative_precision_floor"),
    )


def impact_txs(trace: DataFrame, keys: list[str]) -> DataFrame:
    has_tx = F.coalesce("tx_hash", F.lit("")) != ""
    return trace.where(F.col("event_type").isin(*R.IMPACT_TYPES) & has_tx).select(*keys, "tx_hash").distinct()


def detection_effectiveness(trace: DataFrame, constraints: DataFrame, result: Replay) -> DataFrame:
    """Per case: impact transactions, those localized, alerts and accused accounts."""
    impacts = impact_txs(trace, ["case"])
    localized = result.localized.select("case", "tx_hash", F.lit(1).alias("hit")).distinct()
    per_case = impacts.join(localized, ["case", "tx_hash"], "left").groupBy("case").agg(
        F.count(F.lit(1)).alias("positive_impact_txs"), F.count("hit").alias("detected_impact_txs")
    )
    alerts = result.alerts.groupBy("case").agg(F.count(F.lit(1)).alias("alert_count"))
    actors = result.actors.groupBy("case").agg(F.count(F.lit(1)).alias("attacker_candidate_count"))
    table = failure_class(constraints)
    for part in (per_case, alerts, actors):
        table = table.join(part, "case", "left")
    counts = ["positive_impact_txs", "detected_impact_txs", "alert_count", "attacker_candidate_count"]
    return table.select("case", "failure_class", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).withColumn(
        "case_detected", F.col("alert_count") > 0
    )


def baseline_metrics(effectiveness: DataFrame) -> DataFrame:
    """Case and transaction recall of two baselines and of the replay."""
    cases = F.count(F.lit(1))
    impacts = F.sum("positive_impact_txs")
    whole = effectiveness.agg(
        cases.alias("positive_cases"), impacts.alias("positive_impact_txs"), F.count_if(F.col("positive_impact_txs") > 0).alias("visible"),
        F.count_if("case_detected").alias("detected"), F.sum("detected_impact_txs").alias("localized"),
    )
    zero = F.lit(0).cast("long")
    rows = F.array(*[
        F.struct(F.lit(name).alias("baseline"), c.alias("cases"), t.alias("txs"))
        for name, c, t in [
            ("abi_only_parser", zero, zero), ("tx_level_only_impact_visibility", F.col("visible"), F.col("positive_impact_txs")),
            ("full_replay", F.col("detected"), F.col("localized")),
        ]
    ])
    spread = whole.select("positive_cases", "positive_impact_txs", F.explode(rows).alias("b"))
    return spread.select(
        F.col("b.baseline").alias("baseline"), "positive_cases", F.col("b.cases").alias("detected_cases"),
        F.coalesce(T.rate(F.col("b.cases"), F.col("positive_cases")), F.lit(0.0)).alias("case_recall"), "positive_impact_txs",
        F.col("b.txs").alias("detected_impact_txs"),
        F.coalesce(T.rate(F.col("b.txs"), F.col("positive_impact_txs")), F.lit(0.0)).alias("tx_recall"),
    )


def _first_event(wanted: Column, order: Column, payload: Column) -> Column:
    return F.min_by(payload, F.when(wanted, order))


def lead_time(trace: DataFrame) -> DataFrame:
    """Per case: first dangerous event, first impact with a transaction, and the time between them."""
    stamp = F.coalesce("block_timestamp", F.lit(0).cast("long"))
    tx = F.coalesce("tx_hash", F.lit(""))
    order = F.struct(
        stamp.alias("t"), F.coalesce("transaction_index", F.lit(0)).alias("i"), F.coalesce("log_index", F.lit(0)).alias("l"), tx.alias("h"),
        F.coalesce("input_ord", F.lit(0)).alias("o"),
    )
    seen = F.struct(
        F.col("event_type").alias("event_type"), tx.alias("tx_hash"), stamp.alias("at"), F.col("block_number").alias("block"),
        T.first_text(F.col("topic0"), F.col("decoded.selector")).alias("marker"),
    )
    found = trace.groupBy("case").agg(
        _first_event(F.col("event_type").isin(*R.DANGER_TYPES), order, seen).alias("d"),
        _first_event(F.col("event_type").isin(*R.IMPACT_TYPES) & (tx != ""), order, seen).alias("i"),
    )
    both = F.col("d").isNotNull() & F.col("i").isNotNull()
    same_block = F.coalesce(F.nullif(F.col("d.block"), F.lit(0)), F.lit(-1)) == F.coalesce(F.nullif(F.col("i.block"), F.lit(0)), F.lit(-2))
    status = (
        F.when(~both, F.lit("not_observed"))
        .when((F.col("d.tx_hash") != "") & (F.col("d.tx_hash") == F.col("i.tx_hash")), F.lit("same_tx"))
        .when(same_block, F.lit("same_block"))
        .when(F.col("d.tx_hash") == "", F.lit("semantic_marker_only"))
        .when(F.col("d.at") < F.col("i.at"), F.lit("pre_attack_observed"))
        .otherwise(F.lit("not_observed"))
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return found.select(
        "case", status.alias("lead_time_status"),
        F.when(both, F.greatest(F.lit(0), F.col("i.at") - F.col("d.at"))).alias("lead_time_seconds"),
        text("d.event_type").alias("first_dangerous_event_type"), text("d.tx_hash").alias("first_dangerous_tx_hash"),
        text("d.marker").alias("first_dangerous_topic0_or_selector"), F.col("d.at").alias("first_dangerous_block_timestamp"),
        text("i.event_type").alias("first_impact_event_type"), text("i.tx_hash").alias("first_impact_tx_hash"),
        text("i.marker").alias("first_impact_topic0_or_selector"), F.col("i.at").alias("first_impact_block_timestamp"),
    )


def gold_actors(trace: DataFrame, cases: DataFrame | None, keys: list[str]) -> DataFrame:
    """Known accounts: (keys, address, role) from impact events and from known attacker entries of ``cases``."""
    impacts = trace.where(F.col("event_type").isin(*R.IMPACT_TYPES))
    of_type = lambda kind, field: F.struct(
        F.lit(field).alias("role"), F.when(F.col("event_type") == kind, T.strict_address(F.col(f"decoded.{field}"))).alias("address")
    )
    fields = [of_type(R.LIQUIDATE, "liquidator"), *[of_type(R.BORROW, f) for f in ("borrower", "actor", "account")]]
    named = impacts.select(*keys, F.explode(F.array(*fields)).alias("a")).select(*keys, F.col("a.address").alias("address"), F.col("a.role").alias("role"))
    if cases is not None:
        known = cases.select("case", F.explode(F.map_entries("known_txs")).alias("e")).where(F.col("e.key").contains("attacker"))
        known = known.select("case", T.strict_address(F.col("e.value")).alias("address"), F.col("e.key").alias("role"))
        named = named.unionByName(known if keys == ["case"] else trace.select(*keys).distinct().join(known, "case").select(*keys, "address", "role"))
    return named.where(F.coalesce("address", F.lit("")) != "").distinct()


def actor_localization(trace: DataFrame, result: Replay, cases: DataFrame | None = None, at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per case: known, accused and matched accounts, recall, precision and hit@k."""
    gold = gold_actors(trace, cases, ["case"]).select("case", "address").distinct().withColumn("g", F.lit(1))
    accused = result.actors.select("case", T.strict_address(F.col("address")).alias("address"), "first_mark").where(F.col("address") != "")
    per_address = accused.groupBy("case", "address").agg(F.count(F.lit(1)).alias("listed"), F.min("first_mark").alias("first_mark"))
    joined = gold.join(per_address, ["case", "address"], "full_outer")
    counts = joined.groupBy("case").agg(
        F.count("g").alias("known_actor_count"),
        F.coalesce(F.sum("listed"), F.lit(0)).alias("predicted_candidate_count"),
        F.count_if(F.col("g").isNotNull() & F.col("listed").isNotNull()).alias("matched_actor_count"),
        F.count("listed").alias("_distinct_predicted"),
    )
    leaders = first_n(accused, ["case"], ["first_mark", "address"], max(at), "rank").join(gold, ["case", "address"], "left")
    hits = leaders.groupBy("case").agg(*[F.bool_or(F.col("g").isNotNull() & (F.col("rank") <= k)).alias(f"hit_at_{k}") for k in at])
    return counts.join(hits, "case", "left").select(
        "case", "known_actor_count", "predicted_candidate_count", "matched_actor_count",
        T.rate(F.col("matched_actor_count"), F.col("known_actor_count")).alias("actor_recall"),
        T.rate(F.col("matched_actor_count"), F.col("_distinct_predicted")).alias("candidate_precision"),
        *[F.coalesce(f"hit_at_{k}", F.lit(False)).alias(f"hit_at_{k}") for k in at],
    )


def role_coverage(trace: DataFrame, result: Replay, cases: DataFrame | None = None) -> DataFrame:
    """Roles of each known account that the replay accused too."""
    accused = result.actors.select("case", T.strict_address(F.col("address")).alias("address")).distinct()
    matched = gold_actors(trace, cases, ["case"]).join(accused, ["case", "address"], "left_semi")
    return matched.groupBy("case", "address").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def _by_variant(rows: DataFrame, **seen: Column) -> DataFrame:
    """A copy of each row for every variant whose condition holds."""
    named = {"full": FULL, "boundary": BOUNDARY_ONLY, "impact": IMPACT_ONLY}
    return rows.select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(named[n])) for n, c in seen.items()]))).alias("variant"))


def ablation(
    trace: DataFrame, constraints: DataFrame, samples: DataFrame, cases: DataFrame | None = None, sample_alerts: DataFrame | None = None,
    result: Replay | None = None,
) -> DataFrame:
    """One row per variant: recalls over the cases and warnings over the benign samples.

    ``sample_alerts`` are the alerts of the replayed samples (``sample_id``), which the full replay warns of.

    One replay (``result``) serves all variants. Without impacts only boundary alerts are left. Without boundary events no asset is
    bad, so of all alerts only borrows on an inflated value are left. Without semantics there are none.
    """
    spark = trace.sparkSession
    keys = ["variant", "case"]
    variants = R.inline(spark, [(v,) for v in VARIANTS], "variant string")
    result = result or replay(trace, constraints)
    always = F.lit(True)
    inflated = F.array_contains(F.from_json(F.get_json_object("details", "$.reasons"), "array<string>"), INFLATED)
    of_impact = (F.col("record_role") == "borrow") & F.coalesce(inflated, F.lit(False))
    alerts = _by_variant(result.alerts, full=always, boundary=F.col("record_role") == "oracle_boundary", impact=of_impact)
    accusing = _by_variant(result.localized, full=always, impact=of_impact)
    borrows = _by_variant(result.borrows, full=always, impact=of_impact)
    actors = actor_candidates(account_marks(borrows, result.liquidations.withColumn("variant", F.lit(FULL)), keys), keys)
    impacts = impact_txs(trace, ["case"])
    order = F.struct(
        F.coalesce("block_timestamp", F.lit(0).cast("long")).alias("t"), F.coalesce("transaction_index", F.lit(0)).alias("i"),
        F.coalesce("log_index", F.lit(0)).alias("l"), F.coalesce("tx_hash", F.lit("")).alias("h"),
    )
    has_tx = F.coalesce("tx_hash", F.lit("")) != ""
    early = trace.groupBy("case").agg(
        F.count(F.lit(1)).alias("records"),
        F.min(F.when(F.col("event_type").isin(*R.DANGER_TYPES) & has_tx, order)).alias("d"),
        F.min(F.when(F.col("event_type").isin(*R.IMPACT_TYPES) & has_tx, order)).alias("i"),
    ).select("case", "records", F.coalesce(F.col("d.t") < F.col("i.t"), F.lit(False)).alias("early"))
    localized = accusing.select(*keys, "tx_hash").distinct().join(impacts, ["case", "tx_hash"], "left_semi")
    gold = gold_actors(trace, cases, ["case"]).select("case", "address").distinct()
    accused = actors.select(*keys, T.strict_address(F.col("address")).alias("address")).where(F.col("address") != "").distinct()
    per_case = [
        alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts")),
        localized.groupBy(*keys).agg(F.count(F.lit(1)).alias("localized")),
        accused.groupBy(*keys).agg(F.count(F.lit(1)).alias("accused")),
        accused.join(gold, ["case", "address"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("matched")),
    ]
    spine = failure_class(constraints).select("case", F.explode(F.array(*[F.lit(v) for v in VARIANTS])).alias("variant"))
    for part in per_case:
        spine = spine.join(part, keys, "left")
    spine = spine.join(early, "case", "left").join(impacts.groupBy("case").agg(F.count(F.lit(1)).alias("impacts")), "case", "left").join(
        gold.groupBy("case").agg(F.count(F.lit(1)).alias("known")), "case", "left")
    sees_early = F.col("variant").isin(FULL, BOUNDARY_ONLY) & F.coalesce("early", F.lit(False))
    attack = F.coalesce("alerts", F.lit(0)) > 0
    observed = F.when(F.col("variant") == TOPIC_ONLY, F.coalesce("records", F.lit(0)) > 0).otherwise(
        attack | sees_early | ((F.col("variant") == IMPACT_ONLY) & (F.coalesce("impacts", F.lit(0)) > 0)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    table = spine.groupBy("variant").agg(
        F.count(F.lit(1)).alias("positive_cases"), F.count_if(observed).alias("evidence_observed_cases"),
        F.count_if(attack).alias("attack_alert_cases"), F.count_if(F.coalesce("localized", F.lit(0)) > 0).alias("replayable_attack_cases"),
        total("impacts").alias("positive_impact_txs"), total("localized").alias("detected_impact_txs"),
        F.count_if(sees_early).alias("pre_attack_tx_evidence_cases"), total("known").alias("known_actors"),
        total("matched").alias("matched_actors"), total("accused").alias("predicted_actor_candidates"),
    )
    none = samples.select("sample_id").limit(0)
    hits = (none if sample_alerts is None else sample_alerts.select("sample_id")).distinct().withColumn("_alerted", F.lit(True))
    warned = samples.join(hits, "sample_id", "left").agg(
        F.count(F.lit(1)).alias("benign_materialized_rows"),
        F.count_if(F.col("verification_status").isin(*R.STRICT_STATUSES)).alias("strict_benign_rows"),
        F.count_if(F.col("replay_event_type").isin(*R.IMPACT_TYPES)).alias(IMPACT_ONLY),
        F.count_if(F.coalesce("abi_available", F.lit(False))).alias(ABI_ONLY),
        F.count(F.lit(1)).alias(TOPIC_ONLY),
        F.count_if(F.coalesce("scope_class", F.lit("")).startswith("S")).alias(BOUNDARY_ONLY),
        F.count("_alerted").alias(FULL),
    )
    warnings = warned.select(
        "benign_materialized_rows", "strict_benign_rows",
        F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("benign_warning_rows")) for v in VARIANTS])).alias("w"),
    ).select("w.variant", "w.benign_warning_rows", "benign_materialized_rows", "strict_benign_rows")
    rates = {
        "attack_alert_case_recall": ("attack_alert_cases", "positive_cases"), "replayable_case_recall": ("replayable_attack_cases", "positive_cases"),
        "impact_tx_recall": ("detected_impact_txs", "positive_impact_txs"), "actor_recall": ("matched_actors", "known_actors"),
        "benign_warning_rate": ("benign_warning_rows", "benign_materialized_rows"),
    }
    out = variants.join(table, "variant", "left").join(warnings, "variant", "left")
    return out.select("*", *[T.rate(F.col(a), F.col(b)).alias(n) for n, (a, b) in rates.items()])


def benign_crosstab(samples: DataFrame, field: str) -> DataFrame:
    """Status counts of benign samples by one field."""
    bucket = _status_bucket(F.col("verification_status"))
    key = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("unknown"))
    names = ("strict_benign", "unknown", "review", "other")
    return samples.groupBy(key.alias(field)).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(bucket == n).alias(n) for n in names]
    ).withColumn("strict_rate", T.rate(F.col("strict_benign"), F.col("total")))


def exclusion_reason() -> Column:
    status, event = F.col("verification_status"), F.col("replay_event_type")
    readable = F.coalesce(F.col("source_available") & F.col("abi_available"), F.lit(False))
    scope_log = F.coalesce(event == "BENIGN_ORACLE_SCOPE_LOG", F.lit(False))
    unknown = (
        F.when(scope_log & ~readable, F.lit("generic_oracle_scope_log_without_source_or_abi"))
        .when(scope_log, F.lit("generic_oracle_scope_log_not_bound_to_replay_semantics"))
        .otherwise(F.lit("materialized_but_insufficient_replay_semantics"))
    )
    review = F.when(F.coalesce(event == R.FEED_SET, F.lit(False)), F.lit("feed_binding_log_with_incomplete_actual_feed_identity")).otherwise(
        F.lit("review_required_before_fp_label"))
    return F.when(status.isin(*R.UNKNOWN_STATUSES), unknown).when(status.isin(*R.REVIEW_STATUSES), review).otherwise(F.lit("not_excluded"))


def reason_table(samples: DataFrame, status: str) -> DataFrame:
    """Samples of one status by exclusion reason, with counts per case and per scope class."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = samples.where(F.col("verification_status") == status).select(
        exclusion_reason().alias("reason"), name("case_related_to").alias("c"), name("scope_class").alias("s")
    )
    cells = rows.groupBy("reason", "c", "s").agg(F.count(F.lit(1)).alias("n"))
    by_case = cells.groupBy("reason", "c").agg(F.sum("n").alias("n")).groupBy("reason").agg(
        F.sum("n").alias("count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("case_counts"))
    by_scope = cells.groupBy("reason", "s").agg(F.sum("n").alias("n")).groupBy("reason").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("scope_counts"))
    return by_case.join(by_scope, "reason")


def benign_replay_summary(samples: DataFrame, result: Replay) -> DataFrame:
    """Alerts raised when benign samples are replayed, and rows that need review."""
    alerts = result.alerts.agg(F.count(F.lit(1)).alias("replay_alert_count"))
    needs = samples.agg(
        F.count(F.lit(1)).alias("sample_rows"), F.count_if(F.col("verification_status").isin(*R.REVIEW_STATUSES)).alias("needs_review_count"))
    return one_row(needs, alerts)


