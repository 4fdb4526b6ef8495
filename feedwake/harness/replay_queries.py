"""Replay of derived traces and the metrics over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake import schemas as S
from feedwake.harness import views as V
from feedwake.plans import evaluate as E
from feedwake.plans.replay import Replay, replay

QUERIES = {}
SQL = {}
HEARTBEAT = 10_800


def account(number) -> object:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 40, "0"))


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per chain: signups set feeds, views report answers, the rest is lending activity."""
    logs = V.logs(spark, folder)
    kind = (
        F.when(F.col("topic0") == "signup", R.FEED_SET).when(F.col("topic0") == "view", R.ANSWER)
        .when(F.col("topic0") == "click", R.SUPPLY).when(F.col("topic0") == "purchase", R.BORROW).otherwise(R.LIQUIDATE)
    )
    stamp = F.unix_seconds("block_time")
    who = account(F.col("actor").cast("long"))
    is_kind = lambda name, value: F.when(F.col("event_type") == name, value)
    impact = F.col("event_type").isin(*R.IMPACT_TYPES)
    flow = F.struct(
        F.col("tx_hash").alias("tx_hash"), F.col("log_index").cast("long").alias("log_index"), F.col("contract_address").alias("token_address"), F.col("who").alias("from"),
        F.lit("").alias("to"), F.col("value").cast("string").alias("amount_raw"))
    fields = {
        "asset": F.when(~impact, F.col("asset")),
        "actual_feed": is_kind(R.FEED_SET, F.concat(F.lit("F"), (F.col("k") % 7).cast("string"))),
        "expected_feed": is_kind(R.FEED_SET, F.lit("F0")),
        "updated_at": is_kind(R.ANSWER, F.col("stamp") - F.floor(F.col("value") * 100).cast("long")),
        "supplier": is_kind(R.SUPPLY, F.col("who")),
        "amount": is_kind(R.SUPPLY, F.col("value").cast("string")),
        "borrower": is_kind(R.BORROW, F.col("who")),
        "liquidator": is_kind(R.LIQUIDATE, F.col("who")),
        "actor": F.col("who"),
        "collateral_asset": F.when(impact, F.col("asset")),
        "borrow_asset": is_kind(R.BORROW, F.concat(F.lit("A"), ((F.col("k") + 1) % 5).cast("string"))),
        "borrow_amount": is_kind(R.BORROW, F.col("value").cast("string")),
        "transfer_flow_summary": F.when((F.col("k") % 9 == 0) & (F.col("blockchain") != "ethereum"), F.array(flow)),
    }
    rows = logs.withColumn("event_type", kind).withColumn("stamp", stamp).withColumn("who", who)
    decoded = F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in S.DECODED_FIELDS.items()])
    return rows.select(
        F.col("blockchain").alias("case"), "event_type", "block_number", F.col("stamp").alias("block_timestamp"),
        F.lit(0).cast("long").alias("transaction_index"), F.lit(0).cast("long").alias("log_index"), "tx_hash",
        F.col("contract_address").alias("address"), F.col("topic0"), F.col("block_number").alias("input_ord"), decoded.alias("decoded"),
    )


def constraints(spark: SparkSession) -> DataFrame:
    rows = []
    for chain in V.CHAINS:
        for asset in ("A0", "A1"):
            rows.append((chain, f"FEED_{asset}", "feed_mismatch", asset, None, "F0", None, None, None, None, "critical"))
        rows.append((chain, "FRESH_A2", "stale_oracle", "A2", None, None, None, None, None, HEARTBEAT, "critical"))
    return R.inline(spark, rows, S.CONSTRAINTS)


def cases(spark: SparkSession) -> DataFrame:
    rows = [(c, c, c, f"0x{i + 1:040x}") for i, c in enumerate(V.CHAINS)]
    table = R.inline(spark, rows, "case string, name string, chain string, attacker string")
    return table.select("case", "name", "chain", F.create_map(F.lit("attacker_eoa"), F.col("attacker")).alias("known_txs"))


def result(spark: SparkSession, folder: str) -> Replay:
    return replay(trace(spark, folder), constraints(spark))


def played(spark: SparkSession, folder: str) -> tuple[DataFrame, Replay]:
    """The traces and their replay."""
    events = trace(spark, folder)
    return events, replay(events, constraints(spark))


V.register_view_sql("h_trace", """h_trace AS (
  SELECT chain AS kase, block_number AS pos, us // 1000000 AS stamp, tx_hash, topic0, asset, k, value,
         CASE topic0 WHEN 'signup' THEN 'ORACLE_FEED_SET' WHEN 'view' THEN 'ANSWER_UPDATED' WHEN 'click' THEN 'SUPPLY'
              WHEN 'purchase' THEN 'BORROW' ELSE 'LIQUIDATE' END AS event_type,
         '0x' || lpad(lower(to_hex(CAST(actor AS BIGINT))), 40, '0') AS who, 'A' || CAST((k + 1) % 5 AS VARCHAR) AS borrow_asset
  FROM h_logs)""")
V.register_view_sql("h_broken", f"""h_broken AS (
  SELECT *, 'feed_mismatch' AS kind, 'FEED_' || asset AS id FROM h_trace
  WHERE event_type = 'ORACLE_FEED_SET' AND asset IN ('A0', 'A1') AND k % 7 <> 0
  UNION ALL
  SELECT *, 'stale_oracle' AS kind, 'FRESH_A2' AS id FROM h_trace
  WHERE event_type = 'ANSWER_UPDATED' AND asset = 'A2' AND CAST(floor(value * 100) AS BIGINT) > {HEARTBEAT})""")
V.register_view_sql("h_loose", """h_loose AS (
  SELECT kase, asset, min(pos) FILTER (WHERE kind = 'feed_mismatch') AS bad_feed, min(pos) FILTER (WHERE kind = 'stale_oracle') AS bad_stale
  FROM (SELECT kase, asset, pos, 'feed_mismatch' AS kind FROM h_trace WHERE event_type = 'ORACLE_FEED_SET'
        UNION ALL SELECT kase, asset, pos, kind FROM h_broken WHERE event_type = 'ANSWER_UPDATED') GROUP BY 1, 2)""")
V.register_view_sql("h_strict", """h_strict AS (
  SELECT kase, asset, min(pos) AS first_bad, min(pos) FILTER (WHERE kind = 'stale_oracle') AS first_stale FROM h_broken GROUP BY 1, 2)""")
V.register_view_sql("h_boundary_alerts", """h_boundary_alerts AS (
  SELECT kase AS "case", id, kind AS type, 'critical' AS severity, tx_hash, pos AS block_number, 'oracle_boundary' AS record_role,
         '' AS reasons FROM h_broken)""")
V.register_view_sql("h_borrow_alerts", """h_borrow_alerts AS (
  SELECT t.kase AS "case", 'BORROW_AFTER_ORACLE_VIOLATION' AS id, 'attacker_localization' AS type, 'critical' AS severity, t.tx_hash,
         t.pos AS block_number, 'borrow' AS record_role,
         CASE WHEN l.bad_feed < t.pos AND l.bad_stale < t.pos THEN 'feed_mismatch,stale_oracle'
              WHEN l.bad_feed < t.pos THEN 'feed_mismatch' ELSE 'stale_oracle' END AS reasons
  FROM h_trace t JOIN h_loose l ON l.kase = t.kase AND l.asset = t.asset
  WHERE t.event_type = 'BORROW' AND (l.bad_feed < t.pos OR l.bad_stale < t.pos))""")
V.register_view_sql("h_liquidation_alerts", """h_liquidation_alerts AS (
  SELECT t.kase AS "case", 'LIQUIDATION_AFTER_ORACLE_VIOLATION' AS id, 'attacker_localization' AS type, 'high' AS severity, t.tx_hash,
         t.pos AS block_number, 'liquidation' AS record_role, '' AS reasons
  FROM h_trace t JOIN h_loose l ON l.kase = t.kase AND l.asset = t.asset WHERE t.event_type = 'LIQUIDATE' AND l.bad_feed < t.pos)""")
V.register_view_sql("h_rs", """h_rs AS (
  SELECT *, coalesce(sum(CASE WHEN value > 0 THEN value END) OVER w, 0) AS prior, min(pos) OVER (PARTITION BY kase, who, asset) AS first_pos
  FROM (SELECT t.*, s.first_stale FROM h_trace t JOIN h_strict s ON s.kase = t.kase AND s.asset = t.asset
        WHERE t.event_type = 'SUPPLY' AND s.first_bad < t.pos)
  WINDOW w AS (PARTITION BY kase, who, asset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
V.register_view_sql("h_picked", """h_picked AS (
  SELECT s.kase, s.pos, CASE WHEN s.first_stale < i.pos THEN 'stale_oracle' ELSE 'bad_oracle' END AS prefix,
         s.pos = s.first_pos AS is_first, s.value > 0 AND (s.prior <= 0 OR s.value / s.prior >= 0.1) AS is_material,
         s.pos = max(s.pos) OVER (PARTITION BY i.kase, i.pos) AS is_latest
  FROM h_rs s JOIN h_trace i ON i.kase = s.kase AND i.who = s.who AND i.asset = s.asset AND i.pos > s.pos
  WHERE i.event_type IN ('BORROW', 'LIQUIDATE'))""")
V.register_view_sql("h_supply_alerts", """h_supply_alerts AS (
  SELECT t.kase AS "case", 'COLLATERAL_ENABLING_SUPPLY' AS id,
         CASE WHEN l.bad_stale < t.pos THEN 'collateral_enabling_supply_under_stale_oracle'
              ELSE 'collateral_enabling_supply_under_bad_oracle' END AS type, 'high' AS severity, t.tx_hash, t.pos AS block_number,
         'early_evidence' AS record_role, r.reasons
  FROM (SELECT kase, pos, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (
          SELECT kase, pos, prefix || ':first_risky_collateral_supply' AS reason FROM h_picked WHERE is_first
          UNION ALL SELECT kase, pos, prefix || ':latest_topup_before_impact' FROM h_picked WHERE is_latest
          UNION ALL SELECT kase, pos, prefix || ':material_collateral_increase_>=10%' FROM h_picked WHERE is_material) GROUP BY 1, 2) r
  JOIN h_trace t ON t.kase = r.kase AND t.pos = r.pos LEFT JOIN h_loose l ON l.kase = t.kase AND l.asset = t.asset)""")
V.register_view_sql("h_alerts", """h_alerts AS (
  SELECT * FROM h_boundary_alerts UNION ALL SELECT * FROM h_borrow_alerts UNION ALL SELECT * FROM h_liquidation_alerts
  UNION ALL SELECT * FROM h_supply_alerts)""")
V.register_view_sql("h_marks", """h_marks AS (
  SELECT t.kase, t.who AS address, CASE t.event_type WHEN 'BORROW' THEN 'borrower' ELSE 'liquidator' END AS role, t.tx_hash, t.pos
  FROM h_trace t JOIN (SELECT "case", block_number FROM h_borrow_alerts UNION ALL SELECT "case", block_number FROM h_liquidation_alerts) a
    ON a."case" = t.kase AND a.block_number = t.pos)""")
V.register_view_sql("h_gold", """h_gold AS (
  SELECT DISTINCT kase, who AS address FROM h_trace WHERE event_type IN ('BORROW', 'LIQUIDATE')
  UNION SELECT kase, address FROM (VALUES ('ethereum', '0x0000000000000000000000000000000000000001'),
    ('bnb', '0x0000000000000000000000000000000000000002'), ('base', '0x0000000000000000000000000000000000000003'),
    ('avalanche_c', '0x0000000000000000000000000000000000000004')) g(kase, address))""")

BASE = ["h_logs", "h_trace", "h_broken", "h_loose"]
SUPPLY_VIEWS = [*BASE, "h_strict", "h_rs", "h_picked", "h_supply_alerts"]
ALERT_VIEWS = [*SUPPLY_VIEWS, "h_boundary_alerts", "h_borrow_alerts", "h_liquidation_alerts", "h_alerts"]


def flat_alerts(alerts: DataFrame) -> DataFrame:
    listed = F.col("type").isin(*R.EARLY_ALERTS) | (F.col("record_role") == "borrow")
    reasons = F.from_json(F.get_json_object("details", "$.reasons"), "array<string>")
    return alerts.select(
        "case", "id", "type", "severity", "tx_hash", "block_number", "record_role",
        F.when(listed, F.array_join(reasons, ",")).otherwise(F.lit("")).alias("reasons"),
    )


def _alerts(part: str):
    return lambda spark, folder: flat_alerts(getattr(result(spark, folder), part))


for _name, _role, _view, _views in [
    ("replay_boundary_alerts", "boundary", "h_boundary_alerts", [*BASE, "h_boundary_alerts"]),
    ("replay_borrow_alerts", "borrows", "h_borrow_alerts", [*BASE, "h_borrow_alerts"]),
    ("replay_liquidation_alerts", "liquidations", "h_liquidation_alerts", [*BASE, "h_liquidation_alerts"]),
    ("replay_supply_alerts", "supplies", "h_supply_alerts", SUPPLY_VIEWS),
]:
    QUERIES[_name] = _alerts(_role)
    SQL[_name] = V.with_views(_views, f"SELECT * FROM {_view}")

QUERIES["replay_all_alerts"] = lambda spark, folder: flat_alerts(result(spark, folder).alerts)
SQL["replay_all_alerts"] = V.with_views(ALERT_VIEWS, "SELECT * FROM h_alerts")


def _actors(spark, folder):
    return result(spark, folder).actors.select(
        "case", "address", F.array_join("roles", ",").alias("roles"), "tx_count", "mark_count",
        F.col("first_mark.pos.block_number").alias("first_block"),
    )


QUERIES["replay_actors"] = _actors
SQL["replay_actors"] = V.with_views([*BASE, "h_borrow_alerts", "h_liquidation_alerts", "h_marks"], """
SELECT kase AS "case", address, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT tx_hash) AS tx_count,
       count(*) AS mark_count, min(pos) AS first_block FROM h_marks GROUP BY 1, 2""")


def _marks(spark, folder):
    return result(spark, folder).marks.select("case", "address", "role", "tx_hash", F.col("pos.block_number").alias("block_number"))


QUERIES["replay_actor_marks"] = _marks
SQL["replay_actor_marks"] = V.with_views([*BASE, "h_borrow_alerts", "h_liquidation_alerts", "h_marks"],
                                         'SELECT kase AS "case", address, role, tx_hash, pos AS block_number FROM h_marks')


def _state(spark, folder):
    return result(spark, folder).state.select(
        "case", "asset_key", "kind", F.col("first_bad.block_number").alias("first_bad_block"), F.col("last_seen.block_number").alias("last_block"),
    )


QUERIES["replay_asset_state"] = _state
SQL["replay_asset_state"] = V.with_views(BASE, """
SELECT kase AS "case", lower(asset) AS asset_key, kind, min(pos) AS first_bad_block, max(pos) AS last_block
FROM (SELECT kase, asset, pos, 'feed_mismatch' AS kind FROM h_trace WHERE event_type = 'ORACLE_FEED_SET'
      UNION ALL SELECT kase, asset, pos, kind FROM h_broken WHERE event_type = 'ANSWER_UPDATED') GROUP BY 1, 2, 3""")

QUERIES["lead_time"] = lambda spark, folder: E.lead_time(trace(spark, folder))
SQL["lead_time"] = V.with_views(["h_logs", "h_trace"], """
, d AS (SELECT kase, arg_min(struct_pack(event_type, tx_hash, stamp, pos, topic0), (stamp, tx_hash, pos)) AS d FROM h_trace
        WHERE event_type IN ('ORACLE_FEED_SET', 'ANSWER_UPDATED') GROUP BY 1),
i AS (SELECT kase, arg_min(struct_pack(event_type, tx_hash, stamp, pos, topic0), (stamp, tx_hash, pos)) AS i FROM h_trace
      WHERE event_type IN ('BORROW', 'LIQUIDATE') GROUP BY 1)
SELECT d.kase AS "case", CASE WHEN d.d.tx_hash = i.i.tx_hash THEN 'same_tx' WHEN d.d.pos = i.i.pos THEN 'same_block'
            WHEN d.d.stamp < i.i.stamp THEN 'pre_attack_observed' ELSE 'not_observed' END AS lead_time_status,
       greatest(0, i.i.stamp - d.d.stamp) AS lead_time_seconds, d.d.event_type AS first_dangerous_event_type,
       d.d.tx_hash AS first_dangerous_tx_hash, d.d.topic0 AS first_dangerous_topic0_or_selector,
       d.d.stamp AS first_dangerous_block_timestamp, i.i.event_type AS first_impact_event_type, i.i.tx_hash AS first_impact_tx_hash,
       i.i.topic0 AS first_impact_topic0_or_selector, i.i.stamp AS first_impact_block_timestamp
FROM d JOIN i ON i.kase = d.kase""")


def _flags(spark, folder):
    events, found = played(spark, folder)
    return E.record_flags(events, found.alerts)


V.register_view_sql("h_flags", """h_flags AS (
  SELECT t.kase, t.event_type, t.event_type <> 'SUPPLY' AS direct,
         CASE t.event_type WHEN 'ORACLE_FEED_SET' THEN list_contains(a.types, 'feed_mismatch')
              WHEN 'ANSWER_UPDATED' THEN list_contains(a.types, 'stale_oracle')
              WHEN 'SUPPLY' THEN list_has_any(a.types, ['collateral_enabling_supply_under_stale_oracle', 'collateral_enabling_supply_under_bad_oracle'])
              ELSE list_contains(a.types, 'attacker_localization') END IS TRUE AS alerted
  FROM h_trace t LEFT JOIN (SELECT "case", tx_hash, list(DISTINCT type) AS types FROM h_alerts GROUP BY 1, 2) a
    ON a."case" = t.kase AND a.tx_hash = t.tx_hash)""")
_WILSON = ("greatest(0.0, ((d/n + 3.8416/(2*n)) - 1.96 * sqrt((d/n*(1-d/n) + 3.8416/(4*n))/n)) / (1 + 3.8416/n))",
           "least(1.0, ((d/n + 3.8416/(2*n)) + 1.96 * sqrt((d/n*(1-d/n) + 3.8416/(4*n))/n)) / (1 + 3.8416/n))")


def _rate_sql(name: str, part: str, whole: str) -> str:
    low, high = (w.replace("d/n", f"({part}/{whole}::DOUBLE)").replace("n)", f"{whole}::DOUBLE)").replace("/n", f"/{whole}::DOUBLE") for w in _WILSON)
    return (f"round({part} / {whole}::DOUBLE, 6) AS {name}, round({low}, 6) AS {name}_lower, round({high}, 6) AS {name}_upper")


def _log_level(spark, folder):
    table = E.log_level_metrics(_flags(spark, folder))
    doubles = [c for c, t in table.dtypes if t == "double"]
    return table.select(F.coalesce("case", F.lit("ALL")).alias("case"), *E.LOG_COUNTS, *[F.round(c, 6).alias(c) for c in doubles])


QUERIES["log_level_metrics"] = _log_level
SQL["log_level_metrics"] = V.with_views([*ALERT_VIEWS, "h_flags"], f"""
, m AS (SELECT coalesce(kase, 'ALL') AS "case", count(*) AS all_trace_records, count(*) FILTER (direct OR alerted) AS target_log_records,
         count(*) FILTER (alerted) AS detected_target_log_records, count(*) FILTER (direct) AS direct_violation_target_log_records,
         count(*) FILTER (direct AND alerted) AS detected_direct_violation_log_records,
         count(*) FILTER (NOT direct AND alerted) AS early_evidence_target_log_records,
         count(*) FILTER (direct OR alerted) AS canonical_target_log_records, count(*) FILTER (alerted) AS detected_canonical_target_log_records,
         CAST(0 AS BIGINT) AS semantic_marker_target_records, CAST(0 AS BIGINT) AS detected_semantic_marker_records,
         count(*) FILTER (NOT direct) AS context_log_records, count(*) FILTER (NOT direct AND NOT alerted) AS support_only_context_records
  FROM h_flags GROUP BY ROLLUP (kase))
SELECT *, {_rate_sql('target_recall', 'detected_target_log_records', 'target_log_records')},
       {_rate_sql('direct_violation_recall', 'detected_direct_violation_log_records', 'direct_violation_target_log_records')},
       {_rate_sql('canonical_target_recall', 'detected_canonical_target_log_records', 'canonical_target_log_records')},
       {_rate_sql('incident_log_warning_recall', 'detected_target_log_records', 'all_trace_records')} FROM m""")

QUERIES["event_type_counts"] = lambda spark, folder: E.event_type_counts(_flags(spark, folder)).withColumn("case", F.coalesce("case", F.lit("ALL")))
SQL["event_type_counts"] = V.with_views([*ALERT_VIEWS, "h_flags"], """
SELECT coalesce(kase, 'ALL') AS "case", event_type, count(*) AS target_records, count(*) FILTER (alerted) AS detected_records
FROM h_flags WHERE direct OR alerted GROUP BY GROUPING SETS ((kase, event_type), (event_type))""")


def _effectiveness(spark, folder):
    events, found = played(spark, folder)
    return E.detection_effectiveness(events, constraints(spark), found)


V.register_view_sql("h_effect", """h_effect AS (
  SELECT t.kase AS "case", 'feed_binding' AS failure_class,
         count(DISTINCT t.tx_hash) FILTER (t.event_type IN ('BORROW', 'LIQUIDATE')) AS positive_impact_txs,
         count(DISTINCT t.tx_hash) FILTER (t.event_type IN ('BORROW', 'LIQUIDATE') AND a.tx_hash IS NOT NULL) AS detected_impact_txs,
         any_value(c.n) AS alert_count, any_value(m.n) AS attacker_candidate_count, any_value(c.n) > 0 AS case_detected
  FROM h_trace t LEFT JOIN (SELECT DISTINCT "case", tx_hash FROM h_alerts WHERE type = 'attacker_localization') a
    ON a."case" = t.kase AND a.tx_hash = t.tx_hash
  LEFT JOIN (SELECT "case", count(*) AS n FROM h_alerts GROUP BY 1) c ON c."case" = t.kase
  LEFT JOIN (SELECT kase, count(DISTINCT address) AS n FROM h_marks GROUP BY 1) m ON m.kase = t.kase GROUP BY 1)""")
QUERIES["detection_effectiveness"] = _effectiveness
SQL["detection_effectiveness"] = V.with_views([*ALERT_VIEWS, "h_marks", "h_effect"], "SELECT * FROM h_effect")
QUERIES["detection_baselines"] = lambda spark, folder: E.baseline_metrics(_effectiveness(spark, folder))
SQL["detection_baselines"] = V.with_views([*ALERT_VIEWS, "h_marks", "h_effect"], """
, w AS (SELECT count(*) AS positive_cases, CAST(sum(positive_impact_txs) AS BIGINT) AS p, count(*) FILTER (positive_impact_txs > 0) AS v,
          count(*) FILTER (case_detected) AS d, CAST(sum(detected_impact_txs) AS BIGINT) AS l FROM h_effect)
SELECT 'abi_only_parser' AS baseline, positive_cases, CAST(0 AS BIGINT) AS detected_cases, 0.0::DOUBLE AS case_recall, p AS positive_impact_txs,
       CAST(0 AS BIGINT) AS detected_impact_txs, 0.0::DOUBLE AS tx_recall FROM w
UNION ALL SELECT 'tx_level_only_impact_visibility', positive_cases, v, v / positive_cases::DOUBLE, p, p, 1.0::DOUBLE FROM w
UNION ALL SELECT 'full_replay', positive_cases, d, d / positive_cases::DOUBLE, p, l, l / p::DOUBLE FROM w""")


def _localization(spark, folder):
    events, found = played(spark, folder)
    table = E.actor_localization(events, found, cases(spark))
    return table.withColumn("actor_recall", F.round("actor_recall", 6)).withColumn("candidate_precision", F.round("candidate_precision", 6))


QUERIES["actor_localization_hit_at_k"] = _localization
SQL["actor_localization_hit_at_k"] = V.with_views([*BASE, "h_borrow_alerts", "h_liquidation_alerts", "h_marks", "h_gold"], """
, p AS (SELECT kase, address, row_number() OVER (PARTITION BY kase ORDER BY min(pos)) AS r FROM h_marks GROUP BY 1, 2),
j AS (SELECT coalesce(g.kase, p.kase) AS kase, g.address AS g, p.address AS p, p.r FROM h_gold g FULL JOIN p ON p.kase = g.kase AND p.address = g.address)
SELECT kase AS "case", count(g) AS known_actor_count, count(p) AS predicted_candidate_count,
       count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS matched_actor_count,
       round(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) / count(g)::DOUBLE, 6) AS actor_recall,
       round(count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) / count(p)::DOUBLE, 6) AS candidate_precision,
       bool_or(g IS NOT NULL AND r <= 1) IS TRUE AS hit_at_1, bool_or(g IS NOT NULL AND r <= 3) IS TRUE AS hit_at_3,
       bool_or(g IS NOT NULL AND r <= 5) IS TRUE AS hit_at_5 FROM j GROUP BY 1""")
QUERIES["actor_role_coverage"] = lambda spark, folder: E.role_coverage(
    trace(spark, folder), result(spark, folder), cases(spark)).withColumn("roles", F.array_join("roles", ","))
SQL["actor_role_coverage"] = V.with_views([*BASE, "h_borrow_alerts", "h_liquidation_alerts", "h_marks"], """
, named AS (
  SELECT kase, who AS address, unnest(CASE event_type WHEN 'BORROW' THEN ['borrower', 'actor'] ELSE ['liquidator'] END) AS role
  FROM h_trace WHERE event_type IN ('BORROW', 'LIQUIDATE')
  UNION ALL SELECT kase, address, 'attacker_eoa' FROM (VALUES ('ethereum', '0x0000000000000000000000000000000000000001'),
    ('bnb', '0x0000000000000000000000000000000000000002'), ('base', '0x0000000000000000000000000000000000000003'),
    ('avalanche_c', '0x0000000000000000000000000000000000000004')) g(kase, address))
SELECT n.kase AS "case", n.address, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM named n
WHERE (n.kase, n.address) IN (SELECT (kase, address) FROM h_marks) GROUP BY 1, 2""")


def semantics(spark: SparkSession, folder: str) -> DataFrame:
    """Mined event semantics: what each contract of the first two chains emits."""
    logs = V.logs(spark, folder).where(F.col("blockchain").isin("ethereum", "bnb"))
    event = F.when(F.col("topic0") == "signup", "OracleFeedSet").when(F.col("topic0") == "click", "Supply").otherwise("Borrow")
    return logs.select(
        F.col("blockchain").alias("case"), event.alias("event"), F.array(F.lit("Account"), F.lit("amount")).alias("event_arguments"),
        F.when(F.col("k") == 0, F.array(F.lit("oracle-read"))).otherwise(F.array().cast("array<string>")).alias("transition_tags"),
        (F.col("value") > 400).alias("freshness_check"),
    )


def _labels(spark, folder):
    known = R.inline(spark, [(c, c in ("ethereum", "bnb")) for c in V.CHAINS], "case string, automatic boolean")
    gold = E.gold_labels(trace(spark, folder), constraints(spark))
    table = E.label_accuracy(gold, E.ir_labels(semantics(spark, folder)), known)
    return table.select("level", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


QUERIES["label_prf"] = _labels
SQL["label_prf"] = V.with_views(["h_logs", "h_trace"], """
, g AS (
  SELECT DISTINCT kase, unnest(CASE event_type WHEN 'ORACLE_FEED_SET' THEN ['oracle_boundary', 'oracle_anomaly', 'feed_binding']
      WHEN 'ANSWER_UPDATED' THEN ['oracle_boundary', 'oracle_anomaly', 'freshness'] WHEN 'SUPPLY' THEN ['supply', 'lending_impact']
      WHEN 'BORROW' THEN ['borrow', 'lending_impact'] ELSE ['liquidation', 'lending_impact'] END
      || ['temporal_field', 'actor_field']) AS label FROM h_trace
  UNION SELECT kase, unnest(['oracle_anomaly', 'feed_binding', 'replayable_constraint', 'freshness']) FROM (SELECT DISTINCT kase FROM h_trace)),
p AS (
  SELECT DISTINCT chain AS kase, unnest(CASE topic0 WHEN 'signup' THEN ['oracle_boundary', 'feed_binding'] WHEN 'click' THEN ['supply', 'lending_impact']
      ELSE ['borrow', 'lending_impact'] END || CASE WHEN value > 400 THEN ['freshness'] ELSE [] END
      || CASE WHEN k = 0 THEN ['oracle_boundary'] ELSE [] END || ['actor_field']) AS label FROM h_logs WHERE chain IN ('ethereum', 'bnb')
  UNION SELECT kase, label FROM g WHERE kase NOT IN ('ethereum', 'bnb')),
j AS (SELECT coalesce(g.kase, p.kase) AS kase, g.label AS g, p.label AS p FROM g FULL JOIN p ON p.kase = g.kase AND p.label = g.label),
l AS (SELECT 'case:' || kase AS level, g, p FROM j UNION ALL SELECT 'all_cases', g, p FROM j
      UNION ALL SELECT 'automatic_cases', g, p FROM j WHERE kase IN ('ethereum', 'bnb')),
c AS (SELECT level, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn
      FROM l GROUP BY 1)
SELECT level, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall,
       round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / ((tp / (tp + fp)::DOUBLE) + (tp / (tp + fn)::DOUBLE)), 6) AS f1 FROM c""")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Benign samples, one per event, with a status that follows its number k."""
    k = F.col("k")
    status = (
        F.when(k < 80, R.STRICT_STATUSES[0]).when(k < 90, R.STRICT_STATUSES[1]).when(k < 97, R.UNKNOWN_STATUSES[0]).otherwise(R.REVIEW_STATUSES[0])
    )
    return V.logs(spark, folder).select(
        F.concat(F.lit("s"), F.col("block_number").cast("string")).alias("sample_id"), "tx_hash", F.col("blockchain").alias("case_related_to"),
        F.when(F.col("topic0") == "signup", "S2").when(F.col("topic0") == "view", "S1").otherwise("").alias("scope_class"),
        status.alias("verification_status"),
        F.when(F.col("topic0") == "purchase", R.BORROW).when(F.col("topic0") == "signup", R.FEED_SET).otherwise("BENIGN_ORACLE_SCOPE_LOG").alias("replay_event_type"),
        (F.col("value") > 10).alias("source_available"), (F.col("value") > 20).alias("abi_available"),
    )


V.register_view_sql("h_samples", f"""h_samples AS (
  SELECT 's' || block_number AS sample_id, tx_hash, chain AS case_related_to,
         CASE topic0 WHEN 'signup' THEN 'S2' WHEN 'view' THEN 'S1' ELSE '' END AS scope_class,
         CASE WHEN k < 80 THEN '{R.STRICT_STATUSES[0]}' WHEN k < 90 THEN '{R.STRICT_STATUSES[1]}'
              WHEN k < 97 THEN '{R.UNKNOWN_STATUSES[0]}' ELSE '{R.REVIEW_STATUSES[0]}' END AS verification_status,
         CASE WHEN k < 90 THEN 'strict_benign' WHEN k < 97 THEN 'unknown' ELSE 'review' END AS bucket,
         CASE topic0 WHEN 'purchase' THEN 'BORROW' WHEN 'signup' THEN 'ORACLE_FEED_SET' ELSE 'BENIGN_ORACLE_SCOPE_LOG' END AS replay_event_type,
         value > 10 AS source_available, value > 20 AS abi_available FROM h_logs)""")


def _sample_alerts(spark, folder, found: Replay | None = None):
    numbered = (found or result(spark, folder)).localized
    return numbered.select(F.concat(F.lit("s"), F.col("block_number").cast("string")).alias("sample_id"))


QUERIES["tx_status_all_any"] = lambda spark, folder: E.benign_metrics(samples(spark, folder), _sample_alerts(spark, folder))
V.register_view_sql("h_benign", """h_benign AS (
  SELECT CAST(sum(n) AS BIGINT) AS sample_rows, count(*) AS unique_txs, CAST(sum(st) AS BIGINT) AS strict_benign_rows,
         CAST(sum(u) AS BIGINT) AS unknown_rows, CAST(sum(r) AS BIGINT) AS review_rows, count(*) FILTER (st = n) AS strict_benign_txs,
         count(*) FILTER (u > 0) AS unknown_txs, count(*) FILTER (r > 0) AS review_txs, CAST(sum(fp) AS BIGINT) AS strict_fp_rows,
         count(*) FILTER (fp > 0) AS strict_fp_txs
  FROM (SELECT tx_hash, count(*) AS n, count(*) FILTER (bucket = 'strict_benign') AS st, count(*) FILTER (bucket = 'unknown') AS u,
               count(*) FILTER (bucket = 'review') AS r, count(*) FILTER (bucket = 'strict_benign' AND a.b IS NOT NULL) AS fp
        FROM h_samples s LEFT JOIN (SELECT DISTINCT 's' || block_number AS b FROM h_alerts WHERE type = 'attacker_localization') a
          ON a.b = s.sample_id GROUP BY 1))""")
SQL["tx_status_all_any"] = V.with_views([*ALERT_VIEWS, "h_samples", "h_benign"], "SELECT * FROM h_benign")


def _combined(spark, folder):
    events, found = played(spark, folder)
    benign = E.benign_metrics(samples(spark, folder), _sample_alerts(spark, folder, found))
    table = E.combined_precision(E.log_level_metrics(E.record_flags(events, found.alerts)), benign)
    return table.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


QUERIES["combined_precision"] = _combined
SQL["combined_precision"] = V.with_views([*ALERT_VIEWS, "h_samples", "h_benign", "h_flags"], f"""
, m AS (SELECT count(*) FILTER (alerted) AS tp, count(*) FILTER (direct OR alerted) AS target, count(*) AS total FROM h_flags),
b AS (SELECT *, tp + strict_fp_rows AS n FROM m, h_benign)
SELECT tp AS tp_target_logs, strict_fp_rows AS confirmed_strict_fp_logs, review_rows AS review_logs, target - tp AS fn_target_logs,
       total - tp AS fn_all_semantic_logs, strict_benign_rows - strict_fp_rows AS strict_tn_logs, round(tp / n::DOUBLE, 6) AS strict_precision,
       round({_WILSON[0].replace('d/n', '(tp/n::DOUBLE)').replace('3.8416/', '3.8416::DOUBLE/')}, 6) AS strict_precision_lower,
       round(tp / (n + review_rows)::DOUBLE, 6) AS conservative_precision_floor FROM b""")

QUERIES["benign_crosstab"] = lambda spark, folder: E.benign_crosstab(samples(spark, folder), "scope_class").withColumn(
    "strict_rate", F.round("strict_rate", 6))
SQL["benign_crosstab"] = V.with_views(["h_logs", "h_samples"], """
SELECT coalesce(nullif(scope_class, ''), 'unknown') AS scope_class, count(*) AS total, count(*) FILTER (bucket = 'strict_benign') AS strict_benign,
       count(*) FILTER (bucket = 'unknown') AS unknown, count(*) FILTER (bucket = 'review') AS review, CAST(0 AS BIGINT) AS other,
       round(count(*) FILTER (bucket = 'strict_benign') / count(*)::DOUBLE, 6) AS strict_rate FROM h_samples GROUP BY 1""")


def _reasons(spark, folder):
    table = E.reason_table(samples(spark, folder), R.UNKNOWN_STATUSES[0])
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return table.select("reason", "count", text("case_counts").alias("case_counts"), text("scope_counts").alias("scope_counts"))


QUERIES["benign_reason_table"] = _reasons
SQL["benign_reason_table"] = V.with_views(["h_logs", "h_samples"], f"""
, r AS (SELECT CASE WHEN replay_event_type = 'BENIGN_ORACLE_SCOPE_LOG' AND NOT (source_available AND abi_available)
                      THEN 'generic_oracle_scope_log_without_source_or_abi'
                    WHEN replay_event_type = 'BENIGN_ORACLE_SCOPE_LOG' THEN 'generic_oracle_scope_log_not_bound_to_replay_semantics'
                    ELSE 'materialized_but_insufficient_replay_semantics' END AS reason, case_related_to AS c,
               coalesce(nullif(scope_class, ''), 'unknown') AS s FROM h_samples WHERE verification_status = '{R.UNKNOWN_STATUSES[0]}')
SELECT a.reason, a."count", a.case_counts, b.scope_counts FROM
  (SELECT reason, CAST(sum(n) AS BIGINT) AS "count", string_agg(c || '=' || n, ',' ORDER BY c) AS case_counts
   FROM (SELECT reason, c, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) a JOIN
  (SELECT reason, string_agg(s || '=' || n, ',' ORDER BY s) AS scope_counts FROM (SELECT reason, s, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) b
  ON b.reason = a.reason""")


def _ablation(spark, folder):
    events, found = played(spark, folder)
    table = E.ablation(events, constraints(spark), samples(spark, folder), cases(spark), _sample_alerts(spark, folder, found), found)
    return table.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])


QUERIES["ablation_matrix"] = _ablation
SQL["ablation_matrix"] = V.with_views([*ALERT_VIEWS, "h_marks", "h_gold", "h_effect", "h_samples"], """
, early AS (SELECT kase, min((stamp, tx_hash, pos)) FILTER (event_type IN ('ORACLE_FEED_SET', 'ANSWER_UPDATED')) AS d,
                   min((stamp, tx_hash, pos)) FILTER (event_type IN ('BORROW', 'LIQUIDATE')) AS i FROM h_trace GROUP BY 1),
e AS (SELECT count(*) AS cases, count(*) FILTER (d[1] < i[1]) AS early FROM early),
b AS (SELECT CAST(count(DISTINCT "case") AS BIGINT) AS n FROM h_boundary_alerts),
x AS (SELECT count(*) AS benign, count(*) FILTER (bucket = 'strict_benign') AS strict, count(*) FILTER (replay_event_type = 'BORROW') AS impact,
             count(*) FILTER (abi_available) AS abi, count(*) FILTER (scope_class LIKE 'S%') AS boundary, count(a.b) AS alerted
      FROM h_samples s LEFT JOIN (SELECT DISTINCT 's' || block_number AS b FROM h_alerts WHERE type = 'attacker_localization') a ON a.b = s.sample_id),
f AS (SELECT CAST(sum(positive_impact_txs) AS BIGINT) AS impacts, CAST(sum(detected_impact_txs) AS BIGINT) AS localized,
             CAST(sum(attacker_candidate_count) AS BIGINT) AS accused, count(*) FILTER (case_detected) AS alerted,
             count(*) FILTER (detected_impact_txs > 0) AS replayable FROM h_effect),
g AS (SELECT count(*) AS known, count(m.kase) AS matched FROM h_gold g LEFT JOIN (SELECT DISTINCT kase, address FROM h_marks) m
        ON m.kase = g.kase AND m.address = g.address),
v AS (
  SELECT 'full_replay' AS variant, e.cases AS positive_cases, e.cases AS evidence_observed_cases, f.alerted AS attack_alert_cases,
         f.replayable AS replayable_attack_cases, f.impacts AS positive_impact_txs, f.localized AS detected_impact_txs,
         e.early AS pre_attack_tx_evidence_cases, g.known AS known_actors, g.matched AS matched_actors, f.accused AS predicted_actor_candidates,
         x.alerted AS benign_warning_rows, x.benign AS benign_materialized_rows, x.strict AS strict_benign_rows FROM e, x, f, g
  UNION ALL SELECT 'without_log_semantics_abi_only', e.cases, 0, 0, 0, f.impacts, 0, 0, g.known, 0, 0, x.abi, x.benign, x.strict FROM e, x, f, g
  UNION ALL SELECT 'topic_only_raw_filter', e.cases, e.cases, 0, 0, f.impacts, 0, 0, g.known, 0, 0, x.benign, x.benign, x.strict FROM e, x, f, g
  UNION ALL SELECT 'oracle_boundary_without_lending_binding', e.cases, greatest(b.n, e.early), b.n, 0, f.impacts, 0, e.early, g.known, 0, 0,
                   x.boundary, x.benign, x.strict FROM e, x, f, g, b
  UNION ALL SELECT 'impact_only_without_oracle_boundary', e.cases, e.cases, 0, 0, f.impacts, 0, 0, g.known, 0, 0, x.impact, x.benign, x.strict
            FROM e, x, f, g)
SELECT *, round(attack_alert_cases / positive_cases::DOUBLE, 6) AS attack_alert_case_recall,
       round(replayable_attack_cases / positive_cases::DOUBLE, 6) AS replayable_case_recall,
       round(detected_impact_txs / positive_impact_txs::DOUBLE, 6) AS impact_tx_recall, round(matched_actors / known_actors::DOUBLE, 6) AS actor_recall,
       round(benign_warning_rows / benign_materialized_rows::DOUBLE, 6) AS benign_warning_rate FROM v""")
