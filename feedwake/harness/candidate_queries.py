"""Candidate exports, coverage counts and benign controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import text as T
from feedwake.harness import broad_queries as BQ
from feedwake.harness import replay_queries as RQ
from feedwake.harness import views as V
from feedwake.operators import candidates as K
from feedwake.operators import coverage as COV
from feedwake.operators import dedupe as D
from feedwake.operators import sampling as SMP
from feedwake.storage import write_table

QUERIES = {}
SQL = {}
CLASSES = (R.FEED_BINDING, R.COMPOSITION, R.FRESHNESS)
TIERS = (R.TIER_A, R.TIER_B, R.TIER_B, R.TIER_C)
FLAG_WORDS = ("true", "1", "no", " Y ", "F", "yes", "t")


def _flag(shift: int):
    return BQ.at(FLAG_WORDS, (F.col("k") + shift) % 7)


def exports(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an exported text row with mixed spellings of numbers, flags, times and lists."""
    rows = V.logs(spark, folder)
    k = F.col("k")
    stamp = F.date_format("block_time", "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        F.concat(F.lit("part-"), (F.col("actor").cast("long") % 7).cast("string"), F.lit(".csv")).alias("source_file"), F.col("block_number").alias("source_row"),
        F.concat(F.lit(" "), F.col("blockchain")).alias("chain"), BQ.at(CLASSES, k % 3).alias("failure_class"),
        F.when(k % 2 == 0, F.upper("tx_hash")).otherwise(F.col("tx_hash")).alias("trigger_tx"), F.concat(F.col("block_number").cast("string"), F.lit(".0")).alias("trigger_block"),
        F.when(k % 3 == 0, F.concat(F.date_format("block_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 3 == 1, F.concat(stamp, F.lit(" UTC"))).otherwise(stamp).alias("trigger_time"),
        F.when(k % 5 > 0, F.col("asset")).alias("affected_asset"), BQ.at(TIERS, k % 4).alias("evidence_tier"),
        *[_flag(i).alias(c) for i, c in enumerate(K.FLAGS)],
        (k * 3000 - 1500).cast("string").alias("trigger_to_impact_seconds"), F.when(k % 6 > 0, (k % 6).cast("double").cast("string")).alias("impact_tx_count"),
        F.col("value").cast("string").alias("impact_usd_known"), F.when(k % 10 < 9, (k % 4).cast("string")).otherwise("").alias("source_quality_rank"),
        F.when(k % 4 > 0, F.lit("decoded_protocol_event")).alias("source_quality"),
        F.when(k % 2 == 0, F.concat("tx_hash", F.lit("; 0xaa ;;"), "actor")).otherwise(F.concat("tx_hash", F.lit(", 0xbb"))).alias("impact_txs"),
    )


V.register_view_sql("h_exports", f"""h_exports AS (
  SELECT 'part-' || (CAST(actor AS BIGINT) % 7) || '.csv' AS source_file, block_number AS source_row, chain, {BQ._list(CLASSES)}[(k % 3) + 1] AS failure_class,
         CASE WHEN k % 2 = 0 THEN upper(tx_hash) ELSE tx_hash END AS trigger_tx, block_number AS trigger_block, us // 1000000 AS trigger_s,
         2024 AS trigger_year, CASE WHEN k % 5 > 0 THEN asset ELSE '' END AS affected_asset, {BQ._list(TIERS)}[(k % 4) + 1] AS evidence_tier,
         """ + ",\n         ".join(f"{BQ._list(['true', '1', 'no', 'Y', 'F', 'yes', 't'])}[((k + {i}) % 7) + 1] NOT IN ('no', 'F') AS {c}" for i, c in enumerate(K.FLAGS)) + """,
         k * 3000 - 1500 AS trigger_to_impact_seconds, k % 6 AS impact_tx_count, value AS impact_usd_known,
         CASE WHEN k % 10 < 9 THEN k % 4 ELSE 99 END AS source_quality_rank, CASE WHEN k % 4 > 0 THEN 'decoded_protocol_event' ELSE '' END AS source_quality,
         CASE WHEN k % 2 = 0 THEN [tx_hash, '0xaa', actor] ELSE [tx_hash, '0xbb'] END AS impact_txs
  FROM h_logs)""")
V.register_view_sql("h_cand", """h_cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY source_file, source_row) AS n FROM h_exports)
  QUALIFY row_number() OVER (PARTITION BY chain, failure_class, lower(trigger_tx), lower(affected_asset) ORDER BY n) = 1)""")
V.register_view_sql("h_queue", f"""h_queue AS (
  SELECT *, row_number() OVER (PARTITION BY failure_class ORDER BY CASE evidence_tier WHEN '{R.TIER_A}' THEN 1 ELSE 2 END, has_replayable_constraint DESC,
           has_actor DESC, CASE WHEN trigger_to_impact_seconds >= 0 THEN trigger_to_impact_seconds ELSE 1000000000000 END, impact_usd_known DESC,
           impact_tx_count DESC, source_quality_rank, chain, trigger_year, trigger_tx, n) AS gate_sequence,
         least(impact_tx_count, CASE failure_class WHEN '{R.FEED_BINDING}' THEN 1 ELSE 2 END) AS impact_receipts,
         CASE failure_class WHEN '{R.COMPOSITION}' THEN 3 ELSE 2 END AS abi
  FROM h_cand WHERE evidence_tier = '{R.TIER_A}' OR (evidence_tier = '{R.TIER_B}' AND has_lending_impact AND has_temporal_order
       AND source_quality_rank <= 2 AND impact_tx_count > 0 AND trigger_to_impact_seconds BETWEEN 0 AND 86400))""")
CAND_VIEWS = ["h_logs", "h_exports", "h_cand"]


def _candidates(spark, folder):
    return write_table(K.normalize_candidates(exports(spark, folder)))


def _normal(spark, folder):
    return _candidates(spark, folder).select(
        "candidate_id", "chain", "failure_class", "trigger_tx", "trigger_block", T.seconds(F.col("trigger_time")).alias("trigger_s"), "trigger_year", "affected_asset",
        "evidence_tier", *K.FLAGS, "trigger_to_impact_seconds", "impact_tx_count", "impact_usd_known", "source_quality_rank", "source_quality",
        F.array_join("impact_txs", "|").alias("impact_txs"))


QUERIES["candidate_normalize"] = _normal
SQL["candidate_normalize"] = V.with_views(CAND_VIEWS, f"""
SELECT 'broad-' || lpad(CAST(n AS VARCHAR), 6, '0') AS candidate_id, chain, failure_class, trigger_tx, trigger_block, trigger_s, CAST(trigger_year AS BIGINT) AS trigger_year,
       affected_asset, evidence_tier, {', '.join(K.FLAGS)}, trigger_to_impact_seconds, impact_tx_count, impact_usd_known,
       CAST(source_quality_rank AS BIGINT) AS source_quality_rank, source_quality, array_to_string(impact_txs, '|') AS impact_txs FROM h_cand""")


def _queue(spark, folder):
    return K.materialization_queue(_candidates(spark, folder))


QUERIES["materialization_queue"] = lambda spark, folder: _queue(spark, folder).select(
    "candidate_id", "failure_class", "gate_sequence", "estimated_trigger_receipts", "estimated_impact_receipts", "estimated_abi_requests", "estimated_total_rpc_requests")
SQL["materialization_queue"] = V.with_views([*CAND_VIEWS, "h_queue"], """
SELECT 'broad-' || lpad(CAST(n AS VARCHAR), 6, '0') AS candidate_id, failure_class, gate_sequence, CAST(1 AS BIGINT) AS estimated_trigger_receipts,
       impact_receipts AS estimated_impact_receipts, CAST(abi AS BIGINT) AS estimated_abi_requests, 1 + impact_receipts AS estimated_total_rpc_requests FROM h_queue""")


def _cubes(spark, folder):
    found = _candidates(spark, folder)
    return K.candidate_cubes(found, K.materialization_queue(found)).withColumn("impact_usd_known", F.round("impact_usd_known", 4))


QUERIES["candidate_summary"] = _cubes
SQL["candidate_summary"] = V.with_views([*CAND_VIEWS, "h_queue"], """
, c AS (SELECT chain, CAST(trigger_year AS BIGINT) AS trigger_year, failure_class, evidence_tier, coalesce(nullif(source_quality, ''), 'unknown') AS source_quality,
               impact_usd_known AS usd FROM h_cand)
SELECT 'chain_year_class_tier' AS level, chain, trigger_year, failure_class, evidence_tier, NULL AS source_quality, count(*) AS candidate_count,
       round(sum(usd), 4) AS impact_usd_known FROM c GROUP BY 2, 3, 4, 5
UNION ALL SELECT 'class_tier', NULL, NULL, failure_class, evidence_tier, NULL, count(*), round(sum(usd), 4) FROM c GROUP BY 4, 5
UNION ALL SELECT 'source_quality', NULL, NULL, NULL, NULL, source_quality, count(*), round(sum(usd), 4) FROM c GROUP BY 6
UNION ALL SELECT 'class', NULL, NULL, failure_class, NULL, NULL, count(*), round(sum(usd), 4) FROM c GROUP BY 4
UNION ALL SELECT 'queue_class', NULL, NULL, failure_class, NULL, NULL, count(*), round(sum(impact_usd_known), 4) FROM h_queue GROUP BY 4""")
QUERIES["queue_estimate"] = lambda spark, folder: K.queue_estimate(_queue(spark, folder))
SQL["queue_estimate"] = V.with_views([*CAND_VIEWS, "h_queue"], """
SELECT count(*) AS queue_count, CAST(sum(1 + impact_receipts) AS BIGINT) AS receipt_bundles, CAST(sum(1 + impact_receipts) * 3 AS BIGINT) AS rpc_requests,
       CAST(sum(abi) AS BIGINT) AS abi_requests FROM h_queue""")


def known_txs(spark, folder) -> DataFrame:
    """Incident transactions: those with a liquidation of 100 or more."""
    big = V.logs(spark, folder).where((F.col("topic0") == "error") & (F.col("value") >= 100))
    return big.select(F.col("blockchain").alias("chain"), F.col("blockchain").alias("case"), "tx_hash").distinct()


V.register_view_sql("h_known", "h_known AS (SELECT DISTINCT chain, tx_hash FROM h_logs WHERE topic0 = 'error' AND value >= 100)")


def _scope(spark, folder):
    found = _candidates(spark, folder)
    return K.download_scope(found, write_table(K.materialization_queue(found)), known_txs(spark, folder), 1000)


_HIT_SQL = """
, qt AS (SELECT DISTINCT n, lower(trim(t)) AS tx FROM (SELECT n, unnest([trigger_tx] || impact_txs) AS t FROM h_queue)),
ct AS (SELECT DISTINCT n, lower(trim(t)) AS tx FROM (SELECT n, unnest([trigger_tx] || impact_txs) AS t FROM h_cand)),
kt AS (SELECT DISTINCT tx_hash AS tx FROM h_known)"""
QUERIES["download_scope"] = _scope
SQL["download_scope"] = V.with_views([*CAND_VIEWS, "h_queue", "h_known"], _HIT_SQL + """
SELECT (SELECT count(*) FROM h_queue) AS eligible_queue_candidate_count, (SELECT CAST(sum(1 + impact_receipts) AS BIGINT) FROM h_queue) AS receipt_bundles,
       (SELECT CAST(sum(1 + impact_receipts) * 3 AS BIGINT) FROM h_queue) AS rpc_requests, (SELECT CAST(sum(abi) AS BIGINT) FROM h_queue) AS abi_requests,
       (SELECT count(DISTINCT n) FROM qt JOIN kt USING (tx)) AS overlap_candidate_count, (SELECT count(DISTINCT tx) FROM qt JOIN kt USING (tx)) AS overlap_tx_count,
       (SELECT count(*) FROM h_cand) AS candidate_count, (SELECT CAST(sum(1 + len(impact_txs)) AS BIGINT) FROM h_cand) AS candidate_tx_reference_count,
       (SELECT count(DISTINCT tx) FROM ct) AS unique_candidate_tx_count, (SELECT count(*) FROM kt) AS known_tx_count,
       (SELECT sum(1 + impact_receipts) > 1000 FROM h_queue) AS target_local_bundles_exceeded""")
QUERIES["download_scope_by_case"] = lambda spark, folder: K.download_scope_by_case(write_table(_queue(spark, folder)), known_txs(spark, folder))
SQL["download_scope_by_case"] = V.with_views([*CAND_VIEWS, "h_queue", "h_known"], _HIT_SQL + """
, h AS (SELECT DISTINCT k.chain, q.n, q.tx FROM qt q JOIN h_known k ON k.tx_hash = q.tx)
SELECT k.chain AS "case", count(*) AS known_tx_count, coalesce(any_value(o.c), 0) AS overlap_candidate_count, coalesce(any_value(o.b), 0) AS receipt_bundles,
       coalesce(any_value(t.t), 0) AS overlap_tx_count
FROM h_known k LEFT JOIN (SELECT d.chain, count(*) AS c, CAST(sum(1 + impact_receipts) AS BIGINT) AS b FROM (SELECT DISTINCT chain, n FROM h) d JOIN h_queue q ON q.n = d.n GROUP BY 1) o
  ON o.chain = k.chain LEFT JOIN (SELECT chain, count(DISTINCT tx) AS t FROM h GROUP BY 1) t ON t.chain = k.chain GROUP BY 1""")
QUERIES["download_order"] = lambda spark, folder: K.download_order(write_table(_queue(spark, folder)), known_txs(spark, folder)).select("candidate_id", "known_overlap", "gate_sequence")
SQL["download_order"] = V.with_views([*CAND_VIEWS, "h_queue", "h_known"], _HIT_SQL + """
SELECT 'broad-' || lpad(CAST(q.n AS VARCHAR), 6, '0') AS candidate_id, count(k.tx) AS known_overlap, any_value(q.gate_sequence) AS gate_sequence
FROM h_queue q JOIN qt t ON t.n = q.n LEFT JOIN kt k ON k.tx = t.tx GROUP BY 1""")

# --- coverage -------------------------------------------------------------------------------------------------

V.register_view_sql("b_alltx", f"""b_alltx AS (
  SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {BQ._chain_sql('f.s')} ELSE {BQ._chain_sql('f.p')} END AS chain, us,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {BQ._contract_sql('S', 'f.s')} ELSE {BQ._contract_sql('P', 'f.p')} END AS target,
         '0x' || lpad(lower(to_hex(o_orderkey)), 64, '0') AS hash, o_orderkey AS block_number
  FROM b_orders)""")
QUERIES["yearly_coverage_full_outer"] = lambda spark, folder: COV.raw_coverage_counts(BQ.transactions(spark, folder), V.logs(spark, folder), exact=True)
SQL["yearly_coverage_full_outer"] = V.with_views(["h_logs", "b_orders", "b_alltx"], """
, t AS (SELECT chain, year(make_timestamp(us)) AS year, count(*) AS n, count(DISTINCT target) AS c FROM b_alltx GROUP BY 1, 2),
l AS (SELECT chain, year(block_date) AS year, count(*) AS n, count(DISTINCT contract) AS c FROM h_logs GROUP BY 1, 2)
SELECT coalesce(t.chain, l.chain) AS chain, coalesce(t.year, l.year) AS year, coalesce(t.n, 0) AS tx_count, coalesce(l.n, 0) AS log_count,
       greatest(coalesce(t.c, 0), coalesce(l.c, 0)) AS unique_contract_count, 'raw_index_coverage' AS coverage_layer
FROM t FULL JOIN l ON l.chain = t.chain AND l.year = t.year""")
QUERIES["chain_spine_counts"] = lambda spark, folder: COV.story_scope_counts(V.logs(spark, folder), BQ.transactions(spark, folder), (*V.CHAINS, "scroll"))
SQL["chain_spine_counts"] = V.with_views(["h_logs", "b_orders", "b_alltx"], """
, s(chain) AS (VALUES ('ethereum'), ('bnb'), ('base'), ('avalanche_c'), ('scroll'))
SELECT s.chain, coalesce(l.n, 0) AS raw_log_count, coalesce(l.t, 0) AS tx_with_logs_count, coalesce(l.c, 0) AS log_contract_count,
       coalesce(t.n, 0) AS transaction_count, coalesce(t.c, 0) AS touched_contract_count
FROM s LEFT JOIN (SELECT chain, count(*) AS n, count(DISTINCT tx_hash) AS t, count(DISTINCT contract) AS c FROM h_logs GROUP BY 1) l ON l.chain = s.chain
LEFT JOIN (SELECT chain, count(*) AS n, count(DISTINCT target) AS c FROM b_alltx GROUP BY 1) t ON t.chain = s.chain""")


def transfer_logs(spark, folder) -> DataFrame:
    """Transfers seen as logs of their transaction."""
    return BQ.transfers(spark, folder).withColumnRenamed("evt_index", "log_index")


_SUSPICIOUS_SQL = """
SELECT chain, year, '{f}' AS failure_class, count(DISTINCT tx_hash) AS suspicious_tx_count, count(DISTINCT log_key) AS suspicious_log_count,
       count(DISTINCT actor) AS candidate_actor_count, count(DISTINCT market) AS candidate_market_count, 'rule_suspicious_coverage' AS coverage_layer
FROM s GROUP BY 1, 2"""
QUERIES["suspicious_counts_r1"] = lambda spark, folder: COV.feed_binding_suspicious(
    BQ.transactions(spark, folder), BQ.traces(spark, folder), BQ.tokens(spark, folder), transfer_logs(spark, folder), exact=True)
SQL["suspicious_counts_r1"] = V.with_views(["b_orders", "b_tokens", "b_tx", "b_transfers"], f"""
, m AS (SELECT DISTINCT chain, address FROM b_tokens WHERE regexp_matches(lower(symbol || ' ' || name), '{COV.RAW_LENDING_TOKEN}')),
d AS (SELECT t.chain, year(make_timestamp(t.us)) AS year, t.hash AS tx_hash, t.sender AS actor, t.target AS market FROM b_tx t LEFT JOIN m ON m.chain = t.chain AND m.address = t.target
      WHERE regexp_matches(lower(t.fn), '(oracle|price|feed|source|aggregator|asset|underlying)')
         OR (m.address IS NOT NULL AND regexp_matches(lower(t.fn), '(borrow|mint|supply|deposit|liquidat)'))),
s AS (SELECT d.*, l.tx_hash || ':' || l.evt_index AS log_key FROM d LEFT JOIN b_transfers l ON l.chain = d.chain AND l.tx_hash = d.tx_hash)
""" + _SUSPICIOUS_SQL.format(f=R.FEED_BINDING))
QUERIES["suspicious_counts_r2"] = lambda spark, folder: COV.composition_suspicious(
    BQ.transactions(spark, folder), BQ.traces(spark, folder), transfer_logs(spark, folder), exact=True)
SQL["suspicious_counts_r2"] = V.with_views(["b_orders", "b_tx", "b_transfers"], f"""
, d AS (SELECT chain, year(make_timestamp(us)) AS year, hash AS tx_hash, sender AS actor, target AS market FROM b_tx
        WHERE regexp_matches(lower(fn || ' ' || data), '{COV.COMPOSITION_CALL}')),
s AS (SELECT d.*, l.tx_hash || ':' || l.evt_index AS log_key FROM d LEFT JOIN b_transfers l ON l.chain = d.chain AND l.tx_hash = d.tx_hash)
""" + _SUSPICIOUS_SQL.format(f=R.COMPOSITION))
QUERIES["suspicious_counts_r3"] = lambda spark, folder: COV.freshness_suspicious(
    BQ.answer_logs(spark, folder), BQ.transfers(spark, folder), BQ.tokens(spark, folder), exact=True)
SQL["suspicious_counts_r3"] = V.with_views(["b_orders", "b_labels", "b_tokens", "b_transfers", "b_answers"], """
, s AS (
  SELECT chain, year(make_timestamp(us)) AS year, tx_hash, NULL AS actor, feed AS market, tx_hash || ':0' AS log_key FROM b_answers WHERE answer > 0 AND answer <= 1
  UNION ALL SELECT chain, year(make_timestamp(us)), tx_hash, receiver, sender, tx_hash || ':' || evt_index FROM b_transfers
  WHERE amount > 0 AND usd >= 10000 AND (chain, sender) IN (SELECT (chain, address) FROM b_tokens WHERE regexp_matches(lower(symbol || ' ' || name), '(^|[^a-z0-9])(a|b|c|m|v)[a-z0-9]+')))
""" + _SUSPICIOUS_SQL.format(f=R.FRESHNESS))


def case_manifest(spark) -> DataFrame:
    rows = [(c, f"{c} case", "bsc" if c == "bnb" else c, f, R.FEED_SET) for c, f in zip(V.CHAINS, (*CLASSES, "price_semantics_mismatch"), strict=True)]
    return R.inline(spark, rows, "case string, name string, chain string, failure_class string, trigger_event string").withColumn(
        "impact_events", F.array(F.lit(R.BORROW), F.lit(R.LIQUIDATE)))


V.register_view_sql("h_cases", f"""h_cases(kase, name, chain, display_chain, failure_class, broad) AS (VALUES
  ('ethereum', 'ethereum case', 'ethereum', 'ethereum', '{CLASSES[0]}', '{CLASSES[0]}'), ('bnb', 'bnb case', 'bnb', 'bsc', '{CLASSES[1]}', '{CLASSES[1]}'),
  ('base', 'base case', 'base', 'base', '{CLASSES[2]}', '{CLASSES[2]}'),
  ('avalanche_c', 'avalanche_c case', 'avalanche_c', 'avalanche', 'price_semantics_mismatch', '{CLASSES[1]}'))""")
V.register_view_sql("h_manifest", """h_manifest AS (
  SELECT t.kase AS "case", c.name AS case_name, c.chain, c.failure_class AS original_failure_class, c.broad AS broad_failure_class, t.event_type, t.tx_hash,
         t.pos AS block_number_local, t.stamp AS block_timestamp_local, c.display_chain, CAST(2024 AS BIGINT) AS year_local
  FROM h_trace t JOIN h_cases c ON c.kase = t.kase WHERE t.event_type IN ('BORROW', 'LIQUIDATE')
  QUALIFY row_number() OVER (PARTITION BY t.kase, t.tx_hash ORDER BY t.pos) = 1)""")
QUERIES["attack_tx_manifest"] = lambda spark, folder: COV.attack_tx_manifest(RQ.trace(spark, folder), case_manifest(spark))
SQL["attack_tx_manifest"] = V.with_views(["h_logs", "h_trace", "h_cases", "h_manifest"], "SELECT * FROM h_manifest")
QUERIES["manifest_counts"] = lambda spark, folder: COV.count_by(
    COV.attack_tx_manifest(RQ.trace(spark, folder), case_manifest(spark)), "case", "broad_failure_class")
SQL["manifest_counts"] = V.with_views(["h_logs", "h_trace", "h_cases", "h_manifest"],
                                      'SELECT "case", broad_failure_class, count(*) AS "count" FROM h_manifest GROUP BY 1, 2')


def _index(spark, folder) -> DataFrame:
    """Transactions whose first event is not a signup stand for the searched index."""
    return V.transactions(spark, folder).where(F.col("first_topic") != "signup").withColumn("success", F.lit(True))


def _hits(spark, folder):
    return COV.case_hits(COV.attack_tx_manifest(RQ.trace(spark, folder), case_manifest(spark)), _index(spark, folder))


QUERIES["case_hits"] = lambda spark, folder: _hits(spark, folder).drop("block_time")
SQL["case_hits"] = V.with_views(["h_logs", "h_tx", "h_trace", "h_cases", "h_manifest"], """
SELECT m."case" AS case_id, m.case_name, m.display_chain AS chain, m.original_failure_class, m.broad_failure_class AS expected_broad_failure_class, m.event_type, m.tx_hash,
       t.block_number, CASE WHEN t.tx_hash IS NOT NULL THEN true END AS success, t.sender AS tx_from, t.target AS tx_to, t.tx_hash IS NOT NULL AS found_in_index,
       CASE WHEN t.tx_hash IS NOT NULL THEN m.broad_failure_class END AS matched_failure_class,
       CASE WHEN t.tx_hash IS NOT NULL THEN 'raw_transaction_in_scope' ELSE 'not_found_in_transactions' END AS matched_rule_stage
FROM h_manifest m LEFT JOIN h_tx t ON t.chain = m.chain AND t.tx_hash = m.tx_hash AND t.first_topic <> 'signup'""")
QUERIES["case_hit_summary"] = lambda spark, folder: COV.case_hit_summary(_hits(spark, folder))
SQL["case_hit_summary"] = V.with_views(["h_logs", "h_tx", "h_trace", "h_cases", "h_manifest"], """
SELECT m."case" AS case_id, count(*) AS expected_attack_tx_count, count(t.tx_hash) AS found_count, count(t.tx_hash) AS rule_matched_count,
       count(t.tx_hash) = count(*) AS all_attack_txs_found, count(t.tx_hash) > 0 AS has_representative_rule_match
FROM h_manifest m LEFT JOIN h_tx t ON t.chain = m.chain AND t.tx_hash = m.tx_hash AND t.first_topic <> 'signup' GROUP BY 1""")


def _seeds(spark, folder):
    return COV.seed_candidates(RQ.trace(spark, folder), case_manifest(spark)).select(
        "candidate_id", "chain", "failure_class", "trigger_tx", "trigger_block", "affected_asset", "evidence_tier", "has_actor", "has_temporal_order",
        "trigger_to_impact_seconds", "impact_tx_count", "actor_count", "source_quality")


QUERIES["seed_candidates"] = _seeds
SQL["seed_candidates"] = V.with_views(["h_logs", "h_trace", "h_cases"], f"""
, t AS (SELECT kase, arg_min(struct_pack(tx_hash, pos, stamp, asset), pos) AS t FROM h_trace WHERE event_type = 'ORACLE_FEED_SET' GROUP BY 1),
i AS (SELECT h.kase, arg_min(h.stamp, h.pos) FILTER (h.stamp >= t.t.stamp) AS at, count(DISTINCT h.tx_hash) AS n FROM h_trace h JOIN t ON t.kase = h.kase
      WHERE h.event_type IN ('BORROW', 'LIQUIDATE') GROUP BY 1),
a AS (SELECT kase, count(DISTINCT who) AS n FROM h_trace GROUP BY 1)
SELECT 'seed-' || c.kase AS candidate_id, CASE c.chain WHEN 'bnb' THEN 'bsc' ELSE c.chain END AS chain, c.failure_class, t.t.tx_hash AS trigger_tx, t.t.pos AS trigger_block,
       t.t.asset AS affected_asset, '{R.TIER_A}' AS evidence_tier, true AS has_actor, true AS has_temporal_order, greatest(0, i.at - t.t.stamp) AS trigger_to_impact_seconds,
       i.n AS impact_tx_count, a.n AS actor_count,
       CASE c.failure_class WHEN '{R.FEED_BINDING}' THEN 'receipt_flow_decoded' WHEN '{R.COMPOSITION}' THEN 'dune_decoded_event_plus_receipt'
            WHEN '{R.FRESHNESS}' THEN 'dune_or_local_decoded_event' ELSE 'forum_canonical_tx_list' END AS source_quality
FROM h_cases c JOIN t ON t.kase = c.kase JOIN i ON i.kase = c.kase JOIN a ON a.kase = c.kase""")


# --- known transaction coverage by topic ----------------------------------------------------------------------

def evidence(spark, folder) -> DataFrame:
    """Known transactions, each expected to show a binding change; dates come from their first log."""
    first = V.logs(spark, folder).groupBy("blockchain", "tx_hash").agg(F.min("block_date").alias("tx_date"))
    return known_txs(spark, folder).join(first.withColumnRenamed("blockchain", "chain"), ["chain", "tx_hash"]).select(
        F.col("case").alias("case_id"), "chain", F.lit(R.FEED_BINDING).alias("failure_class"), F.lit("first_attack_tx").alias("evidence_scope"),
        F.lit("R1").alias("expected_rule"), F.lit(R.S2).alias("expected_scope_class"), "tx_hash", "tx_date")


def _hit_validation(spark, folder):
    from feedwake.operators.closure import case_hit_validation

    rules = R.inline(spark, [("signup", "R_PRE_FEED_BINDING_CONFIG", True), ("view", "R_PRE_ORACLE_UPDATE", True), ("error", "R_IMPACT_LIQUIDATION", False)],
                     "topic0 string, rule_id string, semantic_boundary boolean")
    return case_hit_validation(evidence(spark, folder), V.logs(spark, folder), rules)


V.register_view_sql("h_evidence", "h_evidence AS (SELECT k.chain, k.tx_hash, min(l.block_date) AS tx_date FROM h_known k JOIN h_logs l ON l.chain = k.chain AND l.tx_hash = k.tx_hash GROUP BY 1, 2)")
QUERIES["case_hit_validation"] = _hit_validation
SQL["case_hit_validation"] = V.with_views(["h_logs", "h_known", "h_evidence"], f"""
, r(topic0, rule_id, semantic) AS (VALUES ('signup', 'R_PRE_FEED_BINDING_CONFIG', true), ('view', 'R_PRE_ORACLE_UPDATE', true), ('error', 'R_IMPACT_LIQUIDATION', false))
SELECT e.chain AS case_id, e.chain, '{R.FEED_BINDING}' AS failure_class, 'first_attack_tx' AS evidence_scope, 'R1' AS expected_rule, e.tx_hash, count(l.topic0) AS receipt_log_count,
       count(r.rule_id) AS matched_log_count, count(*) FILTER (r.semantic) AS semantic_log_count, coalesce(string_agg(DISTINCT r.rule_id, ', ' ORDER BY r.rule_id), '') AS matched_rules,
       count(*) FILTER (r.semantic) > 0 AS covered_by_minimal_filter
FROM h_evidence e LEFT JOIN h_logs l ON l.chain = e.chain AND l.tx_hash = e.tx_hash AND l.block_date = e.tx_date LEFT JOIN r ON r.topic0 = l.topic0 GROUP BY e.chain, e.tx_hash""")


def _topic_coverage(spark, folder):
    from feedwake.operators.closure import topic0_case_coverage

    return topic0_case_coverage(evidence(spark, folder), V.logs(spark, folder), V.boundary_rules(spark))


QUERIES["topic0_case_coverage"] = _topic_coverage
SQL["topic0_case_coverage"] = V.with_views(["h_logs", "h_known", "h_evidence"], f"""
, r(topic0, rule_id, scope) AS (VALUES ('signup', 'R_SIGNUP', '{R.S2}'), ('view', 'R_VIEW', '{R.S1}'))
SELECT e.chain AS case_id, e.chain, e.tx_hash, '{R.S2}' AS expected_scope_class, count(l.topic0) AS receipt_log_count, count(r.rule_id) AS matched_log_count,
       count(DISTINCT l.topic0) AS unique_topic0_count, count(DISTINCT CASE WHEN r.rule_id IS NOT NULL THEN l.topic0 END) AS matched_topic0_count,
       coalesce(string_agg(DISTINCT r.rule_id, ',' ORDER BY r.rule_id), '') AS matched_rules,
       coalesce(string_agg(DISTINCT CASE WHEN r.rule_id IS NULL THEN l.topic0 END, ',' ORDER BY CASE WHEN r.rule_id IS NULL THEN l.topic0 END), '') AS unmatched_topic0s,
       coalesce(string_agg(DISTINCT r.scope, ',' ORDER BY r.scope), '') AS matched_scope_classes, bool_or(coalesce(r.scope = '{R.S2}', false)) AS expected_scope_matched
FROM h_evidence e LEFT JOIN h_logs l ON l.chain = e.chain AND l.tx_hash = e.tx_hash AND l.block_date = e.tx_date LEFT JOIN r ON r.topic0 = l.topic0 GROUP BY e.chain, e.tx_hash""")

# --- benign controls ------------------------------------------------------------------------------------------

WINDOW = ("2024-01-10 06:00:00", "2024-01-12 18:00:00")
GUARD = 24


def _window(df: DataFrame) -> DataFrame:
    micros = lambda t: F.timestamp_micros(V.wall_micros(f"TIMESTAMP_NTZ '{t}'"))
    return df.withColumn("incident_start", micros(WINDOW[0])).withColumn("incident_end", micros(WINDOW[1]))


def case_contracts(spark) -> DataFrame:
    rows = [(f"case_{c}", c, contract) for c in V.CHAINS for contract in ("C1", "C2", "C3", "C4", "C5")]
    return _window(R.inline(spark, rows, "case_id string, chain string, contract_address string").withColumn("failure_class", F.lit(R.FRESHNESS)))


def bounds(spark) -> DataFrame:
    return case_contracts(spark).select(
        "case_id", "chain", F.col("contract_address").alias("feed_address"), F.lit(5.0).alias("normal_min"), F.lit(100.0).alias("normal_max"), F.lit(8).alias("answer_decimals"),
        "incident_start", "incident_end")


V.register_view_sql("h_contracts", "h_contracts AS (SELECT 'case_' || chain AS case_id, chain, contract FROM (VALUES ('ethereum'), ('bnb'), ('base'), ('avalanche_c')) c(chain), (VALUES ('C1'), ('C2'), ('C3'), ('C4'), ('C5')) k(contract))")
_FREE = (f"NOT (l.us BETWEEN epoch_us(TIMESTAMP '{WINDOW[0]}') - {GUARD} * 3600000000 AND epoch_us(TIMESTAMP '{WINDOW[1]}') + {GUARD} * 3600000000) "
         "AND (l.chain, l.tx_hash) NOT IN (SELECT (chain, tx_hash) FROM h_known)")


def _same_oracle(spark, folder):
    return SMP.benign_same_oracle(V.logs(spark, folder), bounds(spark), known_txs(spark, folder), GUARD, answer=F.abs("value"), topic0="view")


_SAMPLE = ["sample_id", "label", "benign_stratum", "chain", "year", "scope_class", "tx_hash", "contract_address", "topic0", "case_related_to", "expected_violation"]
V.register_view_sql("h_same_oracle", f"""h_same_oracle AS (
  SELECT 'benign-same_oracle-' || l.chain || '-' || l.tx_hash AS sample_id, CASE WHEN abs(l.value) BETWEEN 5 AND 100 THEN 'benign_verified' ELSE 'unknown_negative' END AS label,
         'same_oracle' AS benign_stratum, l.chain, year(l.block_date) AS year, 'S1' AS scope_class, l.tx_hash, l.contract AS contract_address, l.topic0, c.case_id AS case_related_to,
         false AS expected_violation, abs(l.value) AS normalized_answer
  FROM h_logs l JOIN h_contracts c ON c.chain = l.chain AND c.contract = l.contract WHERE l.topic0 = 'view' AND {_FREE})""")
QUERIES["guard_window_benign"] = lambda spark, folder: _same_oracle(spark, folder).select(*_SAMPLE, "normalized_answer")
SQL["guard_window_benign"] = V.with_views(["h_logs", "h_known", "h_contracts", "h_same_oracle"], "SELECT * FROM h_same_oracle")


def topic_rules(spark) -> DataFrame:
    rules = V.boundary_rules(spark).select("topic0", F.substring("scope_class", 1, 2).alias("scope_class"), "topic_name")
    impacts = V.impact_rules(spark).select("topic0", F.lit("IMPACT").alias("scope_class"), "topic_name")
    return rules.unionByName(impacts)


QUERIES["same_protocol_benign"] = lambda spark, folder: SMP.benign_same_protocol(
    V.logs(spark, folder), case_contracts(spark), known_txs(spark, folder), topic_rules(spark), GUARD).select(*_SAMPLE, "failure_class", "topic_name")
SQL["same_protocol_benign"] = V.with_views(["h_logs", "h_known", "h_contracts"], f"""
SELECT 'benign-same_protocol-' || l.chain || '-' || l.tx_hash AS sample_id, 'unknown_negative' AS label, 'same_protocol' AS benign_stratum, l.chain, year(l.block_date) AS year,
       CASE l.topic0 WHEN 'signup' THEN 'S2' WHEN 'view' THEN 'S1' ELSE 'IMPACT' END AS scope_class, l.tx_hash, l.contract AS contract_address, l.topic0,
       c.case_id AS case_related_to, false AS expected_violation, '{R.FRESHNESS}' AS failure_class, l.topic0 AS topic_name
FROM h_logs l JOIN h_contracts c ON c.chain = l.chain AND c.contract = l.contract WHERE {_FREE}""")


def _cross(spark, folder):
    contracts = case_contracts(spark)
    windows = contracts.select("case_id", "chain", "incident_start", "incident_end").distinct()
    return SMP.benign_cross_protocol(V.logs(spark, folder), V.boundary_rules(spark), windows, known_txs(spark, folder), contracts, GUARD)


QUERIES["cross_protocol_benign"] = lambda spark, folder: _cross(spark, folder).select(*_SAMPLE, "topic_name")
SQL["cross_protocol_benign"] = V.with_views(["h_logs", "h_known", "h_contracts"], f"""
SELECT 'benign-cross_protocol-' || l.chain || '-' || l.tx_hash AS sample_id, 'unknown_negative' AS label, 'cross_protocol' AS benign_stratum, l.chain, year(l.block_date) AS year,
       CASE l.topic0 WHEN 'signup' THEN '{R.S2}' ELSE '{R.S1}' END AS scope_class, l.tx_hash, l.contract AS contract_address, l.topic0, '' AS case_related_to,
       false AS expected_violation, l.topic0 AS topic_name
FROM h_logs l WHERE l.topic0 IN ('signup', 'view') AND {_FREE} AND (l.chain, l.contract) NOT IN (SELECT (chain, contract) FROM h_contracts)""")
QUERIES["known_tx_anti"] = lambda spark, folder: SMP._unknown_txs(V.logs(spark, folder), known_txs(spark, folder)).select(F.col("blockchain").alias("chain"), "tx_hash", "block_number")
SQL["known_tx_anti"] = V.with_views(["h_logs", "h_known"], "SELECT chain, tx_hash, block_number FROM h_logs WHERE (chain, tx_hash) NOT IN (SELECT (chain, tx_hash) FROM h_known)")


def _topic_pool(spark, folder):
    dates = lambda df: df.withColumn("start_date", F.lit("2024-01-03").cast("date")).withColumn("end_date", F.lit("2024-01-28").cast("date"))
    rows = [(f"case_{c}", c, "signup", "S2") for c in V.CHAINS]
    controls = dates(_window(R.inline(spark, rows, "case_related_to string, chain string, topic0 string, scope_class string")))
    return SMP.topic_fallback_pool(V.logs(spark, folder), controls, known_txs(spark, folder), GUARD)


V.register_view_sql("h_topic_pool", f"""h_topic_pool AS (
  SELECT DISTINCT 2 AS source_priority, 'case_topic' AS benign_stratum, 'unknown_negative' AS label, 'case_' || l.chain AS case_related_to, l.chain, year(l.block_date) AS year,
         'S2' AS scope_class, l.tx_hash, l.contract AS contract_address, l.topic0, CAST(NULL AS DOUBLE) AS normalized_answer, l.us
  FROM h_logs l WHERE l.topic0 = 'signup' AND l.block_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND {_FREE})""")
QUERIES["quota_per_case"] = lambda spark, folder: SMP.benign_quota(_same_oracle(spark, folder), _topic_pool(spark, folder), 200).select(
    "sample_id", "label", "benign_stratum", "case_related_to", "chain", "tx_hash", "contract_address", "topic0", "normalized_answer", "deterministic_case_sample_index")
SQL["quota_per_case"] = V.with_views(["h_logs", "h_known", "h_contracts", "h_same_oracle", "h_topic_pool"], """
, pool AS (
  SELECT DISTINCT 1 AS source_priority, benign_stratum, label, case_related_to, chain, tx_hash, contract_address, topic0, normalized_answer FROM h_same_oracle WHERE label = 'benign_verified'
  UNION ALL SELECT source_priority, benign_stratum, label, case_related_to, chain, tx_hash, contract_address, topic0, normalized_answer FROM h_topic_pool)
SELECT 'benign-' || benign_stratum || '-' || case_related_to || '-' || tx_hash AS sample_id, label, benign_stratum, case_related_to, chain, tx_hash, contract_address, topic0,
       normalized_answer, row_number() OVER (PARTITION BY case_related_to ORDER BY source_priority, tx_hash, contract_address, topic0, normalized_answer) AS deterministic_case_sample_index
FROM pool QUALIFY deterministic_case_sample_index <= 200""")


def pool(spark, folder) -> DataFrame:
    """All boundary logs as a sampling pool, by chain."""
    rows = V.logs(spark, folder).where(F.col("topic0").isin("signup", "view"))
    return rows.select(
        F.col("blockchain").alias("case_related_to"), F.col("blockchain").alias("chain"), "tx_hash", "contract_address", "topic0", "log_index", F.col("block_number").alias("input_ord"))


def _sample(spark, folder):
    quotas = R.inline(spark, [("ethereum", 120), ("bnb", 7), ("base", 100_000), ("avalanche_c", 0)], "case_related_to string, quota long")
    return SMP.stratified_sample(pool(spark, folder), quotas, F.col("case_related_to")).select(
        "case_related_to", "tx_hash", "contract_address", "topic0", F.col("log_index").cast("long").alias("log_index"))


V.register_view_sql("h_pool", """h_pool AS (
  SELECT chain AS case_related_to, chain, tx_hash, contract AS contract_address, topic0, log_index, block_number,
         sha256(chain || '|' || chain || '|' || chain || '|' || tx_hash || '|' || lower(contract) || '|' || topic0 || '|' || log_index) AS h FROM h_logs WHERE topic0 IN ('signup', 'view'))""")
QUERIES["stable_sample"] = _sample
SQL["stable_sample"] = V.with_views(["h_logs", "h_pool"], """
, q(case_related_to, quota) AS (VALUES ('ethereum', 120), ('bnb', 7), ('base', 100000), ('avalanche_c', 0))
SELECT p.case_related_to, p.tx_hash, p.contract_address, p.topic0, p.log_index FROM h_pool p JOIN q ON q.case_related_to = p.case_related_to
QUALIFY row_number() OVER (PARTITION BY p.case_related_to ORDER BY h, p.tx_hash, p.log_index) <= q.quota""".replace("<= q.quota", "<= any_value(q.quota) OVER (PARTITION BY p.case_related_to)"))


def _allocation(spark, folder):
    """Pool sizes by contract, small pools whole, then the deficit filled in order."""
    sizes = pool(spark, folder).groupBy(F.col("contract_address").alias("stratum")).agg(F.count(F.lit(1)).alias("estimate"))
    place = F.regexp_replace("stratum", "C", "").cast("long")
    quotas = SMP.allocation(sizes.withColumn("place", place), 1500, 200)
    return SMP.top_up(quotas, 137).select("stratum", "estimate", "quota")


QUERIES["stratified_allocation"] = _allocation
SQL["stratified_allocation"] = V.with_views(["h_logs", "h_pool"], """
, e AS (SELECT contract_address AS stratum, count(*) AS estimate, CAST(replace(contract_address, 'C', '') AS BIGINT) AS place FROM h_pool GROUP BY 1),
t AS (SELECT greatest(0, 1500 - coalesce(sum(estimate) FILTER (estimate < 200), 0)) AS rest, count(*) FILTER (estimate >= 200) AS n FROM e),
q AS (SELECT e.*, CASE WHEN estimate < 200 THEN estimate ELSE least(estimate, rest // n + CASE WHEN sum(CASE WHEN estimate >= 200 THEN 1 ELSE 0 END) OVER (ORDER BY place) <= rest % n THEN 1 ELSE 0 END) END AS quota FROM e, t),
r AS (SELECT *, coalesce(sum(estimate - quota) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q)
SELECT stratum, estimate, CAST(quota + greatest(0, least(estimate - quota, 137 - earlier)) AS BIGINT) AS quota FROM r""")


def _ingest(spark, folder):
    k = F.col("k")
    rows = V.logs(spark, folder).select(
        F.col("block_number").alias("input_ord"), F.when(k % 9 == 0, F.lit("0xbad")).otherwise(F.upper("tx_hash")).alias("tx_hash"), F.col("blockchain").alias("blockchain"),
        BQ.at(("same_oracle", "other", "same_protocol"), k % 3).alias("stratum"), F.when(k % 4 == 0, F.lit("positive")).when(k % 4 == 1, F.lit("benign_verified")).alias("label"),
        F.when(k % 7 == 0, F.lit("Yes")).alias("verified_normality"), F.col("contract_address").alias("address"), F.upper("topic0").alias("topic0"), F.lit("2024.0").alias("block_year"))
    found = SMP.ingest_benign(rows, known_txs(spark, folder))
    return found.select("sample_id", "label", "benign_stratum", "chain", "display_chain", "year", "tx_hash", "contract_address", "topic0", "materialization_status")


QUERIES["ingest_benign"] = _ingest
SQL["ingest_benign"] = V.with_views(["h_logs", "h_known"], """
, r AS (SELECT block_number AS n, tx_hash AS tx, chain, CASE k % 3 WHEN 0 THEN 'same_oracle' WHEN 1 THEN 'cross_protocol' ELSE 'same_protocol' END AS stratum,
               CASE WHEN k % 4 = 0 THEN 'unknown_negative' WHEN k % 4 = 1 THEN 'benign_verified' WHEN k % 7 = 0 THEN 'benign_verified' ELSE 'unknown_negative' END AS label, contract, topic0
        FROM h_logs WHERE k % 9 <> 0 AND tx_hash NOT IN (SELECT tx_hash FROM h_known))
SELECT 'benign-' || stratum || '-' || lpad(CAST(n AS VARCHAR), 6, '0') || '-' || chain || '-' || substr(tx, 1, 10) AS sample_id, label, stratum AS benign_stratum, chain,
       CASE chain WHEN 'bnb' THEN 'bsc' WHEN 'avalanche_c' THEN 'avalanche' ELSE chain END AS display_chain, CAST(2024 AS BIGINT) AS year, tx AS tx_hash, lower(contract) AS contract_address,
       topic0, 'remote_candidate_pending_receipt_replay' AS materialization_status
FROM r QUALIFY row_number() OVER (PARTITION BY stratum, tx, topic0, lower(contract) ORDER BY n) = 1""")


def _keep_first(spark, folder):
    rows = V.logs(spark, folder).select(F.col("blockchain").alias("chain"), "contract_address", "topic0", "actor", "block_number", "value")
    return D.keep_first(rows, ["chain", "contract_address", "topic0", "actor"], ["block_number"])


QUERIES["keep_first_dedupe"] = _keep_first
SQL["keep_first_dedupe"] = V.with_views(["h_logs"], """
SELECT chain, contract AS contract_address, topic0, actor, block_number, value FROM h_logs
QUALIFY row_number() OVER (PARTITION BY chain, contract, topic0, actor ORDER BY block_number) = 1""")


def _buckets(spark, folder):
    """A quarter of all transactions by hash prefix, logs counted by topic."""
    logs = V.logs(spark, folder).withColumn("tx_hash", F.concat(F.lit("0x"), F.sha2(F.col("tx_id").cast("string"), 256)))
    return SMP.bucket_sample(logs, 64).groupBy("topic0").agg(F.count(F.lit(1)).alias("logs"), F.count_distinct("tx_hash").alias("txs"))


QUERIES["bucket_sample"] = _buckets
SQL["bucket_sample"] = V.with_views(["h_logs"], """
SELECT topic0, count(*) AS logs, count(DISTINCT tx_id) AS txs FROM h_logs WHERE ('0x' || sha256(CAST(tx_id AS VARCHAR))[1:2])::BIGINT % 4 = 0 GROUP BY 1""")
