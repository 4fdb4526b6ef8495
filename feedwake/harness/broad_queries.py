"""Chain-wide searches over chain tables derived from orders, line items, suppliers and parts.

Suppliers stand for labelled contracts, parts for tokens, orders for transactions, line items for transfers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.harness import views as V
from feedwake.operators import broad as B
from feedwake.operators import inventory as INV
from feedwake.storage import write_table

QUERIES = {}
SQL = {}
PROTOCOLS = ("aave", "compound", "venus", "acme", "zeta")
KINDS = ("oracle", "timelock", "pool", "market")
LABEL_ASSETS = ("usdc", "cbeth", "weth", "btc", "luna", "dai", "foo")
PREFIXES = ("c", "v", "a", "x", "", "b")
SYMBOLS = ("USDC", "cbETH", "WETH", "wstETH", "LUNA", "DAI", "BTC", "FOO", "AVAX")
TOKEN_PROTOCOLS = ("aave", "venus", "benqi")
CALLS = ("setPriceFeed", "borrow", "mint", "supplyCollateral", "executeProposal", "transfer", "setCBETHRatio", "sync")


def at(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def contract(kind: str, key) -> object:
    return F.concat(F.lit("0x"), F.substring(F.sha2(F.concat(F.lit(kind), key.cast("string")), 256), 1, 40))


def _list(names) -> str:
    return "[" + ",".join(f"'{n}'" for n in names) + "]"


def _chain_sql(key: str) -> str:
    return f"{_list(V.CHAINS)}[({key} % 4) + 1]"


def _contract_sql(kind: str, key: str) -> str:
    return f"'0x' || substr(sha256('{kind}' || CAST({key} AS VARCHAR)), 1, 40)"


def labels(spark, folder) -> DataFrame:
    key = F.col("s_suppkey")
    name = F.concat_ws(" ", at(PROTOCOLS, key % 5), at(KINDS, F.col("s_nationkey") % 4), at(LABEL_ASSETS, key % 7))
    return V.table(spark, folder, "supplier").select(at(V.CHAINS, key % 4).alias("blockchain"), contract("S", key).alias("address"), name.alias("name"))


def tokens(spark, folder) -> DataFrame:
    key = F.col("p_partkey")
    return V.table(spark, folder, "part").select(
        at(V.CHAINS, key % 4).alias("blockchain"), contract("P", key).alias("contract_address"),
        F.concat(
            at(PREFIXES, key % 6), at(SYMBOLS, key % 9), F.when((key % 6 == 4) & (key >= 54), F.floor(key / 54).cast("string")).otherwise(F.lit(""))
        ).alias("symbol"),
        F.concat_ws(" ", at(TOKEN_PROTOCOLS, key % 3), at(SYMBOLS, key % 9)).alias("name"),
    )


V.register_view_sql("b_labels", f"""b_labels AS (
  SELECT {_chain_sql('s_suppkey')} AS chain, {_contract_sql('S', 's_suppkey')} AS address,
         {_list(PROTOCOLS)}[(s_suppkey % 5) + 1] || ' ' || {_list(KINDS)}[(s_nationkey % 4) + 1] || ' ' || {_list(LABEL_ASSETS)}[(s_suppkey % 7) + 1] AS name
  FROM supplier)""")
V.register_view_sql("b_tokens", f"""b_tokens AS (
  SELECT {_chain_sql('p_partkey')} AS chain, {_contract_sql('P', 'p_partkey')} AS address,
         {_list(PREFIXES)}[(p_partkey % 6) + 1] || {_list(SYMBOLS)}[(p_partkey % 9) + 1]
           || CASE WHEN p_partkey % 6 = 4 AND p_partkey >= 54 THEN CAST(p_partkey // 54 AS VARCHAR) ELSE '' END AS symbol,
         {_list(TOKEN_PROTOCOLS)}[(p_partkey % 3) + 1] || ' ' || {_list(SYMBOLS)}[(p_partkey % 9) + 1] AS name FROM part)""")


def order_lines(spark, folder) -> DataFrame:
    """Orders with the keys of their first and last line."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ends = V.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    orders = V.table(spark, folder, "orders").join(ends, "o_orderkey")
    micros = V.wall_micros("o_orderdate") + (F.col("o_custkey") * 37 % 86400) * 1_000_000
    return orders.withColumn("us", micros)


V.register_view_sql("b_orders", """b_orders AS (
  SELECT o.*, epoch_us(o_orderdate) + (o_custkey * 37 % 86400) * 1000000 AS us, e.f, e.l FROM orders o JOIN (
    SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS f, max({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS l
    FROM lineitem GROUP BY 1) e ON e.l_orderkey = o.o_orderkey)""")


def written_lines(spark, folder) -> DataFrame:
    """``order_lines`` as far as transactions and traces read them, written once for both."""
    return write_table(order_lines(spark, folder).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "us", "first", "last"))


def transactions(spark, folder, lines: DataFrame | None = None) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    zeros = F.lit("0" * 24)
    address = lambda kind, key: F.substring(contract(kind, F.col(key)), 3, 40)
    return (order_lines(spark, folder) if lines is None else lines).select(
        F.when(urgent, at(V.CHAINS, F.col("first.l_suppkey") % 4)).otherwise(at(V.CHAINS, F.col("first.l_partkey") % 4)).alias("blockchain"),
        F.to_date(F.timestamp_micros("us")).alias("block_date"), F.timestamp_micros("us").alias("block_time"),
        F.col("o_orderkey").alias("block_number"), V.hash_of(F.col("o_orderkey")).alias("hash"), contract("U", F.col("o_custkey")).alias("from"),
        F.when(urgent, contract("S", F.col("first.l_suppkey"))).otherwise(contract("P", F.col("first.l_partkey"))).alias("to"),
        F.concat(F.lit("0x"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8), zeros, address("P", "last.l_partkey"), zeros,
                 address("S", "last.l_suppkey")).alias("data"),
        (F.col("o_orderstatus") != "F").alias("success"),
    )


_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
V.register_view_sql("b_tx", f"""b_tx AS (
  SELECT CASE WHEN {_URGENT} THEN {_chain_sql('f.s')} ELSE {_chain_sql('f.p')} END AS chain, us, o_orderkey AS block_number,
         '0x' || lpad(lower(to_hex(o_orderkey)), 64, '0') AS hash, {_contract_sql('U', 'o_custkey')} AS sender,
         CASE WHEN {_URGENT} THEN {_contract_sql('S', 'f.s')} ELSE {_contract_sql('P', 'f.p')} END AS target,
         substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) || repeat('0', 24) || substr({_contract_sql('P', 'l.p')}, 3) || repeat('0', 24)
           || substr({_contract_sql('S', 'l.s')}, 3) AS data,
         {_list(CALLS)}[(o_custkey % 8) + 1] AS fn
  FROM b_orders WHERE o_orderstatus <> 'F')""")


def traces(spark, folder, lines: DataFrame | None = None) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (order_lines(spark, folder) if lines is None else lines).select(
        F.when(urgent, at(V.CHAINS, F.col("first.l_suppkey") % 4)).otherwise(at(V.CHAINS, F.col("first.l_partkey") % 4)).alias("blockchain"),
        F.to_date(F.timestamp_micros("us")).alias("block_date"), V.hash_of(F.col("o_orderkey")).alias("tx_hash"),
        at(CALLS, F.col("o_custkey") % 8).alias("function_name"),
    )


def transfers(spark, folder) -> DataFrame:
    """Line items: returned ones pay out of a market, accepted ones pay in, the others come from suppliers."""
    orders = V.table(spark, folder, "orders").withColumn("us", V.wall_micros("o_orderdate") + (F.col("o_custkey") * 37 % 86400) * 1_000_000)
    rows = V.table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag, token, user = F.col("l_returnflag"), contract("P", F.col("l_partkey")), contract("U", F.col("o_custkey"))
    return rows.select(
        at(V.CHAINS, F.col("l_partkey") % 4).alias("blockchain"), F.to_date(F.timestamp_micros("us")).alias("block_date"),
        F.timestamp_micros("us").alias("block_time"), F.col("o_orderkey").alias("block_number"), V.hash_of(F.col("l_orderkey")).alias("tx_hash"),
        F.col("l_linenumber").cast("int").alias("evt_index"), token.alias("contract_address"),
        F.when(flag == "A", user).when(flag == "R", token).otherwise(contract("S", F.col("l_suppkey"))).alias("from"),
        F.when(flag == "A", token).otherwise(user).alias("to"), F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("amount_usd"),
    )


V.register_view_sql("b_transfers", f"""b_transfers AS (
  SELECT {_chain_sql('l_partkey')} AS chain, epoch_us(o_orderdate) + (o_custkey * 37 % 86400) * 1000000 AS us, o_orderkey AS block_number,
         '0x' || lpad(lower(to_hex(l_orderkey)), 64, '0') AS tx_hash, l_linenumber AS evt_index, {_contract_sql('P', 'l_partkey')} AS token,
         CASE l_returnflag WHEN 'A' THEN {_contract_sql('U', 'o_custkey')} WHEN 'R' THEN {_contract_sql('P', 'l_partkey')}
              ELSE {_contract_sql('S', 'l_suppkey')} END AS sender,
         CASE l_returnflag WHEN 'A' THEN {_contract_sql('P', 'l_partkey')} ELSE {_contract_sql('U', 'o_custkey')} END AS receiver,
         l_quantity AS amount, l_extendedprice AS usd
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")


def answer_logs(spark, folder) -> DataFrame:
    """Finished orders as price reports of the feed that their first supplier stands for."""
    rows = order_lines(spark, folder).where(F.col("o_orderstatus") == "F")
    word = lambda n: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 64, "0"))
    return rows.select(
        at(V.CHAINS, F.col("first.l_suppkey") % 4).alias("blockchain"), F.to_date(F.timestamp_micros("us")).alias("block_date"),
        F.timestamp_micros("us").alias("block_time"), F.col("o_orderkey").alias("block_number"), V.hash_of(F.col("o_orderkey")).alias("tx_hash"),
        F.lit(0).alias("log_index"), contract("S", F.col("first.l_suppkey")).alias("contract_address"), F.lit(R.ANSWER_UPDATED).alias("topic0"),
        word(F.floor(F.col("o_totalprice") * 1000).cast("long")).alias("topic1"), word(F.col("o_orderkey")).alias("topic2"),
        word(F.floor(F.col("us") / 1_000_000).cast("long")).alias("data"),
    )


V.register_view_sql("b_answers", f"""b_answers AS (
  SELECT {_chain_sql('f.s')} AS chain, us, o_orderkey AS block_number, '0x' || lpad(lower(to_hex(o_orderkey)), 64, '0') AS tx_hash,
         {_contract_sql('S', 'f.s')} AS feed, CAST(floor(o_totalprice * 1000) AS BIGINT) / 1e8 AS answer,
         l.name AS feed_label,
         CASE WHEN regexp_matches(l.name, 'cbeth') THEN 'CBETH' WHEN regexp_matches(l.name, 'btc') THEN 'BTC' WHEN regexp_matches(l.name, 'eth') THEN 'ETH'
              WHEN regexp_matches(l.name, 'usdc') THEN 'USDC' WHEN regexp_matches(l.name, 'dai') THEN 'DAI' WHEN regexp_matches(l.name, 'luna') THEN 'LUNA'
         END AS identity
  FROM b_orders LEFT JOIN b_labels l ON l.address = {_contract_sql('S', 'f.s')} AND l.chain = {_chain_sql('f.s')} WHERE o_orderstatus = 'F')""")


def _cluster_sql(label: str) -> str:
    tests = " ".join(f"WHEN regexp_matches(lower({label}), '{p}') THEN '{n}'" for p, n in ID.PROTOCOLS)
    return (f"CASE {tests} ELSE regexp_replace(lower(regexp_replace({label}, '[^A-Za-z0-9 ]', ' ', 'g')), '\\s+', '_', 'g') END")


def _asset_sql(label: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({label}), '{p}') THEN '{n}'" for p, n in ID.ASSETS) + " END"


V.register_view_sql("b_inventory", f"""b_inventory AS (
  SELECT DISTINCT chain, address, name AS label, {_cluster_sql('name')} AS cluster,
         CASE WHEN regexp_matches(lower(name), '(oracle|price|feed|chainlink)') THEN 'oracle_or_feed'
              WHEN regexp_matches(lower(name), '(govern|timelock|admin|proxy)') THEN 'governance_or_admin' ELSE 'lending_label' END AS role,
         'labels.addresses' AS source
  FROM b_labels WHERE regexp_matches(lower(name), '{ID.PROTOCOL_WORDS}')
  UNION SELECT DISTINCT chain, address, name, {_cluster_sql('name')}, 'market_token', 'tokens.erc20' FROM b_tokens
  WHERE regexp_matches(lower(symbol || ' ' || name), '{ID.PROTOCOL_TOKEN}'))""")
V.register_view_sql("b_feeds", f"""b_feeds AS (
  SELECT DISTINCT chain, address, name AS feed_label, {_asset_sql('name')} AS feed_identity FROM b_labels
  WHERE regexp_matches(lower(name), '{ID.FEED_LABEL}'))""")
V.register_view_sql("b_surface", f"""b_surface AS (
  SELECT DISTINCT i.chain, i.cluster, i.label, t.target AS market, t.fn FROM b_inventory i JOIN b_tx t ON t.chain = i.chain AND t.target = i.address
  WHERE i.role IN ('market_token', 'lending_label') AND regexp_matches(lower(t.fn), '{ID.LENDING_FUNCTION}'))""")
V.register_view_sql("b_cluster", """b_cluster AS (
  SELECT i.* FROM b_inventory i WHERE (i.chain, i.cluster) IN (SELECT (chain, cluster) FROM b_surface))""")
V.register_view_sql("b_changes", f"""b_changes AS (
  SELECT t.chain, t.us, t.block_number, t.hash AS trigger_tx, t.sender AS actor, t.target, t.data, c.label, c.cluster, c.role, t.fn
  FROM b_cluster c JOIN b_tx t ON t.chain = c.chain AND t.target = c.address
  WHERE c.role IN ('oracle_or_feed', 'governance_or_admin', 'lending_label') AND regexp_matches(lower(t.fn), '{ID.BINDING_FUNCTION}'))""")
V.register_view_sql("b_named", f"""b_named AS (
  SELECT b.*, a.address AS asset_address, a.label AS asset_label, {_asset_sql('a.label')} AS asset_identity, f.feed_label, f.feed_identity
  FROM b_changes b
  LEFT JOIN b_cluster a ON a.chain = b.chain AND a.cluster = b.cluster AND a.role IN ('market_token', 'lending_label')
       AND contains(b.data, substr(a.address, 3))
  LEFT JOIN b_feeds f ON f.chain = b.chain AND contains(b.data, substr(f.address, 3)))""")
V.register_view_sql("b_impacts", f"""b_impacts AS (
  SELECT chain, trigger_tx, count(*) AS n, min(us) AS first_us, arg_min(hash, (us, hash)) AS first_tx FROM (
    SELECT DISTINCT b.chain, b.trigger_tx, t.us, t.hash FROM b_changes b
    JOIN (SELECT DISTINCT chain, cluster, market FROM b_surface) s ON s.chain = b.chain AND s.cluster = b.cluster
    JOIN b_tx t ON t.chain = s.chain AND t.target = s.market AND t.us >= b.us AND t.us < b.us + 86400000000
    WHERE regexp_matches(lower(t.fn), '{ID.LENDING_FUNCTION}')) GROUP BY 1, 2)""")
R1_VIEWS = ["b_orders", "b_labels", "b_tokens", "b_tx", "b_inventory", "b_feeds", "b_surface", "b_cluster", "b_changes", "b_named", "b_impacts"]

_COLUMNS = [
    "chain", "protocol", "failure_class", "trigger_tx", "trigger_block", "affected_asset", "has_oracle_anomaly", "impact_tx_count", "impact_usd_known",
    "impact_txs", "has_lending_impact", "has_actor", "has_temporal_order", "has_replayable_constraint", "trigger_to_impact_seconds",
    "source_quality", "source_quality_rank", "evidence_tier",
]


def _r1(spark, folder):
    lines = written_lines(spark, folder)
    return B.feed_binding_candidates(labels(spark, folder), tokens(spark, folder), transactions(spark, folder, lines), traces(spark, folder, lines))


QUERIES["feed_binding_candidates"] = lambda spark, folder: _r1(spark, folder).select(*_COLUMNS, "feed_identity", "identity_mismatch_hint", "protocol_cluster_id")
SQL["feed_binding_candidates"] = V.with_views(R1_VIEWS, f"""
, feat AS (
  SELECT a.chain, coalesce(l.name, a.label) AS protocol, '{R.FEED_BINDING}' AS failure_class, a.trigger_tx, a.block_number AS trigger_block,
         coalesce(a.asset_identity, a.asset_label) AS affected_asset, coalesce(a.asset_identity <> a.feed_identity, false) AS hint,
         a.asset_identity IS NOT NULL AS ao, a.feed_identity IS NOT NULL AS fo, coalesce(i.n, 0) AS n, coalesce(i.first_tx, '') AS impact_txs,
         (i.first_us - a.us) // 1000000 AS secs, a.feed_identity, a.cluster
  FROM b_named a LEFT JOIN b_impacts i ON i.chain = a.chain AND i.trigger_tx = a.trigger_tx
  LEFT JOIN b_labels l ON l.chain = a.chain AND l.address = a.target)
SELECT chain, protocol, failure_class, trigger_tx, trigger_block, affected_asset, hint OR NOT (ao AND fo) AS has_oracle_anomaly, n AS impact_tx_count,
       0.0::DOUBLE AS impact_usd_known, impact_txs, n > 0 AS has_lending_impact, true AS has_actor, n > 0 AS has_temporal_order,
       n > 0 AND hint AS has_replayable_constraint, secs AS trigger_to_impact_seconds,
       CASE WHEN hint AND n > 0 THEN 'decoded_binding_closure' ELSE 'decoded_protocol_event' END AS source_quality,
       CAST(CASE WHEN hint AND n > 0 THEN 1 ELSE 2 END AS BIGINT) AS source_quality_rank,
       CASE WHEN hint AND n > 0 THEN '{R.TIER_A}' WHEN n > 0 THEN '{R.TIER_B}' ELSE '{R.TIER_C}' END AS evidence_tier,
       feed_identity, hint AS identity_mismatch_hint, cluster AS protocol_cluster_id
FROM feat WHERE hint OR NOT (ao AND fo)""")


def _contains(spark, folder):
    inventory = INV.lending_inventory(labels(spark, folder), tokens(spark, folder))
    sent, calls = write_table(transactions(spark, folder)), write_table(traces(spark, folder))
    cluster = B.protocol_cluster(inventory, B.lending_surface(inventory, sent, calls))
    named = B.binding_identities(B.binding_changes(cluster, sent, calls), cluster, INV.price_source_inventory(labels(spark, folder)))
    return named.select(
        F.col("blockchain").alias("chain"), "trigger_tx", "protocol_cluster_id", "affected_asset_address", "asset_identity", "feed_label", "feed_identity"
    )


QUERIES["contains_join_binding"] = _contains
SQL["contains_join_binding"] = V.with_views(R1_VIEWS[:-1], """
SELECT chain, trigger_tx, cluster AS protocol_cluster_id, asset_address AS affected_asset_address, asset_identity, feed_label, feed_identity FROM b_named""")

V.register_view_sql("b_assets", f"""b_assets AS (
  SELECT DISTINCT chain, address, symbol FROM b_tokens WHERE regexp_matches(lower(symbol || ' ' || name), '{ID.DERIVATIVE_ASSET}')
    AND (chain, address) IN (SELECT (chain, address) FROM b_inventory))""")
V.register_view_sql("b_formula", f"""b_formula AS (
  SELECT t.chain, t.us, t.block_number, t.hash AS trigger_tx, t.target, t.data, i.label, i.role, t.fn
  FROM b_inventory i JOIN b_tx t ON t.chain = i.chain AND t.target = i.address WHERE regexp_matches(lower(t.fn || ' ' || t.data), '{ID.FORMULA_CALL}'))""")
V.register_view_sql("b_hints", """b_hints AS (
  SELECT o.*, a.address AS asset_address, a.symbol FROM b_formula o JOIN b_assets a ON a.chain = o.chain
   AND (contains(lower(o.fn), lower(a.symbol)) OR contains(o.data, substr(a.address, 3))))""")
V.register_view_sql("b_activity", """b_activity AS (
  SELECT chain, trigger_tx, count(DISTINCT tx_hash) AS n, sum(usd) AS usd, min(us) AS first_us, arg_min(tx_hash, (us, tx_hash)) AS first_tx FROM (
    SELECT DISTINCT h.chain, h.trigger_tx, t.tx_hash, t.evt_index, t.token, t.sender, t.receiver, t.amount, t.usd, t.us
    FROM (SELECT DISTINCT chain, trigger_tx, us, asset_address FROM b_hints) h
    JOIN b_transfers t ON t.chain = h.chain AND t.us >= h.us AND t.us < h.us + 86400000000
    LEFT JOIN (SELECT DISTINCT chain, address FROM b_inventory WHERE role IN ('market_token', 'lending_label')) s ON s.chain = t.chain AND s.address = t.sender
    LEFT JOIN (SELECT DISTINCT chain, address FROM b_inventory WHERE role IN ('market_token', 'lending_label')) r ON r.chain = t.chain AND r.address = t.receiver
    WHERE t.token = h.asset_address OR s.address IS NOT NULL OR r.address IS NOT NULL) GROUP BY 1, 2)""")
R2_VIEWS = ["b_orders", "b_labels", "b_tokens", "b_tx", "b_inventory", "b_assets", "b_formula", "b_hints", "b_transfers", "b_activity"]


def _r2_tables(spark, folder):
    """The chain tables of this search; transactions and traces share the written lines, transfers are read once and not written."""
    lines = written_lines(spark, folder)
    return labels(spark, folder), tokens(spark, folder), transactions(spark, folder, lines), traces(spark, folder, lines), transfers(spark, folder)


def _r2(spark, folder):
    return B.price_composition_candidates(*_r2_tables(spark, folder))


QUERIES["price_composition_candidates"] = lambda spark, folder: _r2(spark, folder).select(*_COLUMNS).withColumn(
    "impact_usd_known", F.round("impact_usd_known", 2))
SQL["price_composition_candidates"] = V.with_views(R2_VIEWS, f"""
SELECT h.chain, coalesce(l.name, h.label) AS protocol, '{R.COMPOSITION}' AS failure_class, h.trigger_tx, h.block_number AS trigger_block,
       h.symbol AS affected_asset, true AS has_oracle_anomaly, coalesce(i.n, 0) AS impact_tx_count, round(coalesce(i.usd, 0), 2) AS impact_usd_known,
       coalesce(i.first_tx, '') AS impact_txs, coalesce(i.n, 0) > 0 AS has_lending_impact, true AS has_actor, coalesce(i.n, 0) > 0 AS has_temporal_order,
       coalesce(i.n, 0) > 0 AS has_replayable_constraint, (i.first_us - h.us) // 1000000 AS trigger_to_impact_seconds,
       CASE WHEN regexp_matches(lower(h.fn), '(oracle|feed|price|execute|govern)') THEN 'decoded_protocol_event'
            WHEN l.name IS NOT NULL THEN 'label_match' ELSE 'raw_transfer_heuristic' END AS source_quality,
       CAST(CASE WHEN regexp_matches(lower(h.fn), '(oracle|feed|price|execute|govern)') THEN 1 WHEN l.name IS NOT NULL THEN 2 ELSE 4 END AS BIGINT)
         AS source_quality_rank,
       CASE WHEN coalesce(i.n, 0) > 0 THEN '{R.TIER_A}' ELSE '{R.TIER_C}' END AS evidence_tier
FROM b_hints h LEFT JOIN b_activity i ON i.chain = h.chain AND i.trigger_tx = h.trigger_tx
LEFT JOIN b_labels l ON l.chain = h.chain AND l.address = h.target""")

_MARKET_ASSET_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(symbol), '^(a|b|c|m|v)({s}){x}$') OR regexp_matches(lower(symbol || ' ' || name), '(^|[^a-z0-9])({n})([^a-z0-9]|$)') THEN '{i}'"
    for s, x, n, i in ID.MARKET_TOKENS) + " END"
_MARKET_CLUSTER_SQL = (
    f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(name), '(^|[^a-z0-9])({ID.MARKET_WORDS})([^a-z0-9]|$)', ' ', 'g'), "
    "'[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown_market_cluster')")
V.register_view_sql("b_markets", f"""b_markets AS (
  SELECT DISTINCT chain, address, symbol, name AS label, cluster, asset FROM (
    SELECT *, {_MARKET_ASSET_SQL} AS asset, {_MARKET_CLUSTER_SQL} AS cluster FROM b_tokens
    WHERE regexp_matches(lower(symbol), '{ID.GENERIC_MARKET_SYMBOL}') AND NOT regexp_matches(lower(symbol || ' ' || name), '{ID.NOT_A_MARKET}'))
  WHERE asset IS NOT NULL AND cluster <> 'unknown_market_cluster')""")
V.register_view_sql("b_supplies", f"""b_supplies AS (
  SELECT DISTINCT t.chain, m.cluster, m.label, m.address AS market, m.asset, t.token, t.sender AS actor, t.tx_hash AS supply_tx, t.us
  FROM b_markets m JOIN b_transfers t ON t.chain = m.chain AND t.receiver = m.address
  JOIN b_tokens k ON k.chain = t.chain AND k.address = t.token
  WHERE t.amount > 0 AND {_asset_sql("k.symbol || ' ' || k.name")} = m.asset AND (t.usd >= 10000 OR (m.asset NOT IN ('USDC', 'USDT', 'DAI', 'BUSD') AND t.amount >= 1000000)))""")
V.register_view_sql("b_same", """b_same AS (
  SELECT s.chain, s.cluster, s.label, s.market, s.asset, s.token, s.actor, s.supply_tx, s.us, min(t.us) AS borrow_us,
         arg_min(t.tx_hash, (t.us, t.tx_hash)) AS borrow_tx, count(DISTINCT t.tx_hash) + 1 AS n, sum(t.usd) AS usd
  FROM b_supplies s JOIN b_markets m ON m.chain = s.chain AND m.cluster = s.cluster AND m.address <> s.market AND m.asset <> s.asset
  JOIN b_transfers t ON t.chain = s.chain AND t.sender = m.address AND t.receiver = s.actor AND t.us >= s.us AND t.us < s.us + 21600000000
  WHERE t.amount > 0 AND t.usd >= 10000 GROUP BY ALL)""")
V.register_view_sql("b_matched", """b_matched AS (
  SELECT i.*, a.feed, a.identity, a.tx_hash AS trigger_tx, a.block_number AS trigger_block, a.us AS trigger_us, a.answer, 1 AS r
  FROM b_same i JOIN b_answers a ON a.chain = i.chain AND a.identity = i.asset AND a.us <= i.us AND a.us >= i.us - 604800000000
  UNION ALL
  SELECT i.*, a.feed, a.identity, a.tx_hash, a.block_number, a.us, a.answer, 2
  FROM b_same i JOIN b_answers a ON a.chain = i.chain AND a.us <= i.us AND a.us >= i.us - 604800000000 AND a.identity IS NULL
   AND i.asset NOT IN ('USDC', 'USDT', 'DAI', 'BUSD') AND abs(a.answer) > 0 AND abs(a.answer) <= 1)""")
V.register_view_sql("b_latest", """b_latest AS (
  SELECT * FROM b_matched
  QUALIFY row_number() OVER (PARTITION BY chain, cluster, actor, supply_tx ORDER BY r, trigger_us DESC, trigger_block DESC, market DESC) = 1)""")
R3_VIEWS = ["b_orders", "b_labels", "b_tokens", "b_transfers", "b_answers", "b_markets", "b_supplies", "b_same", "b_matched", "b_latest"]


def _r3(spark, folder):
    return B.freshness_candidates(tokens(spark, folder), transfers(spark, folder), answer_logs(spark, folder), labels(spark, folder))


QUERIES["freshness_candidates"] = lambda spark, folder: _r3(spark, folder).select(
    *_COLUMNS, "feed_identity", "feed_identity_source", "actor").withColumn("impact_usd_known", F.round("impact_usd_known", 2))
SQL["freshness_candidates"] = V.with_views(R3_VIEWS, f"""
, feat AS (SELECT *, r = 2 OR (borrow_us - trigger_us) >= 3600000000 OR (abs(answer) > 0 AND abs(answer) <= 1) AS odd FROM b_latest)
SELECT chain, label AS protocol, '{R.FRESHNESS}' AS failure_class, trigger_tx, trigger_block, asset AS affected_asset, odd AS has_oracle_anomaly,
       n AS impact_tx_count, round(usd, 2) AS impact_usd_known, supply_tx || ';' || borrow_tx AS impact_txs, n > 1 AS has_lending_impact, true AS has_actor,
       true AS has_temporal_order, r = 1 AS has_replayable_constraint, (us - trigger_us) // 1000000 AS trigger_to_impact_seconds,
       CASE r WHEN 1 THEN 'impact_led_answerupdated_closure' ELSE 'impact_led_lower_bound_unresolved' END AS source_quality,
       CAST(r AS BIGINT) AS source_quality_rank, CASE r WHEN 1 THEN '{R.TIER_A}' ELSE '{R.TIER_B}' END AS evidence_tier,
       identity AS feed_identity, CASE r WHEN 1 THEN 'label_matched' ELSE 'impact_led_lower_bound_unresolved' END AS feed_identity_source, actor
FROM feat WHERE odd""")

_STAGE = ("SELECT chain, '{f}' AS failure_class, '{s}' AS preflight_stage, '1992-01-01' AS start_date, '2030-01-01' AS end_date, count(*) AS row_count, "
          "{a} AS address_count, {c} AS protocol_cluster_count, {t} AS tx_count FROM {v} GROUP BY 1")


def _stage_sql(failure: str, stages: list[tuple[str, str, str | None, str | None, str | None]]) -> str:
    cell = lambda c: f"count(DISTINCT {c})" if c else "CAST(NULL AS BIGINT)"
    return "\nUNION ALL ".join(_STAGE.format(f=failure, s=s, v=v, a=cell(a), c=cell(c), t=cell(t)) for s, v, a, c, t in stages)


_WINDOW = ("1992-01-01", "2030-01-01")


def _impact_us(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("blockchain", "chain").withColumn("impact_us", T.micros(F.col("impact_time"))).drop("impact_time")


def _r1_txs(spark, folder):
    lines = written_lines(spark, folder)
    return _impact_us(B.binding_impact_txs(labels(spark, folder), tokens(spark, folder), transactions(spark, folder, lines), traces(spark, folder, lines)))


QUERIES["feed_binding_impact_txs"] = _r1_txs
SQL["feed_binding_impact_txs"] = V.with_views(R1_VIEWS[:-2], f"""
SELECT b.chain, b.trigger_tx, t.hash AS impact_tx, min(t.us) AS impact_us FROM b_changes b
JOIN (SELECT DISTINCT chain, cluster, market FROM b_surface) s ON s.chain = b.chain AND s.cluster = b.cluster
JOIN b_tx t ON t.chain = s.chain AND t.target = s.market AND t.us >= b.us AND t.us < b.us + 86400000000
WHERE regexp_matches(lower(t.fn), '{ID.LENDING_FUNCTION}') GROUP BY 1, 2, 3""")


def _r2_txs(spark, folder):
    return _impact_us(B.composition_impact_txs(*_r2_tables(spark, folder))).withColumn("usd", F.round("usd", 2))


QUERIES["price_composition_impact_txs"] = _r2_txs
SQL["price_composition_impact_txs"] = V.with_views(R2_VIEWS[:-1], """
SELECT chain, trigger_tx, tx_hash AS impact_tx, min(us) AS impact_us, round(sum(usd), 2) AS usd FROM (
  SELECT DISTINCT h.chain, h.trigger_tx, t.tx_hash, t.evt_index, t.token, t.sender, t.receiver, t.amount, t.usd, t.us
  FROM (SELECT DISTINCT chain, trigger_tx, us, asset_address FROM b_hints) h
  JOIN b_transfers t ON t.chain = h.chain AND t.us >= h.us AND t.us < h.us + 86400000000
  LEFT JOIN (SELECT DISTINCT chain, address FROM b_inventory WHERE role IN ('market_token', 'lending_label')) s ON s.chain = t.chain AND s.address = t.sender
  LEFT JOIN (SELECT DISTINCT chain, address FROM b_inventory WHERE role IN ('market_token', 'lending_label')) r ON r.chain = t.chain AND r.address = t.receiver
  WHERE t.token = h.asset_address OR s.address IS NOT NULL OR r.address IS NOT NULL) GROUP BY 1, 2, 3""")


def _r3_txs(spark, folder):
    rows = _impact_us(B.same_account_impact_txs(tokens(spark, folder), transfers(spark, folder))).withColumn("usd", F.round("usd", 2))
    return rows.withColumnRenamed("protocol_cluster_id", "cluster")


QUERIES["freshness_impact_txs"] = _r3_txs
SQL["freshness_impact_txs"] = V.with_views(["b_orders", "b_tokens", "b_transfers", "b_markets", "b_supplies"], """
SELECT s.chain, s.cluster, s.market AS collateral_market, s.asset AS collateral_asset, s.token AS collateral_token, s.actor, s.supply_tx, m.asset AS borrowed_asset,
       t.tx_hash AS impact_tx, min(t.us) AS impact_us, round(sum(t.usd), 2) AS usd
FROM b_supplies s JOIN b_markets m ON m.chain = s.chain AND m.cluster = s.cluster AND m.address <> s.market AND m.asset <> s.asset
JOIN b_transfers t ON t.chain = s.chain AND t.sender = m.address AND t.receiver = s.actor AND t.us >= s.us AND t.us < s.us + 21600000000
WHERE t.amount > 0 AND t.usd >= 10000 GROUP BY ALL""")


def _stages_r1(spark, folder):
    lines = written_lines(spark, folder)
    parts = (labels(spark, folder), tokens(spark, folder), transactions(spark, folder, lines), traces(spark, folder, lines))
    return B.stage_counts(B.feed_binding_stages(*parts, *_WINDOW), R.FEED_BINDING, *_WINDOW)


QUERIES["stage_counts_r1"] = _stages_r1
SQL["stage_counts_r1"] = V.with_views(R1_VIEWS[:-1], """
, flags AS (SELECT chain, trigger_tx, cluster, bool_or(asset_identity IS NOT NULL) AS ao, bool_or(feed_identity IS NOT NULL) AS fo,
                   bool_or(coalesce(asset_identity <> feed_identity, false)) AS mm FROM b_named GROUP BY 1, 2, 3)
""" + _stage_sql(R.FEED_BINDING, [
    ("inventory_addresses", "b_inventory", "address", "cluster", None), ("price_source_addresses", "b_feeds", "address", None, None),
    ("lending_surface", "b_surface", "market", "cluster", None),
    ("active_protocol_clusters", "(SELECT DISTINCT chain, cluster FROM b_surface)", None, "cluster", None),
    ("binding_change_candidates", "b_changes", None, "cluster", "trigger_tx"),
    ("asset_identity_observed", "(SELECT * FROM flags WHERE ao)", None, "cluster", "trigger_tx"),
    ("feed_identity_observed", "(SELECT * FROM flags WHERE fo)", None, "cluster", "trigger_tx"),
    ("identity_mismatch_hint", "(SELECT * FROM flags WHERE mm)", None, "cluster", "trigger_tx"),
]))


def _stages_r2(spark, folder):
    return B.stage_counts(B.price_composition_stages(*_r2_tables(spark, folder), *_WINDOW), R.COMPOSITION, *_WINDOW)


QUERIES["stage_counts_r2"] = _stages_r2
SQL["stage_counts_r2"] = V.with_views(R2_VIEWS, _stage_sql(R.COMPOSITION, [
    ("inventory_addresses", "b_inventory", "address", "cluster", None), ("derivative_assets", "b_assets", "address", None, None),
    ("oracle_wrapper_txs", "b_formula", "target", None, "trigger_tx"), ("affected_asset_hint", "b_hints", "asset_address", None, "trigger_tx"),
    ("impact_activity", "b_activity", None, None, "trigger_tx"), ("tiered_candidates", f"({SQL['price_composition_candidates']})", None, None, "trigger_tx"),
]))


def _stages_r3(spark, folder):
    parts = (tokens(spark, folder), transfers(spark, folder), answer_logs(spark, folder), labels(spark, folder))
    return B.stage_counts(B.freshness_stages(*parts, *_WINDOW), R.FRESHNESS, *_WINDOW)


QUERIES["stage_counts_r3"] = _stages_r3
SQL["stage_counts_r3"] = V.with_views(R3_VIEWS, _stage_sql(R.FRESHNESS, [
    ("market_inventory", "b_markets", "address", "cluster", None), ("collateral_supply_events", "b_supplies", "market", "cluster", "supply_tx"),
    ("borrow_outflow_events", """(SELECT s.chain, s.cluster, m.address, t.tx_hash FROM b_supplies s
      JOIN b_markets m ON m.chain = s.chain AND m.cluster = s.cluster AND m.address <> s.market AND m.asset <> s.asset
      JOIN b_transfers t ON t.chain = s.chain AND t.sender = m.address AND t.receiver = s.actor AND t.us >= s.us AND t.us < s.us + 21600000000
      WHERE t.amount > 0 AND t.usd >= 10000)""", "address", "cluster", "tx_hash"),
    ("same_actor_impact", "b_same", "market", "cluster", "borrow_tx"),
    ("label_matched_answer_updated", "(SELECT * FROM b_matched WHERE r = 1)", "feed", "cluster", "trigger_tx"),
    ("lower_bound_unlabeled_answer_updated", "(SELECT * FROM b_matched WHERE r = 2)", "feed", "cluster", "trigger_tx"),
    ("latest_prior_join", "b_latest", "feed", "cluster", "trigger_tx"), ("tiered_candidates", f"({SQL['freshness_candidates']})", None, None, "trigger_tx"),
]))
QUERIES["lending_inventory"] = lambda spark, folder: INV.lending_inventory(labels(spark, folder), tokens(spark, folder)).withColumnRenamed("blockchain", "chain")
SQL["lending_inventory"] = V.with_views(["b_labels", "b_tokens", "b_inventory"], """
SELECT chain, address, label AS protocol_label, cluster AS protocol_cluster_id, role AS inventory_role, source AS inventory_source FROM b_inventory""")
QUERIES["market_inventory"] = lambda spark, folder: INV.market_inventory(tokens(spark, folder)).withColumnRenamed("blockchain", "chain")
SQL["market_inventory"] = V.with_views(["b_tokens", "b_markets"], """
SELECT chain, address AS market_address, symbol AS market_symbol, label AS protocol_label, cluster AS protocol_cluster_id, asset AS market_asset_identity
FROM b_markets""")
QUERIES["wide_market_inventory"] = lambda spark, folder: INV.wide_market_inventory(tokens(spark, folder))
SQL["wide_market_inventory"] = V.with_views(["b_tokens"], """
SELECT DISTINCT chain, address AS market_contract, symbol, name,
       regexp_extract(lower(symbol || ' ' || name), '(^|[^a-z0-9])([abcmv][a-z0-9]{2,})', 2) AS market_token_source,
       regexp_replace(lower(name), '( token| market| lending| pool| collateral| debt| stable| variable)', '', 'g') AS protocol_cluster_id
FROM b_tokens WHERE regexp_matches(lower(symbol || ' ' || name), '(^|[^a-z0-9])([abcmv][a-z0-9]{2,})')
  AND NOT regexp_matches(lower(symbol || ' ' || name), '(debt|variabledebt|stabledebt|reward|staking|farm|lp token)')""")
QUERIES["price_source_inventory"] = lambda spark, folder: INV.price_source_inventory(labels(spark, folder)).withColumnRenamed("blockchain", "chain")
SQL["price_source_inventory"] = V.with_views(["b_labels", "b_feeds"], "SELECT * FROM b_feeds")
