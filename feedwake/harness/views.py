"""Chain-shaped tables derived from the generic test tables, in Spark and in SQL.

Every view covers its whole source table. The SQL text and the DataFrame code state the same mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import rules as R

CHAINS = ("ethereum", "bnb", "base", "avalanche_c")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wall_micros(column: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def wall_time(column: str) -> Column:
    return F.timestamp_micros(wall_micros(column))


def hash_of(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 64, "0"))


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def logs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        _pick(CHAINS, F.col("user_id") % 4).alias("blockchain"),
        F.col("ts").cast("date").alias("block_date"),
        wall_time("ts").alias("block_time"),
        F.col("event_id").alias("block_number"),
        hash_of(F.floor(F.col("event_id") / 3).cast("long")).alias("tx_hash"),
        (F.col("event_id") % 3).cast("int").alias("log_index"),
        F.concat(F.lit("C"), (k % 20).cast("string")).alias("contract_address"),
        F.col("event_type").alias("topic0"),
        F.col("user_id").cast("string").alias("actor"),
        F.concat(F.lit("A"), (k % 5).cast("string")).alias("asset"),
        F.col("value"),
        k.alias("k"),
        F.floor(F.col("event_id") / 3).cast("long").alias("tx_id"),
    )


LOGS_SQL = """h_logs AS (
  SELECT ['ethereum','bnb','base','avalanche_c'][(user_id % 4) + 1] AS chain, CAST(ts AS DATE) AS block_date, epoch_us(ts) AS us,
         event_id AS block_number, '0x' || lpad(lower(to_hex(event_id // 3)), 64, '0') AS tx_hash,
         CAST(event_id % 3 AS BIGINT) AS log_index,
         'C' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS VARCHAR) AS contract,
         event_type AS topic0, CAST(user_id AS VARCHAR) AS actor,
         'A' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS asset, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 3 AS tx_id
  FROM events)"""

# Event kinds of the test table and the role each one plays.
BOUNDARY_RULES = [
    ("signup", R.S2, "R_SIGNUP", "signup", False),
    ("view", R.S1, "R_VIEW", "view", False),
]
CONTEXTUAL_RULES = [*BOUNDARY_RULES, ("error", R.S5, "R_ERROR", "error", True)]
IMPACT_RULES = [("click", R.SUPPLY_RULE, "click"), ("purchase", R.BORROW_RULE, "purchase"), ("error", R.LIQUIDATION_RULE, "error")]


def boundary_rules(spark: SparkSession, contextual: bool = False) -> DataFrame:
    return R.inline(spark, CONTEXTUAL_RULES if contextual else BOUNDARY_RULES, R.BOUNDARY_SCHEMA)


def impact_rules(spark: SparkSession) -> DataFrame:
    return R.inline(spark, IMPACT_RULES, R.IMPACT_SCHEMA)


def _chains(spark: SparkSession) -> DataFrame:
    return R.inline(spark, [(c,) for c in CHAINS], "blockchain string")


def on_all_chains(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(*[F.lit(c) for c in CHAINS])).alias("blockchain"), "*")


def markets(spark: SparkSession, folder: str) -> DataFrame:
    """One market per contract and chain; its cluster is the first brand of its parts."""
    part = table(spark, folder, "part")
    named = part.groupBy(F.concat(F.lit("C"), (F.col("p_partkey") % 20).cast("string")).alias("market_contract")).agg(
        F.min("p_brand").alias("protocol_cluster_id")
    )
    return on_all_chains(named).withColumnRenamed("blockchain", "chain")


MARKETS_SQL = """h_markets AS (
  SELECT c.chain, 'C' || CAST(p_partkey % 20 AS VARCHAR) AS market_contract, min(p_brand) AS protocol_cluster_id
  FROM part, (VALUES ('ethereum'), ('bnb'), ('base'), ('avalanche_c')) c(chain) GROUP BY 1, 2)"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the contracts, one per part; widgets stand for price-path contracts."""
    part = table(spark, folder, "part")
    named = part.select(
        F.concat(F.lit("C"), (F.col("p_partkey") % 20).cast("string")).alias("address"),
        F.concat_ws(" ", F.when(F.col("p_size") >= 48, F.lit("oracle")), F.col("p_name")).alias("name"),
        F.col("p_type").alias("category"),
    )
    return on_all_chains(named)


LABELS_SQL = """h_labels AS (
  SELECT c.chain, 'C' || CAST(p_partkey % 20 AS VARCHAR) AS address,
         CASE WHEN p_size >= 48 THEN 'oracle ' || p_name ELSE p_name END AS name, p_type AS category
  FROM part, (VALUES ('ethereum'), ('bnb'), ('base'), ('avalanche_c')) c(chain))"""


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per chain and hash; its sender is the account of its first event."""
    return logs(spark, folder).groupBy("blockchain", F.col("tx_hash").alias("hash")).agg(
        F.min("block_date").alias("block_date"),
        F.min("block_time").alias("block_time"),
        F.min("block_number").alias("block_number"),
        F.min_by(F.col("actor").cast("long"), "block_number").cast("string").alias("from"),  # numbers aggregate without a sort
        F.min_by("contract_address", "block_number").alias("to"),
        F.min_by("topic0", "block_number").alias("first_topic"),
        F.min_by("k", "block_number").alias("k"),
        F.min_by("value", "block_number").alias("value"),
    )


TRANSACTIONS_SQL = """h_tx AS (
  SELECT chain, tx_hash, min(block_date) AS block_date, min(us) AS us, min(block_number) AS block_number,
         arg_min(actor, block_number) AS sender, arg_min(contract, block_number) AS target,
         arg_min(topic0, block_number) AS first_topic, arg_min(k, block_number) AS k, arg_min(value, block_number) AS value
  FROM h_logs GROUP BY 1, 2)"""

IMPACT_SQL = f"""h_impact AS (
  SELECT l.chain, l.us, l.block_number, l.tx_hash, l.log_index, t.sender AS actor, l.contract, m.protocol_cluster_id AS cluster,
         CASE l.topic0 WHEN 'click' THEN '{R.SUPPLY_RULE}' WHEN 'purchase' THEN '{R.BORROW_RULE}' ELSE '{R.LIQUIDATION_RULE}' END AS rule
  FROM h_logs l JOIN h_markets m ON m.chain = l.chain AND m.market_contract = l.contract
  JOIN h_tx t ON t.chain = l.chain AND t.tx_hash = l.tx_hash
  WHERE l.topic0 IN ('click', 'purchase', 'error'))"""

BOUNDARY_SQL = f"""h_boundary AS (
  SELECT chain, year(block_date) AS trigger_year, us, block_number, tx_hash, contract, topic0,
         CASE topic0 WHEN 'signup' THEN '{R.S2}' ELSE '{R.S1}' END AS scope_class,
         CASE topic0 WHEN 'signup' THEN 'R_SIGNUP' ELSE 'R_VIEW' END AS rule_id,
         CASE WHEN topic0 = 'view' THEN abs(value) END AS answer
  FROM h_logs WHERE topic0 IN ('signup', 'view'))"""

_TEXT = {
    "h_logs": LOGS_SQL, "h_markets": MARKETS_SQL, "h_labels": LABELS_SQL, "h_tx": TRANSACTIONS_SQL,
    "h_impact": IMPACT_SQL, "h_boundary": BOUNDARY_SQL,
}


def register_view_sql(name: str, text: str) -> None:
    _TEXT[name] = text


def with_views(names: list[str], body: str) -> str:
    """SQL statement ``body`` with the named views in front; ``body`` may open with more CTEs (``, x AS ...``)."""
    return "WITH " + ",\n".join(_TEXT[n] for n in names) + "\n" + body


CLOSURE_VIEWS = ["h_logs", "h_markets", "h_tx", "h_impact", "h_boundary"]
