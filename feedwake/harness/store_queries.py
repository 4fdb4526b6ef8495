"""What is written and read again: rollups, appended batches, files of every kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake.harness import replay_queries as RQ
from feedwake.harness import views as V
from feedwake.operators import closure as C
from feedwake.operators import decode as DEC
from feedwake.operators import incidents as INC
from feedwake.operators import rollups as RO
from feedwake.sources import files, tables
from feedwake.storage import scratch_root

QUERIES = {}
SQL = {}
LAST_DAYS = "2024-01-25"


def _folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"


def _rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Rollup of the days before a date, the later days added, both merged into years: counts next to exact ones, within five standard errors."""
    logs, rules, path = V.logs(spark, folder), V.boundary_rules(spark), _folder(spark)
    day = F.col("block_date").cast("string")
    for part in (logs.where(F.col("block_date") < LAST_DAYS), logs.where(F.col("block_date") >= LAST_DAYS)):
        sketches = RO.period_sketches(part, rules, day)
        RO.store_periods(sketches, path)
    rows = RO.merged(RO.stored(spark, path, sketches), [["chain", "year", "scope_class"], ["year", "scope_class"]])
    rows = rows.withColumn("chain", F.coalesce("chain", F.lit("all_active_case_chains")))
    exact = C.scope_activity_counts(logs, rules, exact=True)
    near = lambda name, count: F.abs(F.col(f"{name}_estimate") - F.col(count)) <= F.greatest(F.lit(1.0), 5 * RO.standard_error() * F.col(count))
    joined = rows.join(exact, ["chain", "year", "scope_class"])
    return joined.select(
        "chain", "year", "scope_class", "logs", near("txs", "oracle_scope_tx_count").alias("txs_within_bound"), near("contracts", "oracle_scope_contract_count").alias("contracts_within_bound"))


QUERIES["scope_rollup_incremental"] = _rollup
SQL["scope_rollup_incremental"] = V.with_views(["h_logs", "h_boundary"], """
SELECT CASE WHEN grouping(chain) = 1 THEN 'all_active_case_chains' ELSE chain END AS chain, trigger_year AS year, scope_class, count(*) AS logs, true AS txs_within_bound, true AS contracts_within_bound
FROM h_boundary GROUP BY GROUPING SETS ((chain, trigger_year, scope_class), (trigger_year, scope_class))""")


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines by order in three batches, the second with all rows of the first and the third run twice."""
    path = _folder(spark)
    rows = V.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    for batch, part in (("one", "l_returnflag = 'R'"), ("two", "l_returnflag IN ('R', 'A')"), ("three", "true"), ("three", "true")):
        tables.append_new(rows.where(part), path, ["l_orderkey", "l_linenumber"], batch)
    return tables.read_appended(spark, path, rows.schema).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


QUERIES["append_new_batches"] = _appended
SQL["append_new_batches"] = """
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS batch FROM lineitem),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY batch, l_quantity, l_returnflag) = 1)
SELECT l_returnflag, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM k GROUP BY 1"""


def _trace_file(spark: SparkSession, folder: str) -> DataFrame:
    """Traces written as JSON lines and read again, with the place of each row in its file."""
    path = _folder(spark)
    tables.write_jsonl(RQ.trace(spark, folder).drop("input_ord"), path)
    rows = files.read_trace(spark, path)
    return rows.groupBy("case", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("block_number").alias("blocks"), F.count("decoded.asset").alias("assets"), F.min("input_ord").alias("first_place"))


QUERIES["trace_jsonl_roundtrip"] = lambda spark, folder: _trace_file(spark, folder).drop("first_place")
SQL["trace_jsonl_roundtrip"] = V.with_views(["h_logs", "h_trace"], """
SELECT kase AS "case", event_type, count(*) AS rows, CAST(sum(pos) AS BIGINT) AS blocks, count(*) FILTER (event_type NOT IN ('BORROW', 'LIQUIDATE')) AS assets FROM h_trace GROUP BY 1, 2""")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Events exported as a CSV history and read as log rows."""
    path = _folder(spark)
    text = lambda c: F.col(c).cast("string").alias
    rows = V.logs(spark, folder).select(
        F.date_format("block_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("block_timestamp"), text("block_number")("block_number"), F.upper("tx_hash").alias("transaction_hash"),
        F.lit("").alias("transaction_index"), text("log_index")("log_index"), F.lpad(F.hex("block_number"), 40, "0").alias("address"), F.col("topic0"),
        F.lit(None).cast("string").alias("topic1"), F.lit(None).cast("string").alias("topic2"), F.lit("0x01").alias("data"))
    tables.write_csv(rows, path)
    return files.read_history(spark, path).select(F.unix_seconds("block_time").alias("seconds"), "block_number", "tx_hash", "log_index", "contract_address", "topic0")


QUERIES["history_csv_roundtrip"] = _history
SQL["history_csv_roundtrip"] = V.with_views(["h_logs"], """
SELECT us // 1000000 AS seconds, block_number, lower(tx_hash) AS tx_hash, log_index, '0x' || lpad(lower(to_hex(block_number)), 40, '0') AS contract_address, topic0 FROM h_logs""")


def _exports(spark: SparkSession, folder: str) -> DataFrame:
    """Events dealt out to CSV, JSON lines and JSON documents in one folder, gathered by one reader."""
    path = _folder(spark)
    rows = V.logs(spark, folder).select("blockchain", F.col("block_number").cast("string").alias("block_number"), "topic0", "asset")
    kind = F.col("block_number").cast("long") % 3
    rows.where(kind == 0).drop("asset").write.option("header", True).csv(f"{path}/a")
    rows.where(kind == 1).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/b/lines")
    documents = rows.where(kind == 2).groupBy("blockchain").agg(F.collect_list(F.struct("*")).alias("rows")).select(F.to_json(F.struct("rows")).alias("value"))
    documents.repartition(4, "value").write.option("maxRecordsPerFile", 1).text(f"{path}/c")
    for part, ending in (("b/lines", "jsonl"), ("c", "json")):
        _name(spark, f"{path}/{part}", ending)
    found = files.read_exports(spark, path, ["blockchain", "block_number", "topic0", "asset"])
    return found.groupBy("blockchain", "topic0").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("block_number").cast("long")).alias("blocks"), F.count("asset").alias("assets"))


def _name(spark: SparkSession, path: str, ending: str) -> None:
    """Give the text files of a folder their ending, as exports have one."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name[:-4]}.{ending}"))


QUERIES["read_exports_mixed"] = _exports
SQL["read_exports_mixed"] = V.with_views(["h_logs"], """
SELECT chain AS blockchain, topic0, count(*) AS rows, CAST(sum(block_number) AS BIGINT) AS blocks, count(*) FILTER (block_number % 3 > 0) AS assets FROM h_logs GROUP BY 1, 2""")


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    """A receipt for each transaction, with its events as logs in hex, exploded again."""
    number = lambda c: F.concat(F.lit("0x"), F.hex(c))
    logs = V.logs(spark, folder)
    entry = F.struct(F.upper(V.hash_of(F.col("block_number"))).alias("address"), F.array(F.upper("topic0")).alias("topics"), F.lit("0xAB").alias("data"), number(F.col("log_index")).alias("logIndex"))
    receipts = logs.groupBy(F.col("tx_hash").alias("transactionHash"), "blockchain").agg(
        F.lit("0x1").alias("status"), number(F.min("block_number")).alias("blockNumber"), F.lit("0x2").alias("transactionIndex"),
        number(F.min(F.unix_seconds("block_time"))).alias("blockTimestamp"), F.collect_list(entry).alias("logs"))
    found = files.explode_receipts(receipts)
    return found.select("tx_hash", "block_number", "transaction_index", "receipt_status", F.unix_seconds("block_time").alias("seconds"), "topic0", "data", "log_index")


QUERIES["receipt_logs"] = _receipts
SQL["receipt_logs"] = V.with_views(["h_logs"], """
SELECT tx_hash, min(block_number) OVER w AS block_number, CAST(2 AS BIGINT) AS transaction_index, CAST(1 AS BIGINT) AS receipt_status, min(us // 1000000) OVER w AS seconds, topic0,
       '0xab' AS data, log_index FROM h_logs WINDOW w AS (PARTITION BY tx_hash, chain)""")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    names = {"signup": "FeedSet", "view": "AnswerUpdated"}
    rows = V.logs(spark, folder).withColumn("event", DEC.event_name(F.upper("topic0"), names))
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


QUERIES["event_names"] = _named
SQL["event_names"] = V.with_views(["h_logs"], """
SELECT CASE topic0 WHEN 'signup' THEN 'FeedSet' WHEN 'view' THEN 'AnswerUpdated' ELSE '' END AS event, count(*) AS rows FROM h_logs GROUP BY 1""")


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes that traces name, valid ones once per case; a sixth are cut short."""
    rows = RQ.trace(spark, folder).select("case", F.when(F.col("block_number") % 6 == 0, F.substring("tx_hash", 1, 40)).otherwise(F.upper("tx_hash")).alias("tx"), F.lit(None).cast("string").alias("other"))
    return INC.known_values([(rows, ["tx", "other"]), (rows.where("false"), ["tx"])], "tx_hash")


QUERIES["known_values"] = _known
SQL["known_values"] = V.with_views(["h_logs", "h_trace"], 'SELECT DISTINCT kase AS "case", lower(tx_hash) AS tx_hash FROM h_trace WHERE pos % 6 <> 0')
