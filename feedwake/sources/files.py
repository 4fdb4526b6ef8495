"""Readers of traces, case configs, receipts, histories and export folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import schemas as S
from feedwake.functions import text as T
from feedwake.functions import words as W
from feedwake.operators.timeline import cut, running, Scan


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line or a missing file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema names its columns in order."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Exported log history (all text) as log rows."""
    rows = read_csv(spark, path, S.HISTORY)
    number = lambda c: T.to_long(F.col(c), 0)
    return rows.select(
        T.parse_time(F.col("block_timestamp")).alias("block_time"), number("block_number").alias("block_number"), F.lower("transaction_hash").alias("tx_hash"),
        number("transaction_index").alias("transaction_index"), number("log_index").alias("log_index"), T.address(F.col("address")).alias("contract_address"),
        F.lower("topic0").alias("topic0"), F.lower("topic1").alias("topic1"), F.lower("topic2").alias("topic2"), F.lower("data").alias("data"))


def _input_order(df: DataFrame) -> DataFrame:
    """Place of each row in its files: file, then byte block, then row within the block."""
    placed = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start"))
    return placed.withColumn("_id", F.monotonically_increasing_id())


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    chunks = cut(df, keys, order)
    return running(chunks, keys, order, [Scan(name, "count", F.lit(1))]).drop("_chunk")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows with ``input_ord`` counting the rows of each file, so that ties keep file order."""
    fields = [c for c in spark.createDataFrame([], S.TRACE).columns if c != "input_ord"]
    schema = ", ".join(part for part in _ddl_parts(S.TRACE) if not part.startswith("input_ord"))
    rows = _input_order(read_jsonl(spark, path, schema))
    return number_rows(rows, ["_file"], ["_block", "_id"], "input_ord").select(*fields, F.col("input_ord").cast("long").alias("input_ord")).select(
        *spark.createDataFrame([], S.TRACE).columns)


def _ddl_parts(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def load_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Case config document as (cases, constraints)."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", f"map<string,{S.CASE_CONFIG_ENTRY}>")).alias("case", "c"))
    cases = entries.select("case", "c.name", "c.chain", "c.known_txs")
    constraints = entries.select("case", F.explode("c.constraints").alias("k")).select("case", "k.*")
    return cases, constraints


def explode_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts (hex text) as one row per log with status and position."""
    number = lambda c: W.uint_decimal(c).try_cast("long")  # noqa: E731 - NULL where a long can't hold it
    rows = receipts.select("*", F.explode("logs").alias("log"))
    return rows.select(
        F.lower("transactionHash").alias("tx_hash"), number(F.col("blockNumber")).alias("block_number"), number(F.col("transactionIndex")).alias("transaction_index"),
        F.when(F.col("status").isNotNull(), number(F.col("status"))).alias("receipt_status"),
        F.when(F.col("blockTimestamp").isNotNull(), F.timestamp_seconds(number(F.col("blockTimestamp")))).alias("block_time"),
        T.address(F.col("log.address")).alias("address"), F.transform(F.coalesce("log.topics", F.array().cast("array<string>")), F.lower).alias("topics"),
        F.coalesce(F.lower(F.try_element_at("log.topics", F.lit(1))), F.lit("")).alias("topic0"), F.lower(F.coalesce("log.data", F.lit("0x"))).alias("data"),
        number(F.col("log.logIndex")).alias("log_index"))


def log_index_of(rows: DataFrame, receipt_logs: DataFrame) -> DataFrame:
    """Log index of each history row: the first log of its transaction with the same address, topic and data, else 0."""
    logs = receipt_logs.select("tx_hash", "address", F.col("topic0").alias("_topic"), F.col("data").alias("_data"), F.col("log_index").alias("_index"))
    joined = rows.withColumn("address", T.address(F.col("contract_address"))).join(logs, ["tx_hash", "address"], "left")
    wanted = F.lower(F.coalesce("topic0", F.lit(""))), F.lower(F.coalesce("data", F.lit("")))
    same = ((wanted[0] == "") | (F.col("_topic") == wanted[0])) & ((wanted[1] == "") | (F.col("_data") == wanted[1]))
    found = joined.groupBy(*rows.columns).agg(F.min(F.when(same, F.col("_index"))).alias("found_log_index"))
    return found.withColumn("found_log_index", F.coalesce("found_log_index", F.lit(0).cast("long")))


EXPORT_SHAPES = ("array<map<string,string>>", "struct<rows:array<map<string,string>>>", "struct<result:array<map<string,string>>>",
                 "struct<result:struct<rows:array<map<string,string>>>>")


def read_exports(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """Rows of all csv, json and jsonl exports below ``root`` as text columns with ``source_file`` and ``source_row``.

    JSON may be a list or hold it under ``rows``, ``result`` or ``result.rows``; other shapes are skipped.
    Hidden files are not read.
    """
    base = spark.read.option("recursiveFileLookup", True)
    origin = F.col("_metadata.file_path").alias("source_file")
    parts = []

    def add(df: DataFrame) -> None:
        have = set(df.columns)
        parts.append(df.select("source_file", "_block", "_id", *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns]))

    def found(pattern: str) -> bool:
        return not base.option("pathGlobFilter", pattern).format("binaryFile").load(root).select("path").isEmpty()

    place = [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    if found("*.csv"):
        table = base.option("pathGlobFilter", "*.csv").option("header", True).option("inferSchema", False).csv(root)
        add(table.select("*", origin, *place))
    if found("*.jsonl"):
        text = base.option("pathGlobFilter", "*.jsonl").text(root).select("value", origin, *place).where(F.trim("value") != "")
        add(_columns(text.withColumn("row", F.from_json("value", "map<string,string>")), columns))
    if found("*.json"):
        text = base.option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", origin)
        shaped = [F.from_json("value", s) for s in EXPORT_SHAPES]
        lists = F.coalesce(F.when(F.trim("value").startswith("["), shaped[0]), shaped[1]["rows"], shaped[2]["result"], shaped[3]["result"]["rows"])
        rows = text.select("source_file", F.posexplode(lists).alias("_id", "row")).withColumn("_block", F.lit(0).cast("long"))
        add(_columns(rows.withColumn("_id", F.col("_id").cast("long")), columns))
    if not parts:
        raise FileNotFoundError(f"no csv, json or jsonl exports below {root}")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return number_rows(table, ["source_file"], ["_block", "_id"], "source_row").drop("_block", "_id")


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("source_file", "_block", "_id", *[F.try_element_at("row", F.lit(c)).alias(c) for c in columns])
