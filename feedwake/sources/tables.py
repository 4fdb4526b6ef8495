"""Scans of chain tables stored as Parquet partitioned by chain and date, and writers of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwake import schemas as S
from feedwake.operators.closure import in_chains, in_dates
from feedwake.operators.dedupe import keep_first
from feedwake.operators.joins import in_bits

CHAIN_TABLES = {
    "logs": S.LOGS, "transactions": S.TRANSACTIONS, "traces_decoded": S.TRACES_DECODED, "traces": S.TRACES, "transfers": S.TRANSFERS,
}
DIMENSIONS = {"erc20": S.ERC20, "labels": S.LABELS}


def chain_table(spark: SparkSession, root: str, name: str, start: str, end: str, chains: Sequence[str] | None = None) -> DataFrame:
    """Rows of a fact table between two dates; both filters prune partitions."""
    table = spark.read.schema(CHAIN_TABLES[name]).parquet(f"{root}/{name}")
    return in_dates(in_chains(table, chains), start, end)


def dimension(spark: SparkSession, root: str, name: str, chains: Sequence[str] | None = None) -> DataFrame:
    return in_chains(spark.read.schema(DIMENSIONS[name]).parquet(f"{root}/{name}"), chains)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per value; a hot value is written by several tasks."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_case_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Incident tables (attackers, attack_txs, boundary_logs, summary), one folder each, partitioned by case."""
    for name, df in tables.items():
        write_partitioned(df, f"{root}/{name}", ["case"])


def write_ordered(df: DataFrame, path: str, order: Sequence[str] = ("block_number", "transaction_index", "log_index")) -> None:
    """Rows in position order within each case; a large case is spread over several ordered files."""
    columns = [F.col("case"), *[F.col(c) for c in order]]
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").partitionBy("case").parquet(path)


#: Places of a key filter, and places that one row of it holds.
FILTER, ROW = 1 << 30, 1 << 15


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that were written to the end. A commit is a small file, so the list is one line a batch."""
    if not _exists(spark, f"{path}/commits"):
        return []
    return sorted(r["batch"] for r in spark.read.schema("batch string").json(f"{path}/commits/*").collect())


def read_appended(spark: SparkSession, path: str, schema, batches: Sequence[str] | None = None) -> DataFrame:
    """Rows of the committed batches (or of some of them); what a broken run left is not read."""
    names = committed(spark, path) if batches is None else batches
    parts = [f"{path}/data/batch={name}" for name in names]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _place(keys: Sequence[str], places: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(places))


def _filter(rows: DataFrame, keys: Sequence[str], places: int) -> DataFrame:
    """Bitmaps of the places that the keys hash to, one row for each ``ROW`` places that are touched."""
    place = _place(keys, places)
    return rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def _suspects(rows: DataFrame, filters: DataFrame, keys: Sequence[str], places: int) -> DataFrame:
    """Rows whose key a filter may hold, with the filter's other columns."""
    place = _place(keys, places)
    placed = rows.withColumns({"bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    return placed.join(filters, "bucket").where(in_bits(F.col("bits"), F.col("_bit"))).drop("bucket", "_bit", "bits")


def append_new(df: DataFrame, path: str, keys: Sequence[str], batch: str, places: int = FILTER) -> DataFrame:
    """Append rows whose keys the target does not hold yet as one ``batch``; returns the rows that were new.

    Of rows that share a key inside the batch the first by the other columns is kept. The batch is written under its name, then a filter of its
    keys, then its commit; a run that stops in between leaves nothing that readers see, and the same batch run again overwrites it.
    A committed batch is not written twice: it returns what it appended. Earlier batches are read (keys only) just where their filter
    holds a key of the new one, so a batch of new keys reads filters alone. Rows with a null in a key are always new.
    """
    spark, schema = df.sparkSession, df.schema
    names = committed(spark, path)
    if batch in names:
        return read_appended(spark, path, schema, [batch])
    whole = F.array([F.col(k).isNotNull() for k in keys])
    known, open_keys = df.where(F.forall(whole, lambda x: x)), df.where(~F.forall(whole, lambda x: x))
    new = keep_first(known, list(keys), [c for c in df.columns if c not in keys] or list(keys)) if len(df.columns) > len(keys) else known.distinct()
    if names:
        shape = "bucket long, bits binary, batch string"
        filters = spark.read.schema(shape).parquet(*[f"{path}/filters/batch={n}" for n in names])
        # first against all filters at once, so a row meets one bitmap however many batches there are
        every = filters.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        maybe = _suspects(new.select(*keys), every, keys, places)
        touched = sorted(r[0] for r in _suspects(maybe, filters, keys, places).select("batch").distinct().collect())
        if touched:
            new = new.join(read_appended(spark, path, schema, touched).select(*keys), list(keys), "left_anti").select(*df.columns)
    new.unionByName(open_keys).write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
    wrote = read_appended(spark, path, schema, [batch])
    _filter(wrote.dropna(subset=list(keys)), keys, places).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").json(f"{path}/commits/{batch}")
    return wrote


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with columns in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
