"""Durable intermediate tables.

Some operators need one fixed physical layout that several later stages agree on.
They write it as Parquet below the shared folder named by ``spark.checkpoint.dir``,
so a lost executor re-reads files instead of recomputing (and re-sampling) the cut.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, else a test folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # a local cluster is a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
    folder = tempfile.mkdtemp(prefix="feedwake-")
    spark.sparkContext.setCheckpointDir(folder)
    return (spark.sparkContext.getCheckpointDir() or folder).rstrip("/")


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; call it when results are saved."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
