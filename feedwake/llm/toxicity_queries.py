"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm import toxicity
from feedwake.llm.common import read


def fitted(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The model of the labels that are not held out."""
    return toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def _toxicity(spark, folder):
    docs = read(spark, folder, "documents")
    found = toxicity.score(docs, fitted(docs, read(spark, folder, "labels")))
    held = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_zstd_toxicity": _toxicity}
SQL: dict[str, str] = {}
