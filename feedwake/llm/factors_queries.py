"""Query of the quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm import factors
from feedwake.llm.common import read

#: The only metadata of a document beside what must not be an input.
METADATA = ("n_chars",)


def fitted(docs: DataFrame, labels: DataFrame) -> factors.Model:
    """The model of the labels that are not held out."""
    return factors.fit(docs, labels.where(~factors.held_out(F.col("doc_id"))), metadata=METADATA)


def _quality(spark, folder):
    docs = read(spark, folder, "documents")
    found = factors.score(docs, fitted(docs, read(spark, folder, "labels")))
    held = F.coalesce(factors.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op13_factorisation": _quality}
SQL: dict[str, str] = {}
