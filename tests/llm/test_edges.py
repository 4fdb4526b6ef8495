"""Odd tables through the whole pipeline, and odd texts through the toxicity scores."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedwake.llm import toxicity, toxicity_queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, name, docs, labels):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/{name}"
    spark.createDataFrame(docs, SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_of_nothing(spark):
    found = corpus_pipeline.run(spark, stored(spark, "none", [], []))
    assert found.collect() == [] and {"doc_id", "n_tokens", "ids", "round_trip"} <= set(found.columns)


def test_pipeline_of_odd_rows(spark):
    body = " ".join(f"word{k}" for k in range(60))
    docs = [(1, body, "en", "a", 1), (1, body, "en", "a", 1), (None, None, None, None, None), (None, "loose text", "en", None, 3), (2, "", "en", "b", 0), (3, "x " * 50_000, "en", "b", 9), (4, body + " more", "en", "a", 2)]
    found = corpus_pipeline.run(spark, stored(spark, "odd", docs, [(1, 1, 0), (None, 0, 1), (3, None, None)])).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    assert {r.doc_id for r in found} <= {1, 3, None} and 1 in {r.doc_id for r in found}


@pytest.mark.parametrize("clash", ["score", "toxic"])
def test_toxicity_of_odd_texts(spark, clash):
    texts = {1: "ordinary words " * 80, 2: None, 3: "", 4: "long " * 400_000, 5: "vile " * 30}
    docs = spark.createDataFrame([(k, t, "x") for k, t in [*texts.items(), *texts.items()]], f"doc_id long, text string, {clash} string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(100, 140)], "doc_id long, toxic int")
    taught = docs.select("doc_id", "text").union(spark.createDataFrame([(k, ("vile bad " if k % 2 else "fine good ") * 40 + str(k)) for k in range(100, 140)], "doc_id long, text string"))
    model = toxicity_queries.fitted(taught, labels)
    found = toxicity.score(docs, model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("score").alias("scores"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    assert {r.doc_id: (r.rows, r.scores) for r in found} == {k: (2, 1) for k in texts}
    assert all(0 <= r.low <= r.high <= 1 for r in found)
