"""The labelled sample that comes to the driver."""

from feedwake.llm import toxicity


def test_a_repeated_doc_id_brings_one_text(spark):
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in toxicity.sampled(docs, known, 10).collect())
    assert got == [(1, 1), (2, 0)]
