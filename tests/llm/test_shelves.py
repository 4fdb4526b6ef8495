"""Sizes of shelves."""

from pyspark.sql import functions as F

from feedwake.llm.common import Shelves


def test_long_neighbours_are_cut_by_bytes(spark):
    """One row in a hundred, all neighbours, holds half of the bytes."""
    rows = [(k, "x" * (9900 if 2000 <= k < 2040 else 100)) for k in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shelves = Shelves(table, shelf_bytes=20000).docs
    sizes = [r[1] for r in shelves.groupBy("shelf").agg(F.sum(F.octet_length("text"))).collect()]
    assert sum(sizes) == sum(len(t) for _, t in rows) and max(sizes) <= 2 * 20000 + 9900
    ends = sorted(tuple(r) for r in shelves.groupBy("shelf").agg(F.min("doc_id"), F.max("doc_id")).collect())
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False))
