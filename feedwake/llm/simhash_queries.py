"""Query of the SimHash near-dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwake.llm import simhash
from feedwake.llm.common import read


def _near(spark, folder):
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_gray_simhash": _near}
SQL: dict[str, str] = {}
