"""Query of the byte-level BPE operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm import bpe
from feedwake.llm.common import read

RANKS = "byte_bpe_50k.tiktoken"


def digests(docs: DataFrame) -> DataFrame:
    """Length and digest of the ids, digest of the decoded bytes."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def _bpe(spark, folder):
    return digests(read(spark, folder, "documents"))


QUERIES = {"op2_byte_bpe": _bpe}
SQL: dict[str, str] = {}
