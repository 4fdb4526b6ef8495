"""Query of the cross-tokenizer alignment."""

from __future__ import annotations

import public_tokenizers

from feedwake.llm import alignment
from feedwake.llm.common import read

FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _align(spark, folder):
    return alignment.align(read(spark, folder, "documents"), *map(public_tokenizers.path, FILES))


QUERIES = {"op11_alignment": _align}
SQL: dict[str, str] = {}
