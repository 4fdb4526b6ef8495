"""Query of the fixed-block substring dedup and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwake.llm.common import WORD, read
from feedwake.llm.substring import WINDOW, remove_repeats


def _substrings(spark, folder):
    found = remove_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_fixed_block_anchors": _substrings}
SQL = {"op7_fixed_block_anchors": f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
g AS MATERIALIZED (SELECT doc_id, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM w WHERE len(words) >= {WINDOW})),
again AS (SELECT doc_id, pos FROM g QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, unnest(range({WINDOW})) AS r(k)),
kept AS (SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone.pos IS NULL) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""}
