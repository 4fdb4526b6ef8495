"""Query of the suffix dedup and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwake.llm.common import read
from feedwake.llm.suffixes import LENGTH, remove_repeats


def _suffixes(spark, folder):
    found = remove_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_ranges": _suffixes}
SQL = {"op8_suffix_ranges": f"""
WITH d AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
g AS MATERIALIZED (SELECT doc_id, pos, hash(h[2 * pos + 1:2 * pos + {2 * LENGTH}]) AS gram FROM (
  SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS pos FROM d WHERE length(h) >= {2 * LENGTH})),
again AS (SELECT doc_id, pos FROM g QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) > 1),
runs AS (SELECT doc_id, min(pos) AS low, max(pos) + {LENGTH} AS high FROM (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
    SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, list(high ORDER BY low) AS highs, list(low ORDER BY low) AS lows FROM runs GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN lows IS NULL THEN h ELSE array_to_string(
    [h[2 * (CASE WHEN i = 1 THEN 0 ELSE highs[i - 1] END) + 1:2 * (CASE WHEN i > len(lows) THEN length(h) // 2 ELSE lows[i] END)] FOR i IN range(1, len(lows) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""}
