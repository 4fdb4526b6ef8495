"""Query of the importance resampling and its SQL twin."""

from __future__ import annotations

from feedwake.llm import importance as I
from feedwake.llm.common import read
from feedwake.llm.crc import POLYNOMIAL


def _resample(spark, folder):
    return I.resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BYTES = "[('0x' || hex(encode(word))[2 * k - 1:2 * k])::BIGINT FOR k IN range(1, octet_length(encode(word)) + 1)]"

QUERIES = {"op12_importance": _resample}
SQL = {"op12_importance": f"""
WITH steps AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) FOR n IN range(256)] AS t),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS MATERIALIZED (SELECT {_WORDS} AS words FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
v AS (SELECT unnest(words) AS word FROM b),
hashed AS MATERIALIZED (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % {I.BUCKETS} AS bucket
  FROM (SELECT word FROM w UNION SELECT word FROM v), steps),
s AS (SELECT bucket, count(*) AS s FROM w JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM v JOIN hashed USING (word) GROUP BY bucket),
c AS (SELECT bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM (SELECT unnest(range({I.BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
g AS MATERIALIZED (SELECT bucket, floor({I.SCALE} * ln((t + 1) * (sum(s) OVER () + {I.BUCKETS}) / ((s + 1) * (sum(t) OVER () + {I.BUCKETS}))))::BIGINT AS gain FROM c),
f AS (SELECT doc_id, sum(gain) AS gains FROM w JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(words) AS n, coalesce((gains - ((gains % len(words)) + len(words)) % len(words)) // len(words), 0)::BIGINT AS weight,
  ('0x' || sha256('{I.SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
y AS (SELECT *, weight + floor(-{I.SCALE} * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n >= {I.LEAST_WORDS})
SELECT y.doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT {I.SHARE[0]} * count(*) // {I.SHARE[1]} FROM z) THEN rank END::BIGINT AS rank
FROM y LEFT JOIN z USING (doc_id)"""}
