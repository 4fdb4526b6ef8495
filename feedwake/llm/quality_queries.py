"""Query of the repetition rules and its SQL twin."""

from __future__ import annotations

from feedwake.llm import quality as Q
from feedwake.llm.common import read

REPEAT = ", ".join(f"repeat_{n}_chars" for n in Q.REPEATED_SHARE)


def _quality(spark, folder):
    return Q.repetition(read(spark, folder, "documents"))


def _top(n: int) -> str:
    return f"""(SELECT t.doc_id, max(least(times * (e.cum - b.cum + b.chars), word_chars)) AS top_{n}_chars FROM (
  SELECT doc_id, min(pos) AS pos, count(*) AS times FROM h WHERE left_words >= {n} GROUP BY doc_id, grams[{n}] HAVING count(*) > 1) t
  JOIN h b ON b.doc_id = t.doc_id AND b.pos = t.pos JOIN h e ON e.doc_id = t.doc_id AND e.pos = t.pos + {n - 1} JOIN w ON w.doc_id = t.doc_id GROUP BY ALL) t{n}"""


def _repeat(n: int) -> str:
    return f"""(SELECT doc_id, count(*) AS repeat_{n}_words, sum(chars) AS repeat_{n}_chars FROM (
  SELECT DISTINCT doc_id, pos + k AS pos
  FROM (SELECT doc_id, pos FROM h WHERE left_words >= {n} QUALIFY count(*) OVER (PARTITION BY doc_id, grams[{n}]) > 1), (SELECT unnest(range({n})) AS k))
  JOIN p USING (doc_id, pos) GROUP BY ALL) r{n}"""


_LONGEST = max(Q.REPEATED_SHARE)
_JOINS = "\n".join(f"LEFT JOIN {part} USING (doc_id)" for part in [*map(_top, Q.TOP_SHARE), *map(_repeat, Q.REPEATED_SHARE)])
_TOPS = [f"coalesce(top_{n}_chars, 0)" for n in Q.TOP_SHARE]
_REPEATS = [f"coalesce(repeat_{n}_chars, 0)" for n in Q.REPEATED_SHARE]
_FAILS = " OR ".join(
    [f"{v} > {s} * greatest(word_chars, 1)" for v, s in zip(_TOPS + _REPEATS, [*Q.TOP_SHARE.values(), *Q.REPEATED_SHARE.values()], strict=True)]
    + [f"coalesce(n_dup_lines, 0) > {Q.LINE_SHARE} * greatest(coalesce(n_lines, 0), 1)", f"coalesce(dup_line_chars, 0) > {Q.LINE_CHAR_SHARE} * greatest(n_chars, 1)"]
)
_COLUMNS = ", ".join([f"({v})::BIGINT AS top_{n}_chars" for v, n in zip(_TOPS, Q.TOP_SHARE, strict=True)] + [f"({v})::BIGINT AS repeat_{n}_chars" for v, n in zip(_REPEATS, Q.REPEATED_SHARE, strict=True)])

QUERIES = {"op3_repetition": _quality}
SQL = {"op3_repetition": f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, length(coalesce(text, '')) AS n_chars,
         coalesce(length(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), '')), 0) AS word_chars FROM documents),
p AS MATERIALIZED (SELECT doc_id, pos, word, length(word) AS chars FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w)),
g AS (SELECT doc_id, pos, chars, sum(chars) OVER (PARTITION BY doc_id ORDER BY pos) AS cum,
  list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {_LONGEST - 1} FOLLOWING) AS following FROM p),
h AS MATERIALIZED (SELECT doc_id, pos, chars, cum, len(following) AS left_words, [hash(following[1:n]) FOR n IN range(1, {_LONGEST + 1})] AS grams FROM g),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS chars FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
firsts AS (SELECT doc_id, sum(length(line)) AS chars FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
l AS (SELECT doc_id, n_lines, n_dup_lines, lines.chars - firsts.chars AS dup_line_chars FROM lines JOIN firsts USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeat_5_words, 0)::BIGINT AS n_repeat_words,
  (len(words) < {Q.LEAST_WORDS} OR 100 * coalesce(repeat_5_words, 0) > {Q.REPEAT_PERCENT} * len(words)) AS base_failed,
  NOT (len(words) < {Q.LEAST_WORDS} OR 100 * coalesce(repeat_5_words, 0) > {Q.REPEAT_PERCENT} * len(words) OR {_FAILS}) AS kept,
  {_COLUMNS}, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars
FROM w LEFT JOIN l USING (doc_id)
{_JOINS}"""}
