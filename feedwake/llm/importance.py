"""Importance resampling towards a target distribution: hashed n-gram features, log-ratio gains, and a Gumbel top-k draw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake.llm.common import encoded, slices
from feedwake.llm.crc import crc32_spans
from feedwake.operators.timeline import Scan, cut, running
from feedwake.storage import write_table

#: Words of a feature at most, buckets, words of a document that may be drawn, drawn share as a fraction, seed of the draws.
MOST_WORDS, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, (10, 100), 2024
#: Bytes whose words are looked at together.
CHUNK_BYTES = 1 << 20
#: Gains and draws count thousandths of a nat.
SCALE = 1000
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


def _words(joined: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the words, in chunks that end between words."""
    data, at = np.frombuffer(joined, np.uint8), 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and _IN_WORD[data[end]]:
            gaps = np.flatnonzero(~_IN_WORD[data[end : end + CHUNK_BYTES]])
            end = end + int(gaps[0]) if len(gaps) else min(len(data), end + CHUNK_BYTES)
        edge = np.diff(_IN_WORD[data[at:end]].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        yield np.flatnonzero(edge == 1) + at, np.flatnonzero(edge == -1) + at
        at = end


def features(texts, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Text index and bucket of each feature of the texts, chunk by chunk, and how many of a chunk's features are single words.

    Words are runs of letters, digits and characters beyond ASCII after A-Z are lower-cased; a feature is a run of 1 to
    ``most_words`` words of one text, joined by a blank. Its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.
    """
    raw = [t.lower() for t in encoded(texts)]
    sizes = np.array([len(t) + 1 for t in raw], np.int64)
    begins = np.cumsum(sizes) - sizes
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, np.uint8)
    kept_start = kept_end = np.empty(0, np.int64)
    for starts, ends in _words(joined):
        old = len(kept_start)
        starts, ends = np.r_[kept_start, starts], np.r_[kept_end, ends]
        owner = np.searchsorted(begins, starts, side="right") - 1
        if most_words == 1:
            yield owner, (crc32_spans(data, starts, ends) % np.uint32(buckets)).astype(np.int64), len(owner)
            continue
        # the words of the chunk, each with one blank behind it
        length = ends - starts
        off = np.cumsum(length + 1) - (length + 1)
        plain = np.full(int((length + 1).sum()), 32, np.uint8)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        plain[np.repeat(off, length) + inside] = data[np.repeat(starts, length) + inside]
        for n in range(1, most_words + 1):
            last = np.arange(max(old, n - 1), len(starts))
            first = last - (n - 1)
            whole = owner[first] == owner[last]
            first, last = first[whole], last[whole]
            hashed = crc32_spans(plain, off[first], off[last] + length[last])
            yield owner[first], (hashed % np.uint32(buckets)).astype(np.int64), len(first) if n == 1 else 0
        kept_start, kept_end = starts[len(starts) - most_words + 1 :], ends[len(ends) - most_words + 1 :]


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row for each bucket; the driver gets as many rows as buckets."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, most=CHUNK_BYTES):
                for _, bucket, _ in features(part.column("text").to_pylist(), buckets, most_words):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log-ratio of smoothed shares (target over source) of each bucket."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel draw that depends on doc_id and seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log((drawn + 0.5) / float(1 << 32)))).cast("long")


def weights(docs: DataFrame, table: np.ndarray, most_words: int = MOST_WORDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (floored mean gain; 0 without features) of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=CHUNK_BYTES):
                n = part.num_rows
                words, held, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for owner, bucket, single in features(part.column("text").to_pylist(), len(table), most_words):
                    times = np.bincount(owner, minlength=n)
                    held += times
                    words += times if single else 0
                    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
                    if len(edge):
                        np.add.at(total, owner[edge], np.add.reduceat(table[bucket], edge))
                weight = np.where(held > 0, total // np.maximum(held, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, held, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, taken: int) -> DataFrame:
    """Adds ``rank`` to a written table: 1, 2, 3 ... for the ``taken`` rows (``open``) of the highest ``score``, ties to the smaller doc_id, else null.

    Scores are whole numbers from a small range, whatever the rows: rows are counted by score first, so none below the last
    drawn score is sorted. Rows of one score are numbered by doc_id in a timeline cut by range, so equal rows split as well.
    """
    higher = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = scored.where("open").groupBy(F.col("score").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    steps = write_table(steps.select("step", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before")).where(F.col("before") < taken))
    lowest = steps.agg(F.min("step")).first()[0]
    nothing = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", nothing)
    high = F.col("open") & (F.col("score") >= lowest)
    top = scored.where(high).join(steps, F.col("score") == F.col("step")).withColumns(
        {"id_key": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "salt": F.monotonically_increasing_id()}
    )
    placed = running(cut(top, ["score"], ["id_key", "salt"]), ["score"], ["id_key", "salt"], [Scan("place", "count", F.lit(1))])
    rank = (F.col("before") + F.col("place")).cast("long")
    placed = placed.withColumn("rank", F.when(rank <= taken, rank))
    return placed.select(*scored.columns, "rank").unionByName(scored.where(~high).withColumn("rank", nothing))


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of each row of ``docs`` (``doc_id``, ``text``).

    Bucket shares of all texts of ``docs`` and of ``target`` (``text``) give each bucket a gain; a row's weight is the mean gain of
    its features, its score the weight plus Gumbel noise from its doc_id, so the highest scores are a draw without replacement
    in proportion to exp(weight / 1000). Of the N rows with ``least_words`` words, floor(N * share) are ranked, the others have a null rank.

    A null or empty text has no features and weight 0. Repeated rows are rows of their own with equal scores; a null doc_id draws
    as an empty one and comes last in ties. Other columns are not read. An empty target or an empty table of documents is smoothed
    like any other; without documents the result is empty.
    """
    table = gains(bucket_counts(docs, buckets, most_words), bucket_counts(target, buckets, most_words))
    scored = weights(docs, table, most_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = write_table(scored.withColumn("open", F.col("n_words") >= least_words).drop("n_words"))
    n = scored.where("open").count()
    return drawn(scored, n * share[0] // share[1]).select("doc_id", "n_features", "weight", "score", "rank")
