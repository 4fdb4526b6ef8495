"""What the operators of this subpackage share: reading, batches of texts, word and n-gram hashes, shelves and packed rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP_BYTES = (9, 10, 11, 12, 13, 32)

#: Bytes handled at once when words are hashed.
CHUNK = 1 << 20
#: Text bytes of a shelf (the documents that one task holds together).
SHELF_BYTES = 4 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[list(GAP_BYTES)] = True


#: Bytes of an Arrow batch between Spark and a Python worker: texts are long, and both sides hold a batch several times.
BATCH_BYTES = "8m"


def narrow_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless it has its own setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):  # the default
        spark.conf.set(key, BATCH_BYTES)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def release() -> None:
    """Give memory that this worker no longer needs back to the system; workers are used again, and pools keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(texts) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SHELF_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text (or entries of a list), one row at least."""
    kind = batch.column(column).type
    measure = pc.list_value_length if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pc.binary_length
    sizes = pc.fill_null(measure(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for row, size in enumerate(sizes):
        if row > begin and held + size > most:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _chunk_words(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_IS_GAP[data]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    at = np.flatnonzero(solid)
    lengths = ends - starts
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    offset = (np.arange(len(at)) - first).astype(np.uint64)
    value = mix(data[at].astype(np.uint64) + (offset << np.uint64(8)) + ODD)
    hashes = mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * ODD)
    return hashes, starts + base, ends + base


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in order: hash, index of the text, start and end in the joined bytes; and where each text starts there.

    The hash of a word is a sum of one pseudo-random number for each (offset, byte), so unequal words differ but for 2**-64.
    Bytes are handled in chunks that end between words, so that memory does not follow the longest text.
    """
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text_start = np.cumsum(sizes + 1) - (sizes + 1)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            gaps = np.flatnonzero(_IS_GAP[data[end : end + CHUNK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + CHUNK)
        parts.append(_chunk_words(data[at:end], at))
        at = end
    empty = np.empty(0, np.int64)
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    starts = np.concatenate([p[1] for p in parts]) if parts else empty
    ends = np.concatenate([p[2] for p in parts]) if parts else empty
    owner = np.searchsorted(text_start, starts, side="right") - 1
    return hashes, owner, starts, ends, text_start


def windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words and whether it lies in one text; both of length len(hashes) - n + 1, or empty."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    rolled = np.zeros(m, np.uint64)
    for k in range(n):
        rolled = rolled * ODD + hashes[k : k + m]
    return mix(rolled + np.uint64(n)), owner[:m] == owner[n - 1 :]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a run of ``n`` that begins at one of ``starts``."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, total), -1)
    return np.cumsum(steps[:-1]) > 0


# --- shelves: documents that one task holds together, and packed rows between them -------------------------------------


def pack(hashes: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").reshape(-1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of sorted distinct hashes, one for each bucket that has any; sorting by hash also sorts by bucket."""
    if not len(hashes):
        return
    places = bucket_of(hashes, buckets)
    cuts = np.flatnonzero(np.diff(places)) + 1
    for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(hashes)], strict=True):
        yield int(places[begin]), hashes[begin:end]


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


class Shelves:
    """Documents in ranges of doc_id, about ``SHELF_BYTES`` of text each.

    Order of shelves is order of doc_id, so "in an earlier document" needs no identifiers between shelves. Rows of equal
    doc_id share a shelf, and rows without one form the last: these two are as large as the input makes them. The splitters (one
    number for each shelf) come from a sketch of the doc_ids, in which a row counts once and once more for each mean length of
    its text: rows of a weight hold less bytes than as many of mean length, and all weights are twice the rows at most, so a shelf
    of several doc_ids holds about twice ``SHELF_BYTES`` and a text at most, wherever the long texts are.
    """

    def __init__(self, docs: DataFrame, shelf_bytes: int | None = None, keep: Sequence[str] = ()):
        shelf_bytes = shelf_bytes or SHELF_BYTES
        self.columns = list(dict.fromkeys(["doc_id", "text", *keep]))
        total = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.count(F.lit(1))).first()
        self.rows = total[2]
        self.count = max(1, -(-(total[0] or 0) // shelf_bytes))
        self.splits = np.empty(0, np.int64)
        if self.count > 1 and total[1]:
            parts = [i / self.count for i in range(1, self.count)]
            mean = max(1, -(-total[0] // total[2]))
            weight = (F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / mean) + 1).cast("int")
            ids = docs.where(F.col("doc_id").isNotNull()).select(F.explode(F.array_repeat("doc_id", weight)).alias("doc_id"))
            found = ids.agg(F.percentile_approx("doc_id", parts, 20 * self.count)).first()[0]
            self.splits = np.unique(np.array(found, np.int64))
        self.buckets = self.count
        self.docs = self._assign(docs)

    def _assign(self, docs: DataFrame) -> DataFrame:
        splits = self.splits

        @F.pandas_udf("int")
        def shelf_of(ids: pd.Series) -> pd.Series:
            known = ids.notna()
            out = np.full(len(ids), len(splits) + 1, np.int32)
            out[known.to_numpy()] = np.searchsorted(splits, ids[known].astype("int64").to_numpy(), side="left")
            return pd.Series(out)

        return docs.select(*self.columns).withColumn("shelf", shelf_of("doc_id"))


def ordered_ids(ids) -> np.ndarray:
    """doc_id as numbers; a row without one is after all others and equal to none of them."""
    return pd.Series(ids).astype("Int64").fillna(np.iinfo(np.int64).max).astype("int64").to_numpy()
