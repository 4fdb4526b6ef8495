"""Context-triggered piecewise hashing: chunks end where a rolling hash says so, and each chunk gives one sign."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm.common import CHUNK, mix

#: Bytes of the rolling window, signs that a text's length lets expect and most signs of a signature, signatures of a
#: fingerprint, characters of a sign.
REACH, EXPECTED, SIGNS, SIGNATURES, WIDTH = 8, 45, 64, 3, 2
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ZERO = np.zeros(1, np.int64)
_LETTER = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Block sizes after which a chunk ends without a cut.
LONGEST = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _floor(n: int) -> int:
    """Level of a text of ``n`` bytes."""
    return max(0, -(-n // EXPECTED) - 1).bit_length()


def _cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks at every level: places (one past the byte) and levels.

    The rolling hash is the product of the last eight bytes, as one number, with an odd constant (before the start: zeros). It
    ends a chunk of level k if its k high bits are zero; eight zero bytes end none, at any level. Only levels from that of the length are kept.
    """
    low = _floor(len(data))
    most = np.uint64((1 << (64 - low)) - 1)
    padded = np.concatenate([np.zeros(REACH - 1, np.uint8), data])
    places, levels = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin in range(0, len(data), CHUNK):
        count = min(CHUNK, len(data) - begin)
        last = np.ndarray((count,), "<u8", padded, begin, (1,))
        rolled = last * _STEP
        at = np.flatnonzero((rolled <= most) & (rolled != 0))
        places.append(at + begin + 1)
        levels.append(64 - np.ceil(np.log2(rolled[at].astype(np.float64) + 1)).astype(np.int64))
    return np.concatenate(places), np.concatenate(levels)


def _ends(places: np.ndarray, levels: np.ndarray, level: int, size: int) -> np.ndarray:
    """Ends of the chunks of a level; a stretch without a cut (one period again and again) ends after ``LONGEST`` block sizes."""
    ends = np.append(places[(levels >= level) & (places < size)], size)
    starts, most = np.concatenate((_ZERO, ends[:-1])), LONGEST << level
    more = (ends - starts - 1) // most
    if not more.any():
        return ends
    forced = np.repeat(starts, more) + most * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.sort(np.concatenate((ends, forced)))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, _STEP, np.uint64)])


def _sums(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of byte times power of its place, up to each of the places (ascending)."""
    out = np.zeros(len(places), np.uint64)
    total, power = np.uint64(0), np.uint64(1)
    for begin in range(0, len(data), CHUNK):
        part = data[begin : begin + CHUNK].astype(np.uint64) + np.uint64(1)
        prefix = np.cumsum(part * _powers()[: len(part)], dtype=np.uint64)
        own = (places > begin) & (places <= begin + len(part))
        out[own] = prefix[places[own] - begin - 1] * power + total
        total = np.uint64((int(total) + int(prefix[-1]) * int(power)) % (1 << 64))
        power = np.uint64(int(power) * pow(int(_STEP), len(part), 1 << 64) % (1 << 64))
    return out


@lru_cache(maxsize=1)
def _inverses() -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(CHUNK - 1, _BACK, np.uint64)])


def _back(places: np.ndarray) -> np.ndarray:
    """The inverse step to the power of each place."""
    if places[-1] < CHUNK:
        return _inverses()[places]
    blocks = np.array([pow(int(_BACK), CHUNK * k, 1 << 64) for k in range(int(places[-1]) // CHUNK + 1)], np.uint64)
    return _inverses()[places % CHUNK] * blocks[places // CHUNK]


def _signature(ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A 12-bit sign for each chunk, from its bytes wherever it stands."""
    starts = np.concatenate((_ZERO, ends[:-1]))
    held = (sums - np.concatenate((_ZERO.view(np.uint64), sums[:-1]))) * _back(starts)
    return (mix(held + (ends - starts).astype(np.uint64)) >> np.uint64(52)).astype(np.int64)


def fingerprint(text: str | None) -> str:
    """``level:signs:signs:signs``: signatures at a level of block size and the next two.

    The level follows the length; where a text would make more than ``SIGNS`` chunks it is raised, so nothing is left out. An
    empty text gives ``0:::``.
    """
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return "0" + ":" * SIGNATURES
    places, levels = _cuts(data)
    level = _floor(len(data))
    while len(_ends(places, levels, level, len(data))) > SIGNS:
        level += 1
    ends = [_ends(places, levels, k, len(data)) for k in range(level, level + SIGNATURES)]
    every = np.unique(np.concatenate(ends))
    sums = _sums(data, every)
    parts = [_signature(e, sums[np.searchsorted(every, e)]) for e in ends]
    return f"{level}:" + ":".join(_LETTER[np.stack([part >> 6, part & 63], axis=1)].tobytes().decode() for part in parts)


_VALUE = np.full(256, -1, np.int64)
_VALUE[[ord(c) for c in ALPHABET]] = np.arange(64)


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signs of signatures as rows, filled up with -1, and their lengths."""
    size = np.array([len(t) // WIDTH for t in texts], np.int64)
    out = np.full((len(texts), max(1, int(size.max(initial=0)))), -1, np.int64)
    flat = _VALUE[np.frombuffer("".join(texts).encode(), np.uint8)].reshape(-1, WIDTH)
    row = np.repeat(np.arange(len(texts)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat[:, 0] * 64 + flat[:, 1]
    return out, size


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances (insert, delete, replace) of pairs of signatures, all pairs at once with bit vectors (one bit for each sign of a)."""
    left, m = _signs(a)
    right, n = _signs(b)
    one = np.uint64(1)
    ups, downs = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    score = m.copy()
    top = np.maximum(m - 1, 0).astype(np.uint64)
    bits = one << np.arange(left.shape[1]).astype(np.uint64)
    for j in range(right.shape[1]):
        equal = np.where(left == right[:, j : j + 1], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        across = equal | downs
        diagonal = (((equal & ups) + ups) ^ ups) | equal
        more, less = downs | ~(diagonal | ups), ups & diagonal
        live = j < n
        score += np.where(live & (m > 0), ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64), 0)
        more, less = (more << one) | one, less << one
        ups, downs = np.where(live, less | ~(across | more), ups), np.where(live, more & across, downs)
    return np.where(m == 0, n, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal fingerprints, 0 without a common level, else 1 - edit distance / longer signature at the finest common level."""
    rows = [(x.split(":"), y.split(":")) for x, y in zip(a, b, strict=True)]
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    gaps = np.array([int(x[0]) - int(y[0]) for x, y in rows], np.int64)
    pairs = np.flatnonzero((np.abs(gaps) < SIGNATURES) & (out < 1))
    for begin in range(0, len(pairs), 2048):
        at = pairs[begin : begin + 2048]
        left = [rows[k][0][1 + max(0, -gaps[k])] for k in at]
        right = [rows[k][1][1 + max(0, gaps[k])] for k in at]
        longest = np.array([max(len(x), len(y), WIDTH) // WIDTH for x, y in zip(left, right, strict=True)])
        out[at] = 1 - edit_distances(left, right) / longest
    return np.clip(out, 0.0, 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; a null text counts as empty, repeated rows give equal fingerprints."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")
