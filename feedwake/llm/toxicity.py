"""Toxicity by compression distance: windows are compressed with a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake.llm.common import slices

#: Words of a window, bytes of the shared and of the class part of a dictionary.
WINDOW, BASE_BYTES, CLASS_BYTES = 16, 64 << 10, 8 << 10
#: Bytes of the runs that tell classes apart, how much more frequent they are in one, and the share of its texts (one in ...) that hold them.
GRAM, RATIO, RARE = 8, 5.0, 60
#: Share of toxic texts that the calibration assumes at least, so that rare toxic texts are still caught.
LEAST_SHARE = 0.25
#: Labelled texts of each class that the fit may use, chosen by a hash of doc_id.
SAMPLE = 3000
#: Windows that a dictionary is trained on.
TRAIN_WINDOWS = 80_000
#: Bytes that a window gains under the toxic dictionary, from which shares are counted.
GAINS = (1, 2, 4)


def text_windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().split()
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries and the calibrated weights; without weights the score is ``prior``."""

    toxic: bytes = b""
    ordinary: bytes = b""
    prior: float = 0.0
    weights: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.prior
        x = (features(text, self.toxic, self.ordinary) - np.array(self.centre)) / np.array(self.spread)
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30))))


@lru_cache(maxsize=16)
def compressor(content: bytes):
    """A compressor with this dictionary; frames carry no header fields, so lengths compare."""
    import zstandard

    options = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=options)


def lengths(content: bytes, windows: Iterable[bytes]) -> np.ndarray:
    compress = compressor(content).compress
    return np.array([len(compress(w)) for w in windows], np.int64)


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a dictionary that the library trains: segments with the most frequent substrings. Few samples are taken whole."""
    import zstandard

    if sum(map(len, samples)) > 2 * size and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()[-size + 512 :]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def features(text: str | None, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Mean gain of a window, shares of windows with larger gains, largest gain, and the logarithm of the number of windows."""
    windows = text_windows(text)
    if not windows:
        return np.zeros(len(GAINS) + 3)
    gain = lengths(ordinary, windows) - lengths(toxic, windows)
    return np.array([gain.mean(), *((gain >= g).mean() for g in GAINS), min(8, gain.max()), np.log(len(windows))])


def _spread(items: list, most: int) -> list:
    """At most ``most`` of the items, evenly over all."""
    return items if len(items) <= most else [items[i] for i in np.linspace(0, len(items) - 1, most).astype(int)]


def _distinct_windows(texts: list[str]) -> list[bytes]:
    return list(dict.fromkeys(w for t in texts for w in text_windows(t)))


def _folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def _grams(data: bytes) -> np.ndarray:
    """Every run of ``GRAM`` (eight) bytes as a number."""
    return np.ndarray((max(0, len(data) - GRAM + 1),), "<u8", data, 0, (1,)) if len(data) >= GRAM else np.empty(0, np.uint64)


def _share(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.unique(_grams(t)) for t in texts]), return_counts=True)


def fragments(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """Stretches of the texts of one class whose byte runs are in far more of them than of the other class."""
    grams, times = _share(own)
    others, other_times = _share(other)
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    elsewhere = np.where(others[at] == grams, other_times[at], 0)
    ratio = ((times + 0.5) / (len(own) + 1)) / ((elsewhere + 0.5) / (len(other) + 1))
    telling = grams[(ratio >= RATIO) & (times >= max(3, len(own) // RARE))]
    out = []
    for text in own:
        runs = _grams(text)
        hits = np.flatnonzero(telling[np.minimum(np.searchsorted(telling, runs), len(telling) - 1)] == runs) if len(telling) else []
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > GRAM) + 1) if len(hits) else []:
            out.append(text[max(0, run[0] - 1) : run[-1] + GRAM + 1])
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the dictionary of toxic and of ordinary text.

    Both end in the same base of ordinary text, so that a window of ordinary words has the same length under both, and begin
    with a part trained on what tells their class from the other.
    """
    base = dictionary(_spread(_distinct_windows(ordinary), TRAIN_WINDOWS), BASE_BYTES, 64)
    bad, good = [_folded(t) for t in toxic], [_folded(t) for t in ordinary]
    return dictionary(fragments(bad, good), CLASS_BYTES, 16) + base, dictionary(fragments(good, bad), CLASS_BYTES, 16) + base


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression (intercept first) by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    keep = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + keep * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-6)
        w = w - np.linalg.solve(bend, slope)
    return w


def sampled(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """``doc_id``, ``toxic`` and one ``text`` for each of at most ``sample`` labels (``known``) of each class, by a hash of doc_id.

    Where rows of ``docs`` repeat a doc_id the text with the smallest hash stands for them, so their number does not matter.
    """
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked[0].union(picked[1]).distinct()), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on ``labels`` (``doc_id``, ``toxic``) of ``docs``; at most ``sample`` texts of each class come to the driver.

    The sample (see ``sampled``) is chosen from the labels, then joined with the texts; it has a fixed bound, so it may be broadcast. Rows with a null label or doc_id are not used. Without texts of both classes the model gives the share of toxic
    labels (0 without any).
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rows = sampled(docs, known, sample).select(F.xxhash64("doc_id"), "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[2], r[1] or ""))
    texts = {c: list(dict.fromkeys(r[1] for r in rows if r[2] == c and r[1])) for c in (0, 1)}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if min(len(texts[0]), len(texts[1])) < 4:
        return Model(prior=prior)
    held = []
    for k in (0, 1):  # each half is measured with the dictionaries of the other
        pair = dictionaries(texts[1][k::2], texts[0][k::2])
        held += [(features(t, *pair), c) for c in (0, 1) for t in texts[c][1 - k :: 2]]
    toxic, ordinary = dictionaries(texts[1], texts[0])
    x, y = np.array([f for f, _ in held]), np.array([float(c) for _, c in held])
    toxic_share = max(prior, LEAST_SHARE)
    share = np.array([(1 - toxic_share) / (y == 0).sum(), toxic_share / (y == 1).sum()])
    weight = len(y) * share[y.astype(int)]
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = calibrate((x - centre) / spread, y, weight)
    return Model(toxic, ordinary, prior, tuple(weights.tolist()), tuple(centre.tolist()), tuple(spread.tolist()))


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and ``score`` (0 to 1), from its whole ``text`` alone.

    A null or empty text has no window and gets the score of zero gains. Rows are independent: repeated rows get equal scores, other
    columns are not read, an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                scores = pa.array([model.score(t.as_py()) for t in part.column("text")], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), scores], names=[*keep, "score"])

    wanted = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in keep]
    return wanted.mapInArrow(run, ", ".join([*fields, "score double"]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
