"""Quality by a factorisation machine: hashed words, structure statistics and metadata with low-rank pairwise interactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake.llm.common import encoded, mix, slices, windows, word_hashes

#: Inputs of hashed words, and their factors each input has.
WORDS, RANK = 2048, 8
#: Labelled texts of each class that the fit may use, chosen by a hash of doc_id; each comes to the driver as one vector.
SAMPLE = 3000
#: Passes over the sample, rows of a step, step length, decay of weights and factors, and the seed of the first factors.
PASSES, ROWS, STEP, DECAY, SEED = 40, 64, 0.02, 1e-4, 5
#: Text bytes whose inputs are formed at once.
TEXTS = 1 << 20
#: Kinds of bytes that the statistics count: lower, upper, digit, end of line, other gap, point, other sign, beyond ASCII.
KINDS = ("lower", "upper", "digit", "line", "gap", "point", "sign", "wide")
STATS = (
    "log_words", "word_length", "upper", "digit", "point", "sign", "wide", "sign_words", "point_words", "distinct_words", "top_word", "distinct_pairs",
    "distinct_triples", "words_a_line", "distinct_lines",
)
#: Bits of a number that metadata is told by: its power of two.
POWERS = 32


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("sign"), np.uint8)
    kind[ord("a") : ord("z") + 1] = KINDS.index("lower")
    kind[ord("A") : ord("Z") + 1] = KINDS.index("upper")
    kind[ord("0") : ord("9") + 1] = KINDS.index("digit")
    kind[[9, 11, 12, 13, 32]] = KINDS.index("gap")
    kind[10] = KINDS.index("line")
    kind[[ord(c) for c in ".,;:!?"]] = KINDS.index("point")
    kind[128:] = KINDS.index("wide")
    return kind


_KIND = _kinds()


@dataclass(frozen=True)
class Layout:
    """Which inputs a model has: hashed words, then statistics, then ``POWERS`` + 1 inputs for each metadata column."""

    words: int = WORDS
    metadata: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return self.words + len(STATS) + len(self.metadata) * (POWERS + 1)


def statistics(text: bytes, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``STATS`` of one text from its bytes, its words' hashes and the kinds of the words' last bytes; zeros without words."""
    n = len(hashes)
    if not n:
        return np.zeros(len(STATS))
    kinds = np.zeros(len(KINDS))
    for at in range(0, len(text), TEXTS):
        kinds += np.bincount(_KIND[np.frombuffer(text, np.uint8, min(TEXTS, len(text) - at), at)], minlength=len(KINDS))
    count = dict(zip(KINDS, kinds, strict=True))
    solid = len(text) - count["line"] - count["gap"]
    times = np.unique(hashes, return_counts=True)[1]
    owner = np.zeros(n, np.int8)
    distinct = [len(np.unique(windows(hashes, owner, k)[0])) / (n - k + 1) if n >= k else 1.0 for k in (2, 3)]
    lines = [line for line in text.split(b"\n") if line.strip()]
    return np.array([
        np.log(n), solid / n, count["upper"] / solid, count["digit"] / solid, count["point"] / solid, count["sign"] / solid, count["wide"] / solid,
        np.mean(last == KINDS.index("sign")), np.mean(last == KINDS.index("point")), len(times) / n, times.max() / n, *distinct,
        np.log(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
    ])


def inputs(texts, metadata: Sequence[np.ndarray], layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, input and value of every input that is not zero, in order; ``metadata`` holds one array of numbers (nan: none) for each column.

    A word counts by the logarithm of its times, and a text's word values have length one together.
    """
    raw = encoded(texts)
    hashes, owner, starts, ends, _ = word_hashes([t.lower() for t in raw])
    bounds = np.searchsorted(owner, np.arange(len(raw) + 1))
    joined = np.frombuffer(b"\n".join(raw), np.uint8)
    last = _KIND[joined[ends - 1]] if len(ends) else np.empty(0, np.uint8)
    key, times = np.unique(owner * layout.words + (mix(hashes) % np.uint64(layout.words)).astype(np.int64), return_counts=True)
    row, place, value = key // layout.words, key % layout.words, np.log1p(times)
    length = np.sqrt(np.bincount(row, value**2, len(raw)))
    parts = [(row, place, value / length[row] if len(row) else value)]
    stats = np.array([statistics(t, hashes[a:b], last[a:b]) for t, a, b in zip(raw, bounds[:-1], bounds[1:], strict=True)]).reshape(len(raw), len(STATS))
    at = np.arange(len(raw))
    for k in range(len(STATS)):
        parts.append((at, np.full(len(raw), layout.words + k), stats[:, k]))
    for k, column in enumerate(metadata):
        power = np.minimum(np.floor(np.log2(np.maximum(np.nan_to_num(column), 0) + 1)), POWERS - 1).astype(np.int64)
        parts.append((at, layout.words + len(STATS) + k * (POWERS + 1) + np.where(np.isnan(column), POWERS, power), np.ones(len(raw))))
    rows, places, values = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((places, rows))
    return rows[order], places[order], values[order]


@dataclass(frozen=True)
class Model:
    """A fitted machine. Statistics are centred and scaled before use; without weights the score is ``prior``."""

    layout: Layout
    prior: float = 0.0
    bias: float = 0.0
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None

    def scores(self, texts, metadata: Sequence[np.ndarray] = ()) -> np.ndarray:
        """Score of each text in time linear in its inputs: pairs of inputs are summed as (square of the sum - sum of the squares) / 2."""
        n = len(texts)
        if self.weights is None or not n:
            return np.full(n, self.prior)
        row, place, value = inputs(texts, metadata, self.layout)
        value = standardised(place, value, self)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        linear = np.add.reduceat(value * self.weights[place], first)
        pairs = np.zeros(n)
        for k in range(self.factors.shape[1]):
            part = value * self.factors[place, k]
            pairs += np.add.reduceat(part, first) ** 2 - np.add.reduceat(part**2, first)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def standardised(place: np.ndarray, value: np.ndarray, model: Model) -> np.ndarray:
    stat = place - model.layout.words
    some = (stat >= 0) & (stat < len(STATS))
    out = value.copy()
    out[some] = np.clip((value[some] - model.centre[stat[some]]) / model.spread[stat[some]], -3, 3) / 2
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: int = RANK, passes: int = PASSES, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of the logistic loss over the rows of ``x``, by adaptive gradient steps in a fixed order."""
    random = np.random.default_rng(seed)
    w, v = np.zeros(x.shape[1]), random.normal(0, 0.05, (x.shape[1], rank))
    share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    square_w, square_v, square_b = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
    for _ in range(passes):
        order = random.permutation(len(y))
        for at in range(0, len(y), ROWS):
            rows = order[at : at + ROWS]
            part = x[rows]
            inner = part @ v
            guess = bias + part @ w + ((inner**2).sum(axis=1) - (part**2 @ v**2).sum(axis=1)) / 2
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(guess, -30, 30))) - y[rows]) / len(rows)
            slope_w = part.T @ error + DECAY * w
            slope_v = part.T @ (error[:, None] * inner) - v * ((part**2).T @ error)[:, None] + DECAY * v
            square_w += slope_w**2
            square_v += slope_v**2
            square_b += error.sum() ** 2
            w -= 5 * STEP * slope_w / np.sqrt(square_w)
            v -= STEP * slope_v / np.sqrt(square_v)
            bias -= 5 * STEP * error.sum() / np.sqrt(square_b)
    return bias, w, v


def _read(part: pa.RecordBatch, metadata: Sequence[str]) -> tuple[list, list[np.ndarray]]:
    return part.column("text").to_pylist(), [part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in metadata]


def vectors(rows: DataFrame, layout: Layout) -> DataFrame:
    """``doc_id``, ``label``, ``places`` and ``values`` of each row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                row, place, value = inputs(*_read(part, layout.metadata), layout)
                cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(a)) for a in (place.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *lists], names=["doc_id", "label", "places", "values"])

    wanted = rows.select("doc_id", "label", "text", *[F.col(c).cast("double").alias(c) for c in layout.metadata])
    return wanted.mapInArrow(run, "doc_id long, label int, places array<int>, values array<float>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = (), sample: int = SAMPLE, words: int = WORDS) -> Model:
    """Train on ``labels`` (``doc_id`` and the 0/1 column ``label``) of ``docs``.

    At most ``sample`` labels of each class, by a hash of doc_id, are joined with the texts; of rows that repeat a doc_id the text with the
    smallest hash counts. Inputs are formed on Spark; the driver gets one sparse vector for each sampled label. Classes keep their shares of all
    labels. Labels with a null label or doc_id are not used. With less than four texts of a class the model gives the share of label 1.
    """
    layout = Layout(words, tuple(metadata))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) == 1).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(picked[0].union(picked[1]).distinct()), "doc_id")
    kept = F.struct("text", *metadata)
    once = rows.groupBy("doc_id", "label").agg(F.min_by(kept, F.struct(F.xxhash64("text"), kept)).alias("kept")).select("doc_id", "label", "kept.*")
    found = vectors(once, layout).withColumn("order", F.xxhash64("doc_id")).toArrow()
    found = found.take(np.lexsort((found.column("label").to_numpy(), found.column("doc_id").to_numpy(), found.column("order").to_numpy())))
    y = found.column("label").to_numpy().astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return Model(layout, prior)
    x = np.zeros((len(y), layout.size), np.float32)
    for k, (places, values) in enumerate(zip(found.column("places"), found.column("values"), strict=True)):
        x[k, places.values.to_numpy()] = values.values.to_numpy()
    stats = x[:, words : words + len(STATS)].astype(float)
    centre, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x[:, words : words + len(STATS)] = np.clip((stats - centre) / spread, -3, 3) / 2
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    bias, weights, factors = train(x, y, weight)
    return Model(layout, prior, bias, weights, factors, centre, spread)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row of ``docs``, from its whole text and the model's metadata columns.

    A null or empty text has no words and zero statistics, a null in a metadata column is an input of its own. Rows are independent:
    repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
    """
    metadata = model.layout.metadata

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(*_read(part, metadata)))], names=["doc_id", "score"])

    wanted = docs.select("doc_id", "text", *[F.col(c).cast("double").alias(c) for c in metadata])
    return wanted.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
