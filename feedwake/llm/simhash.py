"""SimHash near-dedup with a hierarchical index in Gray order."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm.common import slices
from feedwake.llm.components import components
from feedwake.storage import write_table

SHINGLE, SEED, NEAR = 4, 42, 4
#: Shingles hashed at once, fingerprints of an index part, rows of a node, node pairs looked at together.
STEP, PART, FAN, PAIRS = 1 << 16, 20_000, 8, 1 << 14


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if over half the shingles' hashes have it."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[len(words) - n :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        parts = [joined[a:b] for a, b in zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits`` (long) of each row; a null or empty text has bits 0."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bits = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, bits long")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits ^ (bits >> np.uint64(shift))
    return bits


def segments(near: int = NEAR) -> list[tuple[int, int]]:
    """(shift, width) of ``near`` + 1 masks: fingerprints that differ in ``near`` bits agree on one of them."""
    cuts = [round(64 * k / (near + 1)) for k in range(near + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class _Forest:
    """Labels of rows that links join; a label is the smallest row of its tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def _expand(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b); of a node with itself each pair once."""
    times = count[a] * count[b]
    pair = np.repeat(np.arange(len(a)), times)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
    x, y = first[a][pair] + k // count[b][pair], first[b][pair] + k % count[b][pair]
    keep = (a[pair] != b[pair]) | (x <= y)
    return x[keep], y[keep]


def linked(bits: np.ndarray, roots: np.ndarray, side: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Label of each row: rows of one root whose bits differ in ``near`` places or less are joined, directly or by others.

    Rows must be sorted by (root, Gray rank). Nodes hold up to ``FAN`` neighbours in that order and what they share: the bits
    that all have (``ones``) and that any has (``any``). Two nodes differ at least where one has only ones and the other only
    zeros; a pair beyond ``near`` is dropped with all below it. A pair whose rows are joined already is not opened either.
    Rows of the same ``side`` are compared only if all rows have that side.
    """
    forest = _Forest(len(bits))
    levels = [(bits, bits, np.arange(len(bits)), np.ones(len(bits), np.int64), np.arange(len(bits)), roots)]
    while len(levels[-1][0]) > len(np.unique(levels[-1][5])):
        ones, some, _, _, low, root = levels[-1]
        starts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        offset = np.arange(len(root)) - np.repeat(starts, np.diff(np.r_[starts, len(root)]))
        first = np.flatnonzero(offset % FAN == 0)
        count = np.diff(np.r_[first, len(root)])
        levels.append((np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(some, first), first, count, low[first], root[first]))
    two = len(np.unique(side)) > 1
    top = len(levels) - 1
    every = np.arange(len(levels[top][0]))
    stack = [(top, every[k : k + PAIRS], every[k : k + PAIRS]) for k in range(0, len(every), PAIRS)]
    while stack:
        depth, a, b = stack.pop()
        ones, some = levels[depth][:2]
        apart = np.bitwise_count((ones[a] & ~some[b]) | (ones[b] & ~some[a]))
        near_by = apart <= near
        a, b = a[near_by], b[near_by]
        if not depth:
            other = (a != b) & ((side[a] != side[b]) if two else True)
            forest.join(a[other], b[other])
            continue
        # labels of all rows of a node: equal smallest and largest mean that the node is joined already
        begin, end = levels[depth][4], np.r_[levels[depth][4][1:], len(bits)]
        least, most = np.minimum.reduceat(forest.label, begin), np.maximum.reduceat(forest.label, begin)
        alike = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]) & ((end - begin)[a] > 0)
        a, b = a[~alike], b[~alike]
        for k in range(0, len(a), PAIRS):
            x, y = _expand(levels[depth][2], levels[depth][3], a[k : k + PAIRS], b[k : k + PAIRS])
            stack.append((depth - 1, x, y))
    return forest.label


def links(nodes: DataFrame, near: int = NEAR, part: int = PART, largest: int = 100_000) -> DataFrame:
    """Edges (u, v) between the distinct ``bits`` of ``nodes`` that join all fingerprints within ``near`` differing bits.

    The upper nodes are the masks of ``segments``: a fingerprint goes to its pattern under each mask. Patterns of a mask that
    follow each other share an index part of about ``part`` fingerprints. A pattern of more than ``largest`` fingerprints is dealt out
    to blocks, and each pair of blocks is a part. A part returns a forest (one edge for each fingerprint at most), not its pairs.
    """
    total = nodes.count()
    masks = segments(near)
    patterns = F.array(*[
        F.struct(F.lit(k).alias("mask"), F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("pattern"))
        for k, (shift, width) in enumerate(masks)
    ])
    rows = nodes.select("bits", F.explode(patterns).alias("p")).select("bits", "p.mask", "p.pattern")
    width = min(w for _, w in masks)
    coarse = max(0, min(width, int(np.floor(np.log2(max(1, part * (1 << width) / max(1, total)))))))
    sizes = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest)
    rows = rows.join(sizes, ["mask", "pattern"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / largest).cast("int"))
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    group = F.when(F.col("blocks") > 1, F.col("pattern")).otherwise(F.shiftright("pattern", coarse))
    keyed = dealt.select(
        "bits", "pattern", "own", "mask", group.alias("part"), F.col("blocks").alias("blocks"),
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf["bits"].to_numpy().view(np.uint64)
        pattern = pdf["pattern"].to_numpy()
        order = np.lexsort((gray_rank(bits), pattern))
        bits = bits[order]
        label = linked(bits, pattern[order], pdf["own"].to_numpy()[order], near)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": bits[moved].view(np.int64), "v": bits[label[moved]].view(np.int64)})

    return keyed.groupBy("mask", "part", "blocks", "a", "b").applyInPandas(join, "u long, v long")


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """``doc_id``, ``bits`` and ``component_id`` (smallest doc_id reachable) of each row of ``docs``.

    Words are lower-cased (A-Z) runs between blanks, shingles four words with repeats; a null or empty text has bits 0 and is
    linked like any other. Equal fingerprints are one node, whatever their number, so copies form no pairs. Repeated rows get equal
    results; a null doc_id stays null and names no component; other columns are not read; an empty table gives an empty result.
    """
    found = write_table(fingerprints(docs))
    nodes = found.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("bits"), near)).withColumnRenamed("node", "bits")
    rooted = nodes.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(rooted.join(lowest, "root").select("bits", "component_id"), "bits", "left").select("doc_id", "bits", "component_id")
