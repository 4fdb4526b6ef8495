"""Substring dedup by fixed-block anchors: non-overlapping blocks are the index, every rolling window probes it, hits are extended."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from feedwake.llm.common import Shelves, by_bucket, covered, encoded, member, ordered_ids, pack, release, unpack, windows, word_hashes

#: Words of a window that is judged as a whole. Any window of this many words holds a whole aligned block.
WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Bytes kept of a block's hash besides its bucket (a false hit only costs work) and of a window's hash (which decides).
ANCHOR_BYTES, WINDOW_BYTES = 4, 8


class _Shelf:
    """The words of the documents of one shelf, in order of doc_id (rows without one last)."""

    def __init__(self, ids, texts):
        self.order = np.argsort(ordered_ids(ids), kind="stable")
        self.ids = ordered_ids(ids)[self.order]
        self.texts = [encoded([texts[i]])[0] for i in self.order]
        self.hashes, self.owner, *_ = word_hashes(self.texts)
        self.counts = np.bincount(self.owner, minlength=len(self.texts))
        #: Rank of the document's id: documents of equal id do not refer to each other.
        self.rank = np.searchsorted(np.unique(self.ids), self.ids)[self.owner]

    def rolling(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all rolling blocks, and the places of the aligned ones."""
        hashes, whole = windows(self.hashes, self.owner, BLOCK)
        first = (np.cumsum(self.counts) - self.counts)[self.owner[: len(hashes)]]
        aligned = whole & ((np.arange(len(hashes)) - first) % BLOCK == 0)
        return np.where(whole, hashes, 0), np.flatnonzero(aligned), np.flatnonzero(whole)

    def candidates(self, remote: dict[int, np.ndarray] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows around block hits in this shelf or (hashes by bucket) in another."""
        blocks, aligned, whole = self.rolling()
        if not len(whole):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        hit = np.zeros(len(blocks), bool)
        order = aligned[np.argsort(blocks[aligned], kind="stable")]
        index, first = np.unique(blocks[order], return_index=True)
        if len(index):
            low, high = np.minimum.reduceat(self.rank[order], first), np.maximum.reduceat(self.rank[order], first)
            at = np.minimum(np.searchsorted(index, blocks), len(index) - 1)
            own = self.rank[: len(blocks)]
            hit = (index[at] == blocks) & ((low[at] != own) | (high[at] != own))
        if remote:
            distinct = np.unique(blocks[whole])
            found = [part[member(_low(part), remote[bucket])] for bucket, part in by_bucket(distinct, buckets) if bucket in remote]
            if found:
                hit |= member(blocks, np.concatenate(found))
        keep = np.zeros(len(blocks), bool)
        keep[whole] = True
        sums = np.r_[0, np.cumsum(hit & keep)]
        hashes, inside = windows(self.hashes, self.owner, WINDOW)
        starts = np.flatnonzero(inside & (sums[np.minimum(np.arange(len(hashes)) + WINDOW - BLOCK + 1, len(blocks))] > sums[: len(hashes)]))
        return starts, hashes[starts]


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)


def _blobs(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    release()
    return pd.DataFrame(rows, columns=names)


def repeats(shelves: Shelves) -> DataFrame:
    """Windows of each shelf that also occur in an earlier one: rows (shelf, bucket, hashes)."""
    buckets = shelves.buckets

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        shelf = _Shelf(pdf["doc_id"], pdf["text"])
        blocks, aligned, whole = shelf.rolling()
        index = dict(by_bucket(np.unique(blocks[aligned]), buckets))
        rows = [
            (int(pdf["shelf"].iloc[0]), bucket, pack(np.unique(_low(index.get(bucket, part[:0]))), ANCHOR_BYTES), pack(np.unique(_low(part)), ANCHOR_BYTES))
            for bucket, part in by_bucket(np.unique(blocks[whole]), buckets)
        ]
        return _blobs(rows, ["shelf", "bucket", "blocks", "probes"])

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [unpack(b, ANCHOR_BYTES) for b in pdf["blocks"]]
        index, times = np.unique(np.concatenate(held), return_counts=True)
        rows = []
        for shelf, own, blob in zip(pdf["shelf"], held, pdf["probes"], strict=True):
            probes = unpack(blob, ANCHOR_BYTES)
            at = np.minimum(np.searchsorted(index, probes), max(0, len(index) - 1))
            if not len(index):
                continue
            others = np.where(index[at] == probes, times[at], 0) - member(probes, own)
            if (others > 0).any():
                rows.append((shelf, int(pdf["bucket"].iloc[0]), pack(probes[others > 0], ANCHOR_BYTES)))
        return _blobs(rows, ["shelf", "bucket", "hits"])

    def extend(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _blobs([], ["shelf", "bucket", "windows"])
        remote = {b: unpack(h, ANCHOR_BYTES) for b, h in zip(hits["bucket"], hits["hits"], strict=True)}
        _, hashes = _Shelf(docs["doc_id"], docs["text"]).candidates(remote, buckets)
        rows = [(int(docs["shelf"].iloc[0]), bucket, pack(part, WINDOW_BYTES)) for bucket, part in by_bucket(np.unique(hashes), buckets)]
        return _blobs(rows, ["shelf", "bucket", "windows"])

    def earlier(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shelf")
        held = [unpack(b, WINDOW_BYTES) for b in pdf["windows"]]
        values, first = np.unique(np.concatenate(held), return_index=True)
        bounds = np.cumsum([len(h) for h in held])
        home = np.searchsorted(bounds, first, side="right")
        rows = []
        for k, (shelf, own) in enumerate(zip(pdf["shelf"], held, strict=True)):
            later = own[home[np.searchsorted(values, own)] < k]
            if len(later):
                rows.append((shelf, int(pdf["bucket"].iloc[0]), pack(later, WINDOW_BYTES)))
        return _blobs(rows, ["shelf", "bucket", "repeats"])

    hits = (
        shelves.docs.groupBy("shelf").applyInPandas(anchors, "shelf int, bucket int, blocks binary, probes binary")
        .groupBy("bucket").applyInPandas(probe, "shelf int, bucket int, hits binary")
    )
    found = shelves.docs.groupBy("shelf").cogroup(hits.groupBy("shelf")).applyInPandas(extend, "shelf int, bucket int, windows binary")
    return found.groupBy("bucket").applyInPandas(earlier, "shelf int, bucket int, repeats binary")


def remove_repeats(docs: DataFrame, shelf_bytes: int | None = None, keep: Sequence[str] = (), keep_layout: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by a blank).

    The text columns ``keep`` come along. With ``keep_layout`` a text that loses nothing stays as it is.

    A word goes if it lies in a window of ``WINDOW`` consecutive words that also starts in a document of a smaller doc_id; all
    windows are judged on the input. Rows of equal doc_id do not refer to each other, a null doc_id counts as larger than all;
    null texts have no words; other columns are not read; an empty table gives an empty result.

    Exchanges hold packed distinct hashes, one entry for each shelf and value, so a passage that a third of all documents share
    is one entry for each shelf, not one for each document, and no pair of documents is formed. A window's 64-bit hash stands
    for its words.
    """
    shelves = Shelves(docs, shelf_bytes, keep)

    def cut(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({c: [] for c in ("doc_id", "n_words", "n_removed", "kept_text", *keep)})
        shelf = _Shelf(docs["doc_id"], docs["text"])
        hashes, inside = windows(shelf.hashes, shelf.owner, WINDOW)
        gone = np.zeros(len(hashes), bool)
        starts = np.flatnonzero(inside)
        values, place = np.unique(hashes[starts], return_inverse=True)
        if len(starts):
            low = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(low, place, shelf.rank[starts])
            gone[starts] = low[place] < shelf.rank[starts]
        if len(known) and len(hashes):
            gone |= inside & member(hashes, np.unique(np.concatenate([unpack(b, WINDOW_BYTES) for b in known["repeats"]])))
        removed = covered(np.flatnonzero(gone), WINDOW, len(shelf.hashes)) if len(shelf.hashes) else np.zeros(0, bool)
        ends = np.cumsum(shelf.counts)
        kept = []
        for text, begin, end in zip(shelf.texts, ends - shelf.counts, ends, strict=True):
            whole = keep_layout and not removed[begin:end].any()
            kept.append(text.decode() if whole else b" ".join(compress(text.split(), ~removed[begin:end])).decode())
        n_removed = np.bincount(shelf.owner[removed], minlength=len(kept))
        ids = docs["doc_id"].astype("Int64").iloc[shelf.order].reset_index(drop=True)
        release()
        others = {c: docs[c].iloc[shelf.order].reset_index(drop=True) for c in keep}
        return pd.DataFrame({"doc_id": ids, "n_words": shelf.counts, "n_removed": n_removed, "kept_text": kept, **others})

    schema = ", ".join(["doc_id long, n_words long, n_removed long, kept_text string", *(f"`{c}` string" for c in keep)])
    return shelves.docs.groupBy("shelf").cogroup(repeats(shelves).groupBy("shelf")).applyInPandas(cut, schema)

