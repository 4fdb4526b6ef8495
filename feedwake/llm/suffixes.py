"""Suffix dedup: sampled suffixes, split by ranges of their leading bytes, sorted in buckets and compared with their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm.common import CHUNK, ODD, Shelves, bucket_of, by_bucket, covered, encoded, member, mix, ordered_ids, pack, unpack

#: Bytes of a string that must not repeat, leading bytes that pick suffixes, and places of these in one string.
LENGTH, LEAD = 100, 32
PLACES = LENGTH - LEAD + 1
#: Bytes kept of a lead's hash besides its bucket; a false match only costs work.
LEAD_BYTES = 4
#: Documents that are looked at for the splitters, for each bucket, and suffixes of each.
SAMPLED, SUFFIXES = 2, 16
_PLACE_BITS = np.uint64(21)


def _lead_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``LEAD`` (a power of two) bytes from each place, by doubling."""
    hashes, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < LEAD:
        hashes = hashes[:-width] * np.uint64(pow(int(ODD), width, 1 << 64)) + hashes[width:]
        width *= 2
    return hashes


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width``."""
    reach = 1
    while 2 * reach <= width:
        keys, reach = np.minimum(keys[:-reach], keys[reach:]), 2 * reach
    rest = width - reach
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


class _Texts:
    """The bytes of a shelf's documents in order of doc_id (rows without one last, equal ids by text)."""

    def __init__(self, ids, texts):
        raw = encoded(texts)
        numbers = ordered_ids(ids)
        self.order = sorted(range(len(raw)), key=lambda i: (numbers[i], raw[i]))
        self.texts = [raw[i] for i in self.order]
        self.joined = b"".join(self.texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.last, self.anchor, self.lead = self._runs()

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of consecutive strings that pick the same suffix: first and last start, place of the suffix, hash of its lead.

        A string picks the place, within it, of the lead with the smallest hash (the first of equal ones). That depends on its bytes
        alone, so equal strings pick the same place, whatever surrounds them.
        """
        parts = [[np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)]]
        ends = self.starts + self.sizes
        for begin in range(0, max(0, len(self.data) - LENGTH + 1), CHUNK):
            part = self.data[begin : begin + CHUNK + LENGTH - 1]
            hashes = _lead_hashes(part)
            keys = ((hashes * ODD) >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
            picked = (_window_minima(keys, PLACES) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
            at = np.arange(len(picked)) + begin
            owner = np.searchsorted(ends, at, side="right")
            inside = at + LENGTH <= ends[owner]
            fresh = inside.copy()
            fresh[1:] &= ~inside[:-1] | (picked[1:] != picked[:-1])
            first = np.flatnonzero(fresh)
            stop = np.flatnonzero(np.append(inside[:-1] & (~inside[1:] | fresh[1:]), inside[-1:]))
            parts.append([first + begin, stop + begin, picked[first] + begin, mix(hashes[picked[first]])])
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))

    def chosen(self, remote: dict[int, np.ndarray] | None, buckets: int) -> np.ndarray:
        """Runs whose lead occurs again here or (hashes by bucket) in another shelf."""
        values, place, times = np.unique(self.lead, return_inverse=True, return_counts=True)
        again = times > 1
        if remote:
            homes = bucket_of(values, buckets).astype(np.int64)
            for bucket, part in by_bucket(values, buckets):
                if bucket in remote:
                    again[homes == bucket] |= member(_low(part), remote[bucket])
        return np.flatnonzero(again[place])

    def records(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs with distinct strings, in order, and for each run the record that stands for it."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.data.astype(np.uint64) * _powers(len(self.data)), dtype=np.uint64)))
        first, stop = self.first[runs], self.last[runs] + LENGTH
        held = (sums[stop] - sums[first]) * _inverses(len(self.data) + 1)[first]
        shape = (stop - first).astype(np.uint64) * np.uint64(256) + (self.anchor[runs] - first).astype(np.uint64)
        _, index, place = np.unique(mix(held + mix(shape)), return_index=True, return_inverse=True)
        order = np.argsort(index)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return runs[index[order]], rank[place]

    def strings(self, runs: np.ndarray) -> np.ndarray:
        """Starts of the strings of runs."""
        first, count = self.first[runs], (self.last - self.first)[runs] + 1
        return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, size: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < size:
        _TABLES[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64))))
    return _TABLES[name][:size]


def _powers(size: int) -> np.ndarray:
    return _table("powers", int(ODD), size)


def _inverses(size: int) -> np.ndarray:
    return _table("inverses", pow(int(ODD), -1, 1 << 64), size)


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 8 * LEAD_BYTES) - 1)


def _leads(shelf: _Texts, runs: np.ndarray) -> np.ndarray:
    """The leading bytes of the runs' suffixes, as strings that compare like bytes."""
    if not len(runs):
        return np.empty(0, f"S{LEAD}")
    return np.ascontiguousarray(shelf.data[shelf.anchor[runs][:, None] + np.arange(LEAD)]).view(f"S{LEAD}").reshape(-1)


def _ranges(shelf: _Texts, records: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each range of leading bytes the places of its records, in order."""
    ranges = np.searchsorted(splitters, _leads(shelf, records), side="right")
    order = np.argsort(ranges, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(ranges[order])) + 1) if len(order) else []:
        yield int(ranges[own[0]]), own


def _refine(tokens: np.ndarray) -> np.ndarray:
    """Order of rows by multikey quicksort: split by one token, go on to the next token only within equal ones."""
    order = np.argsort(tokens[:, 0], kind="stable")
    fresh = np.arange(len(order)) == 0
    for depth in range(tokens.shape[1]):
        column = tokens[order, depth]
        fresh[1:] |= column[1:] != column[:-1]
        if depth + 1 == tokens.shape[1] or fresh.all():
            break
        group = np.cumsum(fresh)
        tied = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
        order[tied] = order[tied][np.lexsort((tokens[order[tied], depth + 1], group[tied]))]
    return order


def repeated(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which strings of each record occur in an earlier record (rows are in that order); a column for each distance of start and suffix.

    ``left`` are the bytes before the suffix (the nearest first), ``right`` those from it on; record i has strings that start
    ``low[i]`` to ``high[i]`` bytes before it. Sorted by ``right``, suffixes with a common prefix of a length are neighbours; strings
    at a distance are equal if the suffixes share the rest of the length and the bytes before agree.
    """
    out = np.zeros((len(left), PLACES), bool)
    padded = np.zeros((len(right), -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = right
    order = _refine(padded.view(">u8").astype(np.uint64))
    differs = right[order[1:]] != right[order[:-1]]
    common = np.concatenate((np.zeros(1, np.int64), np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)))
    before = np.zeros(len(left), np.uint64)
    group = np.empty(len(left), np.uint64)
    for distance in range(PLACES):
        if distance:
            before = before * ODD + left[:, distance - 1] + np.uint64(1)
        rows = np.flatnonzero((low <= distance) & (distance <= high))
        if len(rows) < 2:
            continue
        group[order] = np.cumsum(common < LENGTH - distance).astype(np.uint64)
        keys = mix(mix(group[rows] * ODD) + before[rows])
        earliest = np.unique(keys, return_index=True)[1]
        out[rows, distance] = True
        out[rows[earliest], distance] = False
    return out


def splitters(shelves: Shelves) -> np.ndarray:
    """Leading bytes that cut the suffixes of some documents (about ``SAMPLED`` for each bucket, by a hash) into equal ranges."""
    if shelves.buckets < 2:
        return np.empty(0, f"S{LEAD}")

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        shelf = _Texts(pdf["doc_id"], pdf["text"])
        picked = np.sort(_leads(shelf, np.arange(len(shelf.anchor))[:: max(1, len(shelf.anchor) // (SUFFIXES * len(pdf)))]))
        return pd.DataFrame({"lead": [bytes(x) for x in picked]})

    few = shelves.docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, shelves.rows // (SAMPLED * shelves.buckets)))) == 0)
    leads = few.groupBy("shelf").applyInPandas(some, "lead binary")
    found = sorted(bytes(r[0]) for r in leads.collect())
    return np.unique(np.array([found[len(found) * k // shelves.buckets] for k in range(1, shelves.buckets)] if found else [], f"S{LEAD}"))


def remove_repeats(docs: DataFrame, shelf_bytes: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that remain).

    A byte goes if it lies in a string of ``LENGTH`` bytes of one document that also starts earlier: in a document of a smaller
    doc_id, or before in the same one. All strings are judged on the input. A null doc_id counts as larger than all; rows of equal
    doc_id count as documents in the order of their texts. Null texts are empty; other columns are not read; an empty table gives
    an empty result.

    Suffixes are sampled by content, so that each string picks one and equal strings pick alike (about 1 in 35). Suffixes whose
    leads occur once are done. The others go, with the bytes around them, to the range of their leading bytes; ranges end between
    unequal leads, so no comparison crosses them. Equal surroundings are one record for each shelf, so copies and shared passages
    add one record for each shelf, not for each document.
    """
    shelves = Shelves(docs, shelf_bytes)
    buckets, cuts = shelves.buckets, splitters(shelves)

    def leads(pdf: pd.DataFrame) -> pd.DataFrame:
        shelf = _Texts(pdf["doc_id"], pdf["text"])
        rows = [(int(pdf["shelf"].iloc[0]), bucket, pack(np.unique(_low(part)), LEAD_BYTES)) for bucket, part in by_bucket(np.unique(shelf.lead), buckets)]
        return pd.DataFrame(rows, columns=["shelf", "bucket", "leads"])

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [unpack(b, LEAD_BYTES) for b in pdf["leads"]]
        values, times = np.unique(np.concatenate(held), return_counts=True)
        more = values[times > 1]
        rows = [(s, int(pdf["bucket"].iloc[0]), pack(h[member(h, more)], LEAD_BYTES)) for s, h in zip(pdf["shelf"], held, strict=True)]
        return pd.DataFrame([r for r in rows if r[2]], columns=["shelf", "bucket", "leads"])

    def known(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        return {b: unpack(h, LEAD_BYTES) for b, h in zip(pdf["bucket"], pdf["leads"], strict=True)}

    def surroundings(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            shelf = _Texts(docs["doc_id"], docs["text"])
            records, _ = shelf.records(shelf.chosen(known(hits), buckets))
            for bucket, own in _ranges(shelf, records, cuts):
                runs = records[own]
                first, stop = shelf.first[runs], shelf.last[runs] + LENGTH
                shape = np.stack([shelf.anchor[runs] - first, shelf.last[runs] - first], axis=1).astype(np.uint8)
                text = b"".join(shelf.joined[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True))
                rows.append((int(docs["shelf"].iloc[0]), bucket, shape.tobytes(), text))
        return pd.DataFrame(rows, columns=["shelf", "range", "shapes", "bytes"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shelf")
        shapes = np.frombuffer(b"".join(pdf["shapes"]), np.uint8).reshape(-1, 2).astype(np.int64)
        data = np.frombuffer(b"\0" * PLACES + b"".join(pdf["bytes"]) + b"\0" * LENGTH, np.uint8)
        high, count = shapes[:, 0], shapes[:, 1]
        size = count + LENGTH
        at = PLACES + np.cumsum(size) - size + high
        left = data[at[:, None] - 1 - np.arange(PLACES - 1)]
        right = data[at[:, None] + np.arange(LENGTH)].copy()
        right[np.arange(LENGTH) >= (size - high)[:, None]] = 0
        found = repeated(left, right, high - count, high)
        # strings of a record in order of their starts: the farthest from the suffix first
        start = np.arange(PLACES)
        flags = np.take_along_axis(found, np.clip(high[:, None] - start, 0, PLACES - 1), axis=1)
        bounds = np.cumsum([len(s) // 2 for s in pdf["shapes"]])
        rows = []
        for shelf, begin, end in zip(pdf["shelf"], np.concatenate((np.zeros(1, np.int64), bounds[:-1])), bounds, strict=True):
            bits = flags[begin:end][start <= count[begin:end, None]]
            if bits.any():
                rows.append((int(shelf), int(pdf["range"].iloc[0]), np.packbits(bits).tobytes()))
        return pd.DataFrame(rows, columns=["shelf", "range", "bits"])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def cut(docs: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({n: [] for n in names})
        shelf = _Texts(docs["doc_id"], docs["text"])
        masks = both[both["bits"].notna()]
        masks = dict(zip(masks["range"].astype(int), masks["bits"], strict=True))
        gone = np.zeros(len(shelf.data), bool)
        runs = shelf.chosen(known(both[both["leads"].notna()].astype({"bucket": int})), buckets)
        records, stands = shelf.records(runs)
        for bucket, own in _ranges(shelf, records, cuts):
            if bucket in masks:
                starts = shelf.strings(records[own])
                gone[starts[np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=len(starts)).astype(bool)]] = True
        # where the same surroundings stood before in this shelf, all strings repeat
        gone[shelf.strings(runs[records[stands] != runs])] = True
        removed = covered(np.flatnonzero(gone), LENGTH, len(gone)) if len(gone) else gone
        edges = removed & ~np.concatenate((np.zeros(1, bool), removed[:-1])) if len(gone) else removed
        begins = shelf.starts[shelf.sizes > 0]
        edges[begins] = removed[begins]
        sums, spans = (np.concatenate((np.zeros(1, np.int64), np.cumsum(x))) for x in (removed, edges))
        ends = shelf.starts + shelf.sizes
        ids = docs["doc_id"].astype("Int64").iloc[shelf.order].reset_index(drop=True)
        kept = [shelf.data[a:b][~removed[a:b]].tobytes() for a, b in zip(shelf.starts, ends, strict=True)]
        return pd.DataFrame({"doc_id": ids, "n_bytes": shelf.sizes, "n_removed": sums[ends] - sums[shelf.starts], "n_spans": spans[ends] - spans[shelf.starts], "kept": kept})

    found = shelves.docs.groupBy("shelf").applyInPandas(leads, "shelf int, bucket int, leads binary")
    hits = found.groupBy("bucket").applyInPandas(shared, "shelf int, bucket int, leads binary")
    around = shelves.docs.groupBy("shelf").cogroup(hits.groupBy("shelf")).applyInPandas(surroundings, "shelf int, range int, shapes binary, bytes binary")
    masks = around.groupBy("range").applyInPandas(compare, "shelf int, range int, bits binary")
    both = hits.unionByName(masks, allowMissingColumns=True)
    return shelves.docs.groupBy("shelf").cogroup(both.groupBy("shelf")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
