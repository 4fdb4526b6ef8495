"""Byte-level BPE with a local rank file, by the tiktoken library."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from feedwake.llm.common import release, slices

#: Characters of a text that are encoded in one call.
PIECE = 1 << 16
#: Between these two characters no match of the usual split patterns goes on: they match a blank only at their start.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder of a rank file (a line: base64 of the token, blank, rank); kept for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut only where no match of the pattern crosses.

    The cut is before a single blank between letters or digits. A stretch without such a place stays whole.
    """
    begin = 0
    while len(text) - begin > size:
        found = SAFE.search(text, begin + size)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``ids`` (array of int): the ranks of each whole text, without special tokens.

    ``docs`` needs a ``text`` column; other columns pass through, and an ``ids`` column that was there is replaced. A null or
    empty text has no ids. Texts are encoded in pieces, so a very long one needs no long call; rows are independent, repeated
    rows give repeated results, an empty table an empty one.
    """
    kept = docs.drop("ids")

    def run(batches):
        codec = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                ids, ends = [np.empty(0, np.uint32)], [0]
                for text in part.column("text"):
                    for piece in pieces(text.as_py() or ""):
                        ids.append(codec.encode_to_numpy(piece, disallowed_special=()))
                        ends[-1] += len(ids[-1])
                    ends.append(ends[-1])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                column = pa.ListArray.from_arrays(pa.array([0, *ends[:-1]], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "ids"])
                ids = flat = column = None  # not held while the next part is formed
        release()

    return kept.mapInArrow(run, _with(kept, "ids array<int>"))


def decoded(codec, ids: pa.Array) -> bytes:
    """Bytes of the ids, a slice at a time: as Python numbers the ids of a very long text take many times their room."""
    return b"".join(codec.decode_bytes(ids.slice(at, PIECE).to_pylist()) for at in range(0, len(ids), PIECE))


def round_trip(docs: DataFrame, path: str, pattern: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them) with ``ids`` as :func:`encode` and ``bytes`` as :func:`decode`, by one worker a task instead of one for each step."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "bytes")]
    kept = docs.select(*dict.fromkeys([*names, "text"]))

    def run(batches):
        codec = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                ids, ends, raw = [np.empty(0, np.uint32)], [0], []
                for text in part.column("text"):
                    parts = [codec.encode_to_numpy(piece, disallowed_special=()) for piece in pieces(text.as_py() or "")]
                    raw.append(b"".join(codec.decode_bytes(p.tolist()) for p in parts))
                    ids += parts
                    ends.append(ends[-1] + sum(map(len, parts)))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), column, pa.array(raw, pa.binary())], names=[*names, "ids", "bytes"])
                ids = raw = column = None  # not held while the next part is formed
        release()

    return kept.mapInArrow(run, _with(kept.select(*names), "ids array<int>, bytes binary"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``bytes`` (binary): the raw bytes of ``ids``, which need not be valid UTF-8. Null ids give null; an empty array no bytes."""
    kept = encoded.drop("bytes")

    def run(batches):
        codec = encoding(path, pattern)
        for batch in batches:
            for part in slices(batch, "ids", most=1 << 18):
                out = [decoded(codec, row.values) if row.is_valid else None for row in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "bytes"])
                out = None  # not held while the next part is formed
        release()

    return kept.mapInArrow(run, _with(kept, "bytes binary"))


def _with(df: DataFrame, column: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, column])
