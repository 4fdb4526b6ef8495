"""Alignment of two tokenizers over the same bytes: groups between shared cuts, and how often ids are linked in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm.bpe import PIECE, pieces
from feedwake.llm.common import slices
from feedwake.storage import write_table

#: Text bytes that are aligned at once, and of a chunk (documents whose links share one list of distinct pairs).
TEXTS, CHUNK_BYTES = 1 << 18, 8 << 20
BLANK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Bytes, lengths and decimal digits of each id."""

    tokens: list[bytes]
    sizes: np.ndarray
    digits: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        width = len(str(len(tokens)))
        text = np.array([str(k).encode() for k in range(len(tokens))], dtype=f"S{width + 1}")
        return cls(tokens, np.array([len(t) for t in tokens], np.int64), text.view(np.uint8).reshape(len(tokens), width + 1))

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[k] for k in ids])


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


#: How a byte-level pre-tokenizer splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def by_rank(path: str, tokens: dict[bytes, int]):
    """The tiktoken encoder of a byte-level BPE file, a few times faster than the file's own library; None if the file asks for more than ranks.

    Merges must be numbered in order after the single bytes, so that an id is a rank, and nothing may change the text before the split.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told["pre_tokenizer"] or {}
    whole = [b"".join(b) for b in ([m.encode() for m in (pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"])]
    names = {t.encode(): k for t, k in model["vocab"].items()}
    plain = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or odd or len(tokens) != 256 + len(whole) or any(names.get(t) != 256 + k for k, t in enumerate(whole)):
        return None
    return tiktoken.Encoding("local", pat_str=SPLIT, mergeable_ranks=tokens, special_tokens={})


class Codecs:
    """Both tokenizers: a byte-level BPE file of the tokenizers library (A) and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back, special = byte_characters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        by_id = {k: bytes(back[c] for c in token) for token, k in self.a.get_vocab(with_added_tokens=False).items() if token not in special}
        self.a_words = Vocabulary.of([by_id.get(k, b"") for k in range(max(by_id) + 1)])
        self.ranks = by_rank(path_a, {token: k for k, token in by_id.items()})
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_words = Vocabulary.of([bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else t.replace(BLANK, " ").encode() for k, t in enumerate(names)])
        #: A text may be cut before a blank if no piece holds a blank after another character.
        self.cuts = not any(BLANK in t.lstrip(BLANK) for t in names)

    def encode(self, text: str | None) -> list[tuple[list[int], list[int]]] | None:
        """Ids of both for each part of a blank and the text; None for an empty text and if either gives other bytes.

        Parts are cut before a single blank between letters or digits, where tokens of both end; the blank that B puts before
        a text stands for the one a part begins with.
        """
        if not text:
            return None
        parts = []
        for piece in pieces(" " + text, PIECE) if self.cuts else [" " + text]:
            a = self.ranks.encode_ordinary(piece) if self.ranks else self.a.encode(piece, add_special_tokens=False).ids
            b = self.b.encode(piece[1:])
            raw = piece.encode()
            if self.a_words.join(a) != raw or self.b_words.join(b) != raw:
                return None
            parts.append((a, b))
        return parts


@lru_cache(maxsize=2)
def codecs(path_a: str, path_b: str) -> Codecs:
    return Codecs(path_a, path_b)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and of B are the last of a group, by halving at shared cuts.

    ``a`` and ``b`` are increasing ends of tokens; interval k holds tokens ``a_cuts[k]:a_cuts[k + 1]`` and ``b_cuts[k]:b_cuts[k + 1]``, whose
    last ends agree. Of an open interval the ends of A are looked up in those of B by bisection, from the middle outwards in rings of
    twice the width; it is split at the shared end that is nearest to the middle, and both halves go on. One without any is a group.
    All open intervals take each step together.
    """
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[a_cuts[1:] - 1] = last_b[b_cuts[1:] - 1] = True
    x0, x1, y0, y1 = a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]
    far = np.iinfo(np.int64).max
    while True:
        wide = (x1 - x0 > 1) & (y1 - y0 > 1)
        x0, x1, y0, y1 = x0[wide], x1[wide], y0[wide], y1[wide]
        if not len(x0):
            return last_a, last_b
        middle = (x0 + x1 - 2) >> 1
        reach = np.maximum(middle - x0, x1 - 2 - middle)
        best, place = np.full(len(x0), far), np.full(len(x0), -1)
        open_, near, until = np.arange(len(x0)), 0, 0
        while len(open_):
            mid = middle[open_]
            low, high = np.maximum(x0[open_], mid - until), np.minimum(x1[open_] - 2, mid + until)
            begins, ends = [low, mid + near], [mid - near, high]
            if not near:
                begins, ends = begins[:1], [mid]
            begin, owner = np.concatenate(begins), np.tile(open_, len(begins))
            count = np.maximum(np.concatenate(ends) - begin + 1, 0)
            tried = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner = np.repeat(owner, count)
            found = np.searchsorted(b, a[tried])
            hit = b[found] == a[tried]
            tried, owner, found = tried[hit], owner[hit], found[hit]
            away = 2 * np.abs(tried - middle[owner]) + (tried > middle[owner])
            np.minimum.at(best, owner, away)
            nearest = best[owner] == away
            place[owner[nearest]] = found[nearest]
            open_ = open_[(best[open_] == far) & (reach[open_] > until)]
            near, until = until + 1, 2 * until + 1
        cut = np.flatnonzero(best < far)
        at = middle[cut] + np.where(best[cut] & 1, best[cut] >> 1, -(best[cut] >> 1))
        last_a[at] = last_b[place[cut]] = True
        x0, x1 = np.r_[x0[cut], at + 1], np.r_[at + 1, x1[cut]]
        y0, y1 = np.r_[y0[cut], place[cut] + 1], np.r_[place[cut] + 1, y1[cut]]


def links(a: np.ndarray, b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, ordered by the end of the overlap: each end of either side closes exactly one."""
    alone = np.flatnonzero(~last_b)
    i = np.r_[np.arange(len(a)), np.searchsorted(a, b[alone])]
    j = np.r_[np.searchsorted(b, a), alone]
    order = np.argsort(np.r_[a, b[alone]], kind="stable")
    return i[order], j[order]


def written(a_ids: np.ndarray, b_ids: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, words_a: Vocabulary, words_b: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Groups as ``a1,a2|b1;a3|b2,b3;`` in one array of bytes, and the place in it after each group."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    begins_b = np.r_[0, ends_b[:-1]]
    width = max(words_a.digits.shape[1], words_b.digits.shape[1])
    rows = np.zeros((len(a_ids) + len(b_ids), width), np.uint8)
    place_a, place_b = np.arange(len(a_ids)) + begins_b[group_a], np.arange(len(b_ids)) + ends_a[group_b]
    rows[place_a, : words_a.digits.shape[1]] = words_a.digits[a_ids]
    rows[place_b, : words_b.digits.shape[1]] = words_b.digits[b_ids]
    digits = np.count_nonzero(rows, axis=1)
    rows[np.arange(len(rows)), digits] = ord(",")
    closing = ends_a + begins_b - 1, ends_a + ends_b - 1
    rows[closing[0], digits[closing[0]]], rows[closing[1], digits[closing[1]]] = ord("|"), ord(";")
    return rows[rows > 0], np.cumsum(digits + 1)[closing[1]]


_COLUMNS = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "codes", "times"]
_SCHEMA = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, codes array<long>, times array<long>"


def _aligned(codec: Codecs, texts: list) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, codes of the links) of each text."""
    encoded = [codec.encode(t) for t in texts]
    parts = [p for e in encoded if e for p in e]
    out: list[tuple] = [(0, 0, 0, 0, "", np.empty(0, np.int64))] * len(texts)
    if not parts:
        return out
    a_ids, b_ids = (np.concatenate([np.array(p[k], np.int64) for p in parts]) for k in (0, 1))
    a_cuts, b_cuts = (np.cumsum([0, *[len(p[k]) for p in parts]]) for k in (0, 1))
    a, b = np.cumsum(codec.a_words.sizes[a_ids]), np.cumsum(codec.b_words.sizes[b_ids])
    last_a, last_b = shared_cuts(a, b, a_cuts, b_cuts)
    i, j = links(a, b, last_b)
    codes = a_ids[i] * len(codec.b_words.tokens) + b_ids[j]
    flat, group_ends = written(a_ids, b_ids, last_a, last_b, codec.a_words, codec.b_words)
    groups = np.cumsum(last_a)
    part = 0
    for k, e in enumerate(encoded):
        if not e:
            continue
        a0, b0, a1, b1 = a_cuts[part], b_cuts[part], a_cuts[part + len(e)], b_cuts[part + len(e)]
        g0, g1 = groups[a0 - 1] if a0 else 0, groups[a1 - 1]
        begin = group_ends[g0 - 1] if g0 else 0
        digest = hashlib.sha256(flat[begin : group_ends[g1 - 1] - 1]).hexdigest()
        first, stop = a0 + b0 - g0, a1 + b1 - g1  # a link closes at each end, and a shared one closes one
        out[k] = (a1 - a0, b1 - b0, g1 - g0, stop - first, digest, codes[first:stop])
        part += len(e)
    return out


def _chunk(number: int, ids: list, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a chunk: its distinct pairs (codes, times), then each document with the places of its links in that list."""
    codes, place, times = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
    place, cuts = place.astype("<i4"), np.cumsum([0, *[len(r[5]) for r in rows]])
    packed = [place[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    numbers = [pa.array([None, *[int(r[k]) for r in rows]], pa.int64()) for k in range(4)]
    lists = [pa.array([v, *[None] * len(rows)], pa.list_(pa.int64())) for v in (codes, times)]
    columns = [pa.array([number] * (len(rows) + 1), pa.int64()), pa.array([None, *ids], pa.int64()), *numbers]
    return pa.RecordBatch.from_arrays([*columns, pa.array([None, *[r[4] for r in rows]], pa.string()), pa.array([None, *packed], pa.binary()), *lists], names=_COLUMNS)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens, groups and links of each document, in chunks (see ``_chunk``); rows of a chunk's pairs have ``codes``."""

    def run(batches):
        codec = codecs(path_a, path_b)
        number, ids, rows, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in slices(batch, most=TEXTS):
                texts = part.column("text").to_pylist()
                ids += part.column("doc_id").to_pylist()
                rows += _aligned(codec, texts)
                held += sum(len(t or "") for t in texts)
                if held >= CHUNK_BYTES:
                    yield _chunk(number, ids, rows)
                    number, ids, rows, held = number + 1, [], [], 0
        if rows:
            yield _chunk(number, ids, rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of each row of ``docs``.

    Tokenizer A encodes a blank and the text, B the text, before which it puts the blank; special tokens are ordinary text. Byte
    offsets where tokens of both end cut them into groups. A link is a pair of tokens whose bytes overlap; the count of an id pair is
    the number of links in all documents that hold it. ``n_best`` are links whose count is the highest of their B id, ``count_sum``
    sums the counts of a document's links; the digest is that of the groups (``a1,a2|b1;a3|b2``).

    Null and empty texts and ones whose tokens give other bytes have no tokens: zeros and an empty digest. Rows are
    independent, so repeated rows count as often as they occur; a null doc_id stays; other columns are not read; an empty table
    gives an empty result.

    Each document is tokenised once and its links are written as places in the list of its chunk's distinct pairs. Only these
    lists are joined with the counts, one row for each chunk and pair, so a pair that half of all links hold is one row a chunk.
    """
    table = write_table(aligned(docs, path_a, path_b))
    entries = table.where("codes IS NOT NULL").select(F.col("chunk").alias("part"), F.posexplode(F.arrays_zip("codes", "times")).alias("place", "pair"))
    entries = entries.select("part", "place", F.col("pair.codes").alias("code"), F.col("pair.times").alias("times"))
    width = len(codecs(path_a, path_b).b_words.tokens)
    counts = write_table(entries.groupBy("code").agg(F.sum("times").alias("n")).withColumn("b", F.col("code") % width))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    marked = counts.join(highest, "b").select("code", "n", (F.col("n") == F.col("highest")).alias("best"))
    priced = entries.select("part", "place", "code").join(marked, "code").select("part", "place", "n", "best")

    def total(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        n[pairs["place"]], best[pairs["place"]] = pairs["n"], pairs["best"]
        places = [np.frombuffer(blob, "<i4") for blob in rows["links"]]
        sums = {"n_best": [int(best[p].sum()) for p in places], "count_sum": [int(n[p].sum()) for p in places]}
        return rows.drop(columns=["chunk", "links"]).astype({"doc_id": "Int64"}).assign(**sums)

    rows = table.where("links IS NOT NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("chunk").cogroup(priced.groupBy("part")).applyInPandas(total, schema)
