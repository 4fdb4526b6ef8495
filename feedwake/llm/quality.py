"""Repetition coverage: how much of a text lies in n-grams and lines that occur in it more than once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from feedwake.llm.common import ODD, covered, encoded, mix, slices, word_hashes

#: Largest share of characters inside repeated n-grams of n words, and in the most frequent n-gram for the short ones.
REPEATED_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of lines, and of characters, in lines that equal an earlier one.
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
#: Base rules.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"top_{n}_chars long" for n in TOP_SHARE) + ", " + ", ".join(f"repeat_{n}_chars long" for n in REPEATED_SHARE) + ", n_lines long, dup_line_chars long"
)
_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)]) if n else np.empty(0, np.uint64)


class _Rolling:
    """Prefix sums of h[i] * B**i, from which the hash of any run of words follows in two operations."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.prefix = np.r_[np.uint64(0), np.cumsum(hashes * _powers(ODD, n), dtype=np.uint64)]
        self.inverse = _powers(_INVERSE, n)

    def of(self, n: int) -> np.ndarray:
        m = max(0, len(self.inverse) - n + 1)
        return mix((self.prefix[n:] - self.prefix[:m]) * self.inverse[:m]) if m else np.empty(0, np.uint64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how often it occurs and whether it occurred before."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    count = np.diff(np.r_[np.flatnonzero(fresh), len(keys)])
    times, again = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    times[order] = count[np.cumsum(fresh) - 1]
    again[order] = ~fresh
    return times, again


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: how many, how many equal an earlier one, and the characters of those."""
    total, again, chars = (np.zeros(len(texts), np.int64) for _ in range(3))
    for row, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line and not line.isspace():
                total[row] += 1
                if line in seen:
                    again[row] += 1
                    chars[row] += len(line.decode())
                else:
                    seen.add(line)
    return total, again, chars


def measure(ids: pd.Series, raw) -> pd.DataFrame:
    """The columns of ``SCHEMA`` for some texts at once."""
    texts = encoded(raw)
    rows = len(texts)
    hashes, owner, starts, ends, _ = word_hashes(texts)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    heads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = heads[ends] - heads[starts]
    n_words = np.bincount(owner, minlength=rows)
    word_chars = np.bincount(owner, weights=chars, minlength=rows).astype(np.int64)
    rolling = _Rolling(hashes)
    before = np.r_[0, np.cumsum(chars)]
    own = mix(owner.astype(np.uint64) * ODD)

    out: dict[str, np.ndarray] = {}
    failed = np.zeros(rows, bool)
    size = np.maximum(word_chars, 1)
    at = np.flatnonzero(owner[:-1] == owner[1:])  # starts of pairs within one text
    for n in sorted({*TOP_SHARE, *REPEATED_SHARE}):
        times = _groups(rolling.of(n)[at] + own[at])[0]
        at, times = at[times > 1], times[times > 1]
        if n in TOP_SHARE:
            top = np.zeros(rows, np.int64)
            np.maximum.at(top, owner[at], times * (before[at + n] - before[at]))
            out[f"top_{n}_chars"] = top = np.minimum(top, word_chars)
            failed |= top > TOP_SHARE[n] * size
        if n in REPEATED_SHARE:
            inside = covered(at, n, len(hashes))
            held = np.bincount(owner[inside], weights=chars[inside], minlength=rows).astype(np.int64)
            out[f"repeat_{n}_chars"] = held
            failed |= held > REPEATED_SHARE[n] * size
            if n == WINDOW:
                out["n_repeat_words"] = np.bincount(owner[inside], minlength=rows)
        # a longer run can only occur twice if the runs at its first two words do
        at = at[:-1][np.diff(at) == 1]
        at = at[owner[np.minimum(at + n, len(hashes) - 1)] == owner[at]]
    n_lines, dup_lines, dup_chars = _lines(texts)
    n_chars = np.array([len(t) if isinstance(t, str) else 0 for t in raw], np.int64)
    failed |= (dup_lines > LINE_SHARE * np.maximum(n_lines, 1)) | (dup_chars > LINE_CHAR_SHARE * np.maximum(n_chars, 1))
    base_failed = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n_words)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    out |= {"doc_id": ids, "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "base_failed": base_failed, "kept": ~base_failed & ~failed, "n_lines": n_lines, "dup_line_chars": dup_chars}
    return pd.DataFrame(out)


def repetition(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    A null text has no words: zero counts, ``base_failed`` true. Repeated rows give repeated results and an empty table an
    empty one; a null doc_id stays null. ``kept`` is false if the base rules fail or a share goes beyond its threshold; shares
    are of the characters in words, for lines of all characters. Several texts are measured in one pass; a text of any
    length is measured whole.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = measure(part.column("doc_id").to_pandas(), part.column("text").to_pylist())
                found["doc_id"] = found["doc_id"].astype("Int64")
                yield pa.RecordBatch.from_pandas(found[names], preserve_index=False)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
