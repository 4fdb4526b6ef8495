"""Query of the piecewise hashes: each document against its edited text and against the next document."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwake.llm import ctph
from feedwake.llm.common import Shelves, read

#: Rows (a number and a shelf) that may be broadcast.
SENT_ROWS = 500_000
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Compare neighbours in descending doc_id (rows without one last, equal ids by text; after the last row the first).

    Documents lie in shelves of the doc_id order. Each shelf gets one guest: the first document of the shelf that follows it. The
    driver sees one doc_id for each shelf.
    """
    shelves = Shelves(docs)
    heads = [(r[0], r[1]) for r in shelves.docs.groupBy("shelf").agg(F.max("doc_id")).collect()]
    order = sorted(heads, key=lambda h: (h[1] is not None, h[0]), reverse=True)
    follows = [(after[1], before[0]) for before, after in zip(order, order[1:] + order[:1], strict=True)]
    home = docs.sparkSession.createDataFrame(follows, "head long, goes_to int")
    # one small row a shelf: sent to the tasks up to a checked number of shelves, so that texts need not move for this join
    home = F.broadcast(home) if len(follows) <= SENT_ROWS else home
    guests = docs.select("doc_id", F.col("text").alias("next_text")).join(home, F.col("doc_id").eqNullSafe(F.col("head"))).select("goes_to", "next_text")

    def compare(own: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")})
        own = own.assign(text=own["text"].fillna(""), doc_id=own["doc_id"].astype("Int64"))
        own = own.sort_values(["doc_id", "text"], ascending=False, na_position="last", kind="stable").reset_index(drop=True)
        texts = [*own["text"], max((t or "" for t in guest["next_text"]), default="")]
        changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
        prints, new = [ctph.fingerprint(t) for t in texts], [ctph.fingerprint(t) for t in changed]
        return pd.DataFrame({
            "doc_id": own["doc_id"], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": prints[:-1], "edited_fingerprint": new, "near_edited": ctph.likeness(prints[:-1], new), "near_next": ctph.likeness(prints[:-1], prints[1:]),
        })

    return shelves.docs.groupBy("shelf").cogroup(guests.groupBy("goes_to")).applyInPandas(compare, SCHEMA)


def _ctph(spark, folder):
    return with_next(read(spark, folder, "documents"))


QUERIES = {"op9_ctph": _ctph}
SQL: dict[str, str] = {}
