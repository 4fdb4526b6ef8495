"""Checksums of spans against zlib, and the resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedwake.llm import importance as I
from feedwake.llm.crc import DISTANCES, crc32_spans


@pytest.mark.parametrize("longest", [8, DISTANCES, 5 * DISTANCES, 40_000])
def test_checksums_of_spans(longest):
    draw = random.Random(longest)
    raw = bytes(draw.randrange(256) for _ in range(max(2000, longest)))
    spans = [(a, min(len(raw), a + draw.randint(0, longest))) for a in (draw.randrange(len(raw)) for _ in range(300))]
    spans += [(0, len(raw)), (5, 5), (7, 7 + DISTANCES), (7, 8 + DISTANCES), (0, 2 * DISTANCES)]
    starts, ends = np.array(spans, np.int64).T
    assert crc32_spans(np.frombuffer(raw, np.uint8), starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in spans]
    assert len(crc32_spans(np.frombuffer(raw, np.uint8), starts[:0], ends[:0])) == 0


def plain(rows, target, n, buckets, least, share, seed):
    def grams(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[a : a + k]).encode()) % buckets for k in range(1, n + 1) for a in range(len(words) - k + 1)]

    found = [grams(t) for _, t in rows]
    s, t = Counter(b for _, g in found for b in g), Counter(b for x in target for b in grams(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), (words, g) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: len(order) * share[0] // share[1]])}
    return sorted([(*r[:4], ranks.get(id(r))) for r in out], key=repr)


@pytest.mark.parametrize(("n", "share", "least"), [(1, (10, 100), 20), (1, (1, 1), 0), (3, (1, 2), 5)])
def test_like_a_plain_computation(spark, docs, texts, n, share, least):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = [t for t in texts[20:40]] + [None, ""]
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = I.resample(docs, goal, 500, n, least, share).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows, target, n, 500, least, share, I.SEED)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_features_do_not_depend_on_chunks(texts, monkeypatch, n):
    def counted():
        return Counter((int(o), int(b)) for owner, bucket, _ in I.features(texts, 5000, n) for o, b in zip(owner, bucket, strict=True))

    whole = counted()
    monkeypatch.setattr(I, "CHUNK_BYTES", 40)
    assert counted() == whole


def test_words_and_case(spark):
    docs = spark.createDataFrame([(1, "AÉ b-2_C\x7fé x̂"), (2, "aÉ 2 c é x̂ b")], "doc_id long, text string")
    got = {r.doc_id: r for r in I.resample(docs, docs, least_words=0, share=(1, 1)).collect()}
    assert got[1].n_features == got[2].n_features == 6 and got[1].weight == got[2].weight
    assert sorted(r.rank for r in got.values()) == [1, 2]


def test_nothing(spark, docs, nothing):
    assert I.resample(nothing, docs).collect() == []
    assert {r.rank is None for r in I.resample(docs.where("text is null"), nothing).collect()} == {True}


def test_a_hot_document_is_numbered_in_parts(spark):
    rows = spark.range(30_000).selectExpr("CAST(IF(id % 3 = 0, null, id) AS LONG) AS doc_id", "IF(id % 3 = 0, 'same words of one notice', concat('word', id)) AS text").repartition(8)
    got = I.resample(rows, rows.limit(10), least_words=1, share=(1, 1)).select("rank").collect()
    assert sorted(r.rank for r in got) == list(range(1, 30_001))
