"""Cuts, links and digests against set intersections and overlaps formed pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from feedwake.llm import alignment
from feedwake.llm.alignment_queries import FILES

PATHS = [public_tokenizers.path(f) for f in FILES]
ODD = ["<|endoftext|> and <s>", "a\u2581b", "\u0001\x7f caf\u00e9 \ufb01 \U0001f600\U0001f600", "   many   blanks  ", "x" * 500, "1234567890 " * 30, "\tif (a) {\n\t\treturn;\n}\n", "日本語のテキスト words"]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_and_links_of_random_ends(seed):
    draw = random.Random(seed)
    a, b, a_cuts, b_cuts, base = [], [], [0], [0], 0
    for _ in range(30):
        size = draw.choice([1, 2, 5, 40, 400])
        for ends, cuts, share in ((a, a_cuts, draw.choice([0.02, 0.3, 0.9])), (b, b_cuts, draw.choice([0.02, 0.3, 0.9]))):
            ends += [base + k for k in range(1, size) if draw.random() < share] + [base + size]
            cuts.append(len(ends))
        base += size
    a, b, a_cuts, b_cuts = (np.array(x, np.int64) for x in (a, b, a_cuts, b_cuts))
    last_a, last_b = alignment.shared_cuts(a, b, a_cuts, b_cuts)
    both = set(a.tolist()) & set(b.tolist())
    assert a[last_a].tolist() == b[last_b].tolist() == sorted(both)
    i, j = alignment.links(a, b, last_b)
    spans_a, spans_b = list(zip([0, *a[:-1]], a)), list(zip([0, *b[:-1]], b))
    want = [(x, y) for x, (s, e) in enumerate(spans_a) for y, (t, f) in enumerate(spans_b) if s < f and t < e]
    assert sorted(zip(i.tolist(), j.tolist())) == want and len(want) == len(a) + len(b) - len(both)


def plain(rows):
    """What ``align`` should give, by whole calls of the libraries."""
    codec = alignment.Codecs(*PATHS)
    found, times = [], Counter()
    for doc_id, text in rows:
        a, b = ([], []) if not text else (codec.a.encode(" " + text, add_special_tokens=False).ids, codec.b.encode(text))
        if text and not codec.a_words.join(a) == codec.b_words.join(b) == (" " + text).encode():
            a, b = [], []
        ends = [np.cumsum([0, *[len(v.tokens[k]) for k in ids]]).tolist() for v, ids in ((codec.a_words, a), (codec.b_words, b))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups = [
            ",".join(str(t) for t, e in zip(a, ends[0][1:]) if x < e <= y) + "|" + ",".join(str(t) for t, e in zip(b, ends[1][1:]) if x < e <= y)
            for x, y in zip(shared[:-1], shared[1:])
        ]
        pairs, y = [], 0
        for x in range(len(a)):
            while y and ends[1][y] > ends[0][x]:
                y -= 1
            while y < len(b) and ends[1][y] < ends[0][x + 1]:
                if ends[1][y + 1] > ends[0][x]:
                    pairs.append((a[x], b[y]))
                y += 1
            y = max(0, y - 1)
        times.update(pairs)
        found.append((doc_id, len(a), len(b), groups, pairs))
    highest = defaultdict(int)
    for (_, y), n in times.items():
        highest[y] = max(highest[y], n)
    return [
        (d, n_a, n_b, len(groups), len(pairs), sum(times[p] == highest[p[1]] for p in pairs), sum(times[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for d, n_a, n_b, groups, pairs in found
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_like_a_plain_alignment(spark, docs, nothing):
    odd = spark.createDataFrame([(2000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.select("doc_id", "text", "n_words").unionByName(odd, allowMissingColumns=True).repartition(3)
    rows = [(r.doc_id, r.text) for r in every.select("doc_id", "text").collect()]
    got = alignment.align(every, *PATHS).select(COLUMNS).collect()
    assert sorted([tuple(r) for r in got], key=repr) == sorted(plain(rows), key=repr)
    assert {r.n_a == 0 for r in got if r.doc_id == 2001} == {True}
    assert alignment.align(nothing, *PATHS).collect() == []


def test_ids_by_ranks_are_those_of_the_file(texts):
    codec = alignment.codecs(*PATHS)
    assert codec.ranks
    signs = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xA100), *range(0x1F600, 0x1F650)]]
    for text in [*(t for t in texts + ODD if t), *(f"a{c}b 1{c}2 {c}{c}.{c}\n{c}" for c in signs)]:
        assert codec.ranks.encode_ordinary(text) == codec.a.encode(text, add_special_tokens=False).ids


def test_a_file_with_more_than_ranks_is_read_by_its_library(tmp_path):
    import json

    told = json.load(open(PATHS[0], encoding="utf-8"))
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(told))
    assert alignment.Codecs(str(tmp_path / "other.json"), PATHS[1]).ranks is None


def test_parts_of_long_texts(monkeypatch, texts):
    codec = alignment.codecs(*PATHS)
    whole = [codec.encode(t) for t in texts + ODD]
    monkeypatch.setattr(alignment, "PIECE", 40)
    parts = [codec.encode(t) for t in texts + ODD]
    assert codec.cuts and sum(len(p or ()) for p in parts) > 2 * len(parts)
    for one, many in zip(whole, parts, strict=True):
        assert (one is None) == (many is None)
        if one:
            assert one == [tuple(sum((p[k] for p in many), []) for k in (0, 1))]
    monkeypatch.undo()
    rows = alignment._aligned(codec, texts + ODD)
    monkeypatch.setattr(alignment, "PIECE", 40)
    for x, y in zip(rows, alignment._aligned(codec, texts + ODD), strict=True):
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist()
