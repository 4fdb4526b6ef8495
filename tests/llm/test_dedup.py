"""Fingerprints, components, passages and suffixes against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from feedwake.llm import components, simhash, substring, suffixes


def by_definition(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    got = sorted(((r.doc_id, r.bits % (1 << 64)) for r in simhash.fingerprints(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, by_definition(r.text)) for r in docs.collect()), key=repr)


def plain_components(bits, near=4):
    bits = np.array(bits, np.uint64)
    label = list(range(len(bits)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits[:k] ^ bits[k]) <= near):
            a, b = find(k), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(bits))]


def groups(keys, labels):
    out = defaultdict(set)
    for key, label in zip(keys, labels, strict=True):
        out[label].add(key)
    return sorted(map(sorted, out.values()))


def test_near_duplicates(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    bits = [r.bits % (1 << 64) for r in rows]
    labels = plain_components(bits)
    lowest = {}
    for r, label in zip(rows, labels, strict=True):
        if r.doc_id is not None:
            lowest[label] = min(lowest.get(label, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [lowest.get(label) for label in labels]
    assert len(rows) == docs.count()
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize(("part", "largest"), [(20000, 100000), (50, 40), (1000, 7)])
def test_links_join_all_near_fingerprints(spark, part, largest):
    """Random ones, chains, a dense group around one centre, and bits near both ends of every mask; small blocks must change nothing."""
    draw = random.Random(4)
    values = {draw.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in list(values)[:20]:
        values |= {centre ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(6)}
    centre = draw.getrandbits(64)
    values |= {centre ^ sum({1 << draw.randrange(64) for _ in range(5)}) for _ in range(200)}
    values = sorted(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long").repartition(3)
    roots = {r.node % (1 << 64): r.root for r in components.components(simhash.links(nodes, part=part, largest=largest)).collect()}
    assert groups(values, [roots.get(v, v - (1 << 64) if v >> 63 else v) for v in values]) == groups(values, plain_components(values))


def test_components_of_a_path_a_star_and_a_loop(spark):
    draw = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(400, 401), (401, 402), (402, 400), (500, 500)]
    draw.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7} | {k: 7 for k in range(200, 300)} | {400: 400, 401: 400, 402: 400}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def order(key):
    return (key is None, key or 0)


def words_removed(rows, n=13):
    first = {}
    for key, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k : k + n])
            first[gram] = min(first.get(gram, (True, 1 << 62)), order(key))
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        gone = {k + j for k in range(len(words) - n + 1) if first[tuple(words[k : k + n])] < order(key) for j in range(n)}
        out.append((key, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shelf_bytes", [None, 2000])
def test_repeated_passages(docs, nothing, shelf_bytes):
    got = sorted((tuple(r) for r in substring.remove_repeats(docs, shelf_bytes).collect()), key=repr)
    want = words_removed([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and sum(r[2] for r in want) > 100
    assert substring.remove_repeats(nothing, shelf_bytes).collect() == []


def test_layout_stays_where_nothing_goes(spark):
    text = "  a  b\n" + " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, text, "en"), (2, "x  y " + " ".join(f"w{k}" for k in range(30)), "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.kept_text, r.lang) for r in substring.remove_repeats(rows, keep=["lang"], keep_layout=True).collect()}
    assert got == {1: (text, "en"), 2: ("x y", "de")}


def bytes_removed(rows, n=100):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (order(r[0]), (r[1] or "").encode())):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - n + 1):
            if data[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            else:
                seen.add(data[k : k + n])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((key, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shelf_bytes", [None, 4000])
def test_repeated_strings(docs, nothing, shelf_bytes):
    got = sorted(((*r[:4], bytes(r[4])) for r in suffixes.remove_repeats(docs, shelf_bytes).collect()), key=repr)
    want = bytes_removed([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and sum(r[2] for r in want) > 1000
    assert suffixes.remove_repeats(nothing, shelf_bytes).collect() == []


def test_multikey_quicksort():
    draw = np.random.default_rng(1)
    tokens = draw.integers(0, 3, (500, 6)).astype(np.uint64)
    ordered = tokens[suffixes._refine(tokens)].tolist()
    assert ordered == sorted(tokens.tolist())
