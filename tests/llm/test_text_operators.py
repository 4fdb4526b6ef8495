"""Tokens, repetition and piecewise hashes against plain definitions."""

import hashlib
import random
import re

import public_tokenizers
import pytest

from feedwake.llm import bpe, bpe_queries, ctph, ctph_queries, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    return bpe.encoding(public_tokenizers.path(bpe_queries.RANKS), public_tokenizers.PATTERN).encode_ordinary(text or "")


def test_bpe_equals_the_library_and_round_trips(docs, nothing):
    got = [tuple(r) for r in bpe_queries.digests(docs).collect()]
    want = []
    for r in docs.collect():
        ids = ids_of(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe_queries.digests(nothing).collect() == []


def test_both_ways_in_one_pass(docs, nothing):
    path, pattern = public_tokenizers.path(bpe_queries.RANKS), public_tokenizers.PATTERN
    kept = docs.withColumn("bytes", docs.n_words)
    both = bpe.round_trip(kept, path, pattern, ["doc_id", "n_words"])
    assert both.columns == ["doc_id", "n_words", "ids", "bytes"] and "text" in bpe.round_trip(docs, path, pattern).columns
    got = [(r.doc_id, r.n_words, r.ids, bytes(r.bytes)) for r in both.collect()]
    want = [(r.doc_id, r.n_words, ids_of(r.text), (r.text or "").encode()) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(nothing, path, pattern).collect() == []


@pytest.mark.parametrize("text", ["a b " * 40000 + "x" * 70000 + " 12 34" * 20000, " " * 100000 + "ab " * 50000, "\n\n a's don't 12" * 9000, "", "no-place" * 20000])
def test_pieces_change_no_token(text):
    parts = list(bpe.pieces(text, 5000))
    assert "".join(parts) == text
    assert [i for p in parts for i in ids_of(p)] == ids_of(text)


def test_decode_of_raw_bytes(spark):
    path, pattern = public_tokenizers.path(bpe_queries.RANKS), public_tokenizers.PATTERN
    codec = bpe.encoding(path, pattern)
    half = codec.encode_ordinary("é")  # its bytes may be split between tokens
    rows = spark.createDataFrame([(half[:1],), ([],), (None,)], "ids array<int>")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in bpe.decode(rows, path, pattern).select("bytes").collect()] == [codec.decode_bytes(half[:1]), b"", None]


def by_definition(text):
    words = WORD.findall(text or "")
    total = sum(map(len, words))

    def inside(n):
        seen = {}
        for k in range(len(words) - n + 1):
            seen.setdefault(tuple(words[k : k + n]), []).append(k)
        places = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(n)}
        top = max((len(at) * sum(len(w) for w in gram) for gram, at in seen.items() if len(at) > 1), default=0)
        return len(places), sum(len(words[k]) for k in places), min(top, total)

    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    out = {"n_words": len(words), "word_chars": total, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(again), "n_repeat_words": inside(5)[0]}
    out |= {f"top_{n}_chars": inside(n)[2] for n in (2, 3, 4)} | {f"repeat_{n}_chars": inside(n)[1] for n in range(5, 11)}
    out |= {"n_lines": len(lines), "dup_line_chars": sum(map(len, again))}
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    shares = [out[f"top_{n}_chars"] > s * max(1, total) for n, s in quality.TOP_SHARE.items()] + [out[f"repeat_{n}_chars"] > s * max(1, total) for n, s in quality.REPEATED_SHARE.items()]
    out["kept"] = not out["base_failed"] and not any(shares) and len(again) <= 0.3 * max(1, len(lines)) and out["dup_line_chars"] <= 0.2 * max(1, len(text or ""))
    return out


def test_repetition_equals_its_definition(docs, nothing):
    got = sorted((r.asDict() for r in quality.repetition(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        want.append({"doc_id": r.doc_id} | by_definition(r.text))
    names = list(got[0])
    assert got == sorted(({n: w[n] for n in names} for w in want), key=repr)
    assert quality.repetition(nothing).collect() == []


def test_repetition_rejects_what_repeats(spark):
    line = "one two three four five six seven eight nine ten\n"
    rows = spark.createDataFrame([(1, line * 9), (2, " ".join(f"w{k}" for k in range(200))), (3, "$$ " * 40)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.repetition(rows).collect()} == {1: False, 2: True, 3: False}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances():
    draw = random.Random(1)
    left, right = [], []
    for _ in range(200):
        a = [draw.choice("ABC") + "A" for _ in range(draw.choice([0, 1, 2, 40, 63, 64]))]
        b = list(a) if draw.random() < 0.5 else [draw.choice("ABC") + "A" for _ in range(draw.choice([0, 1, 5, 64]))]
        for _ in range(draw.randint(0, 5)):
            if b:
                b[draw.randrange(len(b))] = "QQ"
        left.append("".join(a))
        right.append("".join(b))
    pairs = [([a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]) for a, b in zip(left, right, strict=True)]
    assert ctph.edit_distances(left, right).tolist() == [plain_distance(a, b) for a, b in pairs]


def test_fingerprints_follow_the_text():
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    other = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(4000))
    changed = text[:9000] + "!" + text[9000:]
    prints = [ctph.fingerprint(t) for t in (text, text, changed, other, None, "", "a" * 3000000)]
    assert prints[0] == prints[1] and prints[4] == prints[5]
    near = ctph.likeness([prints[0]] * 4, [prints[1], prints[2], prints[3], prints[4]])
    assert near[0] == 1 and near[1] > 0.9 and near[2] < 0.1 and near[3] == 0
    assert all(len(part) <= 2 * ctph.SIGNS for p in prints for part in p.split(":")[1:])


@pytest.mark.parametrize("shelf_bytes", [None, 3000])
def test_neighbours_in_descending_order(docs, nothing, shelf_bytes, monkeypatch):
    if shelf_bytes:
        monkeypatch.setattr("feedwake.llm.common.SHELF_BYTES", shelf_bytes)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = ctph_queries.edited(text, after)
        a, b, c = map(ctph.fingerprint, (text, changed, after))
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, float(ctph.likeness([a], [b])[0]), float(ctph.likeness([a], [c])[0])))
    got = [tuple(r) for r in ctph_queries.with_next(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ctph_queries.with_next(nothing).collect() == []


def plain_fingerprint(text):
    """The fingerprint byte by byte: cuts, forced ends, signs and the level, each from its definition."""
    data, full = (text or "").encode(), 1 << 64
    step = 0x9E3779B97F4A7C15
    if not data:
        return "0:::"

    def scrambled(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % full
        return x ^ (x >> 31)

    zeros = []  # high zero bits of the rolling hash after each byte
    window = bytes(8)
    for byte in data:
        window = window[1:] + bytes([byte])
        zeros.append(64 - (int.from_bytes(window, "little") * step % full).bit_length() if any(window) else -1)

    def chunks(level):
        out, begin = [], 0
        for end in range(1, len(data) + 1):
            if end == len(data) or zeros[end - 1] >= level:
                while end - begin > ctph.LONGEST << level:
                    out.append((begin, begin + (ctph.LONGEST << level)))
                    begin += ctph.LONGEST << level
                out.append((begin, end))
                begin = end
        return out

    def sign(begin, end):
        held = sum((data[k] + 1) * pow(step, k - begin, full) for k in range(begin, end))
        bits = scrambled((held + end - begin) % full) >> 52
        return ctph.ALPHABET[bits >> 6] + ctph.ALPHABET[bits & 63]

    lowest = max(0, -(-len(data) // ctph.EXPECTED) - 1).bit_length()
    level = next(k for k in range(lowest, 64) if len(chunks(k)) <= ctph.SIGNS)
    return f"{level}:" + ":".join("".join(sign(*c) for c in chunks(k)) for k in range(level, level + ctph.SIGNATURES))


def test_fingerprints_byte_by_byte(texts):
    draw = random.Random(21)
    more = ["".join(chr(draw.choice([32, 97, 98, 99, 233, 8364])) for _ in range(n)) for n in (1, 7, 8, 9, 44, 45, 46, 200, 1500, 4000)]
    for text in [t for t in texts if t is None or len(t) < 13_000] + more + ["ab" * 900, "\x00" * 300]:
        assert ctph.fingerprint(text) == plain_fingerprint(text)
