"""Toxicity, URL models, mixing, fixity and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedwake.llm import fixity, mixing, toxicity, toxicity_queries, urls, urls_queries

BAD = ["dreadful", "wretched", "vilest", "loathsome"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Invented words; a third of the texts hold bad ones."""
    draw = random.Random(6)
    parts = ["ta", "lo", "mi", "ren", "su", "vek", "or", "an", "ist", "ed"]

    def text(bad):
        words = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(60, 200))]
        for k in range(0, len(words), 20 if bad else len(words) + 1):
            words[k] = draw.choice(BAD) if bad else words[k]
        return " ".join(words)

    rows = [(k, text(k % 3 == 0), int(k % 3 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t, _ in rows] + [(9000, None, "en", None, 0), (9001, "", "en", "s1", 0), (None, "x", "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_on_texts_it_has_not_seen(labelled):
    docs, labels = labelled
    model = toxicity_queries.fitted(docs, labels)
    found = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [(r.score >= 0.5, r.doc_id % 3 == 0) for r in found if r.held and r.doc_id < 9000]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r.score for r in found if r.doc_id in (9000, 9001)}
    assert odd[9000] == odd[9001] < 0.5
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity_queries.fitted(docs, labels) == model


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.limit(0)).score("any") == 0.0
    assert toxicity.fit(docs, labels.where("toxic = 1")).score("any") == 1.0


URLS = [
    (1, "http://a.COM/x", "a.com", "/x", "com/", "allow"), (2, "https://example.com/en/1?q#f", "example.com", "/en/1", "example.com/en/", "block"),
    (3, "https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (4, "http://m.b.net/es/?x=://c.com/", "m.b.net", "/es/", "net/es/", "block"),
    (5, "http://xnet/es/", "xnet", "/es/", None, None), (6, "http://a.com", "a.com", "", None, None), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None),
    (9, "x://É.Com?a/b", "É.com", "", None, None), (10, "://net/fr/", "net", "/fr/", "net/fr/", "block"), (10, "://net/fr/", "net", "/fr/", "net/fr/", "block"), (None, "", "", "", None, None),
    (11, "http://h.org/" + "z" * 20000, "h.org", "/" + "z" * 20000, None, None),
]


def test_url_rules_and_odd_rows(spark):
    pages = spark.createDataFrame([(p, u, "clash") for p, u, *_ in URLS], "page_id long, url string, verdict string")
    got = urls.judge(pages, urls_queries.RULES).collect()
    assert sorted([(r.page_id, r.host, r.path, r.rule) for r in got], key=repr) == sorted([(p, h, q, rule) for p, _, h, q, rule, _ in URLS], key=repr)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert {(r.page_id, r.verdict) for r in got if r.rule} == {(p, v) for p, *_, rule, v in URLS if rule}
    assert urls.judge(pages.limit(0), urls_queries.RULES).collect() == []


def test_url_models_learn_what_rules_reject(spark):
    draw = random.Random(7)
    rows = []
    for k in range(600):
        bad = k % 2
        name = "".join(draw.choice(["win", "bet", "spin"] if bad else ["read", "news", "book"]) for _ in range(3))
        rows.append((k, f"http://{name}.{('net/es' if bad else 'com') if k < 400 else 'org'}/{draw.randrange(100)}"))
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), urls_queries.RULES).collect()}
    assert np.mean([(got[k] == "block") == bool(k % 2) for k in range(400, 600)]) > 0.9


def test_flight_keeps_totals_and_leaves_two_open():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 400):
        sizes, chances = draw.integers(0, 900, n).astype(float), draw.random(n)
        flown = mixing.fly(sizes, chances, draw)
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - chances.sum()) < 1e-6 and abs((flown * sizes).sum() - (chances * sizes).sum()) < 1e-3
        landed = mixing.land(sizes, flown)
        assert set(landed.tolist()) <= {0.0, 1.0}


def test_flight_is_fair():
    sizes, chances = np.array([5.0, 9, 2, 7, 7, 3, 8, 1]), np.array([0.2, 0.5, 0.7, 0.4, 0.1, 0.6, 0.5, 0.3])
    mean = np.mean([mixing.fly(sizes, chances, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - chances).max() < 0.03


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("block", [2000, 20])
def test_mix(spark, block):
    draw = random.Random(8)
    rows = [(k, draw.choice(["a", "b", "b", "b", "é", "z", None]), draw.choice([0, 5, 40, 40, 300])) for k in range(700)]
    rows += [(3, "b", 40), (3, "b", 40), (None, "b", 7)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3)
    got = mixing.plan(table, block=block).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    assert sorted([(r.doc_id, r.source, r.size) for r in got], key=repr) == sorted(rows, key=repr)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 300 for s in want)
    again = mixing.plan(table.repartition(5), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mix_of_nothing(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.target, r.taken) for r in mixing.plan(table).collect()] == [(0.0, 0), (0.0, 0)]
    assert mixing.plan(table.limit(0)).collect() == []


def test_fixity_finds_each_damage_and_only_that(spark):
    rows = [(k * 3, f"record {k}".encode()) for k in range(3000)] + [(None, b"loose"), (None, None), (6, b"second"), (6, b"second"), (-5, b"below")]
    bad = [(k, (b"?" * len(r) if k == 300 else r)) for k, r in rows if k != 6003] + [(10**9, b"new")]
    bad.remove((6, b"second"))
    frames = [spark.createDataFrame([(*x, "clash") for x in part], "page_id long, record binary, key string").repartition(4) for part in (rows, bad)]

    def laid(part):
        """Offset of each key's first byte, by walking the records in order."""
        out, ends = {}, {}
        for k in sorted({k for k, _ in part if k is not None}):
            out[k] = ends.get(k >> 10, 0)
            ends[k >> 10] = out[k] + sum(len(r) for x, r in part if x == k)
        return out

    got = {r.key: r for r in fixity.audit(*frames).collect() if not r.keyless}
    before, after = laid(rows), laid(bad)
    want = {300: "changed", 6: "changed", 6003: "missing", 10**9: "extra"}
    want |= {k: "moved" for k in before.keys() & after.keys() if k not in want and before[k] != after[k]}
    assert {k: r.status for k, r in got.items() if r.status != "ok"} == want and sum(v == "moved" for v in want.values()) > 300
    assert {k: r.offset for k, r in got.items() if r.status != "extra"} == before and {k: r.replica_offset for k, r in got.items() if r.status != "missing"} == after
    same = fixity.audit(frames[0], frames[0].repartition(2)).collect()
    assert {r.status for r in same} == {"ok"} and sum(r.keyless for r in same) == 2 and got[-5].file == -1
    assert fixity.audit(frames[0].limit(0), frames[0].limit(0)).collect() == []
    assert {r.status for r in fixity.audit(frames[0], frames[0].limit(0)).collect()} == {"missing"}


def test_records_of_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None), (-3, "u", None), (1, None, "é"), (1, None, "é")], "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    found = [bytes(r.record) for r in fixity.warc(pages).collect()]
    assert all(f.startswith(b"WARC/1.1") and f.endswith(b"\r\n\r\n") for f in found) and b"Content-Length: 2\r\n\r\n\xc3\xa9" in found[2]
    assert {r.status for r in fixity.audit(fixity.warc(pages), fixity.warc(pages)).collect()} == {"ok"}


def test_pipeline(spark, labelled):
    docs, labels = labelled
    copy = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 5000)
    docs = docs.union(copy)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-input"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    ids = [r.doc_id for r in clean.select("doc_id").collect() if r.doc_id is not None and r.doc_id < 600]
    assert np.mean([k % 3 != 0 for k in ids]) > 0.97 and len(ids) > 380
    one = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    left = {r.doc_id for r in one.select("doc_id").collect()}
    assert {1, 2, None} <= left and not {5001, 5002} & left
    cut = corpus_pipeline.drop_repeated_passages(spark, one, folder)
    assert cut.columns == corpus_pipeline.COLUMNS and cut.count() == one.count()
    mixed = corpus_pipeline.mix_sources(spark, cut, folder)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    done = corpus_pipeline.run(spark, folder)
    assert done.count() == mixed.count() and done.where("not round_trip or size(ids) <> n_tokens").count() == 0
