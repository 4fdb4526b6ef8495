"""Timeline scans against brute force, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from feedwake.operators import timeline as TL
from feedwake.operators.dedupe import keep_first, sequence_within, stable_sample
from feedwake.operators.joins import contains_hex, first_match, interval_join


def rows(seed, n, keys=("hot", "hot", "hot", "b", "c")):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randint(0, 400), f"v{rng.randint(0, 9)}", rng.randint(1, 50), i) for i in range(n)]


SCHEMA = "k string, t long, v string, x long, id long"


@pytest.fixture(scope="module")
def data(spark):
    left, right = rows(1, 300), rows(2, 500)
    return left, right, spark.createDataFrame(left, SCHEMA).repartition(8), spark.createDataFrame(right, SCHEMA).repartition(8)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_asof(data, forward, equal):
    left, right, ldf, rdf = data
    found = TL.asof(ldf, rdf, ["k"], F.col("t"), F.col("t"), F.col("id"), "hit", ties=["id"], forward=forward, equal=equal, within=25)
    got = {r["id"]: r["hit"] for r in found.collect()}
    assert len(got) == len(left)
    for k, t, _, _, i in left:
        near = [(rt, rid) for rk, rt, _, _, rid in right if rk == k and ((rt > t) if forward else (rt < t) or False) or (rk == k and equal and rt == t)]
        best = (min if forward else max)(near, default=None)
        assert got[i] == (best[1] if best and abs(best[0] - t) <= 25 else None)


@pytest.mark.parametrize("closed", ["left", "right"])
def test_window_counts_and_folds(data, closed):
    left, right, ldf, rdf = data
    width = 30
    counts = TL.window_distinct_counts(ldf, rdf, ["k"], F.col("t"), F.col("t"), width, {"vs": "v", "ids": "id"}, closed=closed)
    folds = TL.window_fold(
        ldf, rdf, ["k"], F.col("t"), F.col("t"), width,
        [TL.Scan("total", "sum", F.col("x")), TL.Scan("n", "count", F.lit(1)), TL.Scan("low", "min", F.struct("x", "id")), TL.Scan("high", "max", F.col("x"))], closed=closed)
    c = {r["id"]: r for r in counts.collect()}
    f = {r["id"]: r for r in folds.collect()}
    for k, t, _, _, i in left:
        inside = [r for r in right if r[0] == k and ((t < r[1] <= t + width) if closed == "right" else (t <= r[1] < t + width))]
        assert (c[i]["vs"], c[i]["ids"]) == (len({r[2] for r in inside}), len({r[4] for r in inside}))
        assert (f[i]["n"] or 0) == len(inside) and (f[i]["total"] or 0) == sum(r[3] for r in inside)
        assert (tuple(f[i]["low"]) if inside else None) == (min((r[3], r[4]) for r in inside) if inside else None)
        assert f[i]["high"] == (max(r[3] for r in inside) if inside else None)


def test_a_hot_key_is_cut_into_chunks(spark):
    many = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    chunks = TL.cut(many.repartition(4), ["k"], ["t"])
    sizes = [r["count"] for r in chunks.groupBy(TL.CHUNK).count().collect()]
    if len(sizes) > 1:
        assert max(sizes) < 20_000
    numbered = TL.running(chunks, ["k"], ["t"], [TL.Scan("n", "count", F.lit(1))])
    assert numbered.where(F.col("n") != F.col("t") + 1).count() == 0


def test_rank_keep_first_and_sample(data, spark):
    _, right, _, rdf = data
    ranked = {r["id"]: r["place"] for r in sequence_within(rdf, ["k"], ["t", "id"], "place").collect()}
    for k in {r[0] for r in right}:
        ordered = sorted((r[1], r[4]) for r in right if r[0] == k)
        assert [ranked[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    first = {r["k"]: r["id"] for r in keep_first(rdf, ["k"], ["t", "id"]).collect()}
    assert first == {k: min((r[1], r[4]) for r in right if r[0] == k)[1] for k in first}
    import hashlib

    sample = stable_sample(rdf, ["k"], F.col("id").cast("string"), "salt", F.when(F.col("k") == "hot", 37).otherwise(1000), ["id"])
    got = {(r["k"], r["id"]) for r in sample.collect()}
    digest = lambda i: hashlib.sha256(f"salt|{i}".encode()).hexdigest()
    want = {("hot", i) for i in sorted((r[4] for r in right if r[0] == "hot"), key=digest)[:37]} | {(r[0], r[4]) for r in right if r[0] != "hot"}
    assert got == want


@pytest.mark.parametrize("closed", ["left", "right", "both"])
def test_interval_join(data, closed):
    left, right, ldf, rdf = data
    l, r = ldf.select("k", "t", "id"), rdf.select("k", F.col("t").alias("rt"), F.col("id").alias("rid"))
    got = sorted((x["id"], x["rid"]) for x in interval_join(l, r, ["k"], F.col("t"), F.col("rt"), -7, 5, closed).collect())
    inside = {"left": lambda d: -7 <= d < 5, "right": lambda d: -7 < d <= 5, "both": lambda d: -7 <= d <= 5}[closed]
    assert got == sorted((a[4], b[4]) for a in left for b in right if a[0] == b[0] and inside(b[1] - a[1]))


def test_first_match_keeps_rows_without_partner(spark):
    left = spark.createDataFrame([("a", 3), ("a", 9), ("b", 1)], "k string, s long")
    right = spark.createDataFrame([("a", 3), ("a", 5)], "k string, r long")
    got = {(x["k"], x["s"]): x["hit"] for x in first_match(left, right, ["k"], F.col("s"), F.col("r"), F.col("r"), "hit").collect()}
    assert got == {("a", 3): 3, ("a", 9): None, ("b", 1): None}


def test_contains_hex_at_any_offset(spark):
    rng = random.Random(5)
    needles = ["0x" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)] + ["0x" + "0" * 40]
    hay = []
    for i in range(60):
        body = "".join(rng.choice("01") for _ in range(rng.randint(0, 90)))
        if i % 3:
            body += rng.choice(needles)[2:] + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(0, 50)))
        hay.append((i, "0x" + (body.upper() if i % 2 else body)))
    hay.append((99, "0x" + "0" * 200))
    h, n = spark.createDataFrame(hay, "i long, data string"), spark.createDataFrame([(x,) for x in needles], "needle string")
    got = sorted((r["i"], r["needle"]) for r in contains_hex(h, n, [], "data", "needle", ["i", "needle"]).collect())
    assert got == sorted((i, x) for i, d in hay for x in needles if x[2:] in d.lower())
