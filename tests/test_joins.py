"""Contains joins against plain search, and what they move."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from feedwake.operators import joins as J
from feedwake.operators.timeline import Scan, window_fold

HEX = "0123456789abcdef"


def words(rng, n, zeros=0.6):
    """Call data of ``n`` ABI words: mostly numbers, that is zeros before a few digits."""
    return "".join("0" * 60 + "".join(rng.choice(HEX) for _ in range(4)) if rng.random() < zeros else "".join(rng.choice(HEX) for _ in range(64)) for _ in range(n))


def test_needles_of_zeros_and_needles_over_zeros(spark):
    rng = random.Random(9)
    needles = ["0" * 40, "0" * 39 + "1", "1" + "0" * 39, "f" * 40, "a" * 20 + "0" * 20, "0" * 19 + "12" + "0" * 19, "00" * 10 + "ab" * 10]
    needles += ["".join(rng.choice("01") for _ in range(40)) for _ in range(4)]
    hay = [(0, None), (1, ""), (2, "0x"), (3, "0x" + "0" * 39), (4, "0x" + "0" * 40), (5, "f" * 41), (6, "0x" + "é" * 30 + "0" * 45)]
    for i in range(7, 90):
        body = words(rng, rng.randint(1, 6))[rng.randint(0, 40) :]
        at = rng.randint(0, len(body))
        hay.append((i, "0x" + body[:at] + (rng.choice(needles) if i % 4 else "") + body[at : at + rng.randint(0, 300)]))
    h = spark.createDataFrame(hay, "i long, data string").repartition(3)
    n = spark.createDataFrame([("0x" + x, "x") for x in needles] + [("0x12", "x"), (None, "x")], "needle string, label string")
    got = sorted((r["i"], r["needle"]) for r in J.contains_hex(h, n, [], "data", "needle", ["i", "needle"]).collect())
    assert got == sorted((i, "0x" + x) for i, d in hay for x in needles if d and x in d.lower().removeprefix("0x"))


def test_a_long_call_grows_linearly_and_zeros_are_no_common_key(spark):
    """128 KB of words: entries and their digits by length, and what the zeros of all calls share with an address of many zeros."""
    rng = random.Random(4)
    sizes, entries, digits, took = (512, 4096), [], [], []
    for n in sizes:  # words of 32 bytes: 16 KB and 128 KB
        calls = spark.createDataFrame([(i, "0x" + words(rng, n, 0.9)) for i in range(4)], "i long, data string")
        index = calls.select("i", F.explode(J._hex_index(F.col("data"))).alias("e"))
        began = time.time()
        row = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("e")).alias("digits")).first()
        took.append(time.time() - began)
        entries.append(row["n"])
        digits.append(row["digits"])
    grown = sizes[1] / sizes[0]
    assert entries[1] <= 1.1 * grown * entries[0] and digits[1] <= 1.1 * grown * digits[0]
    assert digits[1] <= 4 * 60 * 64 * sizes[1] / 3 and took[1] < 30
    many = spark.range(2000).select("id", F.concat(F.lit("0x"), F.lpad(F.hex("id"), 64, "0"), F.lit("0" * 64), F.lpad(F.hex(F.col("id") + 7), 64, "0")).alias("data"))
    needles = spark.createDataFrame([("0x" + "0" * 37 + "3e8",), ("0x" + "0" * 12 + "12345678" + "0" * 20,)], "needle string")
    keys = needles.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda o: F.substring("needle", o + 3, F.lit(20)))).alias("piece")).where(J._even(F.col("piece")))
    assert keys.count() > 0  # zeros are slices of both needles
    index = many.select("id", F.explode(J._hex_index(F.col("data"))).alias("e"))
    asked = index.where(J._key(F.col("e")) == "0" * 20)
    assert asked.count() == 0
    found = J.contains_hex(many, needles, [], "data", "needle", ["id", "needle"]).collect()
    assert sorted(r["id"] for r in found) == [993, 1000]
    assert "data" not in found[0].asDict()


def test_words_in_names_like_a_plain_search(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB. ") for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None, "", "Éa", "a" * 3000]
    asked = ["".join(rng.choice("abA") for _ in range(rng.randint(1, 5))) for _ in range(60)] + [None, "", "é", "éA", "zzz", " "]
    got = J.contains_text(spark.createDataFrame([(n, 1) for n in names], "name string, word int"), spark.createDataFrame([(a,) for a in asked], "asked string"), "name", "asked")
    want = {(n, a) for n in names if n is not None for a in asked if a and a.lower() in n.lower()}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n", [3000])
def test_a_common_beginning_is_no_hot_key(spark, n):
    """A tenth of all names begins like all words; they meet on what tells them apart."""
    names = spark.range(n).select(F.concat(F.when(F.col("id") % 10 == 0, F.lit("ethereum ")).otherwise(F.lit("name ")), F.md5(F.col("id").cast("string"))).alias("low"))
    asked = spark.range(200).select(F.concat(F.lit("ethereum "), F.substring(F.md5((F.col("id") * 10).cast("string")), 1, 6)).alias("word")).withColumn("low_word", F.col("word"))
    rare = J.rarest_grams(names, asked)
    assert rare.count() == 200 and rare.agg(F.max("texts")).first()[0] < n / 20
    found = J.contains_text(names.withColumnRenamed("low", "name"), asked.select("word"), "name", "word").select("word").distinct()
    assert found.count() == 200


def test_many_needles_and_triggers_do_not_go_through_the_driver(spark):
    """Sides that look small before an explode, or packed in files, were sent to the driver whole and broadcast."""
    chain = F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("chain")
    address = F.concat(F.lit("0x"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40))
    needles = spark.range(15_000).select(chain, address.alias("needle"))
    calls = spark.range(40_000).select(chain, F.col("id").alias("call"), F.concat(F.lit("0xabcdef01"), F.lit("0" * 24), F.substring(address, 3, 40)).alias("data"))
    found = J.contains_hex(calls, needles, ["chain"], "data", "needle", ["call", "needle"])
    assert len(found.collect()) == 15_000
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    tx = F.concat(F.lit("0x"), F.lpad(F.hex("id"), 600, "0"))
    triggers = spark.range(40_000).select(chain, tx.alias("tx"), F.col("id").alias("at"))
    acts = spark.range(40_000).select(chain, F.col("id").alias("at"))
    folded = window_fold(triggers, acts, ["chain"], F.col("at"), F.col("at"), 10, [Scan("n", "count", F.lit(1))])
    rows = folded.select("tx", "n")
    assert len(rows.collect()) == 40_000
    sides = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.search(r"BroadcastHashJoin \[_left_id#\d+L?\], \[_left_id#\d+L?\], Inner, BuildLeft", sides)


def test_dense_intervals_like_interval_join_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARE", 30)
    rng = random.Random(2)
    left = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.randint(-40, 90)) for i in range(120)], "k string, id long, t long")
    right = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.randint(-40, 90)) for i in range(300)] + [("a", 900, None)], "k string, rid long, rt long")
    for closed, width in (("right", 7), ("left", 7), ("left", 50), ("right", 3)):
        dense = J.dense_interval_join(left, right, ["k"], F.col("t"), F.col("rt"), width, closed)
        assert sorted(dense.columns) == ["id", "k", "rid", "rt", "t"]
        plain = J.interval_join(left, right, ["k"], F.col("t"), F.col("rt"), 0, width, closed)
        assert sorted((r["id"], r["rid"]) for r in dense.collect()) == sorted((r["id"], r["rid"]) for r in plain.collect())
    assert J.dense_interval_join(left, right.where("false"), ["k"], F.col("t"), F.col("rt"), 7).count() == 0


def test_entries_without_a_needle_are_not_shuffled_and_bitmaps_are_sent(spark):
    """Of the blocks of all calls only those that a needle may lie over are kept, whatever the session broadcasts."""
    address = F.concat(F.lit("0x"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40))
    calls = spark.range(3000).select("id", F.concat(F.lit("0xabcdef01"), F.lit("0" * 24), F.substring(address, 3, 40)).alias("data"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = J.contains_hex(calls, spark.range(10).select(address.alias("needle")), [], "data", "needle", ["id", "needle"])
        assert sorted(r["id"] for r in found.collect()) == list(range(10))
        files = [f for f in found.inputFiles() if "table-" in f]
        assert files and 10 <= spark.read.parquet(*files).count() <= 60
        kept = J.unlikely(spark.range(50).select("id"), spark.range(40).select("id"), ["id"])
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert 8 <= kept.count() <= 10 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
