
from pyspark.sql import functions as F

from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.functions import words as W
from feedwake.plans.evaluate import wilson


def values(spark, items, column, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_words_match_big_integers(spark):
    numbers = [0, 255, 2**60 - 1, 2**60, 10**38 - 1, 10**38, 2**127, 2**128 - 1, 2**200 + 7, -1, -(2**60), -(10**38 - 1), -(10**38), -(2**255)]
    texts = ["0x" + format(n % 2**256, "064x") for n in numbers]
    signed = values(spark, texts, lambda c: W.int_decimal(c).cast("string"))
    assert signed == [str(n) if abs(n) < 10**38 else None for n in numbers]
    unsigned = values(spark, texts, lambda c: W.uint_decimal(c).cast("string"))
    assert unsigned == [str(n % 2**256) if n % 2**256 < 10**38 else None for n in numbers]
    for n, got in zip(numbers, values(spark, texts, W.int_double), strict=True):
        assert abs(got - float(n)) <= abs(float(n)) * 1e-15


def test_word_texts_are_exact(spark):
    numbers = [0, 7, 65535, 65536, 10**38, 2**128, 2**200 + 7, 2**256 - 1, -1, -(10**38), -(2**255), -(2**255) + 1, 2**255 - 1, -(2**240)]
    texts = ["0x" + format(n % 2**256, "064x") for n in numbers]
    assert values(spark, texts, W.uint_text) == [str(n % 2**256) for n in numbers]
    assert values(spark, texts, W.int_text) == [str(n if n < 2**255 else n - 2**256) for n in numbers]


def test_wide_numbers_do_not_end_the_job(spark):
    wide = "0x" + "f" * 64
    assert values(spark, [wide, wide * 3], W.dynamic_string) == [None, None]
    odd = "0x" + format(32, "064x") + format(2, "064x") + "ff41"  # no UTF-8
    assert values(spark, [odd], W.dynamic_string) == ["\ufffdA"]
    assert values(spark, ["9" * 30, "-" + "9" * 30, "9223372036854775807", "12.7", "x"], T.to_long) == [None, None, 2**63 - 1, 12, None]


def test_word_cutting(spark):
    assert values(spark, [None, "0x", "0x" + "a" * 64, "b" * 65], W.words) == [[], [], ["a" * 64], ["b" * 64, "b"]]
    assert values(spark, ["0x1234"], W.word_address) == ["0x" + "1234".rjust(40, "0")]


def test_addresses_and_hashes(spark):
    assert values(spark, [None, "", "AB", "0xAB", "0x" + "1" * 44], T.address) == ["", "", "0x" + "ab".rjust(40, "0"), "0x" + "ab".rjust(40, "0"), "0x" + "1" * 40]
    assert values(spark, ["0x" + "A" * 40, "0x12", None], T.strict_address) == ["0x" + "a" * 40, "", ""]
    assert values(spark, ["0x" + "a" * 64, "0x" + "g" * 64, None], T.is_hash) == [True, False, False]
    assert values(spark, ["0x" + "a" * 40, "0x" + "a" * 39 + "b"], T.is_placeholder_address) == [True, False]
    mixed = "0x" + "a" * 40 + "ab" * 12
    assert values(spark, [mixed, "0x" + "ab" * 32, "0x" + "c" * 64, "x"], T.is_placeholder_tx) == [True, False, True, False]


def test_tolerant_casts(spark):
    assert values(spark, ["1", " True", "Y", "no", None, ""], T.to_bool) == [True, True, True, False, False, False]
    assert values(spark, ["1.5", "1e2", "1.0d", "x", "", None, " 7 "], T.to_double) == [1.5, 100.0, None, None, None, None, 7.0]
    assert values(spark, ["3.9", "-3.9", "", None], lambda c: T.to_long(c, 7)) == [3, -3, 7, 7]
    assert values(spark, ["1,234.5", "unknown", None], T.loose_amount) == [1234.5, 0.0, 0.0]
    assert values(spark, ["a; b ;;c,d", "a, b", "", None], T.text_list) == [["a", "b", "c,d"], ["a", "b"], [], []]
    assert values(spark, [" Wr ETH ", None], T.symbol_key) == ["wreth", ""]


def test_times_in_all_spellings(spark):
    same = ["2022-05-12T11:39:06Z", "2022-05-12 11:39:06 UTC", "2022-05-12T11:39:06.000Z", "2022-05-12 11:39:06", "2022-05-12T13:39:06+02:00", "1652355546"]
    got = values(spark, [*same, "", None, "nonsense"], lambda c: F.unix_seconds(T.parse_time(c)))
    assert got == [1652355546] * len(same) + [None, None, None]
    assert values(spark, [""], lambda c: F.unix_seconds(T.parse_time_or_epoch(c))) == [0]


def test_identity_order(spark):
    assert values(spark, ["Coinbase cbETH", "wETH", "nothing"], ID.asset_identity) == ["CBETH", "ETH", None]
    assert values(spark, ["cbETH / USD feed"], lambda c: ID.asset_identity(c, ID.FEED_ASSETS_OLD)) == ["ETH"]
    assert values(spark, ["Aave: pool", "My New  Protocol!"], ID.protocol_cluster) == ["aave", "my_new_protocol_"]
    assert values(spark, ["Moonwell USDC", "USDC", None], ID.market_cluster) == ["moonwell", "unknown_market_cluster", "unknown_market"]
    assert values(spark, ["mUSDC.e", "vusdt.e", "mUSDbC"], lambda c: ID.market_token_asset(c, F.lit(None).cast("string"))) == ["USDC", "USDT", None]


def test_wilson_interval(spark):
    row = spark.range(1).select(wilson(F.lit(431), F.lit(470)).alias("w"), wilson(F.lit(0), F.lit(0)).alias("none")).first()
    assert round(row["w"]["lower"], 4) == 0.8886 and round(row["w"]["upper"], 4) == 0.9387 and row["none"] is None


def test_chain_names():
    assert T.parse_chains("bsc, avalanche,base,bnb") == ["bnb", "avalanche_c", "base"]
    assert T.chain_filter_names(["avalanche_c", "bnb"]) == ["avalanche", "avalanche_c", "bnb"]
    assert len(T.hash_buckets(256)) == 256 and T.hash_buckets(4) == ["00", "40", "80", "c0"]


def test_leaves_of_any_shape(spark):
    from feedwake.operators.audit import leaves

    docs = [(1, '{"a": [1, [true, {"b": "x.y"}], []], "c": null, "d": {}}'), (2, "no json {"), (3, '"alone"'), (4, None), (5, "[[[[7]]]]"), (6, "null"), (7, '{"é k": "v"}')]
    got = sorted((r["k"], r["path"], r["value"]) for r in leaves(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect())
    assert got == [(1, "$.a[0]", "1"), (1, "$.a[1][0]", "true"), (1, "$.a[1][1].b", "x.y"), (2, "$", "no json {"), (3, "$", "alone"), (5, "$[0][0][0][0]", "7"), (7, "$.é k", "v")]
