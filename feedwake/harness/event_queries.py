"""Joins, decoding, names, incidents, audits and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.functions import words as W
from feedwake.harness import broad_queries as BQ
from feedwake.harness import candidate_queries as CQ
from feedwake.harness import closure_queries as CL
from feedwake.harness import replay_queries as RQ
from feedwake.harness import views as V
from feedwake.operators import audit as AUD
from feedwake.operators import closure as C
from feedwake.operators import decode as DEC
from feedwake.operators import incidents as INC
from feedwake.operators import joins as J
from feedwake.operators import sampling as SMP
from feedwake.operators import trends as TR
from feedwake.operators.closure import HOUR
from feedwake.plans import evaluate as EV
from feedwake.storage import write_table

QUERIES = {}
SQL = {}
LONG = "long"

# --- joins ----------------------------------------------------------------------------------------------------


def _kind(spark, folder, name: str) -> DataFrame:
    return V.logs(spark, folder).where(F.col("topic0") == name).select(
        F.col("blockchain").alias("chain"), "asset", "actor", "block_number", "block_time", "value", "tx_hash")


def _latest(spark, folder):
    at = T.micros(F.col("block_time"))
    payload = F.struct("block_number", "value")
    found = J.latest_prior(_kind(spark, folder, "click"), _kind(spark, folder, "view"), ["chain", "asset"], at, at, 7 * 24 * HOUR, payload, "a", ties=["block_number"])
    return found.select("chain", "asset", "block_number", F.col("a.block_number").alias("answer_block"), F.col("a.value").alias("answer"))


QUERIES["latest_prior_answer"] = _latest
SQL["latest_prior_answer"] = V.with_views(["h_logs"], """
SELECT c.chain, c.asset, c.block_number, v.block_number AS answer_block, v.value AS answer
FROM (SELECT * FROM h_logs WHERE topic0 = 'click') c JOIN (SELECT * FROM h_logs WHERE topic0 = 'view') v
  ON v.chain = c.chain AND v.asset = c.asset AND v.us <= c.us AND v.us >= c.us - 7 * 86400000000
QUALIFY row_number() OVER (PARTITION BY c.block_number ORDER BY v.us DESC, v.block_number DESC) = 1""")


def _pairs(spark, folder):
    at = T.micros(F.col("block_time"))
    borrows = _kind(spark, folder, "purchase").select("chain", "actor", F.col("block_number").alias("borrow_block"), F.col("block_time").alias("borrow_time"))
    supplies = _kind(spark, folder, "click").select("chain", "actor", F.col("block_number").alias("supply_block"), "block_time")
    joined = J.interval_join(supplies, borrows, ["chain", "actor"], at, T.micros(F.col("borrow_time")), 0, 6 * HOUR, "right")
    return joined.select("chain", "actor", "supply_block", "borrow_block")


QUERIES["interval_join_same_actor"] = _pairs
SQL["interval_join_same_actor"] = V.with_views(["h_logs"], """
SELECT s.chain, s.actor, s.block_number AS supply_block, b.block_number AS borrow_block FROM h_logs s JOIN h_logs b ON b.chain = s.chain AND b.actor = s.actor
WHERE s.topic0 = 'click' AND b.topic0 = 'purchase' AND b.us > s.us AND b.us <= s.us + 6 * 3600000000""")


def _or(spark, folder):
    watched = V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("account"))
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.or_join(watched, orders, [], [("account", "o_custkey"), ("account", "o_orderkey")], ["o_orderkey"])


QUERIES["or_join_impact"] = _or
SQL["or_join_impact"] = """
SELECT s_suppkey AS account, o_orderkey, o_custkey, o_totalprice FROM supplier JOIN orders ON o_custkey = s_suppkey
UNION SELECT s_suppkey, o_orderkey, o_custkey, o_totalprice FROM supplier JOIN orders ON o_orderkey = s_suppkey"""


def _text(spark, folder):
    words = BQ.tokens(spark, folder).select(F.col("symbol").alias("word"))
    return J.contains_text(BQ.traces(spark, folder), words, "function_name", "word")


QUERIES["contains_text_join"] = _text
SQL["contains_text_join"] = V.with_views(["b_orders", "b_tokens"], f"""
, f AS (SELECT DISTINCT {BQ._list(BQ.CALLS)}[(o_custkey % 8) + 1] AS function_name FROM b_orders)
SELECT DISTINCT f.function_name, t.symbol AS word FROM f JOIN b_tokens t ON contains(lower(f.function_name), lower(t.symbol)) WHERE t.symbol <> ''""")


def borrow_events(spark, folder) -> DataFrame:
    """Every line item as an event of a market (``Borrow``, or ``Mint`` if it was not returned); large ones are logged after their transfer and find no partner."""
    kind = F.when(F.col("l_returnflag") == "R", "Borrow").otherwise("Mint")
    return V.table(spark, folder, "lineitem").select(
        V.hash_of(F.col("l_orderkey")).alias("tx_hash"), kind.alias("event"), F.col("l_suppkey").alias("market"), F.col("l_quantity").cast("decimal(38,0)").alias("raw"),
        (F.col("l_linenumber") + F.when(F.col("l_quantity") > 25, 1).otherwise(0)).cast(LONG).alias("log_index"), "l_partkey")


def _first_match(spark, folder):
    moves = V.table(spark, folder, "lineitem").select(
        V.hash_of(F.col("l_orderkey")).alias("tx_hash"), F.col("l_suppkey").alias("market"), F.col("l_quantity").cast("decimal(38,0)").alias("raw"),
        F.col("l_linenumber").cast(LONG).alias("at"))
    found = J.first_match(borrow_events(spark, folder), moves, ["tx_hash", "market", "raw"], F.col("log_index"), F.col("at"), F.col("at"), "transfer_log_index")
    return found.select("tx_hash", "market", F.col("raw").cast(LONG).alias("raw"), "log_index", "l_partkey", "transfer_log_index")


QUERIES["first_match_transfer"] = _first_match
SQL["first_match_transfer"] = """
WITH b AS (SELECT row_number() OVER () AS id, '0x' || lpad(lower(to_hex(l_orderkey)), 64, '0') AS tx_hash, l_suppkey AS market, CAST(l_quantity AS BIGINT) AS raw,
                  CAST(l_linenumber + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS BIGINT) AS log_index, l_partkey FROM lineitem)
SELECT any_value(b.tx_hash) AS tx_hash, any_value(b.market) AS market, any_value(b.raw) AS raw, any_value(b.log_index) AS log_index, any_value(b.l_partkey) AS l_partkey,
       CAST(min(l.l_linenumber) AS BIGINT) AS transfer_log_index
FROM b LEFT JOIN lineitem l ON '0x' || lpad(lower(to_hex(l.l_orderkey)), 64, '0') = b.tx_hash AND l.l_suppkey = b.market AND CAST(l.l_quantity AS BIGINT) = b.raw
     AND l.l_linenumber >= b.log_index GROUP BY b.id"""

# --- words and logs -------------------------------------------------------------------------------------------


def word_of(number, negative: bool = False):
    """Hex word of a long; a negative one is two's complement."""
    digits = F.lower(F.hex(number))
    return F.when(number < 0, F.lpad(digits, 64, "f")).otherwise(F.lpad(digits, 64, "0")) if negative else F.lpad(digits, 64, "0")


def _cents():
    return F.floor(F.col("value") * 100).cast(LONG)


def _words(spark, folder):
    up, down = word_of(F.col("block_number")), word_of(-_cents(), True)
    rows = V.logs(spark, folder).select("block_number", "value", up.alias("up"), down.alias("down"))
    rows = rows.withColumn("blob", F.concat(F.lit("0x"), "up", "down", F.lit("abc")))
    return rows.select(
        "block_number", F.size(W.words(F.col("blob"))).cast(LONG).alias("word_count"), W.uint_decimal(W.word_at(F.col("blob"), 0)).cast(LONG).alias("uint_value"),
        W.int_decimal(W.word_at(F.col("blob"), 1)).cast(LONG).alias("int_value"), W.int_double(F.col("down")).alias("int_double"),
        (F.substring("down", 1, 1) >= "8").alias("is_negative"), W.word_address(F.col("up")).alias("address"), W.address_topic(W.word_address(F.col("up"))).alias("topic"),
        F.round(W.scaled(W.uint_decimal(F.col("up")), 2), 6).alias("scaled"), W.decimal_text(F.col("value"), 1).alias("decimal_text"))


QUERIES["decode_words_uint_int256"] = _words
SQL["decode_words_uint_int256"] = V.with_views(["h_logs"], """
, c AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS cents FROM h_logs)
SELECT block_number, CAST(3 AS BIGINT) AS word_count, block_number AS uint_value, -cents AS int_value, CAST(-cents AS DOUBLE) AS int_double, cents > 0 AS is_negative,
       '0x' || lpad(lower(to_hex(block_number)), 40, '0') AS address, '0x' || lpad(lower(to_hex(block_number)), 64, '0') AS topic, round(block_number / 100.0, 6) AS scaled,
       CAST(t // 10 AS VARCHAR) || CASE WHEN t % 10 = 0 THEN '' ELSE '.' || CAST(t % 10 AS VARCHAR) END AS decimal_text
FROM (SELECT *, c // 10 + CASE WHEN c % 10 > 5 OR (c % 10 = 5 AND (c // 10) % 2 = 1) THEN 1 ELSE 0 END AS t FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM c))""")


def raw_logs(spark, folder) -> DataFrame:
    """Events as raw logs: clicks mint, purchases borrow, errors accrue interest, views report answers. Small values lack a word."""
    rows = V.logs(spark, folder)
    number, cents = F.col("block_number"), _cents()
    full = F.concat(F.lit("0x"), word_of(F.col("actor").cast(LONG)), word_of(cents), word_of(number), word_of(number + 1))
    short = F.concat(F.lit("0x"), word_of(F.col("actor").cast(LONG)), word_of(cents), word_of(number))
    topic = (
        F.when(F.col("topic0") == "click", R.COMPOUND_MINT).when(F.col("topic0") == "purchase", R.COMPOUND_BORROW)
        .when(F.col("topic0") == "error", R.COMPOUND_ACCRUE_INTEREST).when(F.col("topic0") == "view", R.ANSWER_UPDATED).otherwise("0x00"))
    address = RQ.account(F.col("k"))
    return rows.select(
        "blockchain", "block_date", "block_time", "block_number", "tx_hash", "log_index", address.alias("contract_address"), topic.alias("topic0"),
        F.concat(F.lit("0x"), word_of(-cents, True)).alias("topic1"), F.concat(F.lit("0x"), word_of(number)).alias("topic2"), F.lit(None).cast("string").alias("topic3"),
        F.when(F.col("value") >= 1, full).otherwise(short).alias("data"))


QUERIES["decode_compound_events"] = lambda spark, folder: DEC.decode_compound_events(raw_logs(spark, folder), 2).select(
    "block_number", "event", "market_address", "account", *[F.col(c).cast(LONG).alias(c) for c in (
        "amount_raw", "mint_tokens_raw", "account_borrows_raw", "total_borrows_raw", "cash_prior_raw", "interest_accumulated_raw", "borrow_index_raw")],
    F.round("amount", 6).alias("amount"))
SQL["decode_compound_events"] = V.with_views(["h_logs"], """
, c AS (SELECT *, CAST(floor(value * 100) AS BIGINT) AS cents, '0x' || lpad(lower(to_hex(k)), 40, '0') AS m, '0x' || lpad(lower(to_hex(CAST(actor AS BIGINT))), 40, '0') AS a FROM h_logs)
SELECT block_number, 'Mint' AS event, m AS market_address, a AS account, cents AS amount_raw, block_number AS mint_tokens_raw, NULL::BIGINT AS account_borrows_raw,
       NULL::BIGINT AS total_borrows_raw, NULL::BIGINT AS cash_prior_raw, NULL::BIGINT AS interest_accumulated_raw, NULL::BIGINT AS borrow_index_raw, round(cents / 100.0, 6) AS amount
FROM c WHERE topic0 = 'click'
UNION ALL SELECT block_number, 'Borrow', m, a, cents, NULL, block_number, block_number + 1, NULL, NULL, NULL, round(cents / 100.0, 6) FROM c WHERE topic0 = 'purchase' AND value >= 1
UNION ALL SELECT block_number, 'AccrueInterest', m, NULL, NULL, NULL, NULL, block_number + 1, CAST(actor AS BIGINT), cents, block_number, NULL FROM c WHERE topic0 = 'error' AND value >= 1""")
QUERIES["decode_answer_updated"] = lambda spark, folder: DEC.decode_answer_updated(raw_logs(spark, folder), 2).select(
    "block_number", "feed", F.col("answer_raw").cast(LONG).alias("answer_raw"), F.round("answer", 6).alias("answer"), F.col("round_id").cast(LONG).alias("round_id"), "updated_at")
SQL["decode_answer_updated"] = V.with_views(["h_logs"], """
SELECT block_number, '0x' || lpad(lower(to_hex(k)), 40, '0') AS feed, -CAST(floor(value * 100) AS BIGINT) AS answer_raw, round(-CAST(floor(value * 100) AS BIGINT) / 100.0, 6) AS answer,
       block_number AS round_id, CAST(actor AS BIGINT) AS updated_at FROM h_logs WHERE topic0 = 'view'""")


def _round_data(spark, folder):
    blob = F.concat(F.lit("0x"), word_of(F.col("block_number")), word_of(-_cents(), True), word_of(F.col("k")), word_of(F.col("k") + 1), word_of(F.col("tx_id")))
    data = F.when(F.col("value") >= 1, blob).otherwise(F.substring(blob, 1, 200))
    rows = DEC.latest_round_data(V.logs(spark, folder).select("block_number", data.alias("data")), "data", "r", 2)
    whole = lambda c: F.col(f"r.{c}").cast(LONG).alias(c)
    return rows.select("block_number", whole("round_id"), F.round("r.answer", 6).alias("answer"), whole("started_at"), whole("updated_at"), whole("answered_in_round"))


QUERIES["decode_latest_round_data"] = _round_data
SQL["decode_latest_round_data"] = V.with_views(["h_logs"], """
SELECT block_number, CASE WHEN value >= 1 THEN block_number END AS round_id, CASE WHEN value >= 1 THEN round(-CAST(floor(value * 100) AS BIGINT) / 100.0, 6) END AS answer,
       CASE WHEN value >= 1 THEN k END AS started_at, CASE WHEN value >= 1 THEN k + 1 END AS updated_at, CASE WHEN value >= 1 THEN tx_id END AS answered_in_round FROM h_logs""")


def _strings(spark, folder):
    """Part names packed as ABI strings (offset, length, bytes); items of size 50 are cut short."""
    bytes_ = F.lower(F.hex(F.encode("p_name", "UTF-8")))
    packed = F.concat(F.lit("0x"), word_of(F.lit(32)), word_of(F.octet_length("p_name")), bytes_, F.lit("0" * 24))
    cut = F.when(F.col("p_size") == 50, F.substring(packed, 1, 140)).otherwise(packed)
    return V.table(spark, folder, "part").select("p_partkey", W.dynamic_string(cut).alias("decoded"))


QUERIES["abi_dynamic_string"] = _strings
SQL["abi_dynamic_string"] = "SELECT p_partkey, CASE WHEN p_size = 50 AND strlen(p_name) > 5 THEN NULL ELSE p_name END AS decoded FROM part"


def _by_abi(spark, folder):
    shape = "array<struct<name:string,type:string,indexed:boolean>>"
    event = lambda *args: "[" + ",".join(f'{{"name":"{n}","type":"{t}","indexed":{str(i).lower()}}}' for n, t, i in args) + "]"
    rows = [
        (R.COMPOUND_MINT, "Mint", event(("minter", "address", False), ("amount", "uint256", False), ("tokens", "uint256", False))),
        (R.ANSWER_UPDATED, "AnswerUpdated", event(("current", "int256", True), ("roundId", "uint256", True), ("updatedAt", "uint256", False))),
    ]
    abi = R.inline(spark, rows, "topic0 string, event_name string, inputs_json string").select("topic0", "event_name", F.from_json("inputs_json", shape).alias("inputs"))
    found = DEC.decode_by_abi(raw_logs(spark, folder), abi).where(F.col("event_name").isNotNull())
    return found.select("block_number", "event_name", F.array_join(F.transform("args", lambda a: F.concat_ws("=", a["name"], a["value"])), ",").alias("args"))


QUERIES["decode_by_abi"] = _by_abi
SQL["decode_by_abi"] = V.with_views(["h_logs"], """
SELECT block_number, 'Mint' AS event_name, 'minter=0x' || lpad(lower(to_hex(CAST(actor AS BIGINT))), 40, '0') || ',amount=' || CAST(floor(value * 100) AS BIGINT) || ',tokens=' || block_number AS args
FROM h_logs WHERE topic0 = 'click'
UNION ALL SELECT block_number, 'AnswerUpdated', 'current=' || (-CAST(floor(value * 100) AS BIGINT)) || ',roundId=' || block_number || ',updatedAt=' || actor FROM h_logs WHERE topic0 = 'view'""")


def _wide(spark, folder):
    """Logs whose words need all 256 bits: exact text, and NULL where a narrower type can't hold the value."""
    digits = F.lpad(F.lower(F.hex("block_number")), 64, "0")
    top = F.translate(digits, W.HEX_DIGITS, W.HEX_COMPLEMENT)  # 2**256 - 1 - n
    low = F.concat(F.lit("8"), F.right(digits, F.lit(63)))  # n - 2**255
    rows = V.logs(spark, folder).withColumns({"topic0": F.lit(R.ANSWER_UPDATED), "topic1": F.concat(F.lit("0x"), low), "topic2": F.concat(F.lit("0x"), top), "data": F.concat(F.lit("0x"), top)})
    read = DEC.latest_round_data(DEC.decode_answer_updated(rows).withColumn("blob", F.repeat(top, 5)), "blob", "r")
    words = rows.select("block_number", W.uint_text(F.col("data")).alias("uint_text"), W.int_text(F.col("topic1")).alias("int_text"), W.dynamic_string(F.col("data")).alias("string"))
    return words.join(read, "block_number").select("block_number", "uint_text", "int_text", "string", "updated_at", F.col("r.started_at").alias("started_at"))


QUERIES["decode_wide_words"] = _wide
SQL["decode_wide_words"] = f"""
SELECT event_id AS block_number, '{str(2**256 - 1)[:-18]}' || lpad(CAST({(2**256 - 1) % 10**18} - event_id AS VARCHAR), 18, '0') AS uint_text,
       '-{str(2**255)[:-18]}' || lpad(CAST({2**255 % 10**18} - event_id AS VARCHAR), 18, '0') AS int_text,
       CAST(NULL AS VARCHAR) AS string, CAST(NULL AS BIGINT) AS updated_at, CAST(NULL AS BIGINT) AS started_at FROM events"""


def _dynamic(spark, folder):
    """Events as logs with a string, a number, an array and bytes; every seventh lacks its end."""
    name = F.hex(F.col("topic0").cast("binary"))
    size = F.length(F.col("topic0").cast("binary")).cast(LONG)
    spot = lambda n: word_of(F.lit(n).cast(LONG))
    number, cents = F.col("block_number"), _cents()
    tail = F.concat(word_of(size), F.rpad(F.lower(name), 64, "0"), spot(2), word_of(number), word_of(cents), spot(3), F.lit("c0ffee"))
    full = F.concat(F.lit("0x"), spot(128), word_of(number), spot(192), spot(288), tail)
    rows = V.logs(spark, folder).withColumn("data", full)
    cut = F.when(number % 7 == 0, F.left("data", F.length("data") - 2)).otherwise(F.col("data"))
    rows = rows.withColumns({"data": cut, "topic0": F.lit("0xdd"), "topic1": F.lit(None).cast("string"), "topic2": F.lit(None).cast("string"), "topic3": F.lit(None).cast("string")})
    inputs = [("what", "string", False), ("n", "uint256", False), ("ids", "uint64[]", False), ("raw", "bytes", False)]
    abi = R.inline(spark, [("0xdd", "Note", inputs)], "topic0 string, event_name string, inputs array<struct<name:string,type:string,indexed:boolean>>")
    found = DEC.decode_by_abi(rows, abi)
    return found.select("block_number", F.array_join(F.transform("args", lambda a: F.concat_ws("=", a["name"], a["value"])), ",").alias("args"))


QUERIES["decode_by_abi_dynamic"] = _dynamic
SQL["decode_by_abi_dynamic"] = V.with_views(["h_logs"], """
SELECT block_number, 'what=' || topic0 || ',n=' || block_number || ',ids=[' || block_number || ',' || CAST(floor(value * 100) AS BIGINT) || '],raw'
       || CASE WHEN block_number % 7 = 0 THEN '' ELSE '=0xc0ffee' END AS args FROM h_logs""")


def _nested(spark, folder):
    """Events as logs with a fixed array, a tuple that holds text, a list of texts and a list of lists."""
    n, cents = word_of(F.col("block_number")), word_of(_cents())
    size = lambda k: F.lit(f"{k:064x}")
    text = lambda c: F.concat(word_of(F.octet_length(c).cast(LONG)), F.rpad(F.lower(F.hex(F.col(c).cast("binary"))), 64, "0"))
    note = F.concat(n, size(64), text("topic0"))
    names = F.concat(size(2), size(64), size(128), text("topic0"), text("asset"))
    grid = F.concat(size(2), size(64), size(128), size(1), n, size(0))
    data = F.concat(F.lit("0x"), n, cents, size(160), size(288), size(512), note, names, F.when(F.col("block_number") % 5 > 0, grid).otherwise(F.lit("")))
    rows = V.logs(spark, folder).withColumns({"topic0": F.lit("0xee"), "topic1": F.lit(None).cast("string"), "topic2": F.lit(None).cast("string"), "topic3": F.lit(None).cast("string"), "data": data})
    inputs = [("pair", "uint256[2]", False), ("note", "(uint256,string)", False), ("names", "string[]", False), ("grid", "uint64[][]", False)]
    abi = R.inline(spark, [("0xee", "Deep", inputs)], "topic0 string, event_name string, inputs array<struct<name:string,type:string,indexed:boolean>>")
    found = DEC.decode_by_abi(rows, abi)
    return found.select("block_number", F.array_join(F.transform("args", lambda a: F.concat_ws("=", a["name"], a["value"])), ";").alias("args"))


QUERIES["decode_by_abi_nested"] = _nested
SQL["decode_by_abi_nested"] = V.with_views(["h_logs"], """
SELECT block_number, 'pair=[' || block_number || ',' || CAST(floor(value * 100) AS BIGINT) || '];note=(' || block_number || ',' || topic0 || ');names=[' || topic0 || ',' || asset || '];grid'
       || CASE WHEN block_number % 5 > 0 THEN '=[[' || block_number || '],[]]' ELSE '' END AS args FROM h_logs""")


def transfer_raw(spark, folder) -> DataFrame:
    """Line items as transfer logs; the supplier with key 0 stands for the zero address."""
    user = F.coalesce(F.col("o_custkey"), F.lit(0))
    rows = V.table(spark, folder, "lineitem").join(V.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.lit("ethereum").alias("blockchain"), V.wall_time("o_orderdate").alias("block_time"), F.col("o_orderkey").alias("block_number"), V.hash_of(F.col("l_orderkey")).alias("tx_hash"),
        F.col("l_linenumber").cast(LONG).alias("log_index"), RQ.account(F.col("l_partkey")).alias("contract_address"), F.lit(R.ERC20_TRANSFER).alias("topic0"),
        F.concat(F.lit("0x"), word_of(F.col("l_suppkey"))).alias("topic1"), F.concat(F.lit("0x"), word_of(user)).alias("topic2"),
        F.concat(F.lit("0x"), word_of(F.col("l_quantity").cast(LONG))).alias("data"))


def token_meta(spark, folder) -> DataFrame:
    part = V.table(spark, folder, "part").where(F.col("p_size") <= 40)
    return part.select(
        F.lit("ethereum").alias("blockchain"), RQ.account(F.col("p_partkey")).alias("contract_address"),
        F.when(F.col("p_size") <= 5, F.lit("USDC")).otherwise(F.col("p_name")).alias("symbol"), F.when(F.col("p_size") <= 35, F.lit(1)).alias("decimals"))


V.register_view_sql("h_moves", """h_moves AS (
  SELECT '0x' || lpad(lower(to_hex(l_orderkey)), 64, '0') AS tx_hash, CAST(l_linenumber AS BIGINT) AS log_index, '0x' || lpad(lower(to_hex(l_partkey)), 40, '0') AS token_address,
         '0x' || lpad(lower(to_hex(l_suppkey)), 40, '0') AS sender, '0x' || lpad(lower(to_hex(o_custkey)), 40, '0') AS receiver, CAST(l_quantity AS BIGINT) AS amount_raw,
         CASE WHEN p_size <= 5 THEN 'USDC' WHEN p_size <= 40 THEN p_name ELSE 'UNKNOWN' END AS symbol,
         CASE WHEN p_size <= 35 THEN CAST(l_quantity AS BIGINT) / 10.0 ELSE CAST(l_quantity AS DOUBLE) END AS amount,
         CASE WHEN l_suppkey = 0 OR o_custkey = 0 THEN 'mint_or_burn' WHEN p_size > 35 OR p_size IS NULL THEN 'unknown_or_internal' ELSE 'known_token_flow' END AS classification,
         l_suppkey, o_custkey, l_partkey, l_quantity, l_returnflag, l_linenumber
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey)""")
QUERIES["decode_transfers"] = lambda spark, folder: DEC.decode_transfers(transfer_raw(spark, folder), token_meta(spark, folder)).select(
    "tx_hash", "log_index", "token_address", F.col("from").alias("sender"), F.col("to").alias("receiver"), F.col("amount_raw").cast(LONG).alias("amount_raw"), "symbol",
    F.round("amount", 6).alias("amount"), "classification")
SQL["decode_transfers"] = V.with_views(["h_moves"], "SELECT tx_hash, log_index, token_address, sender, receiver, amount_raw, symbol, round(amount, 6) AS amount, classification FROM h_moves")


def _directions(spark, folder):
    moves = DEC.decode_transfers(transfer_raw(spark, folder), token_meta(spark, folder))
    who = lambda n: F.lit(f"0x{n:040x}")
    return DEC.transfer_flows(moves, who(7), who(11)).groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount_raw").cast(LONG)).alias("raw"))


QUERIES["transfer_directions"] = _directions
SQL["transfer_directions"] = V.with_views(["h_moves"], """
SELECT CASE WHEN l_suppkey = 7 AND o_custkey = 11 THEN 'attacker_to_protocol' WHEN l_suppkey = 11 AND o_custkey = 7 THEN 'protocol_to_attacker' WHEN l_suppkey = 7 THEN 'attacker_outbound'
            WHEN o_custkey = 7 THEN 'attacker_inbound' WHEN l_suppkey = 11 THEN 'protocol_outbound' WHEN o_custkey = 11 THEN 'protocol_inbound' ELSE 'other' END AS direction,
       count(*) AS n, CAST(sum(amount_raw) AS BIGINT) AS raw FROM h_moves GROUP BY 1""")


def _losses(spark, folder):
    moves = DEC.decode_transfers(transfer_raw(spark, folder), token_meta(spark, folder))
    events = borrow_events(spark, folder).select(
        F.lit("ethereum").alias("blockchain"), "tx_hash", "event", RQ.account(F.col("market")).alias("market_address"), F.lit("").alias("account"),
        F.col("raw").alias("amount_raw"), (F.col("log_index") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("market")).alias("log_index"))
    shifted = moves.withColumn("log_index", F.col("log_index") * 1_000_000_000 + 500_000_000)
    return DEC.loss_estimate(events, shifted).select(
        "tx_hash", "confidence", "primary_asset", F.col("primary_amount_raw").cast(LONG).alias("primary_amount_raw"), F.round("primary_amount", 6).alias("primary_amount"),
        F.round("known_usd_estimate", 6).alias("known_usd_estimate"), "unknown_or_internal_flow_count")


QUERIES["loss_estimate"] = _losses
SQL["loss_estimate"] = V.with_views(["h_moves"], """
, b AS (SELECT tx_hash, sender AS market, amount_raw, CAST(l_linenumber + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq FROM h_moves WHERE l_returnflag = 'R'
        QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY seq, market, amount_raw) = 1),
m AS (SELECT b.tx_hash, arg_min(v.symbol, (v.log_index, v.symbol, v.amount)) AS symbol, arg_min(v.amount, (v.log_index, v.symbol, v.amount)) AS amount FROM b JOIN h_moves v ON v.tx_hash = b.tx_hash AND v.sender = b.market
        AND v.amount_raw = b.amount_raw AND v.log_index * 1000000000 + 500000000 >= b.seq GROUP BY 1),
f AS (SELECT tx_hash, arg_max(symbol, (amount, -log_index, symbol, amount_raw)) FILTER (classification = 'known_token_flow') AS symbol,
             arg_max(amount_raw, (amount, -log_index, symbol, amount_raw)) FILTER (classification = 'known_token_flow') AS raw, max(amount) FILTER (classification = 'known_token_flow') AS amount,
             count(*) FILTER (classification <> 'known_token_flow') AS u FROM h_moves GROUP BY 1),
x AS (SELECT f.tx_hash, CASE WHEN b.tx_hash IS NOT NULL THEN 'protocol_event_decoded' WHEN f.raw IS NOT NULL THEN 'receipt_flow_estimated' ELSE 'not_decodable' END AS confidence,
             CASE WHEN b.tx_hash IS NOT NULL THEN coalesce(m.symbol, 'UNKNOWN') ELSE coalesce(f.symbol, 'UNKNOWN') END AS primary_asset,
             CASE WHEN b.tx_hash IS NOT NULL THEN b.amount_raw ELSE f.raw END AS primary_amount_raw,
             round(CASE WHEN b.tx_hash IS NOT NULL THEN coalesce(m.amount, CAST(b.amount_raw AS DOUBLE)) ELSE f.amount END, 6) AS primary_amount, f.u AS unknown_or_internal_flow_count
      FROM f LEFT JOIN b ON b.tx_hash = f.tx_hash LEFT JOIN m ON m.tx_hash = f.tx_hash)
SELECT tx_hash, confidence, primary_asset, primary_amount_raw, primary_amount, CASE WHEN primary_asset IN ('USDC', 'USDT', 'USDC.e', 'USDT.e', 'DAI', 'DAI.e', 'BUSD', 'USDbC') THEN primary_amount END
       AS known_usd_estimate, unknown_or_internal_flow_count FROM x""")

# --- names ----------------------------------------------------------------------------------------------------


def _names(spark, folder):
    rows = BQ.tokens(spark, folder)
    label = F.concat_ws(" ", "name", "symbol")
    return rows.select(
        "contract_address", ID.asset_identity(label).alias("asset_identity"), ID.asset_identity(label, ID.FEED_ASSETS_OLD).alias("asset_identity_old_order"),
        ID.protocol_cluster(F.concat_ws(" ", "name", F.lit("#"), "symbol")).alias("protocol_cluster"), ID.market_token_asset(F.col("symbol"), F.col("name")).alias("market_asset"),
        ID.market_cluster(F.col("name")).alias("market_cluster"))


_OLD = "CASE " + " ".join(f"WHEN regexp_matches(lower(name || ' ' || symbol), '{p}') THEN '{n}'" for p, n in ID.FEED_ASSETS_OLD) + " END"
QUERIES["asset_identity_and_clusters"] = _names
SQL["asset_identity_and_clusters"] = V.with_views(["b_tokens"], f"""
SELECT address AS contract_address, {BQ._asset_sql("name || ' ' || symbol")} AS asset_identity, {_OLD} AS asset_identity_old_order,
       {BQ._cluster_sql("name || ' # ' || symbol")} AS protocol_cluster, {BQ._MARKET_ASSET_SQL} AS market_asset, {BQ._MARKET_CLUSTER_SQL} AS market_cluster FROM b_tokens""")

# --- incidents ------------------------------------------------------------------------------------------------

USDC_MARKETS = "vUSDC"


def _accounts(spark, folder):
    tokens = BQ.tokens(spark, folder)
    markets = tokens.where(F.col("symbol").isin("cUSDC", "vUSDC", "aUSDC", "bUSDC", "xUSDC")).select("blockchain", F.col("contract_address").alias("market_address"))
    usdc = tokens.where(F.lower("symbol").contains("usdc"))
    return INC.deposit_accounts(BQ.transfers(spark, folder), markets, usdc, 5.0)


def native_traces(spark, folder) -> DataFrame:
    """Supplier deliveries as native payments out of a token market."""
    rows = BQ.transfers(spark, folder).where(F.col("amount") >= 40)
    return rows.withColumn("value_double", F.col("amount") * 1e18).withColumn("success", F.col("evt_index") > 1)


def _locator(spark, folder):
    tokens = BQ.tokens(spark, folder)
    accounts = write_table(_accounts(spark, folder))
    sources = tokens.where(~F.lower("symbol").contains("usdc")).select("blockchain", F.col("contract_address").alias("market_address"), F.col("symbol").alias("market_symbol"))
    flows = INC.borrow_outflows(
        accounts, BQ.transfers(spark, folder), native_traces(spark, folder), sources, tokens, "cavax", tokens.where(F.lower("symbol").contains("usdc")), hours=6)
    return INC.deposit_borrow_locator(accounts, flows).select(
        "blockchain", "account", F.round("deposit_amount", 4).alias("deposit_amount"), "deposit_tx_count", "first_deposit_tx", "deposit_market_count",
        F.round("borrowed_usd_known", 2).alias("borrowed_usd_known"), "borrowed_usd_missing_price_count", F.round("native_amount", 4).alias("native_amount"), "borrow_tx_count",
        "first_borrow_tx", F.array_join("borrowed_assets", ",").alias("borrowed_assets"), F.array_join("source_markets", ",").alias("source_markets"))


QUERIES["deposit_borrow_locator"] = _locator
SQL["deposit_borrow_locator"] = V.with_views(["b_tokens", "b_transfers"], """
, t AS MATERIALIZED (SELECT b.*, k.symbol AS token_symbol, s.symbol AS source FROM b_transfers b LEFT JOIN b_tokens k ON k.chain = b.chain AND k.address = b.token
                     LEFT JOIN b_tokens s ON s.chain = b.chain AND s.address = b.sender),
d AS MATERIALIZED (
  SELECT t.chain, t.sender AS account, sum(t.amount) AS amount, count(DISTINCT t.tx_hash) AS n, arg_min(t.tx_hash, (t.block_number, t.tx_hash)) AS first_tx, min(t.us) AS us,
         count(DISTINCT t.receiver) AS m
  FROM t JOIN b_tokens r ON r.chain = t.chain AND r.address = t.receiver AND r.symbol IN ('cUSDC', 'vUSDC', 'aUSDC', 'bUSDC', 'xUSDC')
  WHERE t.amount >= 5 AND contains(lower(t.token_symbol), 'usdc') GROUP BY 1, 2),
p AS MATERIALIZED (SELECT t.*, d.account, d.us AS first_us FROM t JOIN d ON d.chain = t.chain AND d.account = t.receiver WHERE t.source IS NOT NULL AND NOT contains(lower(t.source), 'usdc')),
o AS (SELECT chain, account, tx_hash, block_number, token_symbol AS asset, source AS market, amount, usd, usd IS NULL AS missing, false AS native FROM p
      WHERE us >= first_us AND us < first_us + 21600000000 AND NOT contains(lower(token_symbol), 'usdc')
      UNION ALL SELECT chain, account, tx_hash, block_number, 'NATIVE', source, amount, NULL, true, true FROM p
      WHERE us >= first_us AND us < first_us + 21600000000 AND lower(source) = 'cavax' AND amount >= 40 AND evt_index > 1),
b AS (SELECT chain, account, round(sum(coalesce(usd, 0)), 2) AS usd, count(*) FILTER (missing) AS missing, round(sum(CASE WHEN native THEN amount ELSE 0 END), 4) AS native, count(DISTINCT tx_hash) AS n,
             arg_min(tx_hash, (block_number, tx_hash)) AS first_tx, string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets, string_agg(DISTINCT market, ',' ORDER BY market) AS markets FROM o GROUP BY 1, 2)
SELECT d.chain AS blockchain, d.account, round(d.amount, 4) AS deposit_amount, d.n AS deposit_tx_count, d.first_tx AS first_deposit_tx, d.m AS deposit_market_count, b.usd AS borrowed_usd_known,
       b.missing AS borrowed_usd_missing_price_count, b.native AS native_amount, b.n AS borrow_tx_count, b.first_tx AS first_borrow_tx, b.assets AS borrowed_assets, b.markets AS source_markets
FROM d JOIN b ON b.chain = d.chain AND b.account = d.account""")


def account_events(spark, folder) -> DataFrame:
    rows = V.logs(spark, folder).where(F.col("topic0").isin("click", "purchase"))
    zero = F.lit(0).cast(LONG)
    return rows.select(
        F.col("actor").alias("account"), F.when(F.col("topic0") == "click", "Mint").otherwise("Borrow").alias("event"), F.col("value").cast("decimal(38,6)").alias("amount"), "tx_hash",
        "block_number", zero.alias("transaction_index"), F.col("log_index").cast(LONG).alias("log_index"), F.unix_seconds("block_time").alias("block_timestamp"))


def _profiles(spark, folder):
    return INC.account_profiles(account_events(spark, folder)).select(
        "account", "event", F.col("amount").cast("double").alias("amount"), "event_count", "tx_count", F.col("first.tx_hash").alias("first_tx"),
        F.col("largest.tx_hash").alias("largest_tx"), F.col("largest.block_number").alias("largest_block"))


V.register_view_sql("h_profiles", """h_profiles AS (
  SELECT actor AS account, CASE topic0 WHEN 'click' THEN 'Mint' ELSE 'Borrow' END AS event, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) AS amount, count(*) AS event_count,
         count(DISTINCT tx_hash) AS tx_count, arg_min(tx_hash, block_number) AS first_tx, min(block_number) AS first_block, arg_max(tx_hash, (value, -block_number)) AS largest_tx,
         arg_max(block_number, (value, -block_number)) AS largest_block
  FROM h_logs WHERE topic0 IN ('click', 'purchase') GROUP BY 1, 2)""")
QUERIES["account_profile"] = _profiles
SQL["account_profile"] = V.with_views(["h_logs", "h_profiles"], "SELECT account, event, amount, event_count, tx_count, first_tx, largest_tx, largest_block FROM h_profiles")


def _matched(spark, folder):
    both = INC.matched_accounts(INC.account_profiles(account_events(spark, folder)))
    return both.select(*[F.col(c).cast("double").alias(c) if c.endswith("_amount") else F.col(c) for c in both.columns])


QUERIES["matched_accounts"] = _matched
SQL["matched_accounts"] = V.with_views(["h_logs", "h_profiles"], """
SELECT d.account, d.amount AS deposited_amount, d.tx_count AS deposited_tx_count, d.first_tx AS first_deposited_tx, d.first_block AS first_deposited_block, d.largest_tx AS largest_deposited_tx,
       b.amount AS borrowed_amount, b.tx_count AS borrowed_tx_count, b.first_tx AS first_borrowed_tx, b.first_block AS first_borrowed_block, b.largest_tx AS largest_borrowed_tx
FROM h_profiles d JOIN h_profiles b ON b.account = d.account WHERE d.event = 'Mint' AND b.event = 'Borrow'""")


def incident_events(spark, folder) -> DataFrame:
    rows = V.logs(spark, folder).where(F.col("topic0").isin("click", "purchase", "error"))
    role = F.when(F.col("topic0") == "click", "SUPPLY").when(F.col("topic0") == "purchase", "BORROW").otherwise("LIQUIDATE")
    return rows.select(
        F.col("blockchain").alias("case"), "tx_hash", role.alias("role"), "actor", "asset", F.col("value").alias("amount"), "block_number",
        F.lit(0).cast(LONG).alias("transaction_index"), F.col("log_index").cast(LONG).alias("log_index"), F.unix_seconds("block_time").alias("block_timestamp"))


def statuses(spark, folder) -> DataFrame:
    """Receipts exist for transactions that start with a view; their block lies one later."""
    rows = V.logs(spark, folder).groupBy("tx_hash").agg(F.min_by("topic0", "block_number").alias("t"), F.min("block_number").alias("b"), F.min(F.unix_seconds("block_time")).alias("s"))
    return rows.where(F.col("t") == "view").select(
        "tx_hash", (F.col("b") + 1).alias("block_number"), F.col("s").alias("block_timestamp"), F.lit(3).cast(LONG).alias("transaction_index"), F.lit(1).cast(LONG).alias("status"))


def _fold(spark, folder):
    return INC.tx_role_fold(incident_events(spark, folder), statuses(spark, folder))


V.register_view_sql("h_status", """h_status AS (
  SELECT tx_hash, min(block_number) + 1 AS block_number, min(us // 1000000) AS stamp FROM h_logs GROUP BY 1 HAVING arg_min(topic0, block_number) = 'view')""")
V.register_view_sql("h_fold", """h_fold AS (
  SELECT e.chain AS kase, e.tx_hash, string_agg(DISTINCT role, '+' ORDER BY role) AS tx_role, string_agg(DISTINCT actor, ',' ORDER BY actor) AS actor,
         string_agg(DISTINCT asset, ',' ORDER BY asset) AS asset, count(*) AS event_count, coalesce(sum(value) FILTER (role = 'SUPPLY'), 0) AS supplied,
         coalesce(sum(value) FILTER (role = 'BORROW'), 0) AS borrowed, coalesce(any_value(s.block_number), min(e.block_number)) AS block_number,
         coalesce(any_value(s.stamp), arg_min(e.us // 1000000, e.block_number)) AS stamp, CAST(CASE WHEN any_value(s.tx_hash) IS NOT NULL THEN 3 ELSE 0 END AS BIGINT) AS transaction_index,
         min(log_index) AS log_index, CASE WHEN any_value(s.tx_hash) IS NOT NULL THEN CAST(1 AS BIGINT) END AS receipt_status
  FROM (SELECT *, CASE topic0 WHEN 'click' THEN 'SUPPLY' WHEN 'purchase' THEN 'BORROW' ELSE 'LIQUIDATE' END AS role FROM h_logs WHERE topic0 IN ('click', 'purchase', 'error')) e
  LEFT JOIN h_status s ON s.tx_hash = e.tx_hash GROUP BY 1, 2)""")
INCIDENT_VIEWS = ["h_logs", "h_status", "h_fold"]
QUERIES["tx_role_fold"] = lambda spark, folder: _fold(spark, folder).select(
    "case", "tx_hash", "tx_role", "actor", "asset", "event_count", F.round("supplied", 4).alias("supplied"), F.round("borrowed", 4).alias("borrowed"), "block_number", "block_timestamp",
    "transaction_index", "log_index", "receipt_status")
SQL["tx_role_fold"] = V.with_views(INCIDENT_VIEWS, """
SELECT kase AS "case", tx_hash, tx_role, actor, asset, event_count, round(supplied, 4) AS supplied, round(borrowed, 4) AS borrowed, block_number, stamp AS block_timestamp, transaction_index,
       log_index, receipt_status FROM h_fold""")
QUERIES["role_addresses"] = lambda spark, folder: INC.role_addresses(incident_events(spark, folder))
SQL["role_addresses"] = V.with_views(["h_logs"], """
SELECT chain AS "case", CASE topic0 WHEN 'click' THEN 'SUPPLY' WHEN 'purchase' THEN 'BORROW' ELSE 'LIQUIDATE' END AS role, actor AS address, count(*) AS event_count,
       count(DISTINCT tx_hash) AS tx_count, min(us // 1000000) AS first_tx_time, max(us // 1000000) AS last_tx_time
FROM h_logs WHERE topic0 IN ('click', 'purchase', 'error') GROUP BY 1, 2, 3""")
QUERIES["incident_boundaries"] = lambda spark, folder: INC.incident_boundaries(_fold(spark, folder))
SQL["incident_boundaries"] = V.with_views(INCIDENT_VIEWS, """
, x AS (SELECT 'LAST_CONFIRMED_LIFECYCLE_TX' AS boundary_type, * FROM h_fold UNION ALL SELECT 'LAST_CONFIRMED_BORROW_TX', * FROM h_fold WHERE contains(tx_role, 'BORROW'))
SELECT kase AS "case", boundary_type, tx_hash, block_number, stamp AS block_timestamp, actor, receipt_status FROM x
QUALIFY row_number() OVER (PARTITION BY kase, boundary_type ORDER BY stamp DESC, block_number DESC, tx_hash DESC) = 1""")


def _summary(spark, folder):
    people = INC.role_addresses(incident_events(spark, folder))
    return INC.incident_summary(_fold(spark, folder), people).withColumn("borrowed", F.round("borrowed", 3))


QUERIES["incident_summary"] = _summary
SQL["incident_summary"] = V.with_views(INCIDENT_VIEWS, """
SELECT f.kase AS "case", count(*) FILTER (contains(tx_role, 'SUPPLY')) AS deposit_tx_count, count(*) FILTER (contains(tx_role, 'BORROW')) AS borrow_tx_count,
       count(*) FILTER (contains(tx_role, 'LIQUIDATE')) AS liquidation_tx_count, count(*) AS lifecycle_tx_count, max(stamp) AS last_lifecycle_time,
       arg_max(tx_hash, (stamp, block_number, tx_hash)) AS last_lifecycle_tx, arg_max(tx_hash, (stamp, block_number, tx_hash)) FILTER (contains(tx_role, 'BORROW')) AS last_borrow_tx,
       round(sum(borrowed), 3) AS borrowed, any_value(a.n) AS attacker_count
FROM h_fold f LEFT JOIN (SELECT chain, count(DISTINCT actor) AS n FROM h_logs WHERE topic0 IN ('click', 'purchase', 'error') GROUP BY 1) a ON a.chain = f.kase GROUP BY 1""")


def _trace_rows(spark, folder):
    marks = INC.incident_boundaries(_fold(spark, folder)).where(F.col("boundary_type") == "LAST_CONFIRMED_BORROW_TX").withColumn("target", F.lit("feed")).withColumn("reason", F.lit("marker"))
    rows = INC.attack_tx_trace(_fold(spark, folder), marks, F.lit("LUNA"))
    return rows.select("case", "event_type", "block_number", "block_timestamp", "transaction_index", "log_index", "tx_hash", "input_ord",
                       F.coalesce("decoded.borrower", "decoded.supplier", "decoded.feed").alias("who"))


QUERIES["build_trace"] = _trace_rows
SQL["build_trace"] = V.with_views(INCIDENT_VIEWS, """
SELECT kase AS "case", CASE WHEN contains(tx_role, 'BORROW') THEN 'BORROW' ELSE 'SUPPLY' END AS event_type, block_number, stamp AS block_timestamp, transaction_index, log_index, tx_hash,
       row_number() OVER (PARTITION BY kase ORDER BY stamp, block_number, tx_hash) AS input_ord, actor AS who FROM h_fold
UNION ALL
SELECT * FROM (SELECT kase, 'STALE_ORACLE_START', block_number, stamp, CAST(0 AS BIGINT), CAST(0 AS BIGINT), tx_hash, CAST(0 AS BIGINT), 'feed' FROM h_fold WHERE contains(tx_role, 'BORROW')
  QUALIFY row_number() OVER (PARTITION BY kase ORDER BY stamp DESC, block_number DESC, tx_hash DESC) = 1)""")


def receipt_logs(spark, folder) -> DataFrame:
    rows = V.logs(spark, folder)
    topics = F.when(F.col("k") % 10 > 0, F.array("topic0", "asset")).otherwise(F.array().cast("array<string>"))
    return rows.select("tx_hash", "block_number", F.lit(0).cast(LONG).alias("transaction_index"), F.col("log_index").cast(LONG).alias("log_index"),
                       F.col("contract_address").alias("address"), topics.alias("topics"), F.lit("0x").alias("data"), F.lit(1).cast(LONG).alias("receipt_status"))


def _pre_attack(spark, folder):
    edges = V.logs(spark, folder).where(F.col("topic0") == "signup").select(F.col("blockchain").alias("case"), F.lit("binding").alias("boundary_type"), "tx_hash")
    attacks = V.logs(spark, folder).where((F.col("topic0") == "error") & (F.col("value") >= 300)).select(
        F.col("blockchain").alias("case"), "block_number", F.lit(0).cast(LONG).alias("transaction_index"))
    return INC.pre_attack_logs(receipt_logs(spark, folder), edges, attacks)


_PRE_SQL = """
, a AS (SELECT chain, min(block_number) AS before FROM h_logs WHERE topic0 = 'error' AND value >= 300 GROUP BY 1),
e AS (SELECT DISTINCT chain, tx_hash FROM h_logs WHERE topic0 = 'signup'),
p AS (SELECT e.chain AS kase, l.* FROM h_logs l JOIN e ON e.tx_hash = l.tx_hash JOIN a ON a.chain = e.chain WHERE l.block_number < a.before)"""
QUERIES["pre_attack_logs"] = lambda spark, folder: _pre_attack(spark, folder).select("case", "tx_hash", "block_number", "log_index", "address", "topic0")
SQL["pre_attack_logs"] = V.with_views(["h_logs"], _PRE_SQL + """
SELECT kase AS "case", tx_hash, block_number, log_index, contract AS address, CASE WHEN k % 10 > 0 THEN topic0 ELSE '' END AS topic0 FROM p""")
QUERIES["pre_attack_topic_coverage"] = lambda spark, folder: INC.topic_coverage(_pre_attack(spark, folder))
SQL["pre_attack_topic_coverage"] = V.with_views(["h_logs"], _PRE_SQL + """
SELECT kase AS "case", count(*) AS pre_attack_log_count, count(*) FILTER (k % 10 > 0) AS pre_attack_topic_log_count,
       count(*) FILTER (k % 10 > 0) || '/' || count(*) AS pre_attack_topic_coverage FROM p GROUP BY 1""")


def _footprint(spark, folder):
    rows = [(f"case_{c}", f"addr_{a}", c, a, 0, 10**12, "role_x") for c in V.CHAINS for a in ("C1", "C7", "C99")]
    targets = R.inline(spark, rows, "case_key string, addr_key string, chain string, address string, start_block long, end_block long, role string")
    targets = targets.withColumn("start_date", F.lit("2024-01-05").cast("date")).withColumn("end_date", F.lit("2024-01-20").cast("date"))
    table = INC.config_log_footprint(targets, V.logs(spark, folder), {"signup": "FeedSet"}, exact=True)
    return table.select("case_key", "chain", "addr_key", "topic0", "log_count", "tx_count", "first_block", "latest_tx_hash", "latest_block", "topic_name", "address", "role")


QUERIES["config_log_footprint"] = _footprint
SQL["config_log_footprint"] = V.with_views(["h_logs"], """
SELECT 'case_' || c.chain AS case_key, c.chain, 'addr_' || a.address AS addr_key, l.topic0, count(l.tx_hash) AS log_count, count(DISTINCT l.tx_hash) AS tx_count, min(l.block_number) AS first_block,
       arg_max(l.tx_hash, l.block_number) AS latest_tx_hash, max(l.block_number) AS latest_block, CASE WHEN l.topic0 = 'signup' THEN 'FeedSet' ELSE '' END AS topic_name, a.address, 'role_x' AS role
FROM (VALUES ('ethereum'), ('bnb'), ('base'), ('avalanche_c')) c(chain), (VALUES ('C1'), ('C7'), ('C99')) a(address)
LEFT JOIN h_logs l ON l.chain = c.chain AND l.contract = a.address AND l.block_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
GROUP BY c.chain, a.address, l.topic0""")


def _histogram(spark, folder):
    table = INC.tx_event_histogram(V.logs(spark, folder).withColumn("event_name", F.col("topic0")))
    cells = F.transform(F.map_entries("events"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return table.select("tx_hash", F.array_join(cells, ",").alias("events"), "log_count", F.array_join("touched_addresses", ",").alias("touched_addresses"))


QUERIES["tx_event_histogram"] = _histogram
SQL["tx_event_histogram"] = V.with_views(["h_logs"], """
, c AS (SELECT tx_hash, topic0, count(*) AS n FROM h_logs GROUP BY 1, 2)
SELECT c.tx_hash, string_agg(topic0 || '=' || n, ',' ORDER BY topic0) AS events, CAST(sum(n) AS BIGINT) AS log_count, any_value(t.touched) AS touched_addresses
FROM c JOIN (SELECT tx_hash, string_agg(DISTINCT contract, ',' ORDER BY contract) AS touched FROM h_logs GROUP BY 1) t ON t.tx_hash = c.tx_hash GROUP BY 1""")


def _calls(spark, folder):
    """Conversations as call trees: a turn is a call at its depth."""
    rows = V.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("depth"), F.col("role").alias("type"), F.upper("role").alias("from"), F.lit("").alias("to"))
    table = INC.call_tree_summary(rows)
    cells = F.transform(F.map_entries("call_types"), lambda e: F.concat_ws("=", e.key, e.value.cast("string")))
    return table.select("trace_id", "call_count", "max_depth", F.array_join(cells, ",").alias("call_types"), F.array_join("touched_addresses", ",").alias("touched_addresses"))


QUERIES["call_tree_summary"] = _calls
SQL["call_tree_summary"] = """
WITH c AS (SELECT conv_id, role, count(*) AS n, max(turn) AS d FROM conversations GROUP BY 1, 2)
SELECT conv_id AS trace_id, CAST(sum(n) AS BIGINT) AS call_count, max(d) AS max_depth, string_agg(role || '=' || n, ',' ORDER BY role) AS call_types,
       string_agg(lower(role), ',' ORDER BY lower(role)) AS touched_addresses FROM c GROUP BY 1"""


def _windows(spark, folder):
    rows = [("ethereum", "2024-01-02T00:00:00.000Z", None), ("bnb", None, "2024-01-09 10:00:00 UTC"), ("base", "2024-02-02 00:00:00", None), ("avalanche_c", None, None)]
    keys = ["config_time", "first_attack_time", "window_end", "last_lifecycle_time", "last_attack_time", "last_boundary_time"]
    summaries = R.inline(spark, rows, "case string, natural_window_start string, exploit_time string").select("*", *[F.lit(None).cast("string").alias(k) for k in keys])
    table = INC.case_windows(summaries, RQ.trace(spark, folder))
    return table.select("case", F.unix_seconds("incident_start").alias("start_s"), F.unix_seconds("incident_end").alias("end_s"))


QUERIES["case_windows"] = _windows
SQL["case_windows"] = V.with_views(["h_logs", "h_trace"], """
, s(kase, s, e) AS (VALUES ('ethereum', TIMESTAMP '2024-01-02 00:00:00', NULL), ('bnb', NULL, TIMESTAMP '2024-01-09 10:00:00'), ('base', TIMESTAMP '2024-02-02 00:00:00', NULL), ('avalanche_c', NULL, NULL)),
t AS (SELECT kase, min(stamp) AS lo, max(stamp) AS hi FROM h_trace GROUP BY 1),
w AS (SELECT s.kase, coalesce(epoch_us(s.s) // 1000000, lo) AS a, coalesce(epoch_us(s.e) // 1000000, hi) AS b FROM s JOIN t ON t.kase = s.kase)
SELECT kase AS "case", a AS start_s, CASE WHEN b < a THEN a + 86400 ELSE b END AS end_s FROM w""")


def _positives(spark, folder):
    return INC.positive_cases(RQ.trace(spark, folder), CQ.case_manifest(spark)).select(
        "sample_id", "chain", "display_chain", "year", "scope_class", "tx_hash", "trigger_tx_hash", "first_impact_tx_hash", "contract_address")


QUERIES["positive_cases"] = _positives
SQL["positive_cases"] = V.with_views(["h_logs", "h_trace", "h_cases"], f"""
, t AS (SELECT chain AS kase, arg_min(tx_hash, block_number) AS tx, arg_min(lower(contract), block_number) AS c FROM h_logs WHERE topic0 = 'signup' GROUP BY 1),
i AS (SELECT kase, arg_min(tx_hash, pos) AS tx FROM h_trace WHERE event_type IN ('BORROW', 'LIQUIDATE') GROUP BY 1)
SELECT 'positive-' || c.kase AS sample_id, c.chain, c.display_chain, CAST(2024 AS BIGINT) AS year,
       CASE c.failure_class WHEN '{R.FEED_BINDING}' THEN 'S2' WHEN '{R.FRESHNESS}' THEN 'S1' ELSE 'S3' END AS scope_class, t.tx AS tx_hash, t.tx AS trigger_tx_hash,
       i.tx AS first_impact_tx_hash, t.c AS contract_address FROM h_cases c JOIN t ON t.kase = c.kase JOIN i ON i.kase = c.kase""")

# --- audits and trends ----------------------------------------------------------------------------------------


def _planted(spark, folder) -> DataFrame:
    """Documents with an address and a hash appended; some are placeholders."""
    digit = F.substring("_h", 1, 1)
    address = F.when(F.col("lang") == "en", F.repeat(digit, 40)).otherwise(F.substring("_h", 1, 40))
    tx = F.when(F.col("source").isNotNull() & (digit < "4"), F.concat(F.repeat(digit, 60), F.lit("aaaa"))).otherwise(F.col("_h"))
    docs = V.table(spark, folder, "documents").withColumn("_h", F.sha2(F.col("doc_id").cast("string"), 256))
    return docs.select("doc_id", F.concat_ws(" ", "text", F.concat(F.lit("0x"), address), F.concat(F.lit("0x"), tx)).alias("text"))


def _marked_pages(spark, folder) -> DataFrame:
    """Whole pages; a third of them call themselves a fixture at the end."""
    marked = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.lit(" Fixture")).otherwise(F.lit("")))
    return V.table(spark, folder, "pages").select("page_id", marked.alias("t"))


QUERIES["placeholder_scan"] = lambda spark, folder: AUD.placeholder_values(_planted(spark, folder), "doc_id", "text")
SQL["placeholder_scan"] = """
WITH d AS (SELECT doc_id, lang, source, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
v AS (SELECT doc_id, '0x' || CASE WHEN lang = 'en' THEN repeat(h[1], 40) ELSE substr(h, 1, 40) END AS value, lang = 'en' AS hit FROM d
      UNION ALL SELECT doc_id, '0x' || CASE WHEN source IS NOT NULL AND h[1] < '4' THEN repeat(h[1], 60) || 'aaaa' ELSE h END, source IS NOT NULL AND h[1] < '4' FROM d)
SELECT DISTINCT doc_id, value FROM v WHERE hit"""
QUERIES["synthetic_marker_scan"] = lambda spark, folder: AUD.synthetic_markers(_marked_pages(spark, folder), "page_id", "t").select("page_id", F.md5(F.col("marker").cast("binary")).alias("marker_md5"))
SQL["synthetic_marker_scan"] = f"""
SELECT DISTINCT page_id, md5(t) AS marker_md5 FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN ' Fixture' ELSE '' END AS t FROM pages)
WHERE regexp_matches(lower(t), '{AUD.MARKER_WORDS}')"""


def _paths(spark, folder):
    """Each document as a nested JSON record that holds its planted text in a list of lists."""
    rows = _planted(spark, folder)
    record = F.to_json(F.struct("doc_id", F.struct(F.array(F.array(F.lit("plain"), F.col("text")), F.array().cast("array<string>")).alias("lists")).alias("meta")))
    return AUD.placeholder_paths(rows.select("doc_id", record.alias("record")), "doc_id", "record")


QUERIES["placeholder_paths"] = _paths
SQL["placeholder_paths"] = """
WITH d AS (SELECT doc_id, lang, source, text, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
v AS (SELECT doc_id, 'address' AS kind, '0x' || CASE WHEN lang = 'en' THEN repeat(h[1], 40) ELSE substr(h, 1, 40) END AS value, lang = 'en' AS hit FROM d
      UNION ALL SELECT doc_id, 'transaction', '0x' || CASE WHEN source IS NOT NULL AND h[1] < '4' THEN repeat(h[1], 60) || 'aaaa' ELSE h END, source IS NOT NULL AND h[1] < '4' FROM d),
m AS (SELECT DISTINCT doc_id, 'marker' AS kind, unnest(regexp_extract_all(lower(text), '(synthetic|fixture|placeholder)')) AS value FROM documents)
SELECT DISTINCT doc_id, '$.meta.lists[0][1]' AS path, kind, value FROM (SELECT doc_id, kind, value FROM v WHERE hit UNION ALL SELECT * FROM m)"""


def _flows(spark, folder):
    rows = V.table(spark, folder, "lineitem").select(
        "l_returnflag", V.hash_of(F.col("l_orderkey")).alias("tx_hash"), F.col("l_linenumber").alias("log_index"), F.col("l_partkey").alias("token_address"),
        F.col("l_suppkey").alias("from"), F.lit("x").alias("to"), F.col("l_quantity").alias("amount_raw"))
    nested = rows.groupBy("l_returnflag", "tx_hash").agg(F.collect_list(F.struct("tx_hash", "log_index", "token_address", "from", "to", "amount_raw")).alias("flows"))
    return AUD.nested_flow_counts(nested.drop("tx_hash"), "l_returnflag", "flows")


QUERIES["distinct_flow_count"] = _flows
SQL["distinct_flow_count"] = """
SELECT l_returnflag, count(*) AS transfer_flow_count FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem) GROUP BY 1"""


def _audit(spark, folder):
    rows = [(c, i % 2 == 0, i < 3, True) for i, c in enumerate(V.CHAINS)]
    evidence = R.inline(spark, rows, "case string, raw_receipt_present boolean, has_raw_config_log boolean, locator_exists boolean")
    found = RQ.result(spark, folder)
    return AUD.audit_dataset(RQ.trace(spark, folder), found.alerts, found.actors, evidence)


QUERIES["audit_dataset"] = lambda spark, folder: _audit(spark, folder).select(
    "case", "trace_records", "alerts", "attacker_candidates", "has_real_attacker", "placeholder_count", "fixture_tx_count", "borrow_tx_count", "transfer_flow_count", "status")
SQL["audit_dataset"] = V.with_views([*RQ.ALERT_VIEWS, "h_marks"], """
, e(kase, raw, config) AS (VALUES ('ethereum', true, true), ('bnb', false, true), ('base', true, true), ('avalanche_c', false, false)),
t AS (SELECT kase, count(*) AS n, count(*) FILTER (k % 9 = 0 AND kase <> 'ethereum') AS flows, count(DISTINCT CASE WHEN event_type = 'BORROW' THEN tx_hash END) AS b,
             count(*) FILTER (regexp_matches(tx_hash, '^0x0{60}') AND len(list_distinct(string_split(substr(tx_hash, 3), ''))) <= 2) AS fixture,
             count(DISTINCT CASE WHEN regexp_matches(tx_hash, '^0x0{60}') AND len(list_distinct(string_split(substr(tx_hash, 3), ''))) <= 2 THEN tx_hash END)
               + count(DISTINCT CASE WHEN who = '0x0000000000000000000000000000000000000000' THEN who END) AS p FROM h_trace GROUP BY 1),
m AS (SELECT kase, count(DISTINCT address) AS n, bool_or(address <> '0x0000000000000000000000000000000000000000') AS real FROM h_marks GROUP BY 1),
a AS (SELECT "case" AS kase, count(*) AS n FROM h_alerts GROUP BY 1)
SELECT e.kase AS "case", t.n AS trace_records, a.n AS alerts, m.n AS attacker_candidates, m.real AS has_real_attacker, t.p AS placeholder_count, t.fixture AS fixture_tx_count, t.b AS borrow_tx_count,
       t.flows AS transfer_flow_count, CASE WHEN t.p > 0 OR t.fixture > 0 THEN 'fixture_only' WHEN raw AND flows > 0 AND m.real AND config THEN 'real_tx_with_receipt_flow_decode' ELSE 'real_materialized' END AS status
FROM e JOIN t ON t.kase = e.kase JOIN m ON m.kase = e.kase JOIN a ON a.kase = e.kase""")


def _triggers(spark, folder):
    return AUD.trigger_tx(RQ.result(spark, folder).boundary, RQ.cases(spark), ("config", "attacker_eoa"))


def _case_rows(spark, folder):
    incidents = INC.incident_summary(_fold(spark, folder), INC.role_addresses(incident_events(spark, folder))).select("case", F.col("lifecycle_tx_count").alias("impact_tx_count"), "attacker_count")
    return AUD.case_table(RQ.cases(spark), _audit(spark, folder), _triggers(spark, folder), incidents, INC.topic_coverage(_pre_attack(spark, folder)))


QUERIES["report_case_table"] = lambda spark, folder: _case_rows(spark, folder).select("case", "trigger_tx", "impact_tx_count", "attacker_candidates", "pre_attack_topic_coverage", "trace_records", "alerts")
SQL["report_case_table"] = V.with_views([*RQ.ALERT_VIEWS, "h_status", "h_fold"], _PRE_SQL + """
, g AS (SELECT kase, arg_min(tx_hash, pos) AS tx FROM h_broken GROUP BY 1)
SELECT f.kase AS "case", g.tx AS trigger_tx, f.n AS impact_tx_count, k.n AS attacker_candidates, coalesce(p.c, '0/0') AS pre_attack_topic_coverage, t.n AS trace_records, a.n AS alerts
FROM (SELECT kase, count(*) AS n FROM h_fold GROUP BY 1) f JOIN g ON g.kase = f.kase
JOIN (SELECT chain, count(DISTINCT actor) AS n FROM h_logs WHERE topic0 IN ('click', 'purchase', 'error') GROUP BY 1) k ON k.chain = f.kase
LEFT JOIN (SELECT kase, count(*) FILTER (k % 10 > 0) || '/' || count(*) AS c FROM p GROUP BY 1) p ON p.kase = f.kase
JOIN (SELECT kase, count(*) AS n FROM h_trace GROUP BY 1) t ON t.kase = f.kase JOIN (SELECT "case" AS kase, count(*) AS n FROM h_alerts GROUP BY 1) a ON a.kase = f.kase""")


def _closure_rows(spark, folder):
    incidents = INC.incident_summary(_fold(spark, folder), INC.role_addresses(incident_events(spark, folder))).select("case", F.col("lifecycle_tx_count").alias("impact_tx_count"), "attacker_count")
    state = RQ.result(spark, folder).state
    return AUD.closure_table(RQ.cases(spark), _audit(spark, folder), _triggers(spark, folder), state, incidents, INC.topic_coverage(_pre_attack(spark, folder)))


QUERIES["report_closure_table"] = lambda spark, folder: _closure_rows(spark, folder).drop("evidence_status")
SQL["report_closure_table"] = V.with_views([*RQ.ALERT_VIEWS, "h_status", "h_fold"], _PRE_SQL + """
, c(kase, raw) AS (VALUES ('ethereum', true), ('bnb', false), ('base', true), ('avalanche_c', false))
SELECT c.kase AS "case", c.kase IN (SELECT kase FROM h_broken WHERE tx_hash <> '') AS has_trigger,
       c.kase IN (SELECT kase FROM h_trace WHERE event_type = 'ORACLE_FEED_SET') AS has_oracle_anomaly, c.kase IN (SELECT kase FROM h_fold) AS has_lending_impact,
       c.kase IN (SELECT chain FROM h_logs WHERE topic0 IN ('click', 'purchase', 'error')) AS has_actor, c.kase IN (SELECT kase FROM h_trace) AS has_temporal_order,
       c.kase IN (SELECT "case" FROM h_alerts) AS has_replayable_constraint, c.raw AS raw_receipt_present,
       (SELECT count(*) FROM h_trace t WHERE t.kase = c.kase AND k % 9 = 0 AND kase <> 'ethereum') AS transfer_flow_count,
       c.kase IN (SELECT kase FROM p WHERE k % 10 > 0) AS has_pre_attack_topics FROM c""")


def _loss_rows(spark, folder):
    """Known losses of the transactions of each supplier's nation, with a public figure for every second one."""
    nation = V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("market"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("case"))
    sold = V.table(spark, folder, "lineitem").join(nation, F.col("l_suppkey") == F.col("market"), "left")
    public = F.when(F.substring("case", 2, 9).cast("int") % 2 == 0, F.lit(1e6))
    losses = sold.groupBy("case").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("known_usd_estimate")).withColumn("public_reference", public)
    cases = V.table(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("case"))
    return AUD.loss_table(cases, losses).select("case", F.round("known_usd_estimate", 2).alias("known_usd_estimate"), "public_reference", F.round("coverage", 6).alias("coverage"))


QUERIES["report_loss_table"] = _loss_rows
SQL["report_loss_table"] = """
WITH l AS (SELECT s_nationkey AS n, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS usd FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT 'n' || n_nationkey AS "case", round(usd, 2) AS known_usd_estimate, CASE WHEN l.n % 2 = 0 THEN 1e6::DOUBLE END AS public_reference,
       round(CASE WHEN l.n % 2 = 0 THEN usd / 1e6::DOUBLE END, 6) AS coverage FROM nation LEFT JOIN l ON l.n = n_nationkey"""


def _benign(spark, folder):
    """Each event as a benign sample, with the logs of its transaction that match it; half the chains decode, one looks for a feed."""
    logs, k = V.logs(spark, folder), F.col("k")
    word = lambda n: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 64, "0"))
    address = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(k % 20)), 40, "0"))
    receipts = logs.select("tx_hash", address.alias("address"), "topic0", F.array(F.col("topic0"), word(k % 5), word(k % 7)).alias("topics"), F.col("log_index").cast(LONG).alias("log_index"))
    samples = logs.select(F.concat(F.lit("s"), F.col("block_number").cast("string")).alias("sample_id"), "tx_hash", F.col("blockchain").alias("case_related_to"), address.alias("contract_address"), "topic0")
    abi = R.inline(spark, [("signup", "FeedSet"), ("view", "AnswerUpdated")], "topic0 string, event_name string")
    zero, one = f"0x{0:040x}", f"0x{1:040x}"
    modes = [("ethereum", "decode", None, None, None), ("bnb", "decode", None, None, None), ("base", "receipt", None, None, None), ("avalanche_c", "feed", zero, one, zero)]
    rules = R.inline(spark, modes, "case string, mode string, asset string, forbidden_feed string, expected_feed string")
    return SMP.classify_samples(samples, receipts, abi, rules)


QUERIES["classify_samples"] = lambda spark, folder: _benign(spark, folder).select(
    "sample_id", "verification_status", "replay_event_type", "matching_log_count", F.col("first_log_index").cast(LONG).alias("first_log_index"))
V.register_view_sql("h_classified", f"""h_classified AS (
  SELECT sample_id, matching_log_count, first_log_index,
         CASE chain WHEN 'avalanche_c' THEN coalesce(verdict, '{R.STRICT_STATUSES[1]}') WHEN 'base' THEN '{R.STRICT_STATUSES[0]}'
              ELSE CASE WHEN topic0 IN ('signup', 'view') THEN '{R.STRICT_STATUSES[0]}' ELSE '{R.UNKNOWN_STATUSES[0]}' END END AS verification_status,
         CASE WHEN chain = 'avalanche_c' AND verdict IS NOT NULL THEN '{R.FEED_SET}' ELSE 'BENIGN_ORACLE_SCOPE_LOG' END AS replay_event_type
  FROM (SELECT 's' || s.block_number AS sample_id, any_value(s.chain) AS chain, any_value(s.topic0) AS topic0, count(*) AS matching_log_count, min(l.log_index) AS first_log_index,
               arg_min(CASE WHEN l.k % 5 = 0 AND l.k % 7 = 1 THEN 'violated_constraint' WHEN l.k % 5 = 0 AND l.k % 7 <> 0 THEN 'needs_review_case_asset_other_feed' END, l.log_index)
                 FILTER (l.k % 5 = 0 AND l.k % 7 <> 0) AS verdict
        FROM h_logs s JOIN h_logs l ON l.tx_hash = s.tx_hash AND l.k % 20 = s.k % 20 AND l.topic0 = s.topic0 GROUP BY s.block_number))""")
SQL["classify_samples"] = V.with_views(["h_logs", "h_classified"], "SELECT sample_id, verification_status, replay_event_type, matching_log_count, first_log_index FROM h_classified")
QUERIES["benign_replay_summary"] = lambda spark, folder: EV.benign_replay_summary(_benign(spark, folder), RQ.result(spark, folder))
SQL["benign_replay_summary"] = V.with_views([*RQ.ALERT_VIEWS, "h_classified"], f"""
SELECT (SELECT count(*) FROM h_alerts) AS replay_alert_count, count(*) AS sample_rows, count(*) FILTER (verification_status = '{R.REVIEW_STATUSES[0]}') AS needs_review_count FROM h_classified""")


def _ranked_evidence(spark, folder):
    """Closure candidates in the order in which they are looked at, for each chain and class."""
    found = CL.candidates(spark, folder)
    window = Window.partitionBy("chain", "failure_class").orderBy(*C.evidence_order(found), "boundary_tx_hash", "trigger_block")
    return found.select("chain", "failure_class", "boundary_tx_hash", "trigger_block", F.row_number().over(window).cast(LONG).alias("place"))


QUERIES["evidence_ranked"] = _ranked_evidence
SQL["evidence_ranked"] = V.with_views(V.CLOSURE_VIEWS, CL._ALL_SQL + f"""
SELECT chain, failure_class, trigger_tx AS boundary_tx_hash, trigger_block, row_number() OVER (PARTITION BY chain, failure_class ORDER BY
  CASE evidence_tier WHEN '{R.TIER_A}' THEN 1 WHEN '{R.TIER_B}' THEN 2 ELSE 3 END, trigger_to_impact_seconds, impact_tx_count DESC,
  CASE WHEN failure_class = '{R.FRESHNESS}' THEN 2 WHEN scope_class IN ('{R.S2}', '{R.S3}') THEN 1 ELSE 2 END, chain, trigger_year, trigger_tx, trigger_block) AS place FROM tiered""")


def _monthly(spark, folder):
    """Orders by date as boundary logs, so that the series spans many months."""
    logs = V.table(spark, folder, "orders").select(
        BQ.at(V.CHAINS, F.col("o_custkey") % 4).alias("blockchain"), F.col("o_orderdate").cast("date").alias("block_date"), V.hash_of(F.col("o_orderkey")).alias("tx_hash"),
        F.col("o_custkey").cast("string").alias("contract_address"), F.col("o_orderpriority").alias("topic0"))
    rules = R.inline(spark, [(t, s, t, t, False) for t, s in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), (R.S1, R.S2, R.S3, R.S4), strict=True)], R.BOUNDARY_SCHEMA)
    return logs, rules


V.register_view_sql("h_orders", f"""h_orders AS (
  SELECT {BQ._chain_sql('o_custkey')} AS chain, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS tx, o_custkey AS contract, o_orderpriority AS p FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'))""")
V.register_view_sql("h_monthly", """h_monthly AS (
  SELECT coalesce(chain, 'all_active_case_chains') AS chain, month, count(*) AS oracle_log_count, count(DISTINCT tx) AS oracle_tx_count, count(DISTINCT contract) AS oracle_contract_count,
         count(*) FILTER (p = '1-URGENT') AS s1_price_reporting_log_count, count(*) FILTER (p = '2-HIGH') AS s2_feed_binding_log_count, count(*) FILTER (p = '3-MEDIUM') AS s3_route_config_log_count,
         count(*) FILTER (p = '4-NOT SPECIFIED') AS s4_governance_config_log_count, CAST(0 AS BIGINT) AS s5_contextual_wiring_log_count
  FROM h_orders GROUP BY GROUPING SETS ((chain, month), (month)))""")
_TEXT_MONTH = lambda df, *names: df.select(*[F.col(c).cast("string").alias(c) if c in names else F.col(c) for c in df.columns])
QUERIES["monthly_trend"] = lambda spark, folder: _TEXT_MONTH(TR.monthly_trend(*_monthly(spark, folder), exact=True), "month")
SQL["monthly_trend"] = V.with_views(["h_orders", "h_monthly"], "SELECT * REPLACE (CAST(month AS VARCHAR) AS month) FROM h_monthly")


def _slopes(spark, folder):
    table = TR.trend_summary(TR.monthly_trend(*_monthly(spark, folder), exact=True))
    return _TEXT_MONTH(table, "first_month", "latest_month", "peak_month").withColumn("log_slope", F.round("log_slope", 6)).withColumn("contract_slope", F.round("contract_slope", 6))


QUERIES["trend_slope"] = _slopes
SQL["trend_slope"] = V.with_views(["h_orders", "h_monthly"], """
, x AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY month) - 1 AS i FROM h_monthly)
SELECT chain, CAST(min(month) AS VARCHAR) AS first_month, CAST(max(month) AS VARCHAR) AS latest_month, CAST(arg_min(month, (-oracle_log_count, month)) AS VARCHAR) AS peak_month,
       max(oracle_log_count) AS peak_log_count, round(coalesce(regr_slope(oracle_log_count, i), 0), 6) AS log_slope, round(coalesce(regr_slope(oracle_contract_count, i), 0), 6) AS contract_slope
FROM x GROUP BY 1""")
QUERIES["cumulative_first_seen"] = lambda spark, folder: _TEXT_MONTH(TR.cumulative_trend(*_monthly(spark, folder)), "month")
SQL["cumulative_first_seen"] = V.with_views(["h_orders"], """
, f AS (SELECT chain, contract, min(month) AS month FROM h_orders GROUP BY 1, 2),
m AS (SELECT coalesce(chain, 'all_active_case_chains') AS chain, month, CAST(sum(l) AS BIGINT) AS l, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT chain, month, count(*) AS l, 0 AS n FROM h_orders GROUP BY 1, 2 UNION ALL SELECT chain, month, 0, count(*) FROM f GROUP BY 1, 2) GROUP BY GROUPING SETS ((chain, month), (month)))
SELECT chain, CAST(month AS VARCHAR) AS month, l AS monthly_oracle_log_count, n AS monthly_new_contract_count, CAST(sum(l) OVER w AS BIGINT) AS cumulative_oracle_log_count,
       CAST(sum(n) OVER w AS BIGINT) AS cumulative_unique_contract_count FROM m WINDOW w AS (PARTITION BY chain ORDER BY month)""")


def _impact_rows(spark: SparkSession, folder: str) -> DataFrame:
    return CL.impact(spark, folder).select("chain", "impact_tx_hash", "actor", "market_contract", "protocol_cluster_id", "impact_rule_id", "impact_log_key")


QUERIES["impact_lending_logs"] = _impact_rows
SQL["impact_lending_logs"] = V.with_views(["h_logs", "h_markets", "h_tx", "h_impact"], """
SELECT chain, tx_hash AS impact_tx_hash, actor, contract AS market_contract, cluster AS protocol_cluster_id, rule AS impact_rule_id, tx_hash || ':' || log_index AS impact_log_key FROM h_impact""")
