"""Raw logs to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import abi as ABI
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.functions import words as W


def _decoded(logs: DataFrame, topic: str, needed: int) -> DataFrame:
    """Logs of one topic whose data holds at least ``needed`` words."""
    return logs.where((F.lower("topic0") == topic) & (F.length(W.hex_body(F.col("data"))) > 64 * (needed - 1)))


def _raw(index: int) -> Column:
    return W.uint_decimal(W.word_at(F.col("data"), index))


def decode_compound_events(logs: DataFrame, decimals: Column | int | None = None) -> DataFrame:
    """Mint, borrow and interest events of pooled lending markets, one typed row each.

    ``decimals`` adds ``amount`` in token units for mints and borrows.
    """
    base = ["blockchain", "block_time", "block_number", "tx_hash", "log_index"]
    market = T.address(F.col("contract_address")).alias("market_address")
    who = W.word_address(W.word_at(F.col("data"), 0)).alias("account")
    none = F.lit(None).cast("decimal(38,0)")
    mint = _decoded(logs, R.COMPOUND_MINT, 3).select(
        *base, F.lit("Mint").alias("event"), market, who, _raw(1).alias("amount_raw"), _raw(2).alias("mint_tokens_raw"),
        none.alias("account_borrows_raw"), none.alias("total_borrows_raw"), none.alias("cash_prior_raw"),
        none.alias("interest_accumulated_raw"), none.alias("borrow_index_raw"),
    )
    borrow = _decoded(logs, R.COMPOUND_BORROW, 4).select(
        *base, F.lit("Borrow").alias("event"), market, who, _raw(1).alias("amount_raw"), none.alias("mint_tokens_raw"),
        _raw(2).alias("account_borrows_raw"), _raw(3).alias("total_borrows_raw"), none.alias("cash_prior_raw"),
        none.alias("interest_accumulated_raw"), none.alias("borrow_index_raw"),
    )
    interest = _decoded(logs, R.COMPOUND_ACCRUE_INTEREST, 4).select(
        *base, F.lit("AccrueInterest").alias("event"), market, F.lit(None).cast("string").alias("account"), none.alias("amount_raw"),
        none.alias("mint_tokens_raw"), none.alias("account_borrows_raw"), _raw(3).alias("total_borrows_raw"), _raw(0).alias("cash_prior_raw"),
        _raw(1).alias("interest_accumulated_raw"), _raw(2).alias("borrow_index_raw"),
    )
    events = mint.unionByName(borrow).unionByName(interest)
    return events if decimals is None else events.withColumn("amount", W.scaled(F.col("amount_raw"), decimals))


def decode_answer_updated(logs: DataFrame, decimals: int = 8) -> DataFrame:
    """Price reports: feed, signed answer, round and update time (0 without data, NULL where a long can't hold it)."""
    reports = logs.where(F.lower("topic0") == R.ANSWER_UPDATED)
    return reports.select(
        "blockchain", "block_date", "block_time", "block_number", "tx_hash", "log_index",
        T.address(F.col("contract_address")).alias("feed"),
        W.int_decimal(F.col("topic1")).alias("answer_raw"),
        W.scaled(W.int_double(F.col("topic1")), decimals).alias("answer"),
        W.uint_decimal(F.col("topic2")).alias("round_id"),
        F.when(W.word_at(F.col("data"), 0).isNull(), F.lit(0)).otherwise(W.uint_decimal(W.word_at(F.col("data"), 0)).try_cast("long")).alias("updated_at"),
    )


def latest_round_data(df: DataFrame, blob: str, into: str, decimals: int = 8) -> DataFrame:
    """Add the five-word round tuple of a call result as a struct; NULL when words are missing.

    The words become columns first, so that each is cut from the text once.
    """
    body = df.withColumn("_body", W.hex_body(F.col(blob)))
    cut = body.select("*", *[F.substring("_body", 64 * i + 1, 64).alias(f"_w{i}") for i in range(5)])
    whole = lambda i: W.word_decimal(F.col(f"_w{i}"))
    read = cut.select(
        *df.columns, "_body", whole(0).alias("_r0"), W.word_int_decimal(F.col("_w1")).alias("_r1"), whole(2).try_cast("long").alias("_r2"),
        whole(3).try_cast("long").alias("_r3"), whole(4).alias("_r4"),
    )
    fields = F.struct(
        F.col("_r0").alias("round_id"), F.col("_r1").alias("answer_raw"), W.scaled(F.col("_r1"), decimals).alias("answer"),
        F.col("_r2").alias("started_at"), F.col("_r3").alias("updated_at"), F.col("_r4").alias("answered_in_round"),
    )
    return read.select(*df.columns, F.when(F.length("_body") >= 64 * 5, fields).alias(into))


def decode_transfers(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token transfers with symbol, amount and class. Tokens without metadata keep the raw amount.

    ``amount_raw`` is NULL above 38 digits (unlimited mints); ``amount_text`` has all digits and ``amount`` falls back on it.
    """
    base = ["blockchain", "block_time", "block_number", "tx_hash", "log_index", "token_address", "from", "to"]
    words = logs.where((F.lower("topic0") == R.ERC20_TRANSFER) & F.col("topic2").isNotNull()).select(
        *base[:5], T.address(F.col("contract_address")).alias("token_address"), W.word_address(F.col("topic1")).alias("from"),
        W.word_address(F.col("topic2")).alias("to"), W.pad_word(F.col("data")).alias("_word"),
    )
    moves = words.select(*base, W.word_decimal(F.col("_word")).alias("amount_raw"), W.word_text(F.col("_word")).alias("amount_text"))
    meta = tokens.select("blockchain", T.address(F.col("contract_address")).alias("token_address"), "symbol", "decimals")
    named = moves.join(meta, ["blockchain", "token_address"], "left")
    amount = W.scaled(F.coalesce(F.col("amount_raw").cast("double"), F.col("amount_text").cast("double")), F.coalesce("decimals", F.lit(0)))
    kind = ID.transfer_class(F.col("from"), F.col("to"), F.col("symbol"), F.col("decimals"))
    return named.select(
        "*", amount.alias("amount"), kind.alias("classification")
    ).withColumn("symbol", F.coalesce("symbol", F.lit("UNKNOWN")))


def flow_direction(attacker: Column, protocol: Column) -> Column:
    """Direction of a transfer as seen from an attacker and a protocol."""
    out_a, in_a = F.col("from") == attacker, F.col("to") == attacker
    out_p, in_p = F.col("from") == protocol, F.col("to") == protocol
    return (
        F.when(out_a & in_p, F.lit("attacker_to_protocol")).when(out_p & in_a, F.lit("protocol_to_attacker"))
        .when(out_a, F.lit("attacker_outbound")).when(in_a, F.lit("attacker_inbound"))
        .when(out_p, F.lit("protocol_outbound")).when(in_p, F.lit("protocol_inbound")).otherwise(F.lit("other"))
    )


def transfer_flows(transfers: DataFrame, attacker: Column, protocol: Column) -> DataFrame:
    return transfers.withColumn("direction", flow_direction(attacker, protocol))


def decode_by_abi(logs: DataFrame, abi: DataFrame) -> DataFrame:
    """Event name and arguments of each log by an ABI table.

    ``abi``: topic0, event_name, inputs array<struct<name,type,indexed>>, one row for each event; tuples are written ``(t,u)``. Indexed
    arguments come from the topics in order (of a type that is no word the topic is a hash and stays), the others from the data: words,
    strings, bytes (hex), arrays (``[a,b]``) and tuples (``(a,b)``), nested at will. A value whose bytes are missing is NULL.

    The distinct types of the table that are no words come to the driver, as each becomes an expression.
    """
    types = abi.select(F.explode("inputs.type").alias("type")).distinct().collect()
    nested = {t: ABI.parse(t) for t in sorted(r["type"] for r in types if r["type"]) if not ABI.is_word(t)}
    indexed = F.filter("inputs", lambda a: a["indexed"])
    plain = F.filter("inputs", lambda a: ~a["indexed"])

    def width(kind: Column) -> Column:
        """Words that an argument takes in the head."""
        wide = F.lit(1)
        for name, parsed in nested.items():
            if parsed.head_words != 1:
                wide = F.when(kind == name, F.lit(parsed.head_words)).otherwise(wide)
        return wide

    def place(inputs: Column, i: Column) -> Column:
        return F.aggregate(F.slice(inputs, F.lit(1), i), F.lit(0), lambda total, arg: total + width(arg["type"]))

    def cells(inputs: Column, words: Column, in_head: bool) -> Column:
        """Name, type, place and head word of each argument, so that what follows refers to a field and not to how it was cut."""
        at = (lambda i: place(inputs, i)) if in_head else (lambda i: i)
        # bound, as a column named once would be cut again for each argument
        return W.bind(words, lambda w: F.transform(inputs, lambda arg, i: F.struct(
            arg["name"].alias("name"), arg["type"].alias("type"), arg["indexed"].alias("indexed"), at(i).alias("at"), F.try_element_at(w, at(i) + 1).alias("word"))))

    joined = logs.join(abi, "topic0", "left").withColumns({"_body": W.hex_body(F.col("data")), "_words": W.words(F.col("data"))})
    rows = joined.withColumn("_cells", F.concat(cells(indexed, F.array("topic1", "topic2", "topic3"), False), cells(plain, F.col("_words"), True)))

    def value(cell: Column, body: Column) -> Column:
        kind, word = cell["type"], cell["word"]
        found = F.when(cell["indexed"] & kind.isin(*nested), word) if nested else F.when(F.lit(False), word)
        for name, parsed in nested.items():
            found = found.when(kind == name, ABI.read(parsed, body, F.lit(0).cast("long"), cell["at"].cast("long") * ABI.WORD))
        return found.otherwise(ABI.word_value(kind, word))

    args = W.bind(F.col("_body").cast("binary"), lambda body: F.transform("_cells", lambda cell: F.struct(cell["name"].alias("name"), value(cell, body).alias("value"))))
    return rows.withColumn("args", args).drop("inputs", "_body", "_words", "_cells")


def event_name(topic0: Column, names: dict[str, str]) -> Column:
    """Known event name of a topic, else empty text."""
    chosen = F.lit("")
    for topic, name in names.items():
        chosen = F.when(F.lower(topic0) == topic, F.lit(name)).otherwise(chosen)
    return chosen


def loss_estimate(events: DataFrame, transfers: DataFrame) -> DataFrame:
    """Per transaction: what was borrowed, else the largest known token flow, with a confidence.

    The first borrow event counts; its token is that of the first later transfer out of the market
    with the same raw amount.
    """
    moves = transfers.select("blockchain", "tx_hash", "from", "amount_raw", "log_index", "symbol", "token_address", "amount", "to", "classification")
    borrows = events.where(F.col("event") == "Borrow").select("blockchain", "tx_hash", F.struct("market_address", "account", "amount_raw", "log_index").alias("_event"))
    # transfers are read once: both kinds meet in one shuffle by transaction, but not in rows that lack their chain or transaction
    rows = moves.unionByName(borrows, allowMissingColumns=True).withColumn(
        "_apart", F.when(F.col("blockchain").isNull() | F.col("tx_hash").isNull(), F.col("_event").isNull()))
    group = ["blockchain", "tx_hash", "_apart"]
    order = F.when(F.col("_event").isNotNull(), F.struct("_event.log_index", "_event.market_address", "_event.amount_raw"))
    paired = rows.withColumn("_b", F.min_by("_event", order).over(Window.partitionBy(*group)))
    same = (F.col("from") == F.col("_b.market_address")) & (F.col("amount_raw") == F.col("_b.amount_raw")) & (F.col("log_index") >= F.col("_b.log_index"))
    known = F.col("classification") == "known_token_flow"
    both = paired.groupBy(*group).agg(
        F.first("_b").alias("b"),
        F.min_by(F.struct("symbol", "token_address", "amount", "to", F.col("log_index").alias("transfer_log_index")), F.when(same, F.struct("log_index", "symbol", "amount"))).alias("m"),
        F.max_by(F.struct("symbol", "amount", "amount_raw"), F.when(known, F.struct(F.col("amount"), -F.col("log_index"), F.col("symbol"), F.col("amount_raw")))).alias("f"),
        F.count_if(~known).alias("unknown_or_internal_flow_count"),
    )
    borrowed, flowed = F.col("b").isNotNull(), F.col("f").isNotNull()
    asset = F.when(borrowed, F.coalesce("m.symbol", F.lit("UNKNOWN"))).when(flowed, F.col("f.symbol")).otherwise(F.lit("UNKNOWN"))
    raw = F.when(borrowed, F.col("b.amount_raw")).when(flowed, F.col("f.amount_raw"))
    amount = F.when(borrowed, F.coalesce(F.col("m.amount"), F.col("b.amount_raw").cast("double"))).when(flowed, F.col("f.amount"))
    confidence = (
        F.when(borrowed, F.lit("protocol_event_decoded")).when(flowed, F.lit("receipt_flow_estimated")).otherwise(F.lit("not_decodable"))
    )
    return both.select(
        "blockchain", "tx_hash", confidence.alias("confidence"), asset.alias("primary_asset"), raw.alias("primary_amount_raw"),
        amount.alias("primary_amount"), ID.known_usd(asset, amount).alias("known_usd_estimate"),
        F.col("m.transfer_log_index").alias("matched_transfer_log_index"),
        F.coalesce("unknown_or_internal_flow_count", F.lit(0)).alias("unknown_or_internal_flow_count"),
    )
