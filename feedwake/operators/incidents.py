"""Accounts that deposit then borrow, incident tables, and traces built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake import schemas as S
from feedwake.functions import text as T
from feedwake.operators.closure import HOUR, in_dates
from feedwake.operators.joins import likely
from feedwake.operators.timeline import ranked
from feedwake.storage import write_table


def deposit_accounts(transfers: DataFrame, deposit_markets: DataFrame, tokens: DataFrame, minimum: float, start=None, end=None) -> DataFrame:
    """Per chain and account: deposits of the given tokens into the given markets.

    ``deposit_markets``: blockchain, market_address. ``tokens``: blockchain, contract_address.
    """
    named = tokens.select("blockchain", "contract_address").distinct()
    into = deposit_markets.select("blockchain", F.col("market_address").alias("to")).distinct()
    moves = likely(in_dates(transfers, start, end).where(F.col("amount") >= minimum), into, ["blockchain", "to"])
    moves = likely(moves, named, ["blockchain", "contract_address"])
    moves = moves.join(named, ["blockchain", "contract_address"], "left_semi")
    deposits = moves.join(into, ["blockchain", "to"], "left_semi").withColumnRenamed("from", "account")
    per_tx = write_table(deposits.groupBy("blockchain", "account", "tx_hash").agg(
        F.sum("amount").alias("amount"), F.min("block_time").alias("at"), F.min("block_number").alias("block"), F.collect_set("to").alias("markets")))
    place = F.struct("block", "tx_hash")
    markets = per_tx.select("blockchain", "account", F.explode("markets").alias("m")).groupBy("blockchain", "account").agg(
        F.count_distinct("m").alias("deposit_market_count"))
    return per_tx.groupBy("blockchain", "account").agg(
        F.sum("amount").alias("deposit_amount"), F.count(F.lit(1)).alias("deposit_tx_count"), F.min_by("tx_hash", place).alias("first_deposit_tx"),
        F.min("at").alias("first_deposit_time"), F.min("block").alias("first_deposit_block"),
    ).join(markets, ["blockchain", "account"])


def borrow_outflows(accounts: DataFrame, transfers: DataFrame, native: DataFrame, borrow_markets: DataFrame, tokens: DataFrame, native_market: str,
                    excluded: DataFrame, hours: int = 6, start=None, end=None) -> DataFrame:
    """Token and native outflows from borrow markets to deposit accounts in ``[first deposit, +hours)``.

    ``borrow_markets``: blockchain, market_address, market_symbol. ``native_market`` is the symbol (lower case) of the
    market that pays native coin. ``excluded``: tokens that do not count (blockchain, contract_address).
    """
    since = write_table(accounts.select("blockchain", F.col("account").alias("to"), "first_deposit_time"))
    payees = since.select("blockchain", "to").distinct()
    sources = borrow_markets.select("blockchain", F.col("market_address").alias("from"), F.col("market_symbol").alias("source_market")).distinct()
    gap = T.micros(F.col("block_time")) - T.micros(F.col("first_deposit_time"))
    near = (gap >= 0) & (gap < hours * HOUR)
    meta = tokens.select("blockchain", "contract_address", F.col("symbol").alias("borrow_symbol"))
    banned = excluded.select("blockchain", "contract_address").distinct()

    def out_of(moves: DataFrame, markets: DataFrame) -> DataFrame:
        # the few rows near a first deposit are found before anything else is joined
        met = likely(likely(moves, markets.select("blockchain", "from"), ["blockchain", "from"]), payees, ["blockchain", "to"])
        return met.join(since, ["blockchain", "to"]).where(near).join(markets, ["blockchain", "from"])

    paid = out_of(in_dates(transfers, start, end), sources).join(banned, ["blockchain", "contract_address"], "left_anti")
    erc20 = paid.join(meta, ["blockchain", "contract_address"], "left")
    columns = ["blockchain", F.col("to").alias("account"), "block_time", "block_number", "tx_hash", "source_market"]
    tokens_out = erc20.select(
        *columns, "borrow_symbol", F.col("amount").alias("borrow_amount"), F.col("amount_usd").alias("borrow_amount_usd"),
        F.col("amount_usd").isNull().alias("missing_usd_price"), F.lit(False).alias("native"))
    sent = in_dates(native, start, end).where("success").where(F.col("value_double") > 0)
    coins = out_of(sent, sources.where(F.lower("source_market") == native_market))
    coins_out = coins.select(
        *columns, F.lit("NATIVE").alias("borrow_symbol"), (F.col("value_double") / F.lit(1e18)).alias("borrow_amount"),
        F.lit(None).cast("double").alias("borrow_amount_usd"), F.lit(True).alias("missing_usd_price"), F.lit(True).alias("native"))
    return tokens_out.unionByName(coins_out)


def deposit_borrow_locator(accounts: DataFrame, outflows: DataFrame) -> DataFrame:
    """Accounts that both deposit and borrow, with amounts, counts and first transactions."""
    keys = ["blockchain", "account"]
    per_tx = write_table(outflows.groupBy(*keys, "tx_hash").agg(
        F.sum(F.coalesce("borrow_amount_usd", F.lit(0.0))).alias("usd"), F.count_if("missing_usd_price").alias("missing"),
        F.sum(F.when(F.col("native"), F.col("borrow_amount")).otherwise(0.0)).alias("native_amount"), F.min("block_time").alias("at"),
        F.min("block_number").alias("block"), F.collect_set("source_market").alias("markets"), F.collect_set("borrow_symbol").alias("symbols")))
    borrows = per_tx.groupBy(*keys).agg(
        F.sum("usd").alias("borrowed_usd_known"), F.sum("missing").alias("borrowed_usd_missing_price_count"), F.sum("native_amount").alias("native_amount"),
        F.count(F.lit(1)).alias("borrow_tx_count"), F.min_by("tx_hash", F.struct("block", "tx_hash")).alias("first_borrow_tx"),
        F.min("at").alias("first_borrow_time"), F.min("block").alias("first_borrow_block"))
    names = lambda c, name: per_tx.select(*keys, F.explode(c).alias("v")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("v")).alias(name))
    return accounts.join(borrows, keys).join(names("symbols", "borrowed_assets"), keys, "left").join(names("markets", "source_markets"), keys, "left")


def account_profiles(events: DataFrame) -> DataFrame:
    """Per account and event: total, transactions, first and largest event.

    ``events``: account, event, amount, tx_hash, block_number, transaction_index, log_index, block_timestamp.
    """
    place = F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("block_number", "transaction_index", "log_index")])
    row = F.struct("tx_hash", "block_number", "block_timestamp", "amount")
    size = F.struct(F.col("amount").alias("a"), (-F.col("block_number")).alias("b"), (-F.col("transaction_index")).alias("t"), (-F.col("log_index")).alias("l"))
    txs = events.groupBy("account", "event", "tx_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("account", "event").agg(F.count(F.lit(1)).alias("tx_count"))
    return events.groupBy("account", "event").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("event_count"), F.min_by(row, place).alias("first"), F.max_by(row, size).alias("largest"),
    ).join(txs, ["account", "event"])


def matched_accounts(profiles: DataFrame, deposit: str = "Mint", borrow: str = "Borrow") -> DataFrame:
    """Accounts with both events side by side; sort by ``borrowed_amount`` descending for the ranking."""
    side = lambda event, p: profiles.where(F.col("event") == event).select(
        "account", F.col("amount").alias(f"{p}_amount"), F.col("tx_count").alias(f"{p}_tx_count"), F.col("first.tx_hash").alias(f"first_{p}_tx"),
        F.col("first.block_number").alias(f"first_{p}_block"), F.col("largest.tx_hash").alias(f"largest_{p}_tx"))
    return side(deposit, "deposited").join(side(borrow, "borrowed"), "account")


def tx_role_fold(events: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """One row per incident transaction: joined roles, actors and assets, amounts by role, position.

    ``events``: case, tx_hash, role, actor, asset, amount, block_number, transaction_index, log_index, block_timestamp.
    ``statuses``: tx_hash, block_number, block_timestamp, transaction_index, status. A transaction's events are few.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "+" if c == "role" else ",")
    place = F.struct("block_number", "transaction_index", "log_index")
    folded = events.groupBy("case", F.lower("tx_hash").alias("tx_hash")).agg(
        joined("role").alias("tx_role"), joined("actor").alias("actor"), joined("asset").alias("asset"), F.count(F.lit(1)).alias("event_count"),
        F.sum(F.when(F.col("role").startswith("SUPPLY"), F.col("amount"))).alias("supplied"),
        F.sum(F.when(F.col("role").startswith("BORROW"), F.col("amount"))).alias("borrowed"),
        F.min(F.struct(place.alias("p"), F.col("block_timestamp").alias("at"))).alias("f"), F.min("log_index").alias("log_index"))
    base = folded.select(
        "case", "tx_hash", F.lit("lifecycle").alias("attack_tier"), "tx_role", "actor", "asset", "event_count",
        F.coalesce("supplied", F.lit(0.0)).alias("supplied"), F.coalesce("borrowed", F.lit(0.0)).alias("borrowed"),
        F.col("f.p.block_number").alias("block_number"), F.col("f.at").alias("block_timestamp"), F.col("f.p.transaction_index").alias("transaction_index"), "log_index")
    if statuses is None:
        return base.withColumn("receipt_status", F.lit(None).cast("long")).withColumn("evidence_source", F.lit("local_events"))
    named = statuses.select(F.lower("tx_hash").alias("tx_hash"), *[F.col(c).alias(f"_{c}") for c in ("block_number", "block_timestamp", "transaction_index")], F.col("status").alias("receipt_status"))
    both = base.join(named, "tx_hash", "left")
    for c in ("block_number", "block_timestamp", "transaction_index"):
        both = both.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    source = F.when(F.col("receipt_status").isNotNull(), F.lit("local_events_plus_receipt_status")).otherwise(F.lit("local_events"))
    return both.withColumn("evidence_source", source)


def role_addresses(events: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Per case, role and account: events, distinct transactions and first and last time."""
    times = events if statuses is None else events.drop("block_timestamp").join(statuses.select("tx_hash", "block_timestamp"), "tx_hash", "left")
    per_tx = times.groupBy("case", "role", F.col("actor").alias("address"), "tx_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("block_timestamp").alias("lo"), F.max("block_timestamp").alias("hi"))
    return per_tx.groupBy("case", "role", "address").agg(
        F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("tx_count"), F.min("lo").alias("first_tx_time"), F.max("hi").alias("last_tx_time"))


def incident_boundaries(attack_txs: DataFrame) -> DataFrame:
    """Last lifecycle transaction and last borrow of each case (missing ones stay out)."""
    timed = attack_txs.where(F.col("block_timestamp").isNotNull())
    order = F.struct("block_timestamp", "block_number", "tx_hash")
    row = F.struct("tx_hash", "block_number", "block_timestamp", "actor", "receipt_status")
    last = timed.groupBy("case").agg(
        F.max_by(row, order).alias("LAST_CONFIRMED_LIFECYCLE_TX"), F.max_by(row, F.when(F.contains("tx_role", F.lit("BORROW")), order)).alias("LAST_CONFIRMED_BORROW_TX"))
    kinds = ["LAST_CONFIRMED_LIFECYCLE_TX", "LAST_CONFIRMED_BORROW_TX"]
    rows = last.select("case", F.explode(F.array(*[F.struct(F.lit(k).alias("boundary_type"), F.col(k).alias("row")) for k in kinds])).alias("b"))
    return rows.where(F.col("b.row").isNotNull()).select("case", "b.boundary_type", "b.row.*")


def incident_summary(attack_txs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per case: accounts, transactions by role and the last times."""
    has = lambda word: F.contains("tx_role", F.lit(word))
    order = F.struct("block_timestamp", "block_number", "tx_hash")
    txs = attack_txs.groupBy("case").agg(
        F.count_if(has("SUPPLY")).alias("deposit_tx_count"), F.count_if(has("BORROW")).alias("borrow_tx_count"), F.count_if(has("LIQUIDATE")).alias("liquidation_tx_count"),
        F.count(F.lit(1)).alias("lifecycle_tx_count"), F.max("block_timestamp").alias("last_lifecycle_time"), F.max_by("tx_hash", order).alias("last_lifecycle_tx"),
        F.max_by("tx_hash", F.when(has("BORROW"), order)).alias("last_borrow_tx"), F.sum("borrowed").alias("borrowed"))
    people = accounts.select("case", "address").distinct().groupBy("case").agg(F.count(F.lit(1)).alias("attacker_count"))
    return txs.join(people, "case", "left")


def attack_tx_trace(attack_txs: DataFrame, boundaries: DataFrame, asset: Column, boundary_event: str = R.STALE_START) -> DataFrame:
    """Trace rows from incident tables: the boundary first, then one supply or borrow per transaction.

    Transactions without a known index get their place in the sequence of the case.
    ``boundaries``: case, tx_hash, block_number, block_timestamp, target, reason.
    """
    numbered = ranked(
        attack_txs.withColumn("_t", F.coalesce("block_timestamp", F.lit(0).cast("long"))), ["case"], ["_t", "block_number", "tx_hash"], "_seq")
    borrow = F.contains("tx_role", F.lit("BORROW"))
    value = {
        "borrower": F.when(borrow, F.col("actor")), "collateral_asset": F.when(borrow, asset), "borrow_asset": F.when(borrow, F.col("asset")),
        "borrow_amount": F.when(borrow, F.col("borrowed").cast("string")), "supplier": F.when(~borrow, F.col("actor")), "asset": F.when(~borrow, asset),
        "amount": F.when(~borrow, F.col("supplied").cast("string")), "evidence_quality": F.col("evidence_source"), "source": F.lit("incident_tables_full_lifecycle"),
    }
    body = lambda fields: F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in S.DECODED_FIELDS.items()])
    events = numbered.select(
        "case", F.when(borrow, F.lit(R.BORROW)).otherwise(F.lit(R.SUPPLY)).alias("event_type"), F.coalesce("block_number", F.lit(0).cast("long")).alias("block_number"),
        F.col("_t").alias("block_timestamp"), F.coalesce("transaction_index", F.col("_seq")).cast("long").alias("transaction_index"),
        F.coalesce("log_index", F.col("_seq")).cast("long").alias("log_index"), "tx_hash", F.lit("").alias("address"), F.lit(None).cast("string").alias("topic0"),
        F.col("_seq").alias("input_ord"), body(value).alias("decoded"))
    marker = {"asset": asset, "feed": F.col("target"), "reason": F.col("reason")}
    first = boundaries.select(
        "case", F.lit(boundary_event).alias("event_type"), F.coalesce("block_number", F.lit(0).cast("long")).alias("block_number"),
        F.coalesce("block_timestamp", F.lit(0).cast("long")).alias("block_timestamp"), F.lit(0).cast("long").alias("transaction_index"),
        F.lit(0).cast("long").alias("log_index"), "tx_hash", F.col("target").alias("address"), F.lit(None).cast("string").alias("topic0"),
        F.lit(0).cast("long").alias("input_ord"), body(marker).alias("decoded"))
    return first.unionByName(events)


def candidate_trace(candidates: DataFrame, case: str, asset: Column) -> DataFrame:
    """Supply and borrow rows of located accounts (from the locator), at their first transactions."""
    body = lambda fields: F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in S.DECODED_FIELDS.items()])
    base = [F.lit(case).alias("case")]
    supply = candidates.select(
        *base, F.lit(R.SUPPLY).alias("event_type"), F.col("first_deposit_block").alias("block_number"), F.unix_seconds("first_deposit_time").alias("block_timestamp"),
        F.lit(0).cast("long").alias("transaction_index"), F.lit(0).cast("long").alias("log_index"), F.col("first_deposit_tx").alias("tx_hash"),
        F.lit("").alias("address"), F.lit(None).cast("string").alias("topic0"), F.lit(0).cast("long").alias("input_ord"),
        body({"supplier": F.col("account"), "asset": asset, "amount": F.col("deposit_amount").cast("string"), "source": F.lit("located_accounts")}).alias("decoded"))
    borrow = candidates.select(
        *base, F.lit(R.BORROW).alias("event_type"), F.col("first_borrow_block").alias("block_number"), F.unix_seconds("first_borrow_time").alias("block_timestamp"),
        F.lit(1).cast("long").alias("transaction_index"), F.lit(1).cast("long").alias("log_index"), F.col("first_borrow_tx").alias("tx_hash"),
        F.lit("").alias("address"), F.lit(None).cast("string").alias("topic0"), F.lit(1).cast("long").alias("input_ord"),
        body({"borrower": F.col("account"), "collateral_asset": asset, "borrow_asset": F.array_join("borrowed_assets", ", "),
              "borrow_amount": F.col("borrowed_usd_known").cast("string"), "borrow_amount_usd": F.col("borrowed_usd_known").cast("string"),
              "source": F.lit("located_accounts")}).alias("decoded"))
    return supply.unionByName(borrow)


def evidence_quality(has_flow: Column, has_receipt: Column) -> Column:
    """Best evidence behind a trace row."""
    return F.when(has_flow, F.lit("receipt_flow_decoded")).when(has_receipt, F.lit("rpc_receipt_backed")).otherwise(F.lit("dune_decoded_event"))


def pre_attack_logs(receipt_logs: DataFrame, boundaries: DataFrame, attacks: DataFrame) -> DataFrame:
    """Logs of boundary transactions strictly before the first attack transaction of their case.

    ``receipt_logs``: tx_hash, block_number, transaction_index, log_index, address, topics, data, receipt_status.
    ``boundaries``: case, boundary_type, tx_hash. ``attacks``: case, block_number, transaction_index.
    """
    first = attacks.groupBy("case").agg(F.min(F.struct("block_number", "transaction_index")).alias("before"))
    rows = receipt_logs.join(boundaries.select("case", "boundary_type", F.lower("tx_hash").alias("tx_hash")).distinct(), "tx_hash").join(first, "case")
    return rows.where(F.struct("block_number", "transaction_index") < F.col("before")).drop("before").withColumn(
        "topic0", F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("")))


def topic_coverage(pre_attack: DataFrame) -> DataFrame:
    """Per case: pre-attack logs, those with topics, and the share as text."""
    return pre_attack.groupBy("case").agg(
        F.count(F.lit(1)).alias("pre_attack_log_count"), F.count_if(F.size("topics") > 0).alias("pre_attack_topic_log_count"),
    ).withColumn("pre_attack_topic_coverage", F.concat_ws("/", F.col("pre_attack_topic_log_count").cast("string"), F.col("pre_attack_log_count").cast("string")))


def config_log_footprint(targets: DataFrame, logs: DataFrame, names: dict[str, str] | None = None, exact: bool = False) -> DataFrame:
    """Per watched contract and topic: log and transaction counts, first and latest sighting. Contracts without logs stay.

    ``targets``: case_key, addr_key, chain, address, start_block, end_block, start_date, end_date and any further labels.
    """
    seen = logs.select(
        F.col("blockchain").alias("chain"), F.col("contract_address").alias("address"), "block_date", "block_number", "block_time", "topic0", "tx_hash", "log_index")
    span = seen["block_number"].between(targets["start_block"], targets["end_block"]) & seen["block_date"].between(targets["start_date"], targets["end_date"])
    # the small side can be broadcast in an inner join; contracts without logs come back at the end
    joined = seen.join(targets, (targets["chain"] == seen["chain"]) & (targets["address"] == seen["address"]) & span).select(
        "case_key", targets["chain"], "addr_key", "topic0", "tx_hash", "block_number", "block_time", "log_index")
    count = F.count_distinct("tx_hash") if exact else F.approx_count_distinct("tx_hash")
    latest = F.struct("block_number", "log_index")
    table = joined.groupBy("case_key", "chain", "addr_key", "topic0").agg(
        F.count("tx_hash").alias("log_count"), count.alias("tx_count"), F.min("block_number").alias("first_block"), F.min("block_time").alias("first_time"),
        F.max_by("tx_hash", latest).alias("latest_tx_hash"), F.max("block_number").alias("latest_block"), F.max("block_time").alias("latest_time"),
        F.max_by("log_index", latest).alias("latest_log_index"))
    keys = ["case_key", "chain", "addr_key"]
    spine = targets.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("log_count", "tx_count")]
    rest = [c for c in table.columns if c not in (*keys, "log_count", "tx_count", "topic0")]
    table = spine.join(table, same, "left").select(*[F.col(f"_{k}").alias(k) for k in keys], "topic0", *zero, *rest)
    if names is None:
        return table
    known = F.lit("")
    for topic, name in names.items():
        known = F.when(F.lower("topic0") == topic, F.lit(name)).otherwise(known)
    labels = targets.select("case_key", "addr_key", "address", *[c for c in ("case_id", "role") if c in targets.columns]).distinct()
    return table.withColumn("topic_name", known).join(labels, ["case_key", "addr_key"], "left")


def tx_event_histogram(logs: DataFrame) -> DataFrame:
    """Per transaction: events by name, touched contracts and log count (a transaction's logs are few)."""
    cells = logs.groupBy("tx_hash", "event_name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("contract_address").alias("touched"))
    return cells.groupBy("tx_hash").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_name", "n")))).alias("events"), F.sum("n").alias("log_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("touched_addresses"))


def call_tree_summary(edges: DataFrame) -> DataFrame:
    """Per call trace: calls, depth, calls by type and touched contracts (one trace's calls are few).

    ``edges``: trace_id, depth, type, from, to.
    """
    kinds = edges.groupBy("trace_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d"))
    ends = edges.select("trace_id", F.explode(F.array("from", "to")).alias("a")).where(F.coalesce("a", F.lit("")) != "").groupBy("trace_id").agg(
        F.array_sort(F.collect_set(F.lower("a"))).alias("touched_addresses"))
    return kinds.groupBy("trace_id").agg(
        F.sum("n").alias("call_count"), F.max("d").alias("max_depth"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("call_types")).join(ends, "trace_id", "left")


def case_windows(summaries: DataFrame, trace: DataFrame) -> DataFrame:
    """Incident window of each case: preferred summary times, else the trace's, else 24 hours from the start.

    ``summaries``: case and text columns natural_window_start, config_time, first_attack_time, window_end,
    last_lifecycle_time, last_attack_time, exploit_time, last_boundary_time (missing ones may be NULL).
    """
    span = trace.where(F.col("block_timestamp").isNotNull()).groupBy("case").agg(
        F.timestamp_seconds(F.min("block_timestamp")).alias("_lo"), F.timestamp_seconds(F.max("block_timestamp")).alias("_hi"))
    joined = summaries.join(span, "case", "left")
    starts = ("natural_window_start", "config_time", "first_attack_time")
    ends = ("window_end", "last_lifecycle_time", "last_attack_time", "exploit_time", "last_boundary_time")
    start = F.coalesce(*[T.parse_time(F.col(c)) for c in starts], F.col("_lo"), F.timestamp_seconds(F.lit(0)))
    end = F.coalesce(*[T.parse_time(F.col(c)) for c in ends], F.col("_hi"))
    day = F.expr("INTERVAL 24 HOURS")
    rows = joined.select("case", start.alias("incident_start"), end.alias("_end"))
    late = F.col("_end").isNull() | (F.col("_end") < F.col("incident_start"))
    return rows.select("case", "incident_start", F.when(late, F.col("incident_start") + day).otherwise(F.col("_end")).alias("incident_end"))


def known_values(rows: list[tuple[DataFrame, list[str]]], valid: str) -> DataFrame:
    """Distinct valid hashes or addresses per case, gathered from several columns of several tables."""
    test = T.is_hash if valid == "tx_hash" else T.is_address
    parts = [df.select("case", F.explode(F.array(*[F.lower(F.col(c)) for c in columns])).alias(valid)) for df, columns in rows]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.where(test(F.col(valid))).distinct()


def positive_cases(trace: DataFrame, cases: DataFrame) -> DataFrame:
    """One positive sample per known case: its trigger and its first impact with a valid transaction.

    ``cases``: case, chain, failure_class, trigger_event, impact_events array.
    """
    row = F.struct(F.lower(F.coalesce("tx_hash", F.lit(""))).alias("tx"), F.lower(F.coalesce("address", F.lit(""))).alias("address"), F.col("block_timestamp").alias("at"))
    place = F.coalesce("input_ord", F.lit(0))
    found = trace.join(cases, "case").groupBy("case", "chain", "failure_class").agg(
        F.coalesce(F.min_by(row, F.when(F.col("event_type") == F.col("trigger_event"), place)), F.min_by(row, place)).alias("t"),
        F.min_by(row, F.when(F.array_contains("impact_events", F.col("event_type")) & T.is_hash(F.col("tx_hash")), place)).alias("i"))
    scope = (
        F.when(F.col("failure_class") == R.FEED_BINDING, F.lit("S2")).when(F.col("failure_class").isin(R.COMPOSITION, "price_semantics_mismatch"), F.lit("S3"))
        .when(F.col("failure_class") == R.FRESHNESS, F.lit("S1")).otherwise(F.lit("")))
    chain = T.chain_name(F.col("chain"))
    impact_tx = F.coalesce("i.tx", F.lit(""))
    return found.select(
        F.concat(F.lit("positive-"), "case").alias("sample_id"), F.lit("positive").alias("label"), "case", chain.alias("chain"), T.chain_display(chain).alias("display_chain"),
        F.year(F.timestamp_seconds("t.at")).cast("long").alias("year"), "failure_class", scope.alias("scope_class"), T.first_text(F.col("t.tx"), impact_tx).alias("tx_hash"),
        F.col("t.tx").alias("trigger_tx_hash"), impact_tx.alias("first_impact_tx_hash"), F.col("t.address").alias("contract_address"),
        F.coalesce("i.address", F.lit("")).alias("first_impact_contract_address"), F.lit(True).alias("expected_violation"))
