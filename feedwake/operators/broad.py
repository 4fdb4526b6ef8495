"""Chain-wide searches for the three failure classes, and the counts that precede them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.operators import inventory as INV
from feedwake.operators.closure import HOUR, in_chains, in_dates
from feedwake.operators.decode import decode_answer_updated
from feedwake.operators.joins import contains_hex, contains_text, dense_interval_join, interval_join, likely, marked, unlikely
from feedwake.operators.timeline import Scan, asof, window_fold
from feedwake.storage import write_table

DAY = 24 * HOUR
KEPT_TIERS = (R.TIER_A, R.TIER_B, R.TIER_C)


def _successful(transactions: DataFrame, start, end, chains) -> DataFrame:
    kept = in_dates(in_chains(transactions, chains), start, end).where("success")
    return kept.select(
        "blockchain", "block_time", "block_number", F.col("hash").alias("tx_hash"), F.col("from").alias("actor"), F.col("to").alias("target"), "data"
    )


def _calls(traces: DataFrame, pattern: str, start, end, chains) -> DataFrame:
    """Decoded calls whose name matches; the filter runs before any join."""
    kept = in_dates(in_chains(traces, chains), start, end).where(F.lower(F.coalesce("function_name", F.lit(""))).rlike(pattern))
    return kept.select("blockchain", "tx_hash", "function_name")


def lending_surface(inventory: DataFrame, transactions: DataFrame, traces: DataFrame, start=None, end=None, chains=None) -> DataFrame:
    """Market contracts that successful lending calls reach, with the call names."""
    markets = inventory.where(F.col("inventory_role").isin(*INV.MARKET_LIKE)).select(
        "blockchain", "protocol_cluster_id", "protocol_label", F.col("address").alias("target")
    )
    calls = _calls(traces, ID.LENDING_FUNCTION, start, end, chains)
    sent = _successful(transactions, start, end, chains).select("blockchain", "tx_hash", "target")
    reached = sent.join(markets, ["blockchain", "target"]).join(calls, ["blockchain", "tx_hash"])
    return reached.select(
        "blockchain", "protocol_cluster_id", "protocol_label", F.col("target").alias("market_contract"),
        F.col("function_name").alias("transition_name"),
    ).distinct()


def protocol_cluster(inventory: DataFrame, surface: DataFrame) -> DataFrame:
    """Inventory of the clusters that show lending activity."""
    active = surface.select("blockchain", "protocol_cluster_id").distinct()
    return inventory.join(active, ["blockchain", "protocol_cluster_id"], "left_semi")


def binding_changes(cluster: DataFrame, transactions: DataFrame, traces: DataFrame, start=None, end=None, chains=None) -> DataFrame:
    """Successful calls to oracle, governance or lending contracts that look like a price binding change."""
    contracts = cluster.where(F.col("inventory_role").isin(*INV.BINDING_ROLES)).select(
        "blockchain", F.col("address").alias("target"), "protocol_label", "protocol_cluster_id", "inventory_role"
    )
    sent = _successful(transactions, start, end, chains).join(contracts, ["blockchain", "target"])
    return sent.join(_calls(traces, ID.BINDING_FUNCTION, start, end, chains), ["blockchain", "tx_hash"]).select(
        "blockchain", "block_time", "block_number", F.col("tx_hash").alias("trigger_tx"), "actor", F.col("target").alias("binding_contract"),
        F.col("data").alias("tx_data"), "protocol_label", "protocol_cluster_id", "inventory_role", "function_name",
    )


def binding_identities(changes: DataFrame, cluster: DataFrame, feeds: DataFrame, legacy_order: bool = False) -> DataFrame:
    """Binding changes with the asset and the feed whose addresses occur in the call data."""
    order = ID.LABEL_ASSETS_OLD if legacy_order else ID.ASSETS
    assets = cluster.where(F.col("inventory_role").isin(*INV.MARKET_LIKE)).select(
        "blockchain", "protocol_cluster_id", F.col("address").alias("affected_asset_address"), F.col("protocol_label").alias("affected_asset_label")
    ).withColumn("asset_identity", ID.asset_identity(F.col("affected_asset_label"), order))
    in_cluster = ["blockchain", "protocol_cluster_id"]
    asset_hits = contains_hex(
        changes.select(*in_cluster, "trigger_tx", "tx_data"), assets, in_cluster, "tx_data", "affected_asset_address",
        [*in_cluster, "trigger_tx", "affected_asset_address", "affected_asset_label"],
    )
    sources = feeds.select("blockchain", F.col("address").alias("feed_address"), "feed_label", "feed_identity")
    feed_hits = contains_hex(
        changes.select("blockchain", "trigger_tx", "tx_data"), sources, ["blockchain"], "tx_data", "feed_address",
        ["blockchain", "trigger_tx", "feed_address", "feed_label"],
    )
    joined = changes.join(asset_hits, [*in_cluster, "trigger_tx"], "left").join(feed_hits, ["blockchain", "trigger_tx"], "left")
    seen_asset, seen_feed = F.col("asset_identity").isNotNull(), F.col("feed_identity").isNotNull()
    return joined.withColumn("asset_identity_observed", seen_asset).withColumn("feed_identity_observed", seen_feed).withColumn(
        "identity_mismatch_hint", F.coalesce(F.col("asset_identity") != F.col("feed_identity"), F.lit(False))
    )


def _signatures(triggers: DataFrame, part: str) -> DataFrame:
    """One row per trigger transaction; ``sig`` names its set of clusters or assets."""
    return triggers.groupBy("blockchain", "trigger_tx").agg(
        F.min("block_time").alias("block_time"), F.array_sort(F.collect_set(part)).alias("members")
    ).withColumn("sig", F.array_join("members", "|"))


def _impact_fold(name: str = "impact_tx_count", counted: Column | None = None) -> list[Scan]:
    """Transactions, value and first transaction of a window over one row per transaction."""
    return [
        Scan(name, "count", F.lit(1) if counted is None else counted),
        Scan("impact_usd_known", "sum", F.col("usd")),
        Scan("first", "min", F.struct("block_time", "tx_hash")),
    ]


def within_reach(events: DataFrame, triggers: DataFrame, on: Sequence[str], event_at: Column, trigger_at: Column, width: int, per: Sequence[str] = ()) -> DataFrame:
    """Events that a window ``[t, t+width)`` of some trigger of the same ``on`` may hold; the rest is dropped before anything is copied.

    Windows of a key are united by tiles of their width: one row for each key and tile tells the first and the last moment in reach,
    so an event meets one row at most, however many triggers there are (with ``per``, columns of the triggers only, one for each value of these).
    """
    tile = F.floor(trigger_at / F.lit(width)).cast("long")
    open_ = triggers.select(*on, *per, trigger_at.alias("_from"), F.explode(F.array(tile, tile + 1)).alias("_tile"))
    reach = open_.groupBy(*on, *per, "_tile").agg(F.min("_from").alias("_from"), (F.max("_from") + width).alias("_until"))
    placed = events.withColumn("_tile", F.floor(event_at / F.lit(width)).cast("long"))
    inside = (event_at >= F.col("_from")) & (event_at < F.col("_until"))
    return placed.join(reach, [*on, "_tile"]).where(inside).drop("_tile", "_from", "_until")


def lending_activity(changes: DataFrame, surface: DataFrame, transactions: DataFrame, traces: DataFrame, start=None, end=None, chains=None, hours: int = 24) -> DataFrame:
    """Lending transactions per market cluster that lie in reach of a change of that cluster."""
    at, on = T.micros(F.col("block_time")), ["blockchain", "protocol_cluster_id"]
    markets = surface.select(*on, F.col("market_contract").alias("target")).distinct()
    lending = _calls(traces, ID.LENDING_FUNCTION, start, end, chains).select("blockchain", "tx_hash").distinct()
    sent = _successful(transactions, start, end, chains).select("blockchain", "tx_hash", "block_time", "target")
    near = within_reach(sent.join(markets, ["blockchain", "target"]), changes, on, at, at, hours * HOUR)
    return near.join(lending, ["blockchain", "tx_hash"], "left_semi").select(*on, "tx_hash", "block_time")


def cluster_impacts(changes: DataFrame, surface: DataFrame, transactions: DataFrame, traces: DataFrame, start=None, end=None, chains=None,
                    hours: int = 24) -> DataFrame:
    """Per trigger: lending transactions on markets of its clusters in ``[t, t+hours)``.

    Triggers with the same set of clusters share one stream of distinct transactions.
    """
    triggers = _signatures(changes, "protocol_cluster_id")
    activity = lending_activity(changes, surface, transactions, traces, start, end, chains, hours)
    members = triggers.select("blockchain", "sig", F.explode("members").alias("protocol_cluster_id")).distinct()
    stream = activity.join(members, ["blockchain", "protocol_cluster_id"]).select("blockchain", "sig", "tx_hash", "block_time").distinct()
    folded = window_fold(
        triggers.drop("members"), stream.withColumn("usd", F.lit(0.0)), ["blockchain", "sig"], T.micros(F.col("block_time")),
        T.micros(F.col("block_time")), hours * HOUR, _impact_fold(), closed="left",
    )
    return _found(folded)


def _impact_rows(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys, "impact_tx").agg(F.min("impact_time").alias("impact_time"), F.sum("usd").alias("usd"))


def binding_impact_txs(
    labels: DataFrame, tokens: DataFrame, transactions: DataFrame, traces: DataFrame, start: str | None = None, end: str | None = None,
    chains: Sequence[str] | None = None, hours: int = 24,
) -> DataFrame:
    """Every impact transaction of the binding changes, a row each (``impact_txs`` of the search names the first)."""
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    surface = write_table(lending_surface(inventory, transactions, traces, start, end, chains))
    changes = write_table(binding_changes(protocol_cluster(inventory, surface), transactions, traces, start, end, chains))
    on = ["blockchain", "protocol_cluster_id"]
    activity = lending_activity(changes, surface, transactions, traces, start, end, chains, hours).distinct()
    acts = activity.select(*on, F.col("tx_hash").alias("impact_tx"), F.col("block_time").alias("impact_time"), F.lit(0.0).alias("usd"))
    triggers = changes.select(*on, "trigger_tx", "block_time").distinct()
    pairs = interval_join(triggers, acts, on, T.micros(F.col("block_time")), T.micros(F.col("impact_time")), 0, hours * HOUR, closed="left")
    return _impact_rows(pairs, ["blockchain", "trigger_tx"]).drop("usd")


def _found(folded: DataFrame) -> DataFrame:
    return folded.where(F.coalesce("impact_tx_count", F.lit(0)) > 0).select(
        "blockchain", "trigger_tx", "impact_tx_count", F.coalesce("impact_usd_known", F.lit(0.0)).alias("impact_usd_known"),
        F.col("first.block_time").alias("first_impact_time"), F.col("first.tx_hash").alias("impact_txs"),
    )


def _tiered(features: DataFrame, replayable: Column, reasons: list[str]) -> DataFrame:
    """Tier and reason from the evidence flags; ``reasons`` for A, B, C and rejected rows."""
    closed = F.col("has_trigger") & F.col("has_oracle_anomaly") & F.col("has_lending_impact") & F.col("has_temporal_order")
    visible = F.col("has_trigger") & F.col("has_oracle_anomaly")
    a = F.col("has_trigger") & replayable & F.col("has_lending_impact") & F.col("has_actor") & F.col("has_temporal_order") & F.col("has_replayable_constraint")
    tiers = (R.TIER_A, R.TIER_B, R.TIER_C, R.REJECTED)
    choose = lambda values: F.when(a, values[0]).when(closed, values[1]).when(visible, values[2]).otherwise(values[3])
    tier = choose([F.lit(t) for t in tiers])
    reason = choose([r if isinstance(r, Column) else F.lit(r) for r in reasons])
    return features.withColumn("evidence_tier", tier).withColumn("closure_reason", reason).where(F.col("evidence_tier").isin(*KEPT_TIERS))


OUT_OF_SCOPE = "outside lending oracle-consumption scope"


def evidence_order(candidates: DataFrame) -> list[Column]:
    """Sort columns for broad candidates: tier, closure flags, speed, value, size, source quality."""
    tier = F.when(F.col("evidence_tier") == R.TIER_A, 1).when(F.col("evidence_tier") == R.TIER_B, 2).when(F.col("evidence_tier") == R.TIER_C, 3).otherwise(4)
    return [
        tier, F.col("has_replayable_constraint").desc(), F.col("has_actor").desc(), F.col("trigger_to_impact_seconds").asc_nulls_last(),
        F.col("impact_usd_known").desc(), F.col("impact_tx_count").desc(), F.col("source_quality_rank").asc(),
    ]


def feed_binding_candidates(
    labels: DataFrame, tokens: DataFrame, transactions: DataFrame, traces: DataFrame, start: str | None = None, end: str | None = None,
    chains: Sequence[str] | None = None, hours: int = 24, legacy_order: bool = False,
) -> DataFrame:
    """Binding changes whose asset and feed disagree (or stay unnamed), with same-protocol lending activity after them."""
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    surface = write_table(lending_surface(inventory, transactions, traces, start, end, chains))
    cluster = protocol_cluster(inventory, surface)
    changes = write_table(binding_changes(cluster, transactions, traces, start, end, chains))
    named = binding_identities(changes, cluster, INV.price_source_inventory(labels, chains, legacy_order), legacy_order)
    impacts = cluster_impacts(changes, surface, transactions, traces, start, end, chains, hours)
    titles = labels.select("blockchain", F.col("address").alias("binding_contract"), F.col("name").alias("contract_label"))
    rows = named.join(impacts, ["blockchain", "trigger_tx"], "left").join(titles, ["blockchain", "binding_contract"], "left")
    count = F.coalesce("impact_tx_count", F.lit(0))
    ordered = F.coalesce(F.col("first_impact_time") >= F.col("block_time"), F.lit(False))
    hint = F.col("identity_mismatch_hint")
    decoded = F.lower("function_name").rlike(ID.BINDING_FUNCTION)
    partial = F.col("asset_identity_observed") | F.col("feed_identity_observed")
    grade = lambda values: F.when(hint & (count > 0), F.lit(values[0])).when(decoded, F.lit(values[1])).when(partial, F.lit(values[2])).otherwise(F.lit(values[3]))
    features = rows.select(
        F.col("blockchain").alias("chain"), F.coalesce("contract_label", "protocol_label", F.lit("unknown_protocol")).alias("protocol"),
        F.lit(R.FEED_BINDING).alias("failure_class"), "trigger_tx", F.col("block_number").alias("trigger_block"),
        F.col("block_time").alias("trigger_time"), F.coalesce("asset_identity", "affected_asset_label").alias("affected_asset"),
        "asset_identity_observed", "feed_identity_observed", "identity_mismatch_hint", "feed_label", "feed_identity", "protocol_cluster_id",
        F.lit(True).alias("has_trigger"),
        (hint | ~(F.col("asset_identity_observed") & F.col("feed_identity_observed"))).alias("has_oracle_anomaly"),
        count.alias("impact_tx_count"), F.lit(0.0).alias("impact_usd_known"), F.coalesce("impact_txs", F.lit("")).alias("impact_txs"),
        (count > 0).alias("has_lending_impact"), F.col("actor").isNotNull().alias("has_actor"), ordered.alias("has_temporal_order"),
        ((count > 0) & F.col("actor").isNotNull() & hint & ordered).alias("has_replayable_constraint"),
        T.seconds_between(F.col("block_time"), F.col("first_impact_time")).alias("trigger_to_impact_seconds"),
        grade(["decoded_binding_closure", "decoded_protocol_event", "identity_metadata_partial", "label_match"]).alias("source_quality"),
        grade([1, 2, 3, 4]).cast("long").alias("source_quality_rank"),
    )
    return _tiered(features, F.col("identity_mismatch_hint"), [
        "asset-feed binding change, identity mismatch hint, same-protocol lending impact, actor, temporal order, and replayable fields are present",
        "asset-feed binding change and same-protocol lending impact are present, but identity/source/replay fields are incomplete",
        "asset-feed binding anomaly is visible remotely, but same-protocol lending impact is not closed",
        OUT_OF_SCOPE,
    ])


def formula_changes(inventory: DataFrame, transactions: DataFrame, traces: DataFrame, start=None, end=None, chains=None) -> DataFrame:
    """Successful calls to inventory contracts whose name or data speaks of prices, rates or governance."""
    contracts = inventory.select("blockchain", F.col("address").alias("target"), F.col("protocol_label").alias("inventory_label"), "inventory_role")
    names = in_dates(in_chains(traces, chains), start, end).select("blockchain", "tx_hash", "function_name")
    named = _successful(transactions, start, end, chains).join(names, ["blockchain", "tx_hash"], "left")
    said = F.lower(F.concat(F.coalesce("function_name", F.lit("")), F.lit(" "), F.regexp_replace(F.coalesce("data", F.lit("")), "^0x", "")))
    return named.where(said.rlike(ID.FORMULA_CALL)).join(contracts, ["blockchain", "target"]).select(  # calls that say nothing go before this join
        "blockchain", "block_time", "block_number", F.col("tx_hash").alias("trigger_tx"), "actor",
        F.col("target").alias("oracle_or_governance_contract"), F.col("data").alias("tx_data"), "inventory_label", "inventory_role",
        F.coalesce("function_name", F.lit("unknown_formula_config")).alias("function_name"),
    )


HINT = ["blockchain", "trigger_tx", "function_name", "affected_asset_address", "affected_asset"]


def asset_hints(changes: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derivative assets that calls name, per distinct function name, and that calls carry, per transaction."""
    needles = assets.select("blockchain", F.col("contract_address").alias("affected_asset_address"), F.col("symbol").alias("affected_asset"))
    words = contains_text(changes, needles, "function_name", "affected_asset")
    by_name = changes.select("blockchain", "function_name").distinct().join(words, "function_name").join(needles, ["blockchain", "affected_asset"])
    by_data = contains_hex(
        changes.select("blockchain", "trigger_tx", "function_name", "tx_data"), needles, ["blockchain"], "tx_data", "affected_asset_address", HINT
    )
    return by_name.select("blockchain", "function_name", "affected_asset_address", "affected_asset").distinct(), by_data.select(*HINT).distinct()


def affected_assets(changes: DataFrame, by_name: DataFrame, by_data: DataFrame) -> DataFrame:
    """Formula changes with each derivative asset that the call names or carries."""
    calls = changes.select("blockchain", "trigger_tx", "function_name").distinct()
    named = calls.join(by_name, ["blockchain", "function_name"]).select(*HINT)
    return changes.join(named.unionByName(by_data).distinct(), ["blockchain", "trigger_tx", "function_name"])


def _asset_calls(calls: DataFrame, by_name: DataFrame, by_data: DataFrame) -> DataFrame:
    """Each call with the derivative assets that it names or carries: ``blockchain``, ``trigger_tx``, ``block_time``, ``token``."""
    token = F.col("affected_asset_address").alias("token")
    named = calls.join(by_name.select("blockchain", "function_name", token), ["blockchain", "function_name"])
    carried = calls.join(by_data.select("blockchain", "trigger_tx", token).distinct(), ["blockchain", "trigger_tx"])
    keys = ["blockchain", "trigger_tx", "block_time", "token"]
    return named.select(*keys).unionByName(carried.select(*keys)).distinct()


def _tagged(moves: DataFrame, markets: DataFrame, tokens: DataFrame) -> DataFrame:
    """Transfers whether they are ``at_market`` (sent or received by one), without those that surely are not and move no token of ``tokens``; written.

    A bitmap tells which side of a transfer may be a market. Rows are shuffled once, by that side; only those whose sender is none after all and whose
    receiver may be one are joined again.
    """
    as_market, as_token = F.lit("market"), F.lit("token")
    known = markets.select(as_market.alias("_as"), "blockchain", "address").union(tokens.select(as_token, "blockchain", "token"))
    met, (sends, receives, involved) = marked(moves, known, [[as_market, "blockchain", "from"], [as_market, "blockchain", "to"], [as_token, "blockchain", "token"]])
    kept = ["blockchain", "tx_hash", "block_time", "token", "usd"]
    sides = met.where(sends | receives | involved).select(
        *kept, F.when(sends, F.col("from")).when(receives, F.col("to")).otherwise(F.col("tx_hash")).alias("address"),
        (sends | receives).alias("_asked"),  # rows that ask for nothing are spread by their transaction
        F.when(sends & receives, F.col("to")).alias("_other"),
    )
    found = F.coalesce("_found", F.lit(False)).alias("at_market")
    first = write_table(sides.join(markets.withColumns({"_asked": F.lit(True), "_found": F.lit(True)}), ["blockchain", "address", "_asked"], "left").select(*kept, found, "_other"))
    again = ~F.col("at_market") & F.col("_other").isNotNull()
    second = first.where(again).drop("at_market").join(markets.select("blockchain", F.col("address").alias("_other"), F.lit(True).alias("_found")), ["blockchain", "_other"], "left")
    return first.where(~again).drop("_other").unionByName(write_table(second.select(*kept, found)))


def market_moves(hinted, inventory, transfers, start=None, end=None, chains=None, hours: int = 24) -> DataFrame:
    """Transfers ``at_market`` in reach of a hinted call of their chain, and others in reach of a call that involves their token; read once and written."""
    at, width = T.micros(F.col("block_time")), hours * HOUR
    moves = in_dates(in_chains(transfers, chains), start, end).select(
        "blockchain", "tx_hash", "block_time", F.col("contract_address").alias("token"), "from", "to", F.coalesce("amount_usd", F.lit(0.0)).alias("usd")
    )
    markets = write_table(inventory.where(F.col("inventory_role").isin(*INV.MARKET_LIKE)).select("blockchain", "address").distinct())
    active = within_reach(moves.join(markets.select("blockchain").distinct(), "blockchain", "left_semi"), hinted, ["blockchain"], at, at, width)
    tagged = _tagged(active, markets, hinted.select("blockchain", "token").distinct())
    elsewhere = within_reach(tagged.where(~F.col("at_market")), hinted, ["blockchain", "token"], at, at, width)
    return tagged.where("at_market").unionByName(elsewhere.select(*tagged.columns))


def composition_impact_txs(
    labels: DataFrame, tokens: DataFrame, transactions: DataFrame, traces: DataFrame, transfers: DataFrame, start: str | None = None,
    end: str | None = None, chains: Sequence[str] | None = None, hours: int = 24,
) -> DataFrame:
    """Every impact transaction of the formula calls with an asset hint, a row each with its value (``impact_txs`` of the search names the first).

    Pairs of a call and a transaction at a market of its chain are most rows; they are unique as they are formed. Only those that the transfers
    of an asset may give too, and those of calls with several times, are summed up.
    """
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    changes = write_table(formula_changes(inventory, transactions, traces, start, end, chains))
    by_name, by_data = (write_table(part) for part in asset_hints(changes, INV.derivative_assets(tokens, inventory, chains)))
    calls = changes.select("blockchain", "trigger_tx", "block_time", "function_name").distinct()
    hinted = write_table(_asset_calls(calls, by_name, by_data))
    moves = market_moves(hinted, inventory, transfers, start, end, chains, hours).withColumnRenamed("tx_hash", "impact_tx")
    summed = lambda rows, keys: rows.groupBy(*keys, "impact_tx").agg(F.min("block_time").alias("impact_time"), F.sum("usd").alias("usd"))
    at, seen, row = T.micros(F.col("block_time")), T.micros(F.col("impact_time")), ["blockchain", "trigger_tx", "impact_tx", "impact_time", "usd"]
    of_tokens = summed(moves.where(~F.col("at_market")), ["blockchain", "token"])
    of_asset = write_table(interval_join(hinted, of_tokens, ["blockchain", "token"], at, seen, 0, hours * HOUR, closed="left").select(*row))

    again = of_asset.select(F.col("blockchain").alias("_chain"), F.col("impact_tx").alias("_tx"), F.lit(True).alias("_again")).distinct()
    same = F.col("blockchain").eqNullSafe(F.col("_chain")) & F.col("impact_tx").eqNullSafe(F.col("_tx"))
    at_market = summed(moves.where("at_market"), ["blockchain"])
    acts = write_table(at_market.join(again, same, "left").select(*at_market.columns, F.coalesce("_again", F.lit(False)).alias("_again")))
    opened = hinted.select("blockchain", "trigger_tx", "block_time").distinct()
    opened = write_table(opened.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy("blockchain", "trigger_tx")) == 1))
    alone, several = opened.where("_alone"), opened.where(~F.col("_alone"))
    near = lambda some, acts: dense_interval_join(some, acts, ["blockchain"], at, seen, hours * HOUR, closed="left").select(*row)
    shared, known = near(alone, acts.where("_again")), of_asset.select("blockchain", "trigger_tx", "impact_tx")
    parts = of_asset.unionByName(likely(shared, known, known.columns))
    if not several.isEmpty():
        parts = parts.unionByName(near(several, acts))
    once = near(alone, acts.where(~F.col("_again"))).unionByName(unlikely(shared, known, known.columns))
    summed_up = _impact_rows(parts, ["blockchain", "trigger_tx"])
    return once.select(*summed_up.columns).unionByName(summed_up)


def composition_impacts(
    changes: DataFrame, by_name: DataFrame, by_data: DataFrame, inventory: DataFrame, transfers: DataFrame, start=None, end=None, chains=None, hours: int = 24
) -> DataFrame:
    """Per trigger: transfers in ``[t, t+hours)`` that touch any lending market of the chain or move an affected asset.

    Three streams with one row per transaction cover these without pairing triggers and transfers: market
    transfers per chain, transfers of the assets a function name stands for, and transfers of the
    assets found in call data. A transfer belongs to the first stream that has it, and a transaction
    is counted in the first stream that has it, so the three add up.
    """
    hours_us = hours * HOUR
    tokens = F.col("affected_asset_address").alias("token")
    named = by_name.select("blockchain", "function_name", tokens)
    calls = changes.select("blockchain", "trigger_tx", "block_time", "function_name").distinct()
    hit_names = calls.join(named.select("blockchain", "function_name").distinct(), ["blockchain", "function_name"], "left_semi")
    names = hit_names.groupBy("blockchain", "trigger_tx").agg(F.array_sort(F.collect_set("function_name")).alias("names"))
    carried = by_data.select("blockchain", "trigger_tx", tokens).distinct().groupBy("blockchain", "trigger_tx").agg(F.array_sort(F.collect_set("token")).alias("carried"))
    times = calls.groupBy("blockchain", "trigger_tx").agg(F.min("block_time").alias("block_time"))
    joined = times.join(names, ["blockchain", "trigger_tx"], "left").join(carried, ["blockchain", "trigger_tx"], "left")
    none = F.array().cast("array<string>")
    hinted = joined.where(F.col("names").isNotNull() | F.col("carried").isNotNull())
    triggers = write_table(hinted.select(
        "blockchain", "trigger_tx", "block_time", F.coalesce("names", none).alias("names"), F.coalesce("carried", none).alias("carried"),
        F.array_join(F.coalesce("names", none), "|").alias("name_sig"), F.array_join(F.coalesce("carried", none), "|").alias("data_sig")))

    tagged = market_moves(write_table(_asset_calls(calls, by_name, by_data)), inventory, transfers, start, end, chains, hours)
    per_tx = lambda rows, keys: rows.groupBy(*keys, "tx_hash").agg(F.min("block_time").alias("block_time"), F.sum("usd").alias("usd"))

    at_market = write_table(per_tx(tagged.where("at_market"), ["blockchain"]))
    seen_market = at_market.select("blockchain", "tx_hash", F.lit(True).alias("_market"))
    elsewhere = tagged.where(~F.col("at_market")).select("blockchain", "tx_hash", "block_time", "token", "usd")
    name_tokens = triggers.select("blockchain", "name_sig", F.explode("names").alias("function_name")).distinct().join(
        named, ["blockchain", "function_name"]).select("blockchain", "name_sig", "token").distinct()
    by_names = write_table(
        per_tx(elsewhere.join(name_tokens, ["blockchain", "token"]), ["blockchain", "name_sig"]).join(seen_market, ["blockchain", "tx_hash"], "left"))
    seen_name = by_names.select("blockchain", "name_sig", "tx_hash", F.lit(True).alias("_named"))
    data_tokens = triggers.select("blockchain", "name_sig", "data_sig", F.explode("carried").alias("token")).distinct().join(
        name_tokens, ["blockchain", "name_sig", "token"], "left_anti")
    by_carried = per_tx(elsewhere.join(data_tokens, ["blockchain", "token"]), ["blockchain", "name_sig", "data_sig"]).join(
        seen_market, ["blockchain", "tx_hash"], "left").join(seen_name, ["blockchain", "name_sig", "tx_hash"], "left")

    at = T.micros(F.col("block_time"))
    left = triggers.drop("names", "carried")
    new = F.when(F.col("_market").isNull(), F.lit(1))
    newest = F.when(F.col("_market").isNull() & F.col("_named").isNull(), F.lit(1))
    common = window_fold(left, at_market, ["blockchain"], at, at, hours_us, _impact_fold(), closed="left")
    own = window_fold(left.where(F.col("name_sig") != ""), by_names, ["blockchain", "name_sig"], at, at, hours_us, _impact_fold(counted=new), closed="left")
    other = window_fold(
        left.where(F.col("data_sig") != ""), by_carried, ["blockchain", "name_sig", "data_sig"], at, at, hours_us, _impact_fold(counted=newest), closed="left")
    total = common.unionByName(own).unionByName(other).groupBy("blockchain", "trigger_tx").agg(
        F.sum("impact_tx_count").alias("impact_tx_count"), F.sum("impact_usd_known").alias("impact_usd_known"), F.min("first").alias("first")
    )
    return _found(total)


def price_composition_candidates(
    labels: DataFrame, tokens: DataFrame, transactions: DataFrame, traces: DataFrame, transfers: DataFrame, start: str | None = None,
    end: str | None = None, chains: Sequence[str] | None = None, hours: int = 24,
) -> DataFrame:
    """Formula or governance calls that involve a derivative asset, with transfer activity after them."""
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    changes = write_table(formula_changes(inventory, transactions, traces, start, end, chains))
    by_name, by_data = (write_table(part) for part in asset_hints(changes, INV.derivative_assets(tokens, inventory, chains)))
    impacts = composition_impacts(changes, by_name, by_data, inventory, transfers, start, end, chains, hours)
    return composition_tiers(affected_assets(changes, by_name, by_data), impacts, labels)


def composition_tiers(hints: DataFrame, impacts: DataFrame, labels: DataFrame) -> DataFrame:
    """Tier and reason of each formula change with an asset hint."""
    titles = labels.select("blockchain", F.col("address").alias("oracle_or_governance_contract"), F.col("name").alias("contract_label"))
    rows = hints.join(impacts, ["blockchain", "trigger_tx"], "left").join(titles, ["blockchain", "oracle_or_governance_contract"], "left")
    count = F.coalesce("impact_tx_count", F.lit(0))
    ordered = F.coalesce(F.col("first_impact_time") >= F.col("block_time"), F.lit(False))
    decoded = F.lower("function_name").rlike("(oracle|feed|price|execute|govern)")
    labelled = F.col("contract_label").isNotNull()
    grade = lambda values: F.when(decoded, F.lit(values[0])).when(labelled, F.lit(values[1])).otherwise(F.lit(values[2]))
    features = rows.select(
        F.col("blockchain").alias("chain"), F.coalesce("contract_label", "inventory_label", F.lit("unknown_protocol")).alias("protocol"),
        F.lit(R.COMPOSITION).alias("failure_class"), "trigger_tx", F.col("block_number").alias("trigger_block"),
        F.col("block_time").alias("trigger_time"), "affected_asset", F.lit(True).alias("has_trigger"), F.lit(True).alias("has_oracle_anomaly"),
        count.alias("impact_tx_count"), F.coalesce("impact_usd_known", F.lit(0.0)).alias("impact_usd_known"),
        F.coalesce("impact_txs", F.lit("")).alias("impact_txs"), (count > 0).alias("has_lending_impact"), F.col("actor").isNotNull().alias("has_actor"),
        ordered.alias("has_temporal_order"),
        ((count > 0) & F.col("actor").isNotNull() & F.col("affected_asset").isNotNull() & ordered).alias("has_replayable_constraint"),
        T.seconds_between(F.col("block_time"), F.col("first_impact_time")).alias("trigger_to_impact_seconds"),
        grade(["decoded_protocol_event", "label_match", "raw_transfer_heuristic"]).alias("source_quality"),
        grade([1, 2, 4]).cast("long").alias("source_quality_rank"),
    )
    return _tiered(features, F.lit(True), [
        "formula/config trigger, derivative asset hint, follow-up lending impact, actor, temporal order, and replayable fields are present",
        "formula/config trigger and lending impact are present, but actor or replay fields are incomplete",
        "formula/config anomaly is visible remotely, but lending impact is not closed",
        OUT_OF_SCOPE,
    ])


MIN_USD = 10_000
MIN_UNITS = 1_000_000
NO_ONE = "0x" + "0" * 40


def transfer_events(transfers: DataFrame, tokens: DataFrame, start=None, end=None, chains=None) -> DataFrame:
    """Transfers with the asset their token stands for; old chain names are mapped."""
    names = T.chain_filter_names(chains) if chains else None
    label = F.concat(F.coalesce("symbol", F.lit("")), F.lit(" "), F.coalesce("name", F.lit("")))
    meta = tokens.select("blockchain", "contract_address", ID.asset_identity(label).alias("transfer_asset_identity"))
    joined = in_dates(in_chains(transfers, names), start, end).join(meta, ["blockchain", "contract_address"], "left")
    return joined.select(
        T.chain_name(F.col("blockchain")).alias("blockchain"), "block_time", "block_number", "tx_hash", "from", "to", "contract_address", "amount",
        "amount_usd", "transfer_asset_identity",
    )


def account_moves(transfers: DataFrame, markets: DataFrame, start=None, end=None, chains=None,
                  min_usd: float = MIN_USD, min_units: float = MIN_UNITS) -> DataFrame:
    """Transfers that may be a collateral supply or a borrow outflow of some market; read once, the others go before any join, and written."""
    names = T.chain_filter_names(chains) if chains else None
    worth = F.col("amount_usd").isNull() | (F.col("amount_usd") >= min_usd) | (F.col("amount") >= min_units)
    here = T.chain_name(F.col("blockchain"))
    kept = in_dates(in_chains(transfers, names), start, end).where((F.col("amount") > 0) & worth).select(
        "blockchain", "block_time", "block_number", "tx_hash", "from", "to", "contract_address", "amount", "amount_usd")
    return write_table(likely(kept, markets.select("blockchain", "market_address"), [here, "from"], [here, "to"]))


def paired_moves(moves: DataFrame, hours: int = 6) -> DataFrame:
    """Transfers of which another of the same account may follow (it sends, then receives) or go before within ``hours``; none that has one is missing.

    Accounts meet by hashes of account and tile of time, so the transfers themselves are not shuffled.
    """
    here, tile = T.chain_name(F.col("blockchain")), F.floor(T.micros(F.col("block_time")) / F.lit(hours * HOUR)).cast("long")
    sent, later, received = F.xxhash64(here, "from", tile), F.xxhash64(here, "from", tile + 1), F.xxhash64(here, "to", tile)
    opened = moves.select(F.explode(F.array(sent, later)).alias("_met"))
    met = write_table(moves.select(received.alias("_met")).distinct().join(opened, "_met", "left_semi"))
    near = likely(moves, met, [sent], [later], [received])
    # once more at other places: what the first bitmap let through by chance is about a fifth of all rows when these are many
    salt = F.lit(1)
    return likely(near, met.select("_met", salt.alias("_salt")), [sent, salt], [later, salt], [received, salt])


def collateral_supplies(markets: DataFrame, moves: DataFrame, min_usd: float = MIN_USD, min_units: float = MIN_UNITS) -> DataFrame:
    """Material transfers of an asset into a market of that asset: by dollars, or by units where the asset is no stable one."""
    into = markets.select("blockchain", F.col("market_address").alias("to"), "protocol_cluster_id", "protocol_label", "market_asset_identity")
    joined = moves.where((F.col("amount") > 0) & (F.col("from") != NO_ONE)).join(into, ["blockchain", "to"])
    bulky = ~F.col("market_asset_identity").isin(*ID.STABLE_IDENTITIES) & (F.col("amount") >= min_units)
    material = F.col("amount_usd").isNull() | (F.col("amount_usd") >= min_usd) | bulky
    return joined.where((F.col("transfer_asset_identity") == F.col("market_asset_identity")) & material).select(
        "blockchain", "protocol_cluster_id", "protocol_label", F.col("to").alias("collateral_market"),
        F.col("market_asset_identity").alias("collateral_asset"), F.col("contract_address").alias("collateral_token"), F.col("from").alias("actor"),
        F.col("tx_hash").alias("supply_tx"), F.col("block_number").alias("supply_block"), F.col("block_time").alias("supply_time"),
    ).distinct()


SAME_ACCOUNT = ["blockchain", "protocol_cluster_id", "actor", "collateral_asset"]


def borrow_outflows(supplies: DataFrame, markets: DataFrame, moves: DataFrame, hours: int = 6, min_usd: float = MIN_USD) -> DataFrame:
    """Material transfers out of markets in reach of a supply of another asset by the same account and cluster, once for each such asset."""
    out_of = markets.select("blockchain", F.col("market_address").alias("from"), "protocol_cluster_id", "market_asset_identity")
    paid = moves.where((F.col("amount") > 0) & (F.col("amount_usd").isNull() | (F.col("amount_usd") >= min_usd)))
    borrows = paid.join(out_of, ["blockchain", "from"]).select(
        "blockchain", "protocol_cluster_id", F.col("to").alias("actor"), F.col("from").alias("borrow_market"), "market_asset_identity", "tx_hash",
        "block_time", F.coalesce("amount_usd", F.lit(0.0)).alias("usd"),
    )
    at, supplied = T.micros(F.col("block_time")), T.micros(F.col("supply_time"))
    near = within_reach(borrows, supplies, SAME_ACCOUNT[:3], at, supplied, hours * HOUR, SAME_ACCOUNT[3:])
    return near.where(F.col("market_asset_identity") != F.col("collateral_asset"))


def followed(supplies: DataFrame, outflows: DataFrame, hours: int = 6) -> DataFrame:
    """Supplies that may have an outflow of their account and asset in ``[t, t+hours)``; none that has one is missing."""
    opens = T.micros(F.col("block_time")) - hours * HOUR + 1
    return within_reach(supplies, outflows, SAME_ACCOUNT, T.micros(F.col("supply_time")), opens, hours * HOUR)


def same_account_impacts(supplies: DataFrame, outflows: DataFrame, hours: int = 6) -> DataFrame:
    """Supplies followed within ``[t, t+hours)`` by outflows of other assets to the same account and cluster (see :func:`borrow_outflows`)."""
    keys = SAME_ACCOUNT
    stream = outflows.groupBy(*keys, "tx_hash").agg(F.min("block_time").alias("block_time"), F.sum("usd").alias("usd"))
    folded = window_fold(
        followed(supplies, outflows, hours).select(*supplies.columns), stream, keys, T.micros(F.col("supply_time")), T.micros(F.col("block_time")), hours * HOUR,
        _impact_fold("borrow_tx_count"), closed="left",
    )
    return folded.where(F.coalesce("borrow_tx_count", F.lit(0)) > 0).select(
        *supplies.columns, F.col("first.block_time").alias("first_borrow_time"), F.col("first.tx_hash").alias("first_borrow_tx"),
        (F.col("borrow_tx_count") + 1).alias("impact_tx_count"), "impact_usd_known",
        F.concat_ws(";", "supply_tx", F.col("first.tx_hash")).alias("impact_txs"),
    )


def account_flows(tokens: DataFrame, markets: DataFrame, moves: DataFrame, hours: int = 6) -> tuple[DataFrame, DataFrame]:
    """Collateral supplies that an outflow may follow, and borrow outflows in reach of a supply, each written once; ``moves`` as of :func:`account_moves`."""
    near = write_table(transfer_events(paired_moves(moves, hours), tokens))
    supplies = write_table(collateral_supplies(markets, near))
    return supplies, write_table(borrow_outflows(supplies, markets, near, hours))


def same_account_impact_txs(
    tokens: DataFrame, transfers: DataFrame, start: str | None = None, end: str | None = None, chains: Sequence[str] | None = None, hours: int = 6,
) -> DataFrame:
    """Every outflow that follows a supply of the same account, a row for each transaction and borrowed asset (the search names the first)."""
    markets = write_table(INV.market_inventory(tokens, chains))
    supplies, every = account_flows(tokens, markets, account_moves(transfers, markets, start, end, chains), hours)
    outflows = every.groupBy(
        *SAME_ACCOUNT, F.col("market_asset_identity").alias("borrowed_asset"), F.col("tx_hash").alias("impact_tx")).agg(
        F.min("block_time").alias("impact_time"), F.sum("usd").alias("usd"))
    pairs = interval_join(followed(supplies, every, hours), outflows, SAME_ACCOUNT, T.micros(F.col("supply_time")), T.micros(F.col("impact_time")), 0, hours * HOUR, closed="left")
    return pairs.select(*SAME_ACCOUNT, "collateral_market", "collateral_token", "supply_tx", "borrowed_asset", "impact_tx", "impact_time", "usd")


def labelled_answers(logs: DataFrame, labels: DataFrame, start: str | None = None, end: str | None = None, chains=None, look_back_days: int = 7) -> DataFrame:
    """Price reports with the asset their feed's label names; the scan opens ``look_back_days`` early."""
    if start is not None:
        logs = logs.where(F.col("block_date") >= F.date_sub(F.lit(str(start)).cast("date"), look_back_days))
    reports = decode_answer_updated(in_dates(in_chains(logs, chains), None, end))
    titles = labels.select("blockchain", F.col("address").alias("feed"), F.col("name").alias("feed_label"))
    named = reports.join(titles, ["blockchain", "feed"], "left")
    return named.withColumn("feed_identity", ID.asset_identity(F.coalesce("feed_label", F.lit(""))))


def _is_low() -> Column:
    """Whether an answer without label is at its floor."""
    return F.col("feed_identity").isNull() & (F.abs("answer") > 0) & (F.abs("answer") <= 1)


def usable_answers(answers: DataFrame) -> DataFrame:
    """Labelled answers and unlabelled ones at their floor, as :func:`latest_answers` reads them; written."""
    used = ["blockchain", "feed", "feed_label", "feed_identity", "tx_hash", "block_number", "block_time", "log_index", "answer_raw", "answer", "updated_at"]
    return write_table(answers.where(F.col("feed_identity").isNotNull() | _is_low()).select(*used))


LABEL_MATCHED, UNRESOLVED = "label_matched", "impact_led_lower_bound_unresolved"


def latest_answers(impacts: DataFrame, answers: DataFrame, days: int = 7) -> DataFrame:
    """One row per supply transaction: its latest prior report, by label first, else an unlabelled lower bound."""
    at, seen = T.micros(F.col("supply_time")), T.micros(F.col("block_time"))
    payload = F.struct(
        "feed", "feed_label", "feed_identity", F.col("tx_hash").alias("trigger_tx"), F.col("block_number").alias("trigger_block"),
        F.col("block_time").alias("trigger_time"), "answer_raw", "answer", "updated_at",
    )
    ties = ["block_number", "tx_hash", "log_index"]
    by_label = answers.where(F.col("feed_identity").isNotNull()).withColumn("collateral_asset", F.col("feed_identity"))
    labelled = asof(impacts, by_label, ["blockchain", "collateral_asset"], at, seen, payload, "_labelled", ties=ties, within=days * DAY)
    low = answers.where(_is_low())
    both = asof(labelled, low, ["blockchain"], at, seen, payload, "_low", ties=ties, within=days * DAY)
    unresolved = F.when(~F.col("collateral_asset").isin(*ID.STABLE_IDENTITIES), F.col("_low"))
    chosen = both.withColumn("a", F.coalesce("_labelled", unresolved)).withColumn("answer_match_rank", F.when(F.col("_labelled").isNotNull(), 1).otherwise(2))
    chosen = chosen.where(F.col("a").isNotNull()).drop("_labelled", "_low")
    keys = ["blockchain", "protocol_cluster_id", "actor", "supply_tx"]
    order = F.struct(
        (-F.col("answer_match_rank")).alias("r"), F.col("a.trigger_time").alias("t"), F.col("a.trigger_block").alias("b"), F.col("collateral_market").alias("m")
    )
    rest = [c for c in chosen.columns if c not in keys]
    best = chosen.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    fields = [F.col(f"row.{c}").alias(c) for c in rest if c != "a"]
    return best.select(*keys, *fields, "row.a.*")


def freshness_candidates(
    tokens: DataFrame, transfers: DataFrame, logs: DataFrame, labels: DataFrame, start: str | None = None, end: str | None = None,
    chains: Sequence[str] | None = None, hours: int = 6, days: int = 7,
) -> DataFrame:
    """Accounts that supply one asset and borrow another soon after, while the asset's latest price report was old or at its floor."""
    markets = write_table(INV.market_inventory(tokens, chains))
    supplies, outflows = account_flows(tokens, markets, account_moves(transfers, markets, start, end, chains), hours)
    impacts = write_table(same_account_impacts(supplies, outflows, hours))
    answers = usable_answers(labelled_answers(logs, labels, start, end, chains, days))
    return freshness_tiers(latest_answers(impacts, answers, days))


def freshness_tiers(rows: DataFrame) -> DataFrame:
    """Tiered candidates of the supplies with their latest prior report."""
    rows = rows.withColumn("feed_identity_source", F.when(F.col("answer_match_rank") == 1, F.lit(LABEL_MATCHED)).otherwise(F.lit(UNRESOLVED)))
    matched, many = F.col("feed_identity_source") == LABEL_MATCHED, F.col("impact_tx_count") > 1
    size = F.abs("answer")
    aged = T.seconds_between(F.col("trigger_time"), F.col("first_borrow_time")) >= 3600
    ordered = (F.col("supply_time") >= F.col("trigger_time")) & (F.col("first_borrow_time") >= F.col("supply_time"))
    grade = lambda values: (
        F.when(matched & many, F.lit(values[0])).when(~matched & many, F.lit(values[1])).when(matched, F.lit(values[2])).otherwise(F.lit(values[3])))
    features = rows.select(
        F.col("blockchain").alias("chain"), F.coalesce("protocol_label", "protocol_cluster_id", F.lit("unknown_protocol")).alias("protocol"),
        F.lit(R.FRESHNESS).alias("failure_class"), "trigger_tx", "trigger_block", "trigger_time", F.col("collateral_asset").alias("affected_asset"),
        "feed_identity", "feed_identity_source", "protocol_cluster_id", "actor", F.lit(True).alias("has_trigger"),
        (~matched | aged | ((size > 0) & (size <= 1))).alias("has_oracle_anomaly"), "impact_tx_count", "impact_usd_known", "impact_txs",
        many.alias("has_lending_impact"), F.col("actor").isNotNull().alias("has_actor"), ordered.alias("has_temporal_order"),
        (many & F.col("actor").isNotNull() & matched & F.col("feed_identity").isNotNull() & ordered).alias("has_replayable_constraint"),
        T.seconds_between(F.col("trigger_time"), F.col("supply_time")).alias("trigger_to_impact_seconds"),
        grade(["impact_led_answerupdated_closure", UNRESOLVED, "answerupdated_identity_match", "raw_transfer_heuristic"]).alias("source_quality"),
        grade([1, 2, 2, 4]).cast("long").alias("source_quality_rank"),
    )
    incomplete = F.when(
        F.col("source_quality") == UNRESOLVED,
        F.lit("lower-bound stale marker and same-account lending impact are present, but feed identity metadata is incomplete"),
    ).otherwise(F.lit("freshness anomaly and same-account lending impact are present, but source metadata or replay fields are incomplete"))
    return _tiered(features, F.col("has_oracle_anomaly"), [
        "latest prior AnswerUpdated, same-account collateral supply, borrow outflow, actor, temporal order, and replayable fields are present",
        incomplete, "freshness anomaly is visible remotely, but lending impact is not closed", OUT_OF_SCOPE,
    ])


def stage_counts(stages: dict[str, tuple[DataFrame, str | None, str | None, str | None]], failure_class: str, start: str, end: str) -> DataFrame:
    """Rows and distinct addresses, clusters and transactions per chain at each stage of a search.

    ``stages``: name -> (rows with ``blockchain``, address column, cluster column, transaction column), or a table of counts.
    """
    missing = F.lit(None).cast("long")
    distinct = lambda c: F.count_distinct(F.col(c)) if c else missing
    parts = []
    for stage, source in stages.items():
        if isinstance(source, DataFrame):  # counted already
            parts.append(source.withColumn("preflight_stage", F.lit(stage)))
            continue
        rows, address, cluster, tx = source
        wanted = [c for c in (address, cluster, tx) if c]
        counted = rows.select("blockchain", *dict.fromkeys(wanted)).groupBy(F.col("blockchain").alias("chain")).agg(
            F.count(F.lit(1)).alias("row_count"), distinct(address).alias("address_count"),
            distinct(cluster).alias("protocol_cluster_count"), distinct(tx).alias("tx_count"),
        )
        parts.append(counted.withColumn("preflight_stage", F.lit(stage)))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(
        "chain", F.lit(failure_class).alias("failure_class"), "preflight_stage", F.lit(start).alias("start_date"), F.lit(end).alias("end_date"),
        "row_count", "address_count", "protocol_cluster_count", "tx_count",
    )


def pair_counts(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: Column, right_at: Column, before: int, after: int, address: str, tx: str,
) -> DataFrame:
    """Counts over all pairs with ``left - before <= right < left + after`` of equal keys, without forming them.

    Rows are the sum of windowed counts; clusters are those of left rows with a partner; addresses and transactions are
    those of right rows whose nearest left row lies in reach.
    """
    left = left.select(*dict.fromkeys([*keys, "blockchain", "protocol_cluster_id"]), left_at.alias("_left_at"))
    right = right.select(*dict.fromkeys([*keys, "blockchain", address, tx]), right_at.alias("_right_at"))
    left_at, right_at = F.col("_left_at"), F.col("_right_at")
    counted = window_fold(
        left, right, keys, left_at - F.lit(before), right_at, before + after, [Scan("_pairs", "count", F.lit(1))], closed="left").where(F.col("_pairs") > 0)
    ahead = asof(right, left, keys, right_at, left_at, F.lit(True), "_ahead", forward=True, within=before)
    met = asof(ahead, left, keys, right_at, left_at, F.lit(True), "_behind", within=after - 1) if after > 1 else ahead.withColumn("_behind", F.lit(None).cast("boolean"))
    met = met.where(F.col("_ahead").isNotNull() | F.col("_behind").isNotNull())
    rows = counted.groupBy("blockchain").agg(F.sum("_pairs").cast("long").alias("row_count"), F.count_distinct("protocol_cluster_id").alias("protocol_cluster_count"))
    others = met.groupBy("blockchain").agg(F.count_distinct(address).alias("address_count"), F.count_distinct(tx).alias("tx_count"))
    return rows.join(others, "blockchain").select(
        F.col("blockchain").alias("chain"), "row_count", "address_count", "protocol_cluster_count", "tx_count")


def feed_binding_stages(labels, tokens, transactions, traces, start=None, end=None, chains=None) -> dict:
    """Stages of the feed-binding search, for :func:`stage_counts`."""
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    surface = write_table(lending_surface(inventory, transactions, traces, start, end, chains))
    cluster = protocol_cluster(inventory, surface)
    changes = write_table(binding_changes(cluster, transactions, traces, start, end, chains))
    named = binding_identities(changes, cluster, INV.price_source_inventory(labels, chains))
    flags = write_table(named.groupBy("blockchain", "trigger_tx", "protocol_cluster_id").agg(
        F.bool_or("asset_identity_observed").alias("asset"), F.bool_or("feed_identity_observed").alias("feed"),
        F.bool_or("identity_mismatch_hint").alias("mismatch"),
    ))
    return {
        "inventory_addresses": (inventory, "address", "protocol_cluster_id", None),
        "price_source_addresses": (INV.price_source_inventory(labels, chains), "address", None, None),
        "lending_surface": (surface, "market_contract", "protocol_cluster_id", None),
        "active_protocol_clusters": (surface.select("blockchain", "protocol_cluster_id").distinct(), None, "protocol_cluster_id", None),
        "binding_change_candidates": (changes, None, "protocol_cluster_id", "trigger_tx"),
        "asset_identity_observed": (flags.where("asset"), None, "protocol_cluster_id", "trigger_tx"),
        "feed_identity_observed": (flags.where("feed"), None, "protocol_cluster_id", "trigger_tx"),
        "identity_mismatch_hint": (flags.where("mismatch"), None, "protocol_cluster_id", "trigger_tx"),
    }


def price_composition_stages(labels, tokens, transactions, traces, transfers, start=None, end=None, chains=None) -> dict:
    inventory = write_table(INV.lending_inventory(labels, tokens, chains))
    assets = write_table(INV.derivative_assets(tokens, inventory, chains))
    changes = write_table(formula_changes(inventory, transactions, traces, start, end, chains))
    by_name, by_data = (write_table(part) for part in asset_hints(changes, assets))
    hints = write_table(affected_assets(changes.drop("tx_data"), by_name, by_data))
    impacts = write_table(composition_impacts(changes, by_name, by_data, inventory, transfers, start, end, chains))
    return {
        "inventory_addresses": (inventory, "address", "protocol_cluster_id", None),
        "derivative_assets": (assets, "contract_address", None, None),
        "oracle_wrapper_txs": (changes, "oracle_or_governance_contract", None, "trigger_tx"),
        "affected_asset_hint": (hints, "affected_asset_address", None, "trigger_tx"),
        "impact_activity": (impacts, None, None, "trigger_tx"),
        "tiered_candidates": (composition_tiers(hints, impacts, labels).withColumnRenamed("chain", "blockchain"), None, None, "trigger_tx"),
    }


def freshness_stages(tokens, transfers, logs, labels, start=None, end=None, chains=None, hours: int = 6, days: int = 7) -> dict:
    markets = write_table(INV.market_inventory(tokens, chains))
    moves = account_moves(transfers, markets, start, end, chains)
    supplies, outflows = account_flows(tokens, markets, moves, hours)
    impacts = write_table(same_account_impacts(supplies, outflows, hours))
    answers = usable_answers(labelled_answers(logs, labels, start, end, chains, days))
    latest = write_table(latest_answers(impacts, answers, days))
    supplied, at = T.micros(F.col("supply_time")), T.micros(F.col("block_time"))
    by_label = answers.where(F.col("feed_identity").isNotNull()).withColumn("collateral_asset", F.col("feed_identity"))
    low = answers.where(_is_low())
    loose = impacts.where(~F.col("collateral_asset").isin(*ID.STABLE_IDENTITIES))
    return {
        "market_inventory": (markets, "market_address", "protocol_cluster_id", None),
        "collateral_supply_events": (collateral_supplies(markets, transfer_events(moves, tokens)), "collateral_market", "protocol_cluster_id", "supply_tx"),
        "borrow_outflow_events": pair_counts(followed(supplies, outflows, hours), outflows, SAME_ACCOUNT, supplied, at, 0, hours * HOUR, "borrow_market", "tx_hash"),
        "same_actor_impact": (impacts, "collateral_market", "protocol_cluster_id", "first_borrow_tx"),
        "label_matched_answer_updated": pair_counts(impacts, by_label, ["blockchain", "collateral_asset"], supplied, at, days * DAY, 1, "feed", "tx_hash"),
        "lower_bound_unlabeled_answer_updated": pair_counts(loose, low, ["blockchain"], supplied, at, days * DAY, 1, "feed", "tx_hash"),
        "latest_prior_join": (latest, "feed", "protocol_cluster_id", "trigger_tx"),
        "tiered_candidates": (freshness_tiers(latest).withColumnRenamed("chain", "blockchain"), None, None, "trigger_tx"),
    }
