"""Inventories of lending markets, price sources and derivative assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake.functions import identity as ID
from feedwake.operators.closure import in_chains

MARKET_LIKE = ("market_token", "lending_label")
BINDING_ROLES = ("oracle_or_feed", "governance_or_admin", "lending_label")


def _joined(symbol: str = "symbol", name: str = "name") -> Column:
    return F.lower(F.concat(F.coalesce(symbol, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))


def lending_inventory(labels: DataFrame, tokens: DataFrame, chains: Sequence[str] | None = None) -> DataFrame:
    """Labelled addresses and market tokens of known lending protocols, with cluster and role."""
    named = in_chains(labels, chains).where(F.lower("name").rlike(ID.PROTOCOL_WORDS)).select(
        "blockchain", "address", F.col("name").alias("protocol_label"), ID.protocol_cluster(F.col("name")).alias("protocol_cluster_id"),
        ID.label_role(F.col("name")).alias("inventory_role"), F.lit("labels.addresses").alias("inventory_source"),
    )
    title = F.coalesce("name", "symbol", F.lit("unknown_market_token"))
    minted = in_chains(tokens, chains).where(_joined().rlike(ID.PROTOCOL_TOKEN)).select(
        "blockchain", F.col("contract_address").alias("address"), title.alias("protocol_label"),
        ID.protocol_cluster(title).alias("protocol_cluster_id"), F.lit("market_token").alias("inventory_role"),
        F.lit("tokens.erc20").alias("inventory_source"),
    )
    return named.unionByName(minted).distinct()


def market_inventory(tokens: DataFrame, chains: Sequence[str] | None = None) -> DataFrame:
    """Market tokens by underlying asset and protocol slug, for the account-level search."""
    label = F.coalesce("name", "symbol", F.lit("unknown_market"))
    source = in_chains(tokens, chains).where(
        F.lower(F.coalesce("symbol", F.lit(""))).rlike(ID.GENERIC_MARKET_SYMBOL) & ~_joined().rlike(ID.NOT_A_MARKET)
    )
    rows = source.select(
        "blockchain", F.col("contract_address").alias("market_address"), F.coalesce("symbol", F.lit("")).alias("market_symbol"),
        label.alias("protocol_label"), ID.market_cluster(label).alias("protocol_cluster_id"),
        ID.market_token_asset(F.col("symbol"), F.col("name")).alias("market_asset_identity"),
    )
    return rows.where(F.col("market_asset_identity").isNotNull() & (F.col("protocol_cluster_id") != "unknown_market_cluster")).distinct()


def wide_market_inventory(tokens: DataFrame, chains: Sequence[str] | None = None) -> DataFrame:
    """Market tokens by prefix letter, for the chain-level closures."""
    # fixed values: the three patterns of this inventory
    prefixed = r"(^|[^a-z0-9])([abcmv][a-z0-9]{2,})"
    excluded = "(debt|variabledebt|stabledebt|reward|staking|farm|lp token)"
    kept = in_chains(tokens, chains).where(_joined().rlike(prefixed) & ~_joined().rlike(excluded))
    noise = "( token| market| lending| pool| collateral| debt| stable| variable)"
    return kept.select(
        F.col("blockchain").alias("chain"), F.col("contract_address").alias("market_contract"), "symbol", "name",
        F.regexp_extract(_joined(), prefixed, 2).alias("market_token_source"),
        F.regexp_replace(F.lower(F.coalesce("name", "symbol", F.lit("unknown"))), noise, "").alias("protocol_cluster_id"),
    ).distinct()


def price_source_inventory(labels: DataFrame, chains: Sequence[str] | None = None, legacy_order: bool = False) -> DataFrame:
    """Labelled price feeds and the asset each one names."""
    feeds = in_chains(labels, chains).where(F.lower("name").rlike(ID.FEED_LABEL))
    order = ID.FEED_ASSETS_OLD if legacy_order else ID.ASSETS
    return feeds.select(
        "blockchain", "address", F.col("name").alias("feed_label"), ID.asset_identity(F.col("name"), order).alias("feed_identity")
    ).distinct()


def derivative_assets(tokens: DataFrame, inventory: DataFrame, chains: Sequence[str] | None = None) -> DataFrame:
    """Staked and wrapped tokens that lending protocols list."""
    label = F.lower(F.concat("symbol", F.lit(" "), "name"))
    listed = inventory.select("blockchain", F.col("address").alias("contract_address")).distinct()
    return in_chains(tokens, chains).where(label.rlike(ID.DERIVATIVE_ASSET)).join(
        listed, ["blockchain", "contract_address"], "left_semi"
    ).select("blockchain", "contract_address", "symbol", "name").distinct()
