"""Names to identities: protocol clusters, assets, market tokens and roles.

The tables below are fixed values: order matters, the first matching row wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol words and the cluster each one names.
PROTOCOLS = [
    ("aave", "aave"), ("compound", "compound"), ("venus", "venus"), ("moonwell", "moonwell"),
    ("blizz", "blizz"), ("ploutos", "ploutos"), ("benqi", "benqi"), ("morpho", "morpho"),
    ("radiant", "radiant"), ("silo", "silo"), ("granary", "granary"), ("lodestar", "lodestar"),
    ("geist", "geist"), ("cream", "cream"), ("euler", "euler"),
    ("inverse|iron bank", "inverse_iron_bank"), ("hundred finance", "hundred_finance"),
]

# Asset words in a label and the identity each one names.
ASSETS = [
    ("cbeth", "CBETH"), ("wsteth", "WSTETH"), ("reth", "RETH"), ("btc|wbtc", "BTC"), ("eth|weth", "ETH"),
    ("usdc", "USDC"), ("usdt", "USDT"), ("dai", "DAI"), ("busd", "BUSD"), ("luna", "LUNA"),
    ("avax", "AVAX"), ("bnb", "BNB"), ("link", "LINK"),
]
# The two older orders, which read cbETH and wstETH labels as ETH.
FEED_ASSETS_OLD = [
    ("btc|wbtc", "BTC"), ("eth|weth", "ETH"), ("usdc", "USDC"), ("usdt", "USDT"), ("dai", "DAI"),
    ("luna", "LUNA"), ("avax", "AVAX"), ("bnb", "BNB"), ("cbeth", "CBETH"), ("wsteth", "WSTETH"),
]
LABEL_ASSETS_OLD = [
    ("usdc", "USDC"), ("usdt", "USDT"), ("dai", "DAI"), ("btc|wbtc", "BTC"), ("eth|weth", "ETH"),
    ("luna", "LUNA"), ("avax", "AVAX"), ("bnb", "BNB"), ("cbeth", "CBETH"), ("wsteth", "WSTETH"),
]

# Market tokens as (symbol words, symbol suffix, label words, identity).
MARKET_TOKENS = [
    ("cbeth", r"(\.e)?", "cbeth", "CBETH"), ("wsteth", r"(\.e)?", "wsteth", "WSTETH"), ("reth", r"(\.e)?", "reth", "RETH"),
    ("wbtc|btc", r"(\.e)?", "wbtc|btc", "BTC"), ("weth|eth", r"(\.e)?", "weth|eth", "ETH"),
    ("usdc", r"(\.e|bc)?", "usdc|usd coin", "USDC"), ("usdt", r"(\.e)?", "usdt", "USDT"), ("dai", r"(\.e)?", "dai", "DAI"),
    ("busd", r"(\.e)?", "busd", "BUSD"), ("luna", r"(\.e)?", "luna", "LUNA"), ("wavax|avax", r"(\.e)?", "wavax|avax", "AVAX"),
    ("bnb", r"(\.e)?", "bnb", "BNB"), ("link", r"(\.e)?", "link", "LINK"), ("aave", r"(\.e)?", "aave", "AAVE"),
    ("mim", r"(\.e)?", "mim", "MIM"), ("qi", r"(\.e)?", "qi", "QI"), ("spell", r"(\.e)?", "spell", "SPELL"),
    ("joe", r"(\.e)?", "joe", "JOE"), ("crv", r"(\.e)?", "crv", "CRV"), ("tusd", r"(\.e)?", "tusd", "TUSD"),
    ("alpha", r"(\.e)?", "alpha", "ALPHA"),
]
# Words and patterns of market tokens, protocols, assets, labels and functions, down to FORMULA_CALL.
MARKET_WORDS = (
    "cbeth|wsteth|reth|wbtc|btc|weth|eth|usdc|usd coin|usdt|dai|busd|luna|wavax|avax|bnb|link|"
    "aave|mim|qi|spell|joe|crv|tusd|alpha"
)
GENERIC_MARKET_SYMBOL = (
    r"^(a|b|c|m|v)(cbeth|wsteth|reth|wbtc|btc|weth|eth|usdc|usdbc|usdt|dai|busd|luna|wavax|avax|bnb|"
    r"link|aave|mim|qi|spell|joe|crv|tusd|alpha)(\.e)?$"
)
NOT_A_MARKET = "(variabledebt|stabledebt|debt token|governance|reward|staking|lp token)"
PROTOCOL_WORDS = (
    "(aave|compound|venus|moonwell|blizz|ploutos|benqi|morpho|radiant|silo|granary|lodestar|geist|cream|euler|"
    "inverse|iron bank|hundred finance)"
)
PROTOCOL_TOKEN = (
    "(venus|moonwell|blizz|ploutos|benqi|aave|compound|morpho|radiant|silo|granary|lodestar|geist|cream|euler|inverse|iron bank"
    "|^c(usdc|usdt|dai|weth|wbtc|eth|luna|bnb|avax|cbeth|wsteth|reth|link|btc|busd|usdbc)($|[^a-z0-9])"
    "|^v(usdc|usdt|dai|weth|wbtc|eth|luna|bnb|avax|busd)($|[^a-z0-9])"
    "|^m(usdc|usdt|dai|weth|wbtc|eth|cbeth)($|[^a-z0-9])"
    "|^b(usdc|usdt|dai|weth|wbtc|eth|luna|avax)($|[^a-z0-9])"
    "|^a(usdc|usdt|dai|weth|wbtc|eth|avax|link)($|[^a-z0-9]))"
)
STABLE_IDENTITIES = ("USDC", "USDT", "DAI", "BUSD")
STABLE_SYMBOLS = ("USDC", "USDT", "USDC.e", "USDT.e", "DAI", "DAI.e", "BUSD", "USDbC")
DERIVATIVE_ASSET = "(cbeth|wsteth|reth|rs?eth|lst|lrt|staked|wrapped)"
FEED_LABEL = "(chainlink|oracle|price|feed|aggregator)"
ORACLE_PATH_LABEL = "(oracle|price|feed|aggregator|router|wrapper)"
BINDING_FUNCTION = "(oracle|price|feed|source|aggregator|asset|underlying)"
LENDING_FUNCTION = "(borrow|mint|supply|deposit|repay|redeem|withdraw|liquidat)"
FORMULA_CALL = "(oracle|feed|source|ratio|rate|price|govern|execute)"


def _first_match(label: Column, table: list[tuple[str, str]]) -> Column:
    text = F.lower(label)
    chain = None
    for pattern, name in table:
        test = text.rlike(pattern)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def protocol_cluster(label: Column) -> Column:
    """Protocol named in a label, else the label as a slug."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(label, "[^A-Za-z0-9 ]", " ")), r"\s+", "_")
    return _first_match(label, PROTOCOLS).otherwise(slug)


def asset_identity(label: Column, order: list[tuple[str, str]] | None = None) -> Column:
    """Asset named in a label, NULL when none is; ``order`` picks another table."""
    return _first_match(label, order or ASSETS)


def market_token_asset(symbol: Column, name: Column) -> Column:
    """Underlying asset of a lending-market token from its symbol or name."""
    blank = F.lit("")
    symbol_text = F.lower(F.coalesce(symbol, blank))
    label = F.lower(F.concat(F.coalesce(symbol, blank), F.lit(" "), F.coalesce(name, blank)))
    chain = None
    for symbols, suffix, names, identity in MARKET_TOKENS:
        test = symbol_text.rlike(f"^(a|b|c|m|v)({symbols}){suffix}$") | label.rlike(f"(^|[^a-z0-9])({names})([^a-z0-9]|$)")
        chain = F.when(test, F.lit(identity)) if chain is None else chain.when(test, F.lit(identity))
    return chain


def market_cluster(label: Column) -> Column:
    """Protocol slug left of a market label once asset words are taken out."""
    text = F.lower(F.coalesce(label, F.lit("unknown_market")))
    bare = F.regexp_replace(text, f"(^|[^a-z0-9])({MARKET_WORDS})([^a-z0-9]|$)", " ")
    slug = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown_market_cluster"))


def label_role(name: Column) -> Column:
    text = F.lower(name)
    return (
        F.when(text.rlike("(oracle|price|feed|chainlink)"), F.lit("oracle_or_feed"))
        .when(text.rlike("(govern|timelock|admin|proxy)"), F.lit("governance_or_admin"))
        .otherwise(F.lit("lending_label"))
    )


def known_usd(symbol: Column, amount: Column) -> Column:
    """USD value where the token is a stable coin, else NULL."""
    return F.when(symbol.isin(*STABLE_SYMBOLS), amount)


def transfer_class(sender: Column, receiver: Column, symbol: Column, decimals: Column) -> Column:
    zero = F.lit("0x" + "0" * 40)
    return (
        F.when((sender == zero) | (receiver == zero), F.lit("mint_or_burn"))
        .when((F.coalesce(symbol, F.lit("UNKNOWN")) == "UNKNOWN") | decimals.isNull(), F.lit("unknown_or_internal"))
        .otherwise(F.lit("known_token_flow"))
    )
