"""Event topics and rule tables. All are small fixed tables; callers may pass their own."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Scope classes of price-feed boundary events.
S1 = "S1_ORACLE_PRICE_REPORTING"
S2 = "S2_FEED_BINDING_CONFIG"
S3 = "S3_PRICE_COMPOSITION_OR_ROUTE_CONFIG"
S4 = "S4_GOVERNANCE_EXECUTED_ORACLE_CONFIG"
S5 = "S5_CONTEXTUAL_ORACLE_PROXY_WIRING"

# Event topics.
ANSWER_UPDATED = "0x0559884fd3a460db3073b7fc896cc77986f16e378210ded43186175bf646fc5f"
ERC20_TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
COMPOUND_MINT = "0x4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f"
COMPOUND_BORROW = "0x13ed6866d4e1ee6da46f845c46d7e54120883d75c5ea9a2dacc1c4ca8984ab80"
COMPOUND_ACCRUE_INTEREST = "0x4dec04e750ca11537cabcd8a9eab06494de08da3735bc8871cd41250e190bc04"

# Topic, scope class, rule, name, whether only oracle-path contracts count.
BOUNDARY_TOPICS = [
    ("0xf6a97944f31ea060dfde0566e4167c1a1082551e64b60ecb14d599a9d023d451", S1, "R_S1_CHAINLINK_NEW_TRANSMISSION", "Chainlink OCR NewTransmission", False),
    ("0x0109fc6f55cf40689f02fbaad7af7fe7bbac8a3d2186600afc7d3e10cac60271", S1, "R_S1_CHAINLINK_NEW_ROUND", "Chainlink NewRound", False),
    (ANSWER_UPDATED, S1, "R_S1_CHAINLINK_ANSWER_UPDATED", "Chainlink AnswerUpdated", False),
    ("0x22c5b7b2d8561d39f7f210b6b326a1aa69f15311163082308ac4877db6339dc1", S2, "R_S2_FEED_BINDING_UPDATE", "asset/feed binding update", False),
    ("0xd9e7d1778ca05570ced72c9aeb12a41fcc76f7f57ea25853dea228f8836d0022", S2, "R_S2_MOONWELL_SET_FEED", "oracle wrapper setFeed-style config", False),
    ("0xaef9ecb0b33da1a5a170fdeed3accb3e88c5257f51d6faa019cea841b864d049", S2, "R_S2_SET_TOKEN_PRICE_FEED", "SetTokenPriceFeed", False),
    ("0xd52b2b9b7e9ee655fcb95d2e5b9e0c9f69e7ef2b8e9d2d0ea78402d576d22e22", S2, "R_S2_NEW_PRICE_ORACLE", "NewPriceOracle", False),
    ("0xa8c96090e146ce1076efa81e5424d56e13d5c3854943f7926406c12d15d6dbe9", S3, "R_S3_SET_ROUTE", "SetRoute", False),
    ("0xd1b3641b73e6c323671a85001b02db34d4e63a7fa6d264896138094dd6b8bfdf", S3, "R_S3_SET_TIME_GAP", "SetTimeGap", False),
    ("0xdb99134445c07379338e9d1d3ca5cd958bd95af80ce8e9b6d73882f9b12002e4", S3, "R_S3_TOKEN_REMAPPING", "token remapping", False),
    ("0xd6b3a81dd8b7dc419d8d0f20797397ea2eaba914386b89898aa638438803a1ec", S4, "R_S4_GOVERNANCE_EXECUTED_ORACLE_CHANGE", "governance executed oracle change", False),
    ("0x7f26b83ff96e1f2b6a682f133852f6798a09c465da95921460cefb3847402498", S5, "R_S5_CONTEXTUAL_INITIALIZED", "Initialized on oracle-path contract", True),
    ("0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0", S5, "R_S5_CONTEXTUAL_OWNERSHIP_TRANSFERRED", "OwnershipTransferred on oracle-path contract", True),
]
BOUNDARY_SCHEMA = "topic0 string, scope_class string, rule_id string, topic_name string, contextual_only boolean"

# Impact rules.
SUPPLY_RULE = "R_IMPACT_SUPPLY_OR_MINT"
BORROW_RULE = "R_IMPACT_BORROW"
LIQUIDATION_RULE = "R_IMPACT_LIQUIDATION"
COLLATERAL_RULE = "R_IMPACT_COLLATERAL_ENABLED"
ENTERED_RULE = "R_IMPACT_MARKET_ENTERED"
SUPPLY_SIDE_RULES = (SUPPLY_RULE, COLLATERAL_RULE, ENTERED_RULE)

# Topic, impact rule, name.
IMPACT_TOPICS = [
    ("0x3ab23ab0d51cccc0c3085aec51f99228625aa1a922b3a8ca89a26b0f2027a1a5", ENTERED_RULE, "MarketEntered"),
    (COMPOUND_MINT, SUPPLY_RULE, "Compound Mint"),
    (COMPOUND_ACCRUE_INTEREST, SUPPLY_RULE, "AccrueInterest"),
    ("0xde6857219544bb5b7746f48ed30be6386fefc61b2f864cacf559893bf50fd951", SUPPLY_RULE, "Aave Deposit"),
    (COMPOUND_BORROW, BORROW_RULE, "Compound Borrow"),
    ("0xc6a898309e823ee50bac64e45ca8adba6690e99e7841c45d754e2a38e9019d9b", BORROW_RULE, "Aave Borrow"),
    ("0x298637f684da70674f26509b10f07ec2fbc77a335ab1e7d6215a4b2484d8bb52", LIQUIDATION_RULE, "LiquidateBorrow"),
    ("0x00058a56ea94653cdf4f152d227ace22d4c00ad99e2a43f58cb7d9e3feb295f2", COLLATERAL_RULE, "ReserveUsedAsCollateralEnabled"),
]
IMPACT_SCHEMA = "topic0 string, impact_rule_id string, topic_name string"

# Chains searched by default.
DEFAULT_CHAINS = ("ethereum", "bnb", "base", "avalanche_c")

# Trace event types.
FEED_SET = "ORACLE_FEED_SET"
FORMULA_SET = "ORACLE_FORMULA_SET"
ANSWER = "ANSWER_UPDATED"
STALE_START = "STALE_ORACLE_START"
MALFUNCTION = "ORACLE_PRICE_MALFUNCTION"
MISMATCH = "ORACLE_IMPLEMENTATION_MISMATCH"
SUPPLY = "SUPPLY"
BORROW = "BORROW"
LIQUIDATE = "LIQUIDATE"
ABI_LOG = "ABI_LOG"
DANGER_TYPES = (FEED_SET, FORMULA_SET, ANSWER, STALE_START, MALFUNCTION, MISMATCH)
IMPACT_TYPES = (BORROW, LIQUIDATE)

# Alert types.
BAD_SUPPLY = "collateral_enabling_supply_under_bad_oracle"
STALE_SUPPLY = "collateral_enabling_supply_under_stale_oracle"
LOCALIZATION = "attacker_localization"
EARLY_ALERTS = (BAD_SUPPLY, STALE_SUPPLY)
# Constraint kind that each boundary event type is checked against.
KIND_OF_EVENT = {
    FEED_SET: "feed_mismatch",
    FORMULA_SET: "formula_mismatch",
    ANSWER: "stale_oracle",
    STALE_START: "stale_oracle",
    MALFUNCTION: "price_source_outlier",
    MISMATCH: "decimal_semantics_mismatch",
}

# Verification statuses of benign samples.
STRICT_STATUSES = ("materialized_no_replayable_constraint_violation", "verified_no_case_feed_mismatch")
UNKNOWN_STATUSES = ("unknown_after_materialization",)
REVIEW_STATUSES = ("needs_review_case_asset_other_feed",)

# Failure classes and evidence tiers.
FEED_BINDING = "feed_binding_failure"
COMPOSITION = "price_composition_failure"
FRESHNESS = "freshness_handling_failure"
TIER_A = "A_replayable"
TIER_B = "B_high_confidence_incomplete"
TIER_C = "C_remote_anomaly_only"
REJECTED = "reject_out_of_scope"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan itself, so Spark knows its size and broadcasts it when it fits."""
    types = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types.fields]
    arrays = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(columns, types.fields, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=types.fieldNames()), schema=types)


def boundary_rules(spark: SparkSession, contextual: bool = True) -> DataFrame:
    rows = [r for r in BOUNDARY_TOPICS if contextual or not r[4]]
    return inline(spark, rows, BOUNDARY_SCHEMA)


def impact_rules(spark: SparkSession) -> DataFrame:
    return inline(spark, IMPACT_TOPICS, IMPACT_SCHEMA)
