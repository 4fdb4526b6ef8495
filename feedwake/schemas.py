"""Schemas of the tables the operators read (Spark DDL)."""

LOGS = (
    "blockchain string, block_date date, block_time timestamp, block_number long, tx_hash string, tx_index int, log_index int, "
    "contract_address string, topic0 string, topic1 string, topic2 string, topic3 string, data string"
)
TRANSACTIONS = (
    "blockchain string, block_date date, block_time timestamp, block_number long, hash string, `from` string, `to` string, "
    "data string, success boolean"
)
TRACES_DECODED = "blockchain string, block_date date, tx_hash string, function_name string"
TRACES = (
    "blockchain string, block_date date, block_time timestamp, block_number long, tx_hash string, `from` string, `to` string, "
    "value string, value_double double, success boolean"
)
TRANSFERS = (
    "blockchain string, block_date date, block_time timestamp, block_number long, tx_hash string, evt_index int, "
    "contract_address string, `from` string, `to` string, amount double, amount_usd double"
)
ERC20 = "blockchain string, contract_address string, symbol string, name string, decimals int"
LABELS = "blockchain string, address string, name string, category string"
HISTORY = (
    "block_timestamp string, block_number string, transaction_hash string, transaction_index string, log_index string, "
    "address string, topic0 string, topic1 string, topic2 string, data string"
)
RECEIPTS = (
    "status string, blockNumber string, transactionIndex string, transactionHash string, blockTimestamp string, "
    "logs array<struct<address:string,topics:array<string>,data:string,logIndex:string>>"
)

FLOWS = "array<struct<tx_hash:string,log_index:bigint,token_address:string,from:string,to:string,amount_raw:string>>"

# Text unless a type is given; all fields may be missing.
DECODED_FIELDS = {
    "asset": "string", "actual_feed": "string", "expected_feed": "string", "actual_formula": "string",
    "expected_formula": "string", "feed": "string", "answer": "string", "updated_at": "long", "lower_bound_hit": "boolean",
    "reason": "string", "actual_fault": "string", "quote_asset": "string", "reported_rate": "string",
    "expected_oracle": "string", "actual_oracle": "string", "expected_semantics": "string", "actual_semantics": "string",
    "supplier": "string", "account": "string", "actor": "string", "amount": "string", "borrower": "string",
    "liquidator": "string", "collateral_asset": "string", "borrow_asset": "string", "borrow_amount": "string",
    "borrow_amount_usd": "string", "collateral_value_usd_reported": "string", "collateral_value_usd_expected": "string",
    "seized_amount": "string", "evidence_quality": "string", "source": "string", "selector": "string",
    "transfer_flow_summary": FLOWS,
}
DECODED = "struct<" + ",".join(f"{k}:{v}" for k, v in DECODED_FIELDS.items()) + ">"
TRACE = (
    "case string, event_type string, block_number long, block_timestamp long, transaction_index long, log_index long, "
    f"tx_hash string, address string, topic0 string, input_ord long, decoded {DECODED}"
)
CONSTRAINTS = (
    "case string, id string, type string, asset string, asset_aliases array<string>, expected_feed string, "
    "forbidden_feed string, expected_formula string, forbidden_formula string, heartbeat_seconds long, severity string"
)
CASES = "case string, name string, chain string, known_txs map<string,string>"

CASE_CONFIG_ENTRY = (
    "struct<name:string,chain:string,known_txs:map<string,string>,constraints:array<struct<id:string,type:string,asset:string,"
    "asset_aliases:array<string>,expected_feed:string,forbidden_feed:string,expected_formula:string,forbidden_formula:string,"
    "heartbeat_seconds:bigint,severity:string>>>"
)
