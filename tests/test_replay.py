import json

from feedwake import rules as R
from feedwake.plans.replay import replay
from tests import traces as X


def observed(result):
    alerts = {}
    for row in result.alerts.collect():
        pos = tuple(row["pos"])
        details = json.loads(row["details"])
        if row["type"] in R.EARLY_ALERTS or row["record_role"] == "borrow":
            note = "|".join(details["reasons"])
        else:
            note = "" if row["record_role"] == "liquidation" else row["id"]
        alerts.setdefault(row["case"], []).append((row["type"], pos, note))
    actors = {}
    for row in sorted(result.actors.collect(), key=lambda r: r["first_mark"]):
        actors.setdefault(row["case"], []).append(row["address"])
    return alerts, actors


def test_random_traces_agree_with_definitions(spark):
    cases = [X.random_case(seed) for seed in range(150)]
    events = [e for _, es, _ in cases for e in es]
    rules = [r for _, _, rs in cases for r in rs]
    alerts, actors = observed(replay(X.trace_frame(spark, events), X.constraint_frame(spark, rules)))
    chosen = 0
    for case, es, rs in cases:
        start = events.index(es[0])
        want_alerts, want_actors = X.by_definition(es, rs)
        shifted = sorted((t, (*p[:3], p[3] + start), n) for t, p, n in want_alerts)
        assert sorted(alerts.get(case, [])) == shifted, case
        assert actors.get(case, []) == want_actors, case
        chosen += sum(t in R.EARLY_ALERTS for t, _, _ in want_alerts)
    assert chosen > 100


def test_wrong_feed_then_supply_and_borrow(spark):
    who = "0xcafe"
    events = [
        X.event("feed", R.FEED_SET, 10, 3, 1, 1000, "0xconfig", asset="USDC", actual_feed="BTC/USD", expected_feed="USDC/USD"),
        X.event("feed", R.SUPPLY, 12, 1, 4, 1012, "0xattack", supplier=who, asset="USDC", amount="unknown"),
        X.event("feed", R.BORROW, 12, 1, 9, 1012, "0xattack", borrower=who, actor=who, collateral_asset="USDC", borrow_asset="ETH",
                borrow_amount="187"),
        X.event("feed", "ORACLE_FEED_REPAIRED", 20, 0, 0, 1100, "0xfix", asset="USDC"),
    ]
    rules = [
        X.constraint("feed", "USDC_FEED", "feed_mismatch", "USDC", expected_feed="USDC/USD", forbidden_feed="BTC/USD", severity="critical"),
        X.constraint("feed", "COLLATERALIZED", "borrow_collateralization", severity="critical"),
    ]
    result = replay(X.trace_frame(spark, events), X.constraint_frame(spark, rules))
    rows = sorted(result.alerts.collect(), key=lambda r: r["pos"])
    assert [r["type"] for r in rows] == ["feed_mismatch", R.BAD_SUPPLY, R.LOCALIZATION]
    assert json.loads(rows[1]["details"])["reasons"] == ["bad_oracle:first_risky_collateral_supply", "bad_oracle:latest_topup_before_impact"]
    actors = result.actors.collect()
    assert [(a["address"], a["roles"]) for a in actors] == [(who, ["borrower"])]
    assert result.marks.collect()[0]["summary"] == "borrowed 187 ETH against USDC"
    assert {(s["asset_key"], s["kind"]) for s in result.state.collect()} == {("usdc", "feed_mismatch")}


def test_source_outlier_marks_borrower_then_actor(spark):
    events = [X.event("outlier", R.MALFUNCTION, 0, 0, 0, 50, "", asset="wrsETH", feed="0xfeed", reported_rate="1649934")]
    events += [
        X.event("outlier", R.BORROW, 0, i, 0, 60 + i, f"0xb{i}", borrower="0xcontract", actor="0xowner", collateral_asset="wrsETH",
                borrow_asset="wstETH", borrow_amount="20") for i in range(1, 13)
    ]
    rules = [X.constraint("outlier", "SOURCE", "price_source_outlier", "wrsETH", severity="critical")]
    result = replay(X.trace_frame(spark, events), X.constraint_frame(spark, rules))
    kinds = [r["type"] for r in result.alerts.collect()]
    assert kinds.count("price_source_outlier") == 1 and kinds.count(R.LOCALIZATION) == 12
    actors = sorted(result.actors.collect(), key=lambda r: r["first_mark"])
    assert [(a["address"], a["roles"], a["tx_count"]) for a in actors] == [("0xcontract", ["borrower"], 12), ("0xowner", ["actor"], 12)]


def test_stale_marker_does_not_alert_liquidations(spark):
    events = [
        X.event("stale", R.STALE_START, 1, asset="LUNA", stamp=10, tx_hash="0xs"),
        X.event("stale", R.LIQUIDATE, 2, liquidator="l", borrower="b", collateral_asset="luna", tx_hash="0xl"),
        X.event("stale", R.BORROW, 3, borrower="b", collateral_asset="LUNA", tx_hash="0xb"),
    ]
    result = replay(X.trace_frame(spark, events), X.constraint_frame(spark, [X.constraint("stale", "FRESH", "stale_oracle", "LUNA", heartbeat=60)]))
    assert sorted(r["type"] for r in result.alerts.collect()) == [R.LOCALIZATION, "stale_oracle"]


def test_strict_state_ignores_correct_feed_events(spark):
    events = [
        X.event("ok", R.FEED_SET, 1, asset="USDC", actual_feed="USDC/USD", tx_hash="0xa"),
        X.event("ok", R.BORROW, 2, borrower="b", collateral_asset="USDC", tx_hash="0xb"),
    ]
    rules = X.constraint_frame(spark, [X.constraint("ok", "F", "feed_mismatch", "USDC", expected_feed="USDC/USD")])
    trace = X.trace_frame(spark, events)
    assert [r["type"] for r in replay(trace, rules).alerts.collect()] == [R.LOCALIZATION]
    assert replay(trace, rules, strict_state=True).alerts.count() == 0


def test_one_replay_writes_two_tables_for_all_results(spark):
    from feedwake import storage
    from feedwake.plans import evaluate as E

    cases = [X.random_case(seed) for seed in range(12)]
    trace = X.trace_frame(spark, [e for _, es, _ in cases for e in es])
    rules = X.constraint_frame(spark, [r for _, _, rs in cases for r in rs])
    before = sum(map(len, storage._WRITTEN.values()))
    result = replay(trace, rules)
    assert sum(map(len, storage._WRITTEN.values())) == before, "a replay that nothing was asked of writes nothing"
    for part in (result.alerts, result.actors, result.state, E.log_level_metrics(E.record_flags(trace, result.alerts))):
        part.collect()
    samples = spark.createDataFrame([("s", "t", "strict_benign", "BORROW", "S1", True)], "sample_id string, tx_hash string, verification_status string, replay_event_type string, scope_class string, abi_available boolean")
    E.ablation(trace, rules, samples, result=result).collect()
    assert sum(map(len, storage._WRITTEN.values())) == before + 2


def test_ablation_variants_are_replays_of_cut_traces(spark):
    """Filters of one replay's alerts against a replay of each variant's own rows."""
    from pyspark.sql import functions as F

    from feedwake.plans import evaluate as E

    cases = [X.random_case(seed) for seed in range(40)]
    trace = X.trace_frame(spark, [e for _, es, _ in cases for e in es])
    rules = X.constraint_frame(spark, [r for _, _, rs in cases for r in rs])
    samples = spark.createDataFrame([], "sample_id string, tx_hash string, verification_status string, replay_event_type string, scope_class string, abi_available boolean")
    got = {r["variant"]: r for r in E.ablation(trace, rules, samples).collect()}
    shown = {E.FULL: trace, E.BOUNDARY_ONLY: trace.where(F.col("event_type").isin(*R.DANGER_TYPES)), E.IMPACT_ONLY: trace.where(F.col("event_type").isin(*R.IMPACT_TYPES))}
    for variant, rows in shown.items():
        own = replay(rows, rules)
        assert got[variant]["attack_alert_cases"] == own.alerts.select("case").distinct().count(), variant
        assert got[variant]["replayable_attack_cases"] == own.localized.where("tx_hash <> ''").select("case").distinct().count(), variant
        assert got[variant]["detected_impact_txs"] == own.localized.where("tx_hash <> ''").select("case", "tx_hash").distinct().count(), variant
    assert got[E.IMPACT_ONLY]["attack_alert_cases"] > 0 and got[E.ABI_ONLY]["attack_alert_cases"] == 0
