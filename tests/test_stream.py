"""The stream against the batch replay: rows shuffled and late, in several batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.plans.replay import replay
from feedwake.streaming.replay_stream import replay_stream, settled
from tests import traces as X

END = 10_000_000


def played(spark, folder, events, rules, batches, **options):
    """Alerts of a stream that gets ``batches`` (lists of places in ``events``) one after the other."""
    trace = X.trace_frame(spark, events).drop("input_ord").withColumn("input_ord", F.lit(0).cast("long"))
    whole = X.trace_frame(spark, events).cache()
    for places in batches:
        whole.where(F.col("input_ord").isin(places)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = replay_stream(source, X.constraint_frame(spark, rules), f"{folder}/out", f"{folder}/check", **options)
    assert query.awaitTermination(300) is not False
    whole.unpersist()
    return spark.read.schema(replay(trace, X.constraint_frame(spark, rules)).alerts.schema).parquet(f"{folder}/out")


def told(alerts):
    out = []
    for r in alerts.collect():
        reasons = json.loads(r["details"]).get("reasons") if r["record_role"] in ("borrow", "early_evidence") else None
        out.append((r["case"], r["type"], r["id"], tuple(r["pos"]), r["tx_hash"], r["severity"], r["record_role"], tuple(reasons or ()), tuple(sorted(r["candidate_actor_roles"].items()))))
    return sorted(out)


def timed(case, events):
    """The same events with a time that follows their block; updated_at keeps its distance."""
    return [(*e[:3], 100 * (e[2] + 1) + 5000, *e[4:]) for e in events]


def test_shuffled_late_rows_give_the_alerts_of_the_batch(spark, tmp_path):
    cases = [X.random_case(seed) for seed in range(40)]
    events = [e for case, es, _ in cases for e in timed(case, es)]
    rules = [r for _, _, rs in cases for r in rs]
    want = told(replay(X.trace_frame(spark, events), X.constraint_frame(spark, rules)).alerts)
    assert {w[1] for w in want} >= {R.LOCALIZATION, *R.EARLY_ALERTS, "feed_mismatch", "stale_oracle"} and {w[6] for w in want} >= {"liquidation", "borrow"}
    order = list(range(len(events)))
    random.Random(1).shuffle(order)
    cut = len(order) // 5 + 1
    events.append(X.event("end", "ORACLE_FEED_REPAIRED", 1, stamp=END))
    batches = [order[k * cut : (k + 1) * cut] for k in range(5)] + [[len(events) - 1]]
    got = settled(played(spark, tmp_path, events, rules, batches, delay="1 hour", parts=3))
    assert told(got) == want


def test_a_supply_is_told_when_its_impact_arrives_and_accounts_are_forgotten(spark, tmp_path):
    said = {"asset": "USDC", "actual_feed": "BAD"}
    events = [
        X.event("c", R.FEED_SET, 1, stamp=1000, tx_hash="0x1", **said), X.event("c", R.SUPPLY, 2, stamp=1010, tx_hash="0x2", supplier="ann", asset="USDC", amount="5"),
        X.event("c", R.SUPPLY, 3, stamp=1020, tx_hash="0x3", supplier="bob", asset="USDC", amount="5"),
        X.event("c", R.LIQUIDATE, 4, stamp=1030, tx_hash="0x4", liquidator="ann", collateral_asset="USDC"),
        X.event("end", "ORACLE_FEED_REPAIRED", 1, stamp=1200),
        X.event("c", R.LIQUIDATE, 9, stamp=9000, tx_hash="0x9", liquidator="bob", collateral_asset="USDC"),
        X.event("end", "ORACLE_FEED_REPAIRED", 1, stamp=99_000),
    ]
    rules = [X.constraint("c", "F", "feed_mismatch", "USDC", expected_feed="good")]
    got = told(played(spark, tmp_path, events, rules, [[3, 1], [2, 0], [4], [5], [6]], delay="1 minute", keep="1 hour", parts=2))
    assert [(g[1], g[4]) for g in got] == [("attacker_localization", "0x4"), ("attacker_localization", "0x9"), (R.BAD_SUPPLY, "0x2"), ("feed_mismatch", "0x1")]
    state = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "held").load()
    assert state.count() == 0
    waiting = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("stateVarName", "waiting").load()
    assert waiting.count() == 0


@pytest.mark.parametrize("amounts", [[100, 9, 10, 11, 0, None, 1], [None, -5, 5]])
def test_kept_supplies_grow_with_the_logarithm_of_the_amounts(amounts):
    from feedwake.streaming.replay_stream import Held

    held = Held(None)
    for k in range(5000):
        held.supply(str(k), amounts[k % len(amounts)], "{}", False)
    assert len(held.supplies) < 120
    assert Held(held.text()).supplies == held.supplies
