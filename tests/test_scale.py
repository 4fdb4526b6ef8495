"""What keeps searches from moving all rows: whole keys, filters before joins, and rows read once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.operators import broad as B
from feedwake.operators import closure as C
from feedwake.operators import decode as DEC
from feedwake.operators import incidents as INC
from feedwake.operators import timeline as TL
from feedwake.operators.dedupe import sequence_within
from feedwake.operators.joins import first_match, likely
from feedwake.plans import replay as RP
from feedwake.storage import write_table
from tests import traces as X


def test_only_keys_on_a_bound_need_totals(spark):
    many = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("t"))
    chunks = TL.cut(many.repartition(4), ["k"], ["t"])
    parted = chunks.where(F.col(TL.CHUNK) != TL.WHOLE).select("k").distinct().count()
    assert parted <= chunks.select(TL.CHUNK).distinct().count()
    found = TL.running(chunks, ["k"], ["t"], [TL.Scan("n", "count", F.lit(1))])
    assert found.where(F.col("n") != F.floor(F.col("t") / 5000) + 1).count() == 0


def test_likely_keeps_partners_and_drops_most_others(spark):
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("a"), (F.col("id") + 20_000).cast("string").alias("b"))
    known = spark.createDataFrame([("5",), ("20007",), (None,)], "k string")
    kept = {r["a"] for r in likely(rows, known, ["a"], ["b"]).collect()}
    assert {"5", "7"} <= kept and len(kept) < 20
    assert likely(rows, known.where("false"), ["a"]).count() == 0


def test_rows_are_numbered_without_a_second_shuffle(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20_011).alias("t")).repartition(4)
    whole = sequence_within(rows, [], ["t"], "n")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    found = sorted((r["t"], r["n"]) for r in whole.collect())
    assert [n for _, n in found] == list(range(1, 20_001))
    # also where a key, or the rows without one, lie in several chunks
    per_key = {}
    for r in sequence_within(rows, ["k"], ["t"], "n").collect():
        per_key.setdefault(r["k"], []).append((r["t"], r["n"]))
    assert set(per_key) == {None, 1, 2}
    for found in per_key.values():
        assert [n for _, n in sorted(found)] == list(range(1, len(found) + 1))
    assert sequence_within(rows.where("false"), ["k"], ["t"], "n").count() == 0


def test_only_acts_on_bad_assets_are_scanned_for_supplies(spark, monkeypatch):
    cases = [X.random_case(seed) for seed in range(30)]
    result = RP.replay(X.trace_frame(spark, [e for _, es, _ in cases for e in es]), X.constraint_frame(spark, [r for _, _, rs in cases for r in rs]))
    scanned, running = [], RP.running

    def seen(chunks, *args, **more):
        scanned.append(chunks)
        return running(chunks, *args, **more)

    monkeypatch.setattr(RP, "running", seen)
    assert result.supplies.count() > 0
    assert scanned[0].where(~F.col("risky")).count() == 0 and 0 < scanned[0].count() < result._acts.count()
    assert scanned[0].schema["decoded"].dataType.names == ["asset", "amount", "actor"]


def test_keys_are_kept_once_in_a_timeline(spark):
    left = spark.createDataFrame([("x", 1, 5), ("x", 9, 6), (None, 1, 7)], "k string, at int, id long")
    right = spark.createDataFrame([("x", 3), ("x", 4)], "k string, at int")
    found = first_match(left, right, ["k"], F.col("at"), F.col("at"), F.col("at"), "hit")
    assert found.columns == ["k", "at", "id", "hit"]
    assert sorted((r["k"] or "", r["id"], r["hit"]) for r in found.collect()) == [("", 7, None), ("x", 5, 3), ("x", 6, None)]


def test_loss_reads_transfers_once(spark):
    moves = write_table(spark.createDataFrame(
        [("e", "t1", "m", 5, 3, "USDC", "tok", 0.5, "u", "known_token_flow"), ("e", "t2", "z", 7, 1, "ABC", "tok", 7.0, "u", "known_token_flow"),
         (None, "t4", "m", 5, 3, "USDC", "tok", 0.5, "u", "mint_or_burn")],
        "blockchain string, tx_hash string, `from` string, amount_raw long, log_index long, symbol string, token_address string, amount double, `to` string, "
        "classification string"))
    events = spark.createDataFrame(
        [("e", "t1", "Borrow", "m", "a", 5, 2), ("e", "t1", "Borrow", "m", "a", 9, 8), ("e", "t3", "Borrow", "m", "a", 4, 1), (None, "t4", "Borrow", "m", "a", 5, 1)],
        "blockchain string, tx_hash string, event string, market_address string, account string, amount_raw long, log_index long")
    found = DEC.loss_estimate(events, moves)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    rows = sorted((r["tx_hash"], r["confidence"], r["primary_asset"], r["primary_amount_raw"], r["matched_transfer_log_index"]) for r in found.collect() if r["blockchain"])
    assert rows == [("t1", "protocol_event_decoded", "USDC", 5, 3), ("t2", "receipt_flow_estimated", "ABC", 7, None), ("t3", "protocol_event_decoded", "UNKNOWN", 4, None)]
    # without a chain, event and transfer are no pair
    assert sorted(r["confidence"] for r in found.collect() if not r["blockchain"]) == ["not_decodable", "protocol_event_decoded"]


MOVE = "blockchain string, block_date date, block_time timestamp, block_number long, tx_hash string, `from` string, `to` string, contract_address string, amount double, amount_usd double"


def _moves(spark):
    at = lambda hour: f"2024-01-02 {hour:02d}:00:00"
    rows = [("e", at(1), 1, "in", "u", "M", "M", 9.0, 20000.0), ("e", at(5), 2, "out", "N", "u", "N", 9.0, 20000.0), ("e", at(8), 3, "late", "N", "u", "N", 9.0, 20000.0),
            ("e", at(1), 4, "other", "s", "w", "M", 9.0, 20000.0), ("e", at(1), 5, "alone", "w", "M", "M", 9.0, 20000.0)]
    return spark.createDataFrame([(c, None, t, *rest) for c, t, *rest in rows], MOVE.replace("block_time timestamp", "block_time string")).withColumn(
        "block_time", F.to_timestamp("block_time")).select(*[p.split()[0].strip("`") for p in MOVE.split(", ")])


def test_only_transfers_of_markets_and_paired_accounts_stay(spark):
    markets = spark.createDataFrame([("e", "M"), ("e", "N")], "blockchain string, market_address string")
    moves = B.account_moves(_moves(spark), markets)
    assert {r["tx_hash"] for r in moves.collect()} == {"in", "out", "late", "alone"}
    assert {"in", "out"} <= {r["tx_hash"] for r in B.paired_moves(moves, 6).collect()} <= {"in", "out", "late"}


def test_outflows_of_accounts_come_from_few_rows(spark):
    accounts = spark.createDataFrame([("e", "u", "2024-01-02 01:00:00")], "blockchain string, account string, t string").select(
        "blockchain", "account", F.to_timestamp("t").alias("first_deposit_time"))
    markets = spark.createDataFrame([("e", "N", "cN")], "blockchain string, market_address string, market_symbol string")
    tokens = spark.createDataFrame([("e", "N", "N")], "blockchain string, contract_address string, symbol string")
    native = _moves(spark).withColumns({"success": F.lit(True), "value_double": F.col("amount")})
    flows = INC.borrow_outflows(accounts, _moves(spark), native, markets, tokens, "cn", tokens.where("false"))
    assert sorted((r["tx_hash"], r["native"]) for r in flows.collect()) == [("out", False), ("out", True)]


def test_a_frequent_value_changes_counts_at_few_moments(spark):
    rows = spark.range(5000).select(F.lit("c").alias("k"), (F.col("id") * 7).alias("t"), F.lit("hot").alias("v"), F.col("id").alias("own"))
    widths = [1000, 3000]
    steps = TL.distinct_steps(rows.where("t < 10000 or t > 15000"), ["k"], F.col("t"), widths, {"vs": "v"})
    assert steps.count() == 6
    found = sorted((r["_at"], r["_step_vs_0"], r["_step_vs_1"]) for r in steps.collect())
    first, last = 15001 + (-15001 % 7), 4999 * 7
    assert found == [(-3000, None, 1), (-1000, 1, None), (9996, -1, -1), (first - 3000, None, 1), (first - 1000, 1, None), (last, -1, -1)]


def test_closures_sort_their_timeline_once_and_runs_cross_chunks(spark):
    rng, t0 = random.Random(5), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    edges = [("hot", 2024, t0 + dt.timedelta(minutes=rng.randint(0, 9000)), i, f"t{i}", "c", R.S2, "rule", None) for i in range(300)]
    # long runs of one transaction, so that the next one of another lies some chunks on
    impacts = [("hot", t0 + dt.timedelta(minutes=20 * i), 1000 + i, f"x{i // 90 if i < 400 else rng.randint(0, 9)}", i, f"a{rng.randint(0, 30)}", f"m{i % 3}", "p", R.BORROW_RULE)
               for i in range(460)]
    b = spark.createDataFrame(edges, "chain string, trigger_year long, trigger_time timestamp, trigger_block long, boundary_tx_hash string, boundary_contract string, "
                                     "scope_class string, boundary_rule_id string, normalized_answer double")
    # rows that come twice are no second transaction
    i = spark.createDataFrame(impacts * 2, "chain string, impact_time timestamp, impact_block long, impact_tx_hash string, impact_log_index int, actor string, "
                                       "market_contract string, protocol_cluster_id string, impact_rule_id string")
    options = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        closures = C.config_impact_closure(b, i, hours=48)
        rows = {r["trigger_tx"]: r for r in closures.collect()}
        plan = closures._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Window [") <= 4  # two over the rows, two over one row a chunk
    for _, _, t, _, tx, *_ in edges:
        near = [x for x in impacts if t < x[1] <= t + dt.timedelta(hours=48)]
        if not near:
            assert tx not in rows
            continue
        r, order = rows[tx], list(dict.fromkeys(x[3] for x in near))
        assert (r["impact_tx_count"], r["actor_count"], r["market_count"]) == (len(order), len({x[5] for x in near}), len({x[6] for x in near}))
        assert (r["leading_impact_txs"], r["first_impact_time"].timestamp()) == (order[:2], near[0][1].timestamp())
