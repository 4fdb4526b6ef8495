import datetime as dt
import random


from feedwake import rules as R
from feedwake.operators import closure as C
from feedwake.operators import joins as J
from feedwake.operators import sampling as SMP

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BOUNDARY = ("chain string, trigger_year long, trigger_time timestamp, trigger_block long, boundary_tx_hash string, boundary_contract string, "
            "scope_class string, boundary_rule_id string, normalized_answer double")
IMPACT = ("chain string, impact_time timestamp, impact_block long, impact_tx_hash string, impact_log_index int, actor string, market_contract string, "
          "protocol_cluster_id string, impact_rule_id string")


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def sets(seed):
    rng = random.Random(seed)
    edges = [("hot", 2024, at(rng.randint(0, 200)), i, f"t{i}", "c", R.S2, "rule", None) for i in range(40)]
    impacts = [("hot", at(rng.randint(0, 220)), 100 + i, f"x{rng.randint(0, 60)}", i, f"a{rng.randint(0, 8)}", f"m{rng.randint(0, 4)}", rng.choice(["p", "q"]), R.BORROW_RULE) for i in range(150)]
    return edges, impacts


def test_config_closure_and_its_transactions(spark):
    edges, impacts = sets(3)
    b, i = spark.createDataFrame(edges, BOUNDARY), spark.createDataFrame(impacts, IMPACT)
    found = C.config_impact_closure(b, i, hours=10)
    rows = {r["trigger_tx"]: r for r in found.collect()}
    listed = {}
    for r in C.closure_impact_txs(found, i, 10).collect():
        listed.setdefault(r["trigger_tx"], set()).add(r["impact_tx"])
    for _, _, t, _, tx, *_ in edges:
        near = sorted((x for x in impacts if t < x[1] <= t + dt.timedelta(hours=10)), key=lambda x: (x[1], x[2]))
        if not near:
            assert tx not in rows
            continue
        order = list(dict.fromkeys(x[3] for x in near))
        r = rows[tx]
        assert (r["impact_tx_count"], r["actor_count"], r["market_count"]) == (len(order), len({x[5] for x in near}), len({x[6] for x in near}))
        assert r["leading_impact_txs"] == order[:2] and r["protocol_cluster_id"] == near[0][7] and listed[tx] == set(order)


def test_same_protocol_closure(spark):
    edges, impacts = sets(4)
    b, i = spark.createDataFrame(edges, BOUNDARY), spark.createDataFrame(impacts, IMPACT)
    clusters = spark.createDataFrame([("hot", "c", "p")], "chain string, boundary_contract string, protocol_cluster_id string")
    got = {r["trigger_tx"]: r["impact_tx_count"] for r in C.config_impact_closure(b, i, 10, same_protocol=True, clusters=clusters).collect()}
    for _, _, t, _, tx, *_ in edges:
        near = {x[3] for x in impacts if t < x[1] <= t + dt.timedelta(hours=10) and x[7] == "p"}
        assert got.get(tx, 0) == len(near)


def test_freshness_counts_each_account_once_unless_asked(spark):
    edge = [("hot", 2024, at(0), 1, "t", "c", R.S1, "rule", 0.5)]
    impacts = [("hot", at(1), 2, "s", 0, "a", "m", "p", R.SUPPLY_RULE), ("hot", at(2), 3, "b1", 0, "a", "m", "p", R.BORROW_RULE), ("hot", at(3), 4, "b2", 0, "a", "m", "p", R.BORROW_RULE)]
    same = C.same_actor_supply_borrow(spark.createDataFrame(impacts, IMPACT))
    b = spark.createDataFrame(edge, BOUNDARY)
    once, twice = C.freshness_closure(b, same).first(), C.freshness_closure(b, same, count_twice=True).first()
    assert (once["impact_tx_count"], twice["impact_tx_count"], once["leading_impact_txs"]) == (2, 4, ["s", "b1"])


def test_sample_statuses(spark):
    asset, bad, good, other = ("0x" + c * 40 for c in "1234")
    word = lambda a: "0x" + a[2:].rjust(64, "0")
    log = lambda tx, topics, i: (tx, "0xc0", "0xt", ["0xt", *topics], i)
    logs = spark.createDataFrame(
        [log("0x1", [word(asset), word(bad)], 1), log("0x2", [word(asset), word(good)], 1), log("0x3", [word(asset), word(other)], 1), log("0x4", [], 2), log("0x5", [], 3)],
        "tx_hash string, address string, topic0 string, topics array<string>, log_index long")
    samples = spark.createDataFrame([(f"s{i}", f"0x{i}", "feed", "0xc0", "0xT") for i in (1, 2, 3)] + [("s4", "0x4", "dec", "0xc0", "0xt"), ("s5", "0x9", "dec", "0xc0", "0xt"), ("s6", "0x5", "plain", "", "")],
                                    "sample_id string, tx_hash string, case_related_to string, contract_address string, topic0 string")
    rules = spark.createDataFrame([("feed", "feed", asset, bad, good), ("dec", "decode", None, None, None), ("plain", "receipt", None, None, None)],
                                  "case string, mode string, asset string, forbidden_feed string, expected_feed string")
    abi = spark.createDataFrame([("0xt", "Thing")], "topic0 string, event_name string")
    got = {r["sample_id"]: (r["verification_status"], r["replay_event_type"], r["matching_log_count"]) for r in SMP.classify_samples(samples, logs, abi, rules).collect()}
    plain = "BENIGN_ORACLE_SCOPE_LOG"
    assert got == {
        "s1": ("violated_constraint", R.FEED_SET, 1), "s2": (R.STRICT_STATUSES[1], plain, 1), "s3": (R.REVIEW_STATUSES[0], R.FEED_SET, 1),
        "s4": (R.STRICT_STATUSES[0], plain, 1), "s5": (R.UNKNOWN_STATUSES[0], plain, 0), "s6": (R.STRICT_STATUSES[0], plain, 1)}


def test_impact_transactions_are_listed_without_an_aggregation(spark, monkeypatch):
    """Dense tiles in many blocks; then triggers of several times and clusters, whose transactions come once, with the first time seen."""
    monkeypatch.setattr(J, "SHARE", 50)
    rng = random.Random(8)
    shape = "chain string, trigger_tx string, trigger_block long, matched_rule string, trigger_time timestamp, protocol_cluster_id string"
    plain = [("hot", f"t{i}", i, "rule", at(rng.randint(0, 60)), "p") for i in range(200)]
    several = [("hot", "s", 1, None, at(5), "p"), ("hot", "s", 1, None, at(9), "q"), ("hot", None, None, "rule", at(30), "p"), ("hot", None, None, "rule", at(33), "p"), (None, "n", 1, "rule", at(1), "p")]
    impacts = [("hot", at(rng.randint(0, 60)), i, rng.choice([f"x{rng.randint(0, 40)}", None]), i, "a", "m", rng.choice(["p", "q", None]), R.BORROW_RULE) for i in range(300)]
    impacts += [(None, at(2), 1, "x", 1, "a", "m", "p", R.BORROW_RULE), ("hot", None, 1, "x1", 1, "a", "m", "p", R.BORROW_RULE)]
    events = spark.createDataFrame(impacts * 2, IMPACT)
    for rows, same in ((plain, False), (plain, True), (plain + several, False), (plain + several, True)):
        listed = C.closure_impact_txs(spark.createDataFrame(rows * 2, shape), events, 10, same_protocol=same)
        want = {}
        for chain, tx, block, rule, t, cluster in rows:
            for x in impacts:
                if chain and chain == x[0] and x[1] and t < x[1] <= t + dt.timedelta(hours=10) and (not same or cluster == x[7]):
                    key = (chain, tx, block, rule, x[3])
                    want[key] = min(want.get(key, x[1]), x[1])
        got = [(r["chain"], r["trigger_tx"], r["trigger_block"], r["matched_rule"], r["impact_tx"], r["impact_time"].astimezone(dt.timezone.utc)) for r in listed.collect()]
        assert sorted(got, key=repr) == sorted(((*k, v) for k, v in want.items()), key=repr)
        if rows is plain:
            assert "Aggregate" not in listed._jdf.queryExecution().optimizedPlan().toString()
