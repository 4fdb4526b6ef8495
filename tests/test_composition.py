"""The composition search over small chain tables: pairs, market tags and what is read and written."""

import datetime as dt

from pyspark.sql import functions as F

from feedwake.harness import broad_queries as BQ
from feedwake.operators import broad as B
from feedwake.operators import joins as J

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MOVE = "blockchain string, block_date date, block_time timestamp, block_number long, tx_hash string, `from` string, `to` string, contract_address string, amount double, amount_usd double"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def address(i):
    return "0x" + f"{i:040x}".replace("0", "e")


def tables(spark):
    market, asset = address(1), address(2)
    labels = spark.createDataFrame([("e", address(3), "aave oracle usdc"), ("e", address(3), "aave oracle usdc")], "blockchain string, address string, name string")
    tokens = spark.createDataFrame([("e", market, "aUSDC", "aave USDC"), ("e", asset, "wstETH", "aave wstETH")], "blockchain string, contract_address string, symbol string, name string")
    sent = [(f"c{i}", at(i), "0xabcdef01" + "0" * 24 + asset[2:]) for i in range(6)] + [("c0", at(3), "0xabcdef01" + "0" * 24 + asset[2:]), ("quiet", at(1), "0xabcdef01")]
    calls = spark.createDataFrame([("e", t.date(), t, i, h, "u", address(3), d, True) for i, (h, t, d) in enumerate(sent)],
                                  "blockchain string, block_date date, block_time timestamp, block_number long, hash string, `from` string, `to` string, data string, success boolean")
    traces = spark.createDataFrame([("e", T0.date(), h, "setPriceFeed" if h != "quiet" else "sync") for h in sorted({h for h, _, _ in sent})],
                                   "blockchain string, block_date date, tx_hash string, function_name string")
    moves = []
    for i in range(40):
        t, tx = at(i * 0.75), f"x{i % 25}"  # transactions with several moments
        sides = ((market, "v"), ("v", market), ("w", "v"), (market, market), ("w", "v"))[i % 5]
        moves.append(("e", t.date(), t, i, tx, *sides, asset if i % 3 else address(9), 1.0, float(2 ** (i % 20))))
    moves.append(("e", T0.date(), at(2), 99, None, market, "v", asset, 1.0, 0.5))
    moves.append(("e", T0.date(), at(2), 99, None, "w", "v", asset, 1.0, 0.25))
    return labels, tokens, calls, traces, spark.createDataFrame(moves, MOVE), moves, sent, market, asset


def wanted(moves, sent, market, asset, hours):
    """As the search pairs them: one act for each transaction at a market, one for each transaction and hinted token elsewhere."""
    opened = {(h, t) for h, t, _ in sent if h != "quiet"}
    reach = [m for m in moves if any(t <= m[2] < t + dt.timedelta(hours=hours) for _, t in opened)]
    acts = {}
    for m in reach:
        kind = "market" if market in m[5:7] else m[7]
        if kind in ("market", asset):
            first, usd = acts.get((m[4], kind), (m[2], 0.0))
            acts[m[4], kind] = (min(first, m[2]), usd + m[9])
    rows = {}
    for h, t in opened:
        for (tx, _), (seen, usd) in acts.items():
            if t <= seen < t + dt.timedelta(hours=hours):
                first, total = rows.get((h, tx), (seen, 0.0))
                rows[h, tx] = (min(first, seen), total + usd)
    return rows


def test_market_pairs_are_listed_without_an_aggregation(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARE", 8)
    labels, tokens, calls, traces, transfers, moves, sent, market, asset = tables(spark)
    found = B.composition_impact_txs(labels, tokens, calls, traces, transfers, hours=8)
    rows = [((r["trigger_tx"], r["impact_tx"]), (r["impact_time"].astimezone(dt.timezone.utc), r["usd"])) for r in found.collect()]
    want = wanted(moves, sent, market, asset, 8)
    assert len(rows) == len(dict(rows)) and dict(rows) == want
    assert any(tx is None for _, tx in want) and len(want) > 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parts = plan.split("Union")[1].split("Aggregate")  # the pairs that come once stand before the ones that are summed up
    assert "Join Inner" in parts[0]


def test_a_transfer_is_tagged_by_the_side_that_may_be_a_market(spark, monkeypatch):
    """A bitmap of few places says yes to all, so every side is asked; still only true markets count."""
    labels, tokens, calls, traces, transfers, moves, _, market, asset = tables(spark)
    markets = spark.createDataFrame([("e", market)], "blockchain string, address string")
    known = spark.createDataFrame([("e", asset)], "blockchain string, token string")
    columns = ["blockchain", "tx_hash", "block_time", F.col("contract_address").alias("token"), "from", "to", F.col("amount_usd").alias("usd")]
    for places in (J.PLACES, 1 << 3):
        monkeypatch.setattr(J, "PLACES", places)
        tagged = B._tagged(transfers.select(*columns), markets, known)
        got = sorted((r["usd"], r["tx_hash"] or "", r["at_market"]) for r in tagged.collect() if r["at_market"] or r["token"] == asset)
        assert got == sorted((m[9], m[4] or "", market in m[5:7]) for m in moves if market in m[5:7] or m[7] == asset)
        assert tagged.columns == ["blockchain", "tx_hash", "block_time", "token", "usd", "at_market"]


def test_stage_counts_and_candidates_share_their_pieces(spark, monkeypatch):
    labels, tokens, calls, traces, transfers, *_ = tables(spark)
    ran = []
    for name in ("formula_changes", "asset_hints", "market_moves", "composition_impacts"):
        monkeypatch.setattr(B, name, lambda *a, _f=getattr(B, name), _n=name, **k: (ran.append(_n), _f(*a, **k))[1])
    stages = B.price_composition_stages(labels, tokens, calls, traces, transfers)
    assert sorted(ran) == ["asset_hints", "composition_impacts", "formula_changes", "market_moves"]
    counts = {k: rows.count() for k, (rows, *_) in stages.items()}
    candidates = B.price_composition_candidates(labels, tokens, calls, traces, transfers)
    tiers = stages["tiered_candidates"][0].withColumnRenamed("blockchain", "chain").select(*candidates.columns)
    assert counts["tiered_candidates"] == candidates.count() > 0 and counts["impact_activity"] == 6
    assert sorted(map(repr, tiers.collect())) == sorted(map(repr, candidates.collect()))


def test_transfers_are_not_written_before_the_search(spark, monkeypatch, tmp_path):
    rows = {
        "supplier": ([(1, 2)], "s_suppkey long, s_nationkey int"), "part": ([(1,)], "p_partkey long"),
        "orders": ([(1, 1, "1-URGENT", "O", 5.0, T0)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
        "lineitem": ([(1, 1, 1, 1, "A", 2.0, 3.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double"),
    }
    for name, (values, shape) in rows.items():
        spark.createDataFrame(values, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    given = []
    monkeypatch.setattr(B, "price_composition_candidates", lambda *a, **k: given.extend(a))
    BQ._r2(spark, str(tmp_path))
    transactions, traces, transfers = given[2:]
    assert all("table-" not in f for f in transfers.inputFiles()) and transfers.count() == 1
    assert set(transactions.inputFiles()) == set(traces.inputFiles()) and all("table-" in f for f in traces.inputFiles())
