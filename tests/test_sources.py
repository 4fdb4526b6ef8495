import json

import pytest
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake import schemas as S
from feedwake.sources import files, tables
from tests import traces as X


def test_trace_keeps_file_order_and_rejects_bad_lines(spark, tmp_path):
    good = tmp_path / "t.jsonl"
    lines = [{"case": "c", "event_type": "SUPPLY", "block_number": 5, "tx_hash": f"0x{i}", "decoded": {"asset": "A"}} for i in range(40)]
    good.write_text("\n".join(json.dumps(x) for x in lines) + "\n\n")
    rows = files.read_trace(spark, str(good)).orderBy("input_ord").collect()
    assert [r["tx_hash"] for r in rows] == [f"0x{i}" for i in range(40)] and rows[0]["decoded"]["asset"] == "A"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"case": "c"}\n{"case": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), "case string").collect()
    assert files.read_jsonl_if_exists(spark, str(tmp_path / "none.jsonl"), "case string").count() == 0


def test_exports_of_all_shapes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("chain,trigger_tx\nbase,0x1\nbnb,0x2\n")
    (tmp_path / "sub" / "b.jsonl").write_text('{"chain":"base","trigger_tx":"0x3"}\n\n{"chain":"bnb","n":4}\n')
    (tmp_path / "list.json").write_text('[{"chain":"l"}]')
    (tmp_path / "rows.json").write_text('{"rows": [\n {"chain": "r1"},\n {"chain": "r2"}]}')
    (tmp_path / "result.json").write_text('{"result":[{"chain":"s"}]}')
    (tmp_path / "deep.json").write_text('{"result":{"rows":[{"chain":"d"}]}}')
    (tmp_path / "other.json").write_text('{"x":1}')
    (tmp_path / ".hidden.csv").write_text("chain,trigger_tx\nno,0x9\n")
    got = files.read_exports(spark, str(tmp_path), ["chain", "trigger_tx"])
    seen = sorted((r["source_file"].rsplit("/", 1)[1], r["source_row"], r["chain"], r["trigger_tx"]) for r in got.collect())
    assert seen == [
        ("a.csv", 1, "base", "0x1"), ("a.csv", 2, "bnb", "0x2"), ("b.jsonl", 1, "base", "0x3"), ("b.jsonl", 2, "bnb", None), ("deep.json", 1, "d", None),
        ("list.json", 1, "l", None), ("result.json", 1, "s", None), ("rows.json", 1, "r1", None), ("rows.json", 2, "r2", None)]


def test_case_config(spark, tmp_path):
    config = {"one": {"name": "n", "chain": "base", "known_txs": {"attacker": "0xa"}, "constraints": [
        {"id": "F", "type": "feed_mismatch", "asset": "USDC", "asset_aliases": ["usdc.e"]}, {"id": "S", "type": "stale_oracle", "heartbeat_seconds": 60}]}, "two": {"name": "m"}}
    (tmp_path / "cases.json").write_text(json.dumps(config, indent=1))
    cases, constraints = files.load_cases(spark, str(tmp_path / "cases.json"))
    assert {r["case"]: r["known_txs"] for r in cases.collect()} == {"one": {"attacker": "0xa"}, "two": None}
    rows = {r["id"]: r for r in constraints.collect()}
    assert rows["F"]["asset_aliases"] == ["usdc.e"] and rows["S"]["heartbeat_seconds"] == 60
    assert set(constraints.columns) == set(spark.createDataFrame([], S.CONSTRAINTS).columns)


def test_receipts_and_log_lookup(spark):
    log = lambda a, t, d, i: {"address": a, "topics": t, "data": d, "logIndex": i}
    receipts = spark.createDataFrame(
        [("0x1", "0x10", "0x2", "0xAB", "0x5", [log("0xC1", ["0xT", "0xU"], "0xD1", "0x7"), log("0xC1", ["0xT"], "0xD2", "0x8"), log("0xC2", None, None, "0x9")])], S.RECEIPTS)
    logs = files.explode_receipts(receipts)
    rows = logs.orderBy("log_index").collect()
    assert [(r["block_number"], r["transaction_index"], r["receipt_status"], r["log_index"], r["topic0"]) for r in rows] == [(16, 2, 1, 7, "0xt"), (16, 2, 1, 8, "0xt"), (16, 2, 1, 9, "")]
    wanted = spark.createDataFrame([("0xab", "0xC1", "0xt", "0xD2"), ("0xab", "0xc2", "", ""), ("0xab", "0xc3", "", "")], "tx_hash string, contract_address string, topic0 string, data string")
    found = {r["contract_address"]: r["found_log_index"] for r in files.log_index_of(wanted, logs).collect()}
    assert found == {"0xC1": 8, "0xc2": 9, "0xc3": 0}


def test_history_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text("block_timestamp,block_number,transaction_hash,transaction_index,log_index,address,topic0,topic1,topic2,data\n"
                                    "2022-05-12T11:39:06.000Z,77,0xAA,,3,AB,0xT0,,,0x01\n")
    row = files.read_history(spark, str(tmp_path / "h.csv")).select("*", F.unix_seconds("block_time").alias("s")).first()
    assert (row["s"], row["block_number"], row["tx_hash"], row["transaction_index"], row["log_index"]) == (1652355546, 77, "0xaa", 0, 3)


def test_date_and_chain_filters_prune_partitions(spark, tmp_path):
    fact = spark.createDataFrame([("base", "2024-01-01", "t", 1), ("bnb", "2024-01-02", "t", 2)], "blockchain string, block_date string, tx_hash string, block_number long")
    fact.withColumn("block_date", F.col("block_date").cast("date")).write.partitionBy("blockchain", "block_date").parquet(f"{tmp_path}/logs")
    found = tables.chain_table(spark, str(tmp_path), "logs", "2024-01-02", "2024-01-31", ["bnb"])
    assert [r["block_number"] for r in found.select("block_number").collect()] == [2]
    plan = found.select("tx_hash")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "block_date" in plan.split("PartitionFilters:")[1].split("]")[0] and "blockchain" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_append_new_skips_done_keys(spark, tmp_path):
    path = f"{tmp_path}/done"
    schema = "k string, v long"
    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 0), (None, 5)], schema)
    two = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3), (None, 5)], schema)
    assert sorted(map(tuple, tables.append_new(one, path, ["k"], "one").collect()), key=repr) == [("a", 1), ("b", 0), (None, 5)]
    assert sorted(map(tuple, tables.append_new(two, path, ["k"], "two").collect()), key=repr) == [("c", 3), (None, 5)]
    assert sorted(map(tuple, tables.append_new(two, path, ["k"], "two").collect()), key=repr) == [("c", 3), (None, 5)]
    want = [("a", 1), ("b", 0), ("c", 3), (None, 5), (None, 5)]
    assert sorted(map(tuple, tables.read_appended(spark, path, schema).collect()), key=repr) == want
    assert tables.append_new(one.limit(0), path, ["k"], "none").collect() == []


@pytest.mark.parametrize("stop", ["data", "filters", "commits"])
def test_a_batch_that_stopped_is_run_again(spark, tmp_path, monkeypatch, stop):
    path = f"{tmp_path}/done"
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k long, v long")
    tables.append_new(rows(1, 2), path, ["k"], "one", places=64)
    writer = type(spark.range(1).write)
    for kind in ("parquet", "json"):
        plain = getattr(writer, kind)

        def broken(self, where, *args, _plain=plain, **more):
            if f"/{stop}/" in where:
                raise OSError("stopped")
            return _plain(self, where, *args, **more)

        monkeypatch.setattr(writer, kind, broken)
    with pytest.raises(OSError):
        tables.append_new(rows(2, 3), path, ["k"], "two", places=64)
    monkeypatch.undo()
    assert sorted(r["k"] for r in tables.read_appended(spark, path, "k long, v long").collect()) == [1, 2]
    tables.append_new(rows(2, 3), path, ["k"], "two", places=64)
    tables.append_new(rows(3, 4), path, ["k"], "three", places=64)
    assert sorted(r["k"] for r in tables.read_appended(spark, path, "k long, v long").collect()) == [1, 2, 3, 4]


def test_batches_without_a_common_key_are_not_read_again(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/done"
    asked = []
    plain = tables.read_appended
    monkeypatch.setattr(tables, "read_appended", lambda s, p, schema, batches=None: asked.append(batches) or plain(s, p, schema, batches))
    for n in range(4):
        tables.append_new(spark.range(100 * n, 100 * n + 100).withColumnRenamed("id", "k").withColumn("v", F.lit(n)), path, ["k"], f"b{n}")
    assert asked == [["b0"], ["b1"], ["b2"], ["b3"]]  # only what each has just written
    tables.append_new(spark.createDataFrame([(150, 9), (999, 9)], "k long, v int"), path, ["k"], "b4")
    assert asked[4:] == [["b1"], ["b4"]]
    assert plain(spark, path, "k long, v int").count() == 401


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("x", 2, 1, 0), ("x", 1, 5, 0), ("y", 3, 0, 0)], "case string, block_number long, transaction_index long, log_index long")
    tables.write_ordered(rows, f"{tmp_path}/o")
    tables.write_case_tables({"attackers": rows}, f"{tmp_path}/cases")
    tables.write_jsonl(rows, f"{tmp_path}/j")
    tables.write_csv(rows, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/o").count() == 3 and spark.read.parquet(f"{tmp_path}/cases/attackers").count() == 3
    assert spark.read.json(f"{tmp_path}/j").count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/c").columns == rows.columns
