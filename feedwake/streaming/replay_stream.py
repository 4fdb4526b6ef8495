"""Replay of arriving trace rows with keyed state.

Rows wait in a buffer until the watermark has passed their time, then they are played in trace order, however they arrived.
State of a part of a case: the first bad position of each asset and kind, and for each account and asset the supplies that a later
impact may build on (the first, the latest, and each that added a tenth; so their number grows with the logarithm of the amounts).

A case is dealt out to parts by account and asset. Events that make assets bad go to all parts of their case, acts to one,
so a case that holds most of the rows is played by several tasks. Position, reasons and the row itself come out of the state; alerts
are then formed by the same expressions as in the batch replay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from feedwake import rules as R
from feedwake.plans import replay as P

#: Parts of a case.
PARTS = 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ("block_number", "transaction_index", "log_index", "input_ord")
#: A row as the state sees it; ``said`` is the whole row as JSON, from which alerts are formed.
STEP = (
    "clock long, block_number long, transaction_index long, log_index long, input_ord long, what string, asset string, kind string, hit boolean, "
    "account string, borrowed string, amount double, inflated boolean, said string"
)
FIELDS = [f.split()[0] for f in STEP.split(", ")]
OUT = "case string, what string, said string, reasons array<string>, stale_now boolean"


class Held:
    """Supplies of one account and asset that impacts may build on."""

    def __init__(self, text: str | None):
        kept = json.loads(text) if text else {"total": 0.0, "first": None, "latest": None, "supplies": {}}
        self.total, self.first, self.latest, self.supplies = kept["total"], kept["first"], kept["latest"], kept["supplies"]

    def text(self) -> str:
        return json.dumps({"total": self.total, "first": self.first, "latest": self.latest, "supplies": self.supplies})

    def supply(self, name: str, amount: float | None, said: str, stale_now: bool) -> None:
        positive = amount is not None and amount > 0
        material = positive and (self.total <= 0 or amount / self.total >= P.MATERIAL_RATIO)
        if self.latest not in (None, self.first) and not self.supplies[self.latest]["material"]:
            del self.supplies[self.latest]
        self.first, self.latest = self.first or name, name
        self.supplies[name] = {"said": said, "stale_now": stale_now, "material": material, "reasons": []}
        self.total += amount if positive else 0.0

    def impact(self, prefix: str) -> list[dict]:
        """Supplies that this impact gives reasons they did not have, with all their reasons."""
        grown = []
        for name, supply in self.supplies.items():
            found = [(name == self.first, P.FIRST_SUPPLY), (name == self.latest, P.LATEST_SUPPLY), (supply["material"], P.MATERIAL_SUPPLY)]
            known = set(supply["reasons"])
            every = known | {f"{prefix}:{reason}" for chosen, reason in found if chosen}
            if every != known:
                supply["reasons"] = sorted(every)
                grown.append(supply)
        return grown


class Player(StatefulProcessor):
    """Buffers rows, plays them in order once the watermark has passed them, and forgets accounts that were idle for ``keep`` milliseconds."""

    def __init__(self, keep: int, strict_state: bool):
        self.keep, self.strict_state = keep, strict_state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STEP)
        self.bad = handle.getMapState("bad", "name string", ", ".join(f"{c} long" for c in PLACE))
        self.held = handle.getMapState("held", "name string", "touched long, supplies string")
        self.idle = handle.getMapState("idle", "at long", "names array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clocks = set()
        for pdf in rows:
            steps = [tuple(None if v is None or v != v else v for v in row) for row in pdf[FIELDS].itertuples(index=False)]
            self.waiting.appendList([_typed(step) for step in steps])
            clocks |= {int(step[0]) for step in steps}
        for clock in clocks:
            self.handle.registerTimer(clock)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        found = []
        if self.waiting.exists():
            steps = [dict(zip(FIELDS, row, strict=True)) for row in self.waiting.get()]
            due = sorted((s for s in steps if s["clock"] <= now), key=_place)
            if due:
                later = [tuple(s[f] for f in FIELDS) for s in steps if s["clock"] > now]
                if later:
                    self.waiting.put(later)
                else:
                    self.waiting.clear()
                for step in due:
                    found += self._play(step)
        if self.idle.containsKey((at,)):
            self._forget(at)
        yield pd.DataFrame([(key[0], *f) for f in found], columns=["case", "what", "said", "reasons", "stale_now"])

    def _play(self, step: dict) -> list[tuple]:
        place = _place(step)
        if step["what"] == "mark":
            for name in [("proven", step["hit"]), ("loose", step["hit"] or not self.strict_state)]:
                if name[1]:
                    self._turn(f"{name[0]} {step['kind']} {step['asset']}", place)
            return [("boundary", step["said"], [], False)] if step["hit"] and step["said"] else []
        kinds = [k for k in P.KINDS if self._before(f"loose {k} {step['asset']}", place)]
        out = []
        if step["what"] == R.BORROW:
            odd = list(kinds)
            odd += ["borrow_asset_formula_mismatch"] if self._before(f"loose formula_mismatch {step['borrowed']}", place) else []
            odd += [P.INFLATED] if step["inflated"] else []
            out += [("borrow", step["said"], sorted(odd), False)] if odd else []
        elif step["what"] == R.LIQUIDATE and {"feed_mismatch", "formula_mismatch"} & set(kinds):
            out.append(("liquidation", step["said"], [], False))
        if not step["account"] or not step["asset"]:
            return out
        name = (f"{step['account']}\n{step['asset']}",)
        if step["what"] == R.SUPPLY:
            if any(self._before(f"proven {k} {step['asset']}", place) for k in P.KINDS):
                held = Held(self.held.getValue(name)[1] if self.held.containsKey(name) else None)
                held.supply(json.dumps(place), step["amount"], step["said"], "stale_oracle" in kinds)
                self._hold(name, step["clock"], held)
        elif self.held.containsKey(name):
            held = Held(self.held.getValue(name)[1])
            grown = held.impact("stale_oracle" if self._before(f"proven stale_oracle {step['asset']}", place) else "bad_oracle")
            out += [("supply", s["said"], s["reasons"], s["stale_now"]) for s in grown]
            self._hold(name, step["clock"], held)
        return out

    def _turn(self, name: str, place: tuple) -> None:
        if not self.bad.containsKey((name,)) or place < tuple(self.bad.getValue((name,))):
            self.bad.updateValue((name,), place)

    def _before(self, name: str, place: tuple) -> bool:
        return self.bad.containsKey((name,)) and tuple(self.bad.getValue((name,))) < place

    def _hold(self, name: tuple, clock: int, held: Held) -> None:
        self.held.updateValue(name, (int(clock), held.text()))
        step = max(1, self.keep // 8)  # accounts are looked at in steps, so that busy ones need few timers
        at = -(-(int(clock) + self.keep) // step) * step
        names = list(self.idle.getValue((at,))[0]) if self.idle.containsKey((at,)) else []
        if not names:
            self.handle.registerTimer(at)
        if name[0] not in names:
            self.idle.updateValue((at,), (names + [name[0]],))

    def _forget(self, at: int) -> None:
        for name in self.idle.getValue((at,))[0]:
            if self.held.containsKey((name,)) and self.held.getValue((name,))[0] + self.keep <= at:
                self.held.removeKey((name,))
        self.idle.removeKey((at,))


def _typed(step: tuple) -> tuple:
    row = dict(zip(FIELDS, step, strict=True))
    for name in ("clock", *PLACE):
        row[name] = int(row[name])
    for name in ("hit", "inflated"):
        row[name] = bool(row[name])
    return tuple(row[f] for f in FIELDS)


def _place(step: dict) -> tuple:
    return tuple(int(step[c]) for c in PLACE)


def _steps(trace: DataFrame, constraints: DataFrame, clock: Column, parts: int) -> tuple[DataFrame, StructType]:
    """Rows that the state sees, with their part, and the schema of ``said``."""
    keys = ["case"]
    rows = P.prepare(trace, keys, {"clock_at": clock}).join(P.constraint_keys(constraints, keys), [*keys, "asset_key", "kind"], "left")
    broken = F.col("kind").isNotNull() & F.col("constraint_id").isNotNull() & F.coalesce(P.breaks(), F.lit(False))
    marks = F.col("kind").isNotNull() & ((F.col("event_type") != R.ANSWER) | F.col("hit"))
    is_act = F.col("event_type").isin(R.SUPPLY, *R.IMPACT_TYPES)
    rows = rows.withColumn("hit", broken).where(marks | is_act)
    told = F.struct("event_type", "block_number", "block_timestamp", "tx_hash", "decoded", "pos", "kind", "event_actor", "constraint_id", "rule")
    act = P.act_columns()
    asset = F.when(is_act, act["asset_key"]).otherwise(F.col("asset_key"))
    own = F.pmod(F.xxhash64(act["actor_key"], asset), F.lit(parts)).cast("int")
    alone = (act["actor_key"] == "") | (asset == "")  # nothing to remember: dealt out by place
    own = F.when(alone, F.pmod(F.xxhash64("pos"), F.lit(parts)).cast("int")).otherwise(own)
    part = F.explode(F.when(is_act, F.array(own)).otherwise(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = rows.withColumn("part", part)
    said = F.when(is_act | (F.col("hit") & (F.col("part") == 0)), F.to_json(told))
    out = spread.select(
        "case", "part", F.unix_millis("clock_at").alias("clock"), *[F.col(f"pos.{c}").alias(c) for c in PLACE], "clock_at",
        F.when(is_act, F.col("event_type")).otherwise(F.lit("mark")).alias("what"), asset.alias("asset"), "kind", "hit", act["actor_key"].alias("account"),
        F.col("borrow_key").alias("borrowed"), act["amount"].alias("amount"), act["inflated"].alias("inflated"), said.alias("said"),
    )
    return out, rows.select(told.alias("told")).schema["told"].dataType


def alerts_of(played: DataFrame, told: StructType) -> DataFrame:
    """Alerts from what the state gave out, formed as in the batch replay."""
    rows = played.select("case", "what", "reasons", "stale_now", F.from_json("said", told).alias("told")).select("case", "what", "reasons", "stale_now", "told.*")
    kinds = {"boundary": P.boundary_alert(), "borrow": P.borrow_alert(), "liquidation": P.liquidation_alert(), "supply": P.supply_alert()}
    chosen = {
        name: reduce(lambda rest, kind: F.when(F.col("what") == kind, kinds[kind][name]).otherwise(rest), list(kinds)[1:], kinds["boundary"][name])
        for name in kinds["boundary"]
    }
    return P.alert_rows(rows, ["case"], chosen)


def settled(alerts: DataFrame) -> DataFrame:
    """The last word on each alert: a supply is told again when a later impact gives it a further reason."""
    reasons = F.size(F.coalesce(F.from_json(F.get_json_object("details", "$.reasons"), "array<string>"), F.array().cast("array<string>")))
    rest = [c for c in alerts.columns if c not in ("case", "id", "pos")]
    last = alerts.groupBy("case", "id", "pos").agg(F.max_by(F.struct(*rest), reasons).alias("last"))
    return last.select(*[F.col(c) if c in ("case", "id", "pos") else F.col(f"last.{c}").alias(c) for c in alerts.columns])


def replay_stream(
    trace: DataFrame, constraints: DataFrame, output: str, checkpoint: str, *, delay: str = "10 minutes", keep: str = "30 days",
    clock: Column | None = None, parts: int = PARTS, strict_state: bool = False, **trigger,
) -> StreamingQuery:
    """Start a stream over ``trace`` that appends alerts of all four kinds to ``output`` (see ``settled``).

    ``clock`` is the time of a row (default ``block_timestamp``, else 0), which should follow trace order; rows may come in any order
    as long as none is later than ``delay`` behind the newest one, which Spark drops. A row is played when the watermark has
    passed it, so the newest ``delay`` waits for more. An account that was idle for ``keep`` is forgotten, so impacts after that raise
    no supply alert; what makes assets bad is kept. A row without a case meets no constraint and is dropped. Rows of one account and asset
    go to one task, one after the other.
    """
    spark = trace.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    time = F.timestamp_seconds(F.coalesce("block_timestamp", F.lit(0))) if clock is None else clock
    marked = trace.where(F.col("case").isNotNull()).withColumn("clock_at", time).withWatermark("clock_at", delay)
    steps, told = _steps(marked, constraints, F.col("clock_at"), parts)
    millis = int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + interval {keep})")).first()[0])
    played = steps.groupBy("case", "part").transformWithStateInPandas(Player(millis, strict_state), OUT, "append", "eventtime")
    writer = alerts_of(played, told).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
