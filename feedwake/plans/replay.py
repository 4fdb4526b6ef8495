"""Replay of ordered event traces against constraints.

State in a trace only grows: an asset that turned bad stays bad. "Bad when event e happens"
is therefore "first bad position < position of e", and the whole replay is joins,
grouped minima and ordered scans over all cases at once.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import text as T
from feedwake.operators.timeline import CHUNK, Scan, cut, running
from feedwake.storage import write_table

MATERIAL_RATIO = 0.10
INFLATED_RATIO = 10
KINDS = ("feed_mismatch", "formula_mismatch", "stale_oracle", "price_source_outlier", "decimal_semantics_mismatch")
# Reasons of alerts.
INFLATED = "collateral_value_inflated"
FIRST_SUPPLY, MATERIAL_SUPPLY, LATEST_SUPPLY = "first_risky_collateral_supply", "material_collateral_increase_>=10%", "latest_topup_before_impact"
EVIDENCE_RULE = "first risky collateral supply or latest top-up before same-actor impact"


class Replay:
    """Results of one replay, each built when it is first asked for.

    ``alerts``: one row per alert. ``marks``: one row per accused account and alert.
    ``actors``: one row per accused account. ``state``: one row per bad asset and kind.

    All read at most two written tables: when assets turned bad (a row per asset), and the cut of what matters of the acts
    (supplies, borrows, liquidations). Neither is written before a result needs it. Of the cut, supply alerts scan the acts on bad assets only.
    """

    def __init__(self, events: DataFrame, boundary: DataFrame, keys: list[str], strict_state: bool):
        self._events, self._boundary, self._keys, self._strict_state = events, boundary, keys, strict_state

    @cached_property
    def _acts(self) -> DataFrame:
        bad = write_table(first_bad(self._boundary, self._keys, self._strict_state))
        acts = judged(self._events.where(F.col("event_type").isin(R.SUPPLY, *R.IMPACT_TYPES)), bad, self._keys)
        return cut(acts, [*self._keys, "actor_key", "asset_key"], ["pos"])

    @cached_property
    def _steps(self) -> DataFrame:
        told = F.when(F.col("is_supply"), F.struct(*[_d(c).alias(c) for c in ("asset", "amount", "actor")])).alias("decoded")
        return self._acts.where("risky").select(
            *self._keys, "actor_key", "asset_key", "pos", CHUNK, "tx_hash", "block_number", "event_actor", "is_supply", "amount", "risky",
            "stale_now", "first_stale", told)

    @cached_property
    def boundary(self) -> DataFrame:
        return alert_rows(self._boundary.where("hit"), self._keys, boundary_alert())

    @cached_property
    def borrows(self) -> DataFrame:
        return alert_rows(self._acts.where(F.size("reasons") > 0), self._keys, borrow_alert())

    @cached_property
    def liquidations(self) -> DataFrame:
        return alert_rows(self._acts.where("seized"), self._keys, liquidation_alert())

    @cached_property
    def supplies(self) -> DataFrame:
        return alert_rows(early_supplies(self._steps, self._keys), self._keys, supply_alert())

    @cached_property
    def localized(self) -> DataFrame:
        """Alerts that accuse accounts."""
        return self.borrows.unionByName(self.liquidations)

    @cached_property
    def alerts(self) -> DataFrame:
        return self.boundary.unionByName(self.localized).unionByName(self.supplies)

    @cached_property
    def marks(self) -> DataFrame:
        return account_marks(self.borrows, self.liquidations, self._keys)

    @cached_property
    def actors(self) -> DataFrame:
        return actor_candidates(self.marks, self._keys)

    @cached_property
    def state(self) -> DataFrame:
        return asset_state(self._boundary, self._keys)


def position(df: DataFrame) -> Column:
    """Sortable place of an event in its trace; missing parts count as 0, ties go by input order."""
    parts = ["block_number", "transaction_index", "log_index", "input_ord"]
    return F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in parts])


def _d(field: str) -> Column:
    return F.col(f"decoded.{field}")


def prepare(trace: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Trace rows with position, comparison keys and the columns ``more``."""
    supply_actor = T.first_text(_d("supplier"), _d("account"), _d("actor"))
    last_resort = F.when(F.col("event_type") == R.LIQUIDATE, _d("liquidator")).otherwise(_d("actor"))
    impact_actor = T.first_text(_d("borrower"), _d("account"), last_resort)
    is_supply = F.col("event_type") == R.SUPPLY
    kind = reduce(
        lambda chain, item: F.when(F.col("event_type") == item[0], F.lit(item[1])).otherwise(chain),
        R.KIND_OF_EVENT.items(), F.lit(None).cast("string"),
    )
    return trace.select(
        *keys, "event_type", "block_number", "block_timestamp", "tx_hash", "decoded",
        position(trace).alias("pos"),
        kind.alias("kind"),
        T.symbol_key(_d("asset")).alias("asset_key"),
        T.symbol_key(_d("collateral_asset")).alias("collateral_key"),
        T.symbol_key(_d("borrow_asset")).alias("borrow_key"),
        F.when(is_supply, supply_actor).otherwise(impact_actor).alias("event_actor"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )


def constraint_keys(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """One row per constraint and asset name it covers."""
    names = F.concat(F.array("asset"), F.coalesce("asset_aliases", F.array().cast("array<string>")))
    covered = F.array_distinct(F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), T.symbol_key))
    return constraints.select(
        *keys, F.explode(covered).alias("asset_key"), F.col("id").alias("constraint_id"), F.col("type").alias("kind"),
        F.struct("expected_feed", "forbidden_feed", "expected_formula", "heartbeat_seconds", "severity").alias("rule"),
    )


def breaks() -> Column:
    """Whether a boundary event breaks the constraint (``rule``) beside it."""
    event = F.col("event_type")
    forbidden, expected = F.coalesce(F.col("rule.forbidden_feed"), F.lit("")), F.coalesce(F.col("rule.expected_feed"), F.lit(""))
    actual = T.symbol_key(_d("actual_feed"))
    feed = ((forbidden != "") & (actual == T.symbol_key(forbidden))) | ((expected != "") & (actual != T.symbol_key(expected)))
    wanted = F.coalesce(F.col("rule.expected_formula"), _d("expected_formula"), F.lit(""))
    formula = T.symbol_key(_d("actual_formula")) != T.symbol_key(wanted)
    heartbeat = F.coalesce(F.col("rule.heartbeat_seconds"), F.lit(0))
    late = (heartbeat > 0) & (_clock() - _updated_at() > heartbeat)
    stale = late | F.coalesce(_d("lower_bound_hit"), F.lit(False))
    return F.when(event == R.FEED_SET, feed).when(event == R.FORMULA_SET, formula).when(event == R.ANSWER, stale).otherwise(F.lit(True))


def _clock() -> Column:
    return F.coalesce(F.col("block_timestamp"), F.lit(0))


def _updated_at() -> Column:
    return F.coalesce(F.nullif(_d("updated_at"), F.lit(0)), _clock())


def _details() -> Column:
    """What the event says about its asset, as JSON."""
    event = F.col("event_type")
    answer_reason = F.when(F.coalesce(_d("lower_bound_hit"), F.lit(False)), F.lit("lower_bound_hit")).otherwise(F.lit("heartbeat_exceeded"))
    stale = [_d("asset").alias("asset"), _d("feed").alias("feed"), _d("answer").alias("answer")]
    tx, stamp = F.col("tx_hash"), F.col("block_timestamp")
    return (
        F.when(event == R.FEED_SET, F.to_json(F.struct(
            _d("asset").alias("asset"), F.coalesce(F.col("rule.expected_feed"), _d("expected_feed")).alias("expected_feed"),
            _d("actual_feed").alias("actual_feed"))))
        .when(event == R.FORMULA_SET, F.to_json(F.struct(
            _d("asset").alias("asset"), F.coalesce(F.col("rule.expected_formula"), _d("expected_formula")).alias("expected_formula"),
            _d("actual_formula").alias("actual_formula"))))
        .when(event == R.ANSWER, F.to_json(F.struct(
            *stale, _updated_at().alias("updated_at"), _clock().alias("block_timestamp"), tx, answer_reason.alias("reason"))))
        .when(event == R.STALE_START, F.to_json(F.struct(
            *stale, _d("updated_at").alias("updated_at"), stamp, tx,
            F.coalesce(_d("reason"), F.lit("explicit_stale_marker")).alias("reason"))))
        .when(event == R.MALFUNCTION, F.to_json(F.struct(
            _d("asset").alias("asset"), _d("feed").alias("feed"), _d("quote_asset").alias("quote_asset"),
            _d("reported_rate").alias("reported_rate"), stamp, tx,
            F.coalesce(_d("actual_fault"), F.lit("price_source_outlier")).alias("reason"))))
        .otherwise(F.to_json(F.struct(
            _d("asset").alias("asset"), _d("expected_oracle").alias("expected_oracle"), _d("actual_oracle").alias("actual_oracle"),
            _d("expected_semantics").alias("expected_semantics"), _d("actual_semantics").alias("actual_semantics"), stamp, tx,
            F.coalesce(_d("actual_fault"), F.lit("oracle_implementation_mismatch")).alias("reason"))))
    )


def boundary_rows(events: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary events, one row for each constraint on their asset and kind (one without any): ``hit`` if it is broken.

    ``marks`` tells whether the event makes its asset bad for borrows and liquidations: every event but an answer does.
    """
    rows = events.where(F.col("kind").isNotNull()).join(covered, [*keys, "asset_key", "kind"], "left")
    hit = F.col("constraint_id").isNotNull() & F.coalesce(breaks(), F.lit(False))
    return rows.withColumn("hit", hit).withColumn("marks", (F.col("event_type") != R.ANSWER) | F.col("hit"))


def first_bad(boundary: DataFrame, keys: list[str], strict_state: bool) -> DataFrame:
    """Per asset: its first bad position by kind, and by proof (a broken constraint) of any kind and of staleness."""
    marking = F.col("hit") if strict_state else F.col("marks")
    return boundary.where("marks").groupBy(*keys, "asset_key").agg(
        *[F.min(F.when((F.col("kind") == k) & marking, F.col("pos"))).alias(f"bad_{k}") for k in KINDS],
        F.min(F.when(F.col("hit"), F.col("pos"))).alias("first_bad"),
        F.min(F.when(F.col("hit") & (F.col("kind") == "stale_oracle"), F.col("pos"))).alias("first_stale"),
    )


def alert_rows(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Rows as alerts: ``columns`` gives id, type, severity, record_role, candidate_actor_roles and details."""
    has_tx = F.coalesce(F.col("tx_hash"), F.lit("")) != ""
    evidence = F.when(has_tx, F.array("tx_hash")).otherwise(F.array().cast("array<string>"))
    c = columns
    return rows.select(
        *keys, c["id"].alias("id"), c["id"].alias("constraint_id"), c["type"].alias("type"), c["severity"].alias("severity"), "tx_hash", "block_number",
        F.col("pos"), c["record_role"].alias("record_role"), evidence.alias("evidence_tx_hashes"),
        c["candidate_actor_roles"].alias("candidate_actor_roles"), c["details"].alias("details"),
    )


def _columns(id: Column, kind: Column, severity: Column, role: str, roles: Column, details: Column) -> dict[str, Column]:
    return {"id": id, "type": kind, "severity": severity, "record_role": F.lit(role), "candidate_actor_roles": roles, "details": details}


def _role_map(*pairs: tuple[str, Column]) -> Column:
    flat = [x for name, value in pairs for x in (F.lit(name), F.coalesce(value, F.lit("")))]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def boundary_alert() -> dict[str, Column]:
    return _columns(F.col("constraint_id"), F.col("kind"), F.coalesce(F.col("rule.severity"), F.lit("critical")), "oracle_boundary", _role_map(), _details())


def borrow_alert() -> dict[str, Column]:
    """Borrows against bad collateral, of an asset with a bad formula, or on an inflated value."""
    borrower = T.first_text(_d("borrower"), _d("account"))
    details = F.to_json(F.struct(
        borrower.alias("borrower"), _d("collateral_asset").alias("collateral_asset"), _d("borrow_asset").alias("borrow_asset"),
        _d("borrow_amount").alias("borrow_amount"), F.col("reasons").alias("reasons"),
    ))
    roles = _role_map(("borrower", borrower), ("actor", _d("actor")))
    return _columns(F.lit("BORROW_AFTER_ORACLE_VIOLATION"), F.lit(R.LOCALIZATION), F.lit("critical"), "borrow", roles, details)


def liquidation_alert() -> dict[str, Column]:
    """Liquidations of collateral whose feed or formula was set before."""
    roles = _role_map(("liquidator", _d("liquidator")), ("borrower", _d("borrower")))
    return _columns(F.lit("LIQUIDATION_AFTER_ORACLE_VIOLATION"), F.lit(R.LOCALIZATION), F.lit("high"), "liquidation", roles, F.to_json("decoded"))


def supply_alert() -> dict[str, Column]:
    """Supplies of a bad asset that a later impact of the same account builds on."""
    details = F.to_json(F.struct(
        F.col("event_actor").alias("supplier"), _d("asset").alias("asset"), _d("amount").alias("amount"),
        F.col("reasons").alias("reasons"), F.lit(EVIDENCE_RULE).alias("evidence_rule"),
    ))
    kind = F.when(F.col("stale_now"), F.lit(R.STALE_SUPPLY)).otherwise(F.lit(R.BAD_SUPPLY))
    roles = _role_map(("supplier", F.col("event_actor")), ("actor", _d("actor")))
    return _columns(F.lit("COLLATERAL_ENABLING_SUPPLY"), kind, F.lit("high"), "early_evidence", roles, details)


def act_columns() -> dict[str, Column]:
    """The account and the asset that a supply, borrow or liquidation is followed by, and what it amounts to."""
    is_supply = F.col("event_type") == R.SUPPLY
    reported, expected = T.to_double(_d("collateral_value_usd_reported")), T.to_double(_d("collateral_value_usd_expected"))
    inflated = (F.col("event_type") == R.BORROW) & (expected > 0) & (F.try_divide(reported, expected) > INFLATED_RATIO)
    return {
        "actor_key": T.symbol_key(F.col("event_actor")), "asset_key": F.when(is_supply, F.col("asset_key")).otherwise(F.col("collateral_key")),
        "is_supply": is_supply, "amount": F.when(is_supply, T.to_double(_d("amount"))), "inflated": F.coalesce(inflated, F.lit(False)),
    }


def _before(position: str) -> Column:
    return F.coalesce(F.col(position) < F.col("pos"), F.lit(False))


def judged(events: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Acts that matter: odd borrows (``reasons``), ``seized`` liquidations, and ``risky`` acts on an asset that is proven bad.

    Whether an asset was bad before an act is a comparison with its first bad positions, so acts meet one row per asset.
    """
    of_formula = bad.where(F.col("bad_formula_mismatch").isNotNull()).select(
        *keys, F.col("asset_key").alias("borrow_key"), F.col("bad_formula_mismatch").alias("bad_borrow_formula")
    )
    told = [*keys, "event_type", "pos", "tx_hash", "block_number", "event_actor", "borrow_key", "decoded"]
    rows = events.select(*told, *[c.alias(name) for name, c in act_columns().items()]).join(bad, [*keys, "asset_key"], "left").join(of_formula, [*keys, "borrow_key"], "left")
    is_borrow = F.col("event_type") == R.BORROW
    found = [F.when(_before(f"bad_{k}"), F.lit(k)) for k in KINDS]
    found += [F.when(_before("bad_borrow_formula"), F.lit("borrow_asset_formula_mismatch")), F.when(F.col("inflated"), F.lit(INFLATED))]
    reasons = F.array_sort(F.array_compact(F.array(*found)))
    seized = (F.col("event_type") == R.LIQUIDATE) & (_before("bad_feed_mismatch") | _before("bad_formula_mismatch"))
    risky = (F.col("actor_key") != "") & (F.col("asset_key") != "") & _before("first_bad")
    marked = rows.withColumns({
        "reasons": F.when(is_borrow, reasons).otherwise(F.array().cast("array<string>")), "seized": seized,
        "risky": F.coalesce(risky, F.lit(False)), "stale_now": _before("bad_stale_oracle"),
    })
    kept = marked.where((F.size("reasons") > 0) | F.col("seized") | F.col("risky"))
    return kept.drop("borrow_key", "bad_borrow_formula", "first_bad", *[f"bad_{k}" for k in KINDS])


def early_supplies(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Supplies of an already bad asset that a later impact of the same account builds on.

    Chosen are an account's first risky supply, its latest one before each impact, and every
    one that adds at least a tenth to what it supplied before. ``chunks`` is the cut of the judged acts; only risky ones count.
    """
    group, order = [*keys, "actor_key", "asset_key"], ["pos"]
    risky = F.col("risky")
    supply = risky & F.col("is_supply")
    impact_pos = F.when(risky & ~F.col("is_supply"), F.col("pos"))
    step = F.when(risky, F.struct(F.col("is_supply").alias("is_supply"), F.col("pos").alias("pos")))
    looked_back = running(
        chunks, group, order,
        [
            Scan("prior_amount", "sum", F.when(supply & (F.col("amount") > 0), F.col("amount"))),
            Scan("prior_supplies", "count", F.when(supply, F.lit(1))),
            Scan("previous", "last", step),
        ],
        strict=True,
    )
    looked_ahead = running(
        looked_back, group, order,
        [
            Scan("next_step", "last", step),
            Scan("next_impact", "last", impact_pos),
            Scan("last_impact", "max", impact_pos),
            Scan("before_next_supply", "last", F.when(supply, F.col("previous"))),
        ],
        strict=True, descending=True,
    )
    supplies = looked_ahead.where(supply & F.col("last_impact").isNotNull())
    prior = F.coalesce("prior_amount", F.lit(0.0))
    material = F.coalesce((F.col("amount") > 0) & ((prior <= 0) | (F.try_divide(F.col("amount"), prior) >= MATERIAL_RATIO)), F.lit(False))
    run_end = F.when(F.col("before_next_supply").isNull(), F.col("last_impact")).otherwise(F.col("before_next_supply.pos"))
    reasons = F.concat(
        _prefixed(F.col("prior_supplies") == 0, FIRST_SUPPLY, F.col("last_impact")),
        _prefixed(material, MATERIAL_SUPPLY, F.col("last_impact")),
        _prefixed(~F.col("next_step.is_supply"), LATEST_SUPPLY, run_end),
    )
    return supplies.withColumn("reasons", F.array_sort(F.array_distinct(F.array_compact(reasons)))).where(F.size("reasons") > 0)


def _prefixed(chosen: Column, reason: str, last: Column) -> Column:
    """Reason texts for impacts from ``next_impact`` to ``last``, by what was known of the asset then."""
    stale = F.col("first_stale")
    bad = chosen & (stale.isNull() | (F.col("next_impact") < stale))
    late = chosen & stale.isNotNull() & (last > stale)
    return F.array(F.when(bad, F.lit(f"bad_oracle:{reason}")), F.when(late, F.lit(f"stale_oracle:{reason}")))


def account_marks(borrows: DataFrame, liquidations: DataFrame, keys: list[str]) -> DataFrame:
    """Accounts named by borrow and liquidation alerts, in the order they are named."""
    text = lambda name: F.coalesce(F.get_json_object("details", f"$.{name}"), F.lit("None"))
    roles = F.col("candidate_actor_roles")
    borrowed = F.concat(F.lit("borrowed "), text("borrow_amount"), F.lit(" "), text("borrow_asset"), F.lit(" against "),
                        F.coalesce(F.get_json_object("details", "$.collateral_asset"), F.lit("")))
    separate = T.symbol_key(roles["actor"]) != T.symbol_key(roles["borrower"])
    named = F.array(
        F.struct(F.lit(0).alias("seq"), roles["borrower"].alias("address"), F.lit("borrower").alias("role")),
        F.struct(F.lit(1).alias("seq"), F.when(separate, roles["actor"]).alias("address"), F.lit("actor").alias("role")),
    )
    of_borrow = borrows.select(*keys, "tx_hash", "pos", borrowed.alias("summary"), F.explode(named).alias("m"))
    seized = F.concat(F.lit("liquidated "), text("seized_amount"), F.lit(" "),
                      F.coalesce(F.get_json_object("details", "$.collateral_asset"), F.lit("")))
    of_liquidation = liquidations.select(
        *keys, "tx_hash", "pos", seized.alias("summary"),
        F.struct(F.lit(0).alias("seq"), roles["liquidator"].alias("address"), F.lit("liquidator").alias("role")).alias("m"),
    )
    marks = of_borrow.unionByName(of_liquidation).select(
        *keys, F.col("m.address").alias("address"), F.col("m.role").alias("role"), "tx_hash", "pos", F.col("m.seq").alias("seq"), "summary"
    )
    return marks.where(F.coalesce("address", F.lit("")) != "")


def actor_candidates(marks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per accused account; ``first_mark`` orders the candidates of a case."""
    per_tx = marks.groupBy(*keys, "address", "tx_hash").agg(
        F.collect_set("role").alias("roles"), F.count(F.lit(1)).alias("marks"), F.min(F.struct("pos", "seq")).alias("first_mark")
    )
    return per_tx.groupBy(*keys, "address").agg(
        F.array_sort(F.array_compact(F.array(
            *[F.max(F.when(F.array_contains("roles", r), F.lit(r))) for r in ("actor", "borrower", "liquidator")]
        ))).alias("roles"),
        F.count(F.lit(1)).alias("tx_count"),
        F.sum("marks").alias("mark_count"),
        F.min("first_mark").alias("first_mark"),
    )


def asset_state(boundary: DataFrame, keys: list[str]) -> DataFrame:
    """Per bad asset and kind: when it turned bad and what the latest such event said."""
    rule = F.when(F.col("event_type") == R.ANSWER, F.col("rule"))  # other events speak for themselves
    seen = boundary.where("marks").withColumn("rule", rule).select(*keys, "asset_key", "kind", "pos", _details().alias("details"))
    return seen.groupBy(*keys, "asset_key", "kind").agg(
        F.min("pos").alias("first_bad"), F.max("pos").alias("last_seen"), F.max_by("details", "pos").alias("details")
    )


def replay(trace: DataFrame, constraints: DataFrame, *, keys: tuple[str, ...] = ("case",), strict_state: bool = False) -> Replay:
    """Replay every trace named by ``keys`` against the constraints that share those keys.

    ``strict_state`` lets only events that break a constraint make an asset bad for later
    borrows and liquidations; by default correct feed and formula events do so too.
    """
    keys = list(keys)
    events = prepare(trace, keys)
    return Replay(events, boundary_rows(events, constraint_keys(constraints, keys), keys), keys, strict_state)
