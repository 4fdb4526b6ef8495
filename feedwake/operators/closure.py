"""Boundary events, lending impacts and the closures between them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake import rules as R
from feedwake.functions import identity as ID
from feedwake.functions import text as T
from feedwake.functions import words as W
from feedwake.operators.joins import dense_interval_join
from feedwake.operators.timeline import CHUNK, WHOLE, Scan, cut, distinct_steps, running, window_fold
from feedwake.storage import write_table

HOUR = 3_600_000_000
SCALE = 100_000_000.0  # feeds report eight decimals


def in_dates(df: DataFrame, start: date | str | None, end: date | str | None, column: str = "block_date") -> DataFrame:
    """Keep ``start <= column <= end``; literal bounds reach the partition filter."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(str(end)).cast("date"))
    return df


def in_chains(df: DataFrame, chains: Sequence[str] | None, column: str = "blockchain") -> DataFrame:
    return df if not chains else df.where(F.col(column).isin(*chains))


def scope_activity_counts(
    logs: DataFrame,
    rules: DataFrame,
    chains: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    exact: bool = False,
    error: float = 0.02,
) -> DataFrame:
    """Logs, transactions and contracts per chain, year and scope class, and over all chains.

    Unless ``exact``, distinct counts are estimates with a standard error of ``error`` of the count.
    """
    scoped = in_dates(in_chains(logs, chains), start, end).join(rules.where(~F.col("contextual_only")), "topic0")
    rows = scoped.select(
        F.col("blockchain").alias("chain"), F.year("block_date").cast("long").alias("year"), "scope_class", "tx_hash", "contract_address"
    )
    levels = rows.groupingSets(
        [["chain", "year", "scope_class"], ["year", "scope_class"]], "chain", "year", "scope_class"
    )
    if exact:
        return _exact_scope_counts(rows)
    counted = levels.agg(
        F.grouping("chain").alias("_all"),
        F.count(F.lit(1)).alias("oracle_scope_log_count"),
        F.approx_count_distinct("tx_hash", error).alias("oracle_scope_tx_count"),
        F.approx_count_distinct("contract_address", error).alias("oracle_scope_contract_count"),
    )
    return _named_levels(counted)


def _named_levels(counted: DataFrame) -> DataFrame:
    chain = F.when(F.col("_all") == 1, F.lit("all_active_case_chains")).otherwise(F.col("chain"))
    return counted.select(
        chain.alias("chain"),
        "year",
        "scope_class",
        "oracle_scope_log_count",
        "oracle_scope_tx_count",
        "oracle_scope_contract_count",
        F.lit("broad_oracle_activity_surface").alias("dataset_layer"),
    )


def _exact_scope_counts(rows: DataFrame) -> DataFrame:
    """Exact distinct counts through one row per value, so no group is counted in one task."""
    group = ["chain", "year", "scope_class"]
    spread = rows.select(
        *group,
        F.explode(F.array(
            F.struct(F.lit("tx").alias("dim"), F.col("tx_hash").alias("value"), F.lit(1).alias("logs")),
            F.struct(F.lit("contract").alias("dim"), F.col("contract_address").alias("value"), F.lit(0).alias("logs")),
        )).alias("v"),
    )
    per_value = spread.groupBy(*group, F.col("v.dim").alias("dim"), F.col("v.value").alias("value")).agg(F.sum("v.logs").alias("logs"))
    everywhere = per_value.groupBy("year", "scope_class", "dim", "value").agg(F.sum("logs").alias("logs")).select(
        F.lit(None).cast("string").alias("chain"), "year", "scope_class", "dim", "value", "logs", F.lit(1).alias("_all")
    )
    both = per_value.withColumn("_all", F.lit(0)).unionByName(everywhere)
    counted = both.groupBy("_all", *group).agg(
        F.sum("logs").alias("oracle_scope_log_count"),
        F.count(F.when((F.col("dim") == "tx"), F.col("value"))).alias("oracle_scope_tx_count"),
        F.count(F.when((F.col("dim") == "contract"), F.col("value"))).alias("oracle_scope_contract_count"),
    )
    return _named_levels(counted)


def oracle_path_contracts(labels: DataFrame, chains: Sequence[str] | None = None) -> DataFrame:
    """Distinct labelled addresses that look like part of a price path."""
    named = in_chains(labels, chains).where(F.lower(F.coalesce("name", F.lit(""))).rlike(ID.ORACLE_PATH_LABEL))
    return named.select(F.col("blockchain").alias("chain"), F.col("address").alias("contract_address")).distinct()


def normalized_answer(scope_class: Column, topic1: Column) -> Column:
    return F.when(scope_class == R.S1, F.abs(W.int_double(topic1)) / F.lit(SCALE))


def oracle_boundary_logs(
    logs: DataFrame,
    rules: DataFrame,
    oracle_path: DataFrame,
    start: str | None = None,
    end: str | None = None,
    chains: Sequence[str] | None = None,
    answer: Column | None = None,
) -> DataFrame:
    """Boundary rows; generic topics count only on oracle-path contracts."""
    matched = in_dates(in_chains(logs, chains), start, end).join(rules, "topic0")
    matched = matched.withColumn("chain", F.col("blockchain"))
    direct = matched.where(~F.col("contextual_only"))
    contextual = matched.where(F.col("contextual_only")).join(oracle_path, ["chain", "contract_address"], "left_semi")
    value = normalized_answer(F.col("scope_class"), F.col("topic1")) if answer is None else answer
    columns = [
        F.col("chain"),
        F.year("block_date").cast("long").alias("trigger_year"),
        F.col("block_time").alias("trigger_time"),
        F.col("block_number").alias("trigger_block"),
        F.col("tx_hash").alias("boundary_tx_hash"),
        F.col("log_index").alias("boundary_log_index"),
        F.col("contract_address").alias("boundary_contract"),
        "topic0",
        "scope_class",
        F.col("rule_id").alias("boundary_rule_id"),
        F.col("topic_name").alias("boundary_topic_name"),
        value.alias("normalized_answer"),
    ]
    return direct.select(*columns).unionByName(contextual.select(*columns))


def impact_lending_logs(
    logs: DataFrame,
    transactions: DataFrame,
    markets: DataFrame,
    rules: DataFrame,
    start: str | None = None,
    end: str | None = None,
    chains: Sequence[str] | None = None,
) -> DataFrame:
    """Lending events on known markets with the sending account and the protocol cluster."""
    events = in_dates(in_chains(logs, chains), start, end).join(rules.select("topic0", "impact_rule_id"), "topic0")
    events = events.select(
        F.col("blockchain").alias("chain"), "block_time", "block_number", "tx_hash", "log_index",
        F.col("contract_address").alias("market_contract"), "impact_rule_id",
    )
    on_market = events.join(markets.select("chain", "market_contract", "protocol_cluster_id"), ["chain", "market_contract"])
    senders = in_dates(in_chains(transactions, chains), start, end).select(
        F.col("blockchain").alias("chain"), F.col("hash").alias("tx_hash"), F.col("from").alias("actor")
    )
    return on_market.join(senders, ["chain", "tx_hash"]).select(
        "chain",
        F.col("block_time").alias("impact_time"),
        F.col("block_number").alias("impact_block"),
        F.col("tx_hash").alias("impact_tx_hash"),
        F.col("log_index").alias("impact_log_index"),
        "actor",
        "market_contract",
        "protocol_cluster_id",
        "impact_rule_id",
        T.log_key(F.col("tx_hash"), F.col("log_index")).alias("impact_log_key"),
    )


IMPACT_TIES = ["impact_block", "impact_tx_hash", "impact_log_index"]


COUNTED = {"impact_tx_count": "impact_tx_hash", "actor_count": "actor", "market_count": "market_contract"}


def _impacts_after(triggers: DataFrame, impact: DataFrame, hours: Sequence[int], keys: Sequence[str], replay_txs: int) -> DataFrame:
    """First impact, first distinct transactions and distinct counts in ``(t, t+_width]``; ``_width`` of a trigger is one of ``hours``.

    Triggers, impacts and the changes of the distinct counts lie in one timeline, cut once for all widths and sorted once, from the end:
    a trigger sees the next impact, the next one of another transaction, and the changes still to come, which with those so far make zero.
    """
    keys, widths = list(keys), [h * HOUR for h in hours]
    at = T.micros(F.col("impact_time"))
    early = F.lit(0).alias("_side")  # at one instant before the triggers, which look beyond it
    steps = distinct_steps(impact, keys, at, widths, COUNTED).withColumn("_side", early).withColumn("_salt", F.lit(-1).cast("long"))
    sent = impact.select(*keys, at.alias("_at"), early, *IMPACT_TIES, "impact_time", "protocol_cluster_id", F.lit(0).cast("long").alias("_salt"))
    asked = triggers.select(
        *keys, T.micros(F.col("trigger_time")).alias("_at"), F.lit(1).alias("_side"), F.struct(*triggers.columns).alias("_left"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    order = ["_at", "_side", *IMPACT_TIES, "_salt"]
    line = asked.unionByName(sent, allowMissingColumns=True).unionByName(steps, allowMissingColumns=True)
    chunks = cut(line, keys, order)
    part, counts = [*keys, CHUNK], [f"{name}_{i}" for i in range(len(widths)) for name in COUNTED]
    is_impact, tx = F.col("impact_time").isNotNull(), F.col("impact_tx_hash")
    head = F.when(is_impact, F.struct(F.col("_at").alias("at"), tx.alias("tx"), "impact_time", "protocol_cluster_id"))
    later = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    seen = chunks.select(
        "*", *[F.sum(f"_step_{c}").over(later).alias(f"_here_{c}") for c in counts], F.last(head, ignorenulls=True).over(later).alias("_next"))
    seen = seen.where(is_impact | (F.col("_side") == 1)).drop(*[f"_step_{c}" for c in counts])
    ends_run = F.when(is_impact & (F.col("_next.tx") != tx), F.col("_next"))
    seen = seen.withColumn("_other", F.last(ends_run, ignorenulls=True).over(later)).where(F.col("_side") == 1)
    found = seen.join(_later_chunks(chunks, keys, order, counts, head), part, "left")

    def of_width(name: str) -> Column:
        coming = [F.coalesce(f"_here_{name}_{i}", F.lit(0)) + F.coalesce(f"_beyond_{name}_{i}", F.lit(0)) for i in range(len(widths))]
        return F.coalesce(*[F.when(F.col("_left._width") == w, -coming[i]) for i, w in enumerate(widths)], F.lit(0)).cast("long").alias(name)

    beyond = F.when(F.col("_beyond_first.tx") != F.col("_next.tx"), F.col("_beyond_first")).otherwise(F.col("_beyond_other"))
    rows = found.select(
        "_left.*", "_at", F.coalesce("_next", "_beyond_first").alias("_first"), F.coalesce(F.col("_other"), beyond).alias("_second"),
        *[of_width(name) for name in COUNTED],
    ).where(F.col("impact_tx_count") > 0)
    second = F.when(F.col("_second.at") <= F.col("_at") + F.col("_width"), F.col("_second.tx")) if replay_txs > 1 else F.lit(None).cast("string")
    return rows.select(
        "*",
        F.col("_first.impact_time").alias("first_impact_time"),
        F.col("_first.tx").alias("first_impact_tx"),
        F.array_compact(F.array(F.col("_first.tx"), second)).alias("leading_impact_txs"),
        F.col("_first.protocol_cluster_id").alias("protocol_cluster_id"),
    ).drop("_first", "_second", "_width", "_at")


def _later_chunks(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Sequence[str], head: Column) -> DataFrame:
    """Per key and chunk what lies beyond it: the changes, the first impact and the first one after it of another transaction.

    Each chunk gives one row: its changes, its first impact, and its first impact of a transaction other than that one's.
    """
    part, parted = [*keys, CHUNK], chunks.where(F.col(CHUNK) != WHOLE)
    is_impact, place = F.col("impact_time").isNotNull(), F.struct(*order)
    totals = write_table(parted.groupBy(*part).agg(
        *[F.sum(f"_step_{c}").alias(f"_total_{c}") for c in counts], F.min(F.when(is_impact, F.col("_at"))).alias("_first_at")))
    impacts = parted.where(is_impact)
    at_first = impacts.join(totals.select(*part, "_first_at"), part).where(F.col("_at") == F.col("_first_at"))  # few rows are left to sort
    firsts = write_table(at_first.groupBy(*part).agg(F.min_by(head, place).alias("_chunk_first")))
    others = impacts.join(firsts.select(*part, F.col("_chunk_first.tx").alias("_first_tx")), part).where(F.col("impact_tx_hash") != F.col("_first_tx"))
    both = totals.join(firsts, part, "left").join(others.groupBy(*part).agg(F.min_by(head, place).alias("_chunk_other")), part, "left")
    beyond = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(
        *part, *[F.sum(f"_total_{c}").over(beyond).alias(f"_beyond_{c}") for c in counts], "_chunk_first", "_chunk_other",
        F.last("_chunk_first", ignorenulls=True).over(beyond).alias("_beyond_first"),
    )
    turn = F.coalesce(F.col("_chunk_other"), F.when(F.col("_beyond_first.tx") != F.col("_chunk_first.tx"), F.col("_beyond_first")))
    return carried.withColumn("_beyond_other", F.last(turn, ignorenulls=True).over(beyond)).drop("_chunk_first", "_chunk_other")


CLOSURE_COLUMNS = [
    "chain", "trigger_year", "failure_class", "trigger_tx", "trigger_block", "trigger_time", "first_impact_time", "first_impact_tx",
    "leading_impact_txs", "impact_tx_count", "actor_count", "market_count", "protocol_cluster_id", "matched_rule", "scope_class",
    "normalized_answer",
]


def _triggers(boundary: DataFrame, failure_class: Column, matched_rule: Column, answer: Column) -> DataFrame:
    """One row per group of boundary logs that the closures report together."""
    return boundary.select(
        "chain", "trigger_year", failure_class.alias("failure_class"), F.col("boundary_tx_hash").alias("trigger_tx"),
        "trigger_block", "trigger_time", matched_rule.alias("matched_rule"), "scope_class", answer.alias("normalized_answer"),
    ).distinct()


def _of_hours(triggers: DataFrame, hours: int) -> DataFrame:
    return triggers.withColumn("_width", F.lit(hours * HOUR))


def _config_triggers(boundary: DataFrame) -> DataFrame:
    config = boundary.where(F.col("scope_class").isin(R.S2, R.S3, R.S4, R.S5))
    failure = F.when(F.col("scope_class") == R.S2, F.lit(R.FEED_BINDING)).otherwise(F.lit(R.COMPOSITION))
    return _triggers(config, failure, F.col("boundary_rule_id"), F.lit(None).cast("double"))


def _abnormal_triggers(boundary: DataFrame, lo: float, hi: float) -> DataFrame:
    odd = boundary.where((F.col("scope_class") == R.S1) & ((F.col("normalized_answer") <= lo) | (F.col("normalized_answer") >= hi)))
    return _triggers(odd, F.lit(R.COMPOSITION), F.lit("R2_S1_ABNORMAL_PRICE_THEN_LENDING_IMPACT"), F.col("normalized_answer"))


def chain_closures(
    boundary: DataFrame, impact: DataFrame, config_hours: int = 72, answer_hours: int = 24, lo: float = 1.0, hi: float = 100000.0, replay_txs: int = 2
) -> DataFrame:
    """The rows of :func:`config_impact_closure` and :func:`abnormal_answer_closure`, from one index of the impacts for both widths."""
    triggers = _of_hours(_config_triggers(boundary), config_hours).unionByName(_of_hours(_abnormal_triggers(boundary, lo, hi), answer_hours))
    return _impacts_after(triggers, impact, sorted({config_hours, answer_hours}), ["chain"], replay_txs).select(*CLOSURE_COLUMNS)


def config_impact_closure(
    boundary: DataFrame, impact: DataFrame, hours: int = 72, same_protocol: bool = False, replay_txs: int = 2,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Configuration changes followed by lending activity on the same chain within ``hours``.

    ``same_protocol`` also asks for the same protocol cluster; ``clusters`` then names the
    cluster of a boundary contract (chain, boundary_contract, protocol_cluster_id).
    """
    if not same_protocol:
        return _impacts_after(_of_hours(_config_triggers(boundary), hours), impact, [hours], ["chain"], replay_txs).select(*CLOSURE_COLUMNS)
    config = boundary.where(F.col("scope_class").isin(R.S2, R.S3, R.S4, R.S5))
    failure = F.when(F.col("scope_class") == R.S2, F.lit(R.FEED_BINDING)).otherwise(F.lit(R.COMPOSITION))
    bound = config.join(clusters.withColumnRenamed("protocol_cluster_id", "_cluster"), ["chain", "boundary_contract"])
    triggers = bound.select(
        "chain", "trigger_year", failure.alias("failure_class"), F.col("boundary_tx_hash").alias("trigger_tx"), "trigger_block",
        "trigger_time", F.col("boundary_rule_id").alias("matched_rule"), "scope_class", F.lit(None).cast("double").alias("normalized_answer"), "_cluster",
    ).distinct()
    events = impact.withColumn("_cluster", F.col("protocol_cluster_id"))
    return _impacts_after(_of_hours(triggers, hours), events, [hours], ["chain", "_cluster"], replay_txs).select(*CLOSURE_COLUMNS)


def abnormal_answer_closure(
    boundary: DataFrame, impact: DataFrame, hours: int = 24, lo: float = 1.0, hi: float = 100000.0, replay_txs: int = 2
) -> DataFrame:
    """Reported answers at or outside ``lo``..``hi`` followed by lending activity within ``hours``."""
    return _impacts_after(_of_hours(_abnormal_triggers(boundary, lo, hi), hours), impact, [hours], ["chain"], replay_txs).select(*CLOSURE_COLUMNS)


def _used_steps(impact: DataFrame, hours: int) -> DataFrame:
    """Supplies and borrows of an account that follow each other within ``hours``: ``_borrow`` tells which a row is.

    Both lie in one timeline, cut once. At one instant borrows stand before supplies, so what a supply finds ahead and a borrow behind is
    at another instant.
    """
    keys, width = ["chain", "actor"], hours * HOUR
    is_borrow = F.col("impact_rule_id") == R.BORROW_RULE
    steps = impact.where(is_borrow | F.col("impact_rule_id").isin(*R.SUPPLY_SIDE_RULES)).withColumns(
        {"_at": T.micros(F.col("impact_time")), "_borrow": is_borrow, "_side": F.when(is_borrow, 0).otherwise(1)})
    order = ["_at", "_side", *IMPACT_TIES]
    chunks = cut(steps.select(*keys, *order, "_borrow", "impact_time", "protocol_cluster_id"), keys, order)
    behind = running(chunks, keys, order, [Scan("_supplied", "last", F.when(~F.col("_borrow"), F.col("_at")))], strict=True)
    both = running(behind, keys, order, [Scan("_borrowed", "last", F.when(F.col("_borrow"), F.col("_at")))], strict=True, descending=True)
    near = F.when(F.col("_borrow"), F.col("_at") - F.col("_supplied") <= width).otherwise(F.col("_borrowed") - F.col("_at") <= width)
    return both.where(near)


def same_actor_supply_borrow(impact: DataFrame, hours: int = 6) -> DataFrame:
    """Per chain and actor: the supplies and borrows that follow each other within ``hours``.

    A supply takes part if the actor's next borrow is close enough, a borrow if the actor's
    previous supply is; each is one nearest-row lookup instead of a pair join.
    """
    keys = ["chain", "actor"]
    place = F.struct(F.struct("impact_time", *IMPACT_TIES).alias("o"), F.col("protocol_cluster_id").alias("c"))
    used = _used_steps(impact, hours).dropna(subset=keys)
    per_tx = used.groupBy(*keys, "impact_tx_hash").agg(
        F.min(F.when(~F.col("_borrow"), place)).alias("_supply"), F.min(F.when(F.col("_borrow"), place)).alias("_borrow")
    )
    firsts = per_tx.groupBy(*keys).agg(
        F.min("_supply").alias("_supply"), F.min("_borrow").alias("_first"), F.count("_borrow").alias("borrow_tx_count")
    )
    return firsts.where(F.col("_supply").isNotNull() & F.col("_first").isNotNull()).select(
        *keys,
        F.col("_supply.o.impact_time").alias("first_supply_time"),
        F.col("_supply.o.impact_tx_hash").alias("first_supply_tx"),
        F.col("_first.o.impact_time").alias("first_borrow_time"),
        F.col("_first.o.impact_tx_hash").alias("first_borrow_tx"),
        "borrow_tx_count",
        F.col("_first.c").alias("protocol_cluster_id"),
    )


def same_actor_borrow_txs(impact: DataFrame, hours: int = 6) -> DataFrame:
    """The distinct borrow transactions behind :func:`same_actor_supply_borrow`, one per row."""
    return _used_steps(impact, hours).where("_borrow").select("chain", "actor", F.col("impact_tx_hash").alias("borrow_tx")).distinct()


def freshness_closure(boundary: DataFrame, same_actor: DataFrame, hours: int = 48, count_twice: bool = False) -> DataFrame:
    """Lower-bound answers followed by actors that start supplying within ``hours`` and then borrow.

    ``count_twice`` repeats each actor's borrow count for its two transactions, as older reports did.
    """
    low = boundary.where((F.col("scope_class") == R.S1) & (F.col("normalized_answer") > 0) & (F.col("normalized_answer") <= 1))
    triggers = _triggers(
        low, F.lit(R.FRESHNESS), F.lit("R3_LOWER_BOUND_OR_STALE_ANSWER_THEN_SUPPLY_BORROW_CLOSURE"), F.col("normalized_answer")
    )
    first = F.struct(
        F.col("first_borrow_time"), F.col("first_borrow_tx"), F.col("actor").cast("string").alias("actor"),
        "first_supply_time", "first_supply_tx", "protocol_cluster_id",
    )
    weight = F.col("borrow_tx_count") * F.lit(2 if count_twice else 1)
    folded = window_fold(
        triggers, same_actor, ["chain"], T.micros(F.col("trigger_time")), T.micros(F.col("first_supply_time")), hours * HOUR,
        [Scan("_first", "min", first), Scan("impact_tx_count", "sum", weight), Scan("actor_count", "count", F.lit(1))], distinct_left=True,
    ).where(F.col("_first").isNotNull())
    return folded.select(
        "*",
        F.col("_first.first_borrow_time").alias("first_impact_time"),
        F.col("_first.first_borrow_tx").alias("first_impact_tx"),
        F.array_distinct(F.array("_first.first_supply_tx", "_first.first_borrow_tx")).alias("leading_impact_txs"),
        F.lit(1).cast("long").alias("market_count"),
        F.col("_first.protocol_cluster_id").alias("protocol_cluster_id"),
    ).select(*CLOSURE_COLUMNS)


def closure_impact_txs(closures: DataFrame, impact: DataFrame, hours: int, same_protocol: bool = False) -> DataFrame:
    """All distinct impact transactions of the given closure rows, one per row with the time of its first impact.

    ``leading_impact_txs`` of a closure holds the first two, these rows hold all. The list grows with trigger and impact
    density, so pass the closures you mean to download, not all of them. ``same_protocol`` also asks for the closure's protocol cluster.

    A transaction shows in a window by the impact whose predecessor of the same transaction lies before the window, so pairs are formed
    once and need no aggregation. Only triggers of several times or clusters have theirs aggregated.
    """
    on = ["chain", "protocol_cluster_id"] if same_protocol else ["chain"]
    group = ["chain", "trigger_tx", "trigger_block", "matched_rule"]
    at = F.col("impact_time")
    seen = impact.select(*on, F.col("impact_tx_hash").alias("impact_tx"), at).repartition(*on, "impact_tx").distinct()
    events = write_table(seen.withColumn("_before", F.lag(at).over(Window.partitionBy(*on, "impact_tx").orderBy(at))))
    opened = closures.select(*group, "trigger_time", *on[1:]).distinct()
    triggers = write_table(opened.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy(*group)) == 1))
    first = F.col("_before").isNull() | (F.col("_before") <= F.col("trigger_time"))

    def rows(some: DataFrame) -> DataFrame:
        paired = dense_interval_join(some.drop("_alone"), events, on, T.micros(F.col("trigger_time")), T.micros(at), hours * HOUR)
        return paired.where(first).select(*group, "impact_tx", "impact_time")

    several = triggers.where(~F.col("_alone"))
    if several.isEmpty():
        return rows(triggers)
    return rows(triggers.where("_alone")).unionByName(rows(several).groupBy(*group, "impact_tx").agg(F.min("impact_time").alias("impact_time")))


def closure_candidates(*closures: DataFrame) -> DataFrame:
    """Closures with evidence tier, flags, reason and source quality."""
    rows = closures[0]
    for more in closures[1:]:
        rows = rows.unionByName(more)
    failure, scope = F.col("failure_class"), F.col("scope_class")
    has_impact = F.col("impact_tx_count") > 0
    complete = (F.col("actor_count") > 0) & (F.col("market_count") > 0) & has_impact & failure.isin(R.FEED_BINDING, R.FRESHNESS)
    tier = F.when(complete, F.lit(R.TIER_A)).when(has_impact, F.lit(R.TIER_B)).otherwise(F.lit(R.TIER_C))
    reason = (
        F.when(failure == R.FEED_BINDING, F.lit("S2 binding config plus same-window lending impact"))
        .when(failure == R.FRESHNESS, F.lit("lower-bound oracle answer plus same-actor supply-to-borrow closure"))
        .otherwise(F.lit("oracle config or abnormal oracle answer plus downstream borrow/liquidation"))
    )
    quality = (
        F.when((failure == R.FRESHNESS) & (F.col("normalized_answer") <= 1), F.lit("impact_led_lower_bound"))
        .when(scope == R.S1, F.lit("oracle_answer_outlier"))
        .otherwise(F.lit("oracle_config_log"))
    )
    rank = F.when(failure == R.FRESHNESS, F.lit(2)).when(scope.isin(R.S2, R.S3), F.lit(1)).otherwise(F.lit(2))
    return rows.where(F.col("first_impact_time") > F.col("trigger_time")).select(
        "chain",
        F.col("trigger_year").alias("year"),
        "failure_class",
        tier.alias("evidence_tier"),
        F.lit(True).alias("has_trigger"),
        F.lit(True).alias("has_oracle_anomaly"),
        has_impact.alias("has_lending_impact"),
        (F.col("actor_count") > 0).alias("has_actor"),
        (F.col("first_impact_time") > F.col("trigger_time")).alias("has_temporal_order"),
        (has_impact & F.col("first_impact_tx").isNotNull()).alias("has_replayable_constraint"),
        F.col("trigger_tx").alias("boundary_tx_hash"),
        "trigger_block",
        "trigger_time",
        "first_impact_tx",
        "leading_impact_txs",
        "impact_tx_count",
        F.col("actor_count").alias("candidate_actor_count"),
        F.col("market_count").alias("candidate_market_count"),
        T.seconds_between(F.col("trigger_time"), F.col("first_impact_time")).alias("trigger_to_impact_seconds"),
        F.lit(None).cast("double").alias("impact_usd_known"),
        "protocol_cluster_id",
        "matched_rule",
        reason.alias("closure_reason"),
        quality.alias("source_quality"),
        rank.cast("long").alias("source_quality_rank"),
        F.lit("remote_candidate").alias("dataset_layer"),
        F.lit(False).alias("already_materialized"),
    )


def evidence_order(candidates: DataFrame) -> list[Column]:
    """Sort columns: tier, then speed, size and source quality."""
    tier = F.when(F.col("evidence_tier") == R.TIER_A, 1).when(F.col("evidence_tier") == R.TIER_B, 2).otherwise(3)
    return [
        tier, F.col("trigger_to_impact_seconds").asc_nulls_last(), F.col("impact_tx_count").desc(),
        F.col("source_quality_rank").asc(), F.col("chain"), F.col("year"),
    ]


# Impact receipts and ABI lookups planned per candidate of each class.
IMPACT_RECEIPTS = {R.FEED_BINDING: 1, R.COMPOSITION: 2, R.FRESHNESS: 2}
ABI_LOOKUPS = {R.COMPOSITION: 3}


def minimal_replay_queue(candidates: DataFrame, max_seconds: int = 259_200) -> DataFrame:
    """Candidates worth downloading, with the few transactions each one needs."""
    failure = F.col("failure_class")
    receipts = F.lit(1)
    for name, count in IMPACT_RECEIPTS.items():
        receipts = F.when(failure == name, F.lit(count)).otherwise(receipts)
    lookups = F.when(failure == R.COMPOSITION, F.lit(ABI_LOOKUPS[R.COMPOSITION])).otherwise(F.lit(2))
    soon = F.col("trigger_to_impact_seconds").between(0, max_seconds)
    gate = (F.col("evidence_tier") == R.TIER_A) | (
        (F.col("evidence_tier") == R.TIER_B) & (F.col("impact_tx_count") > 0) & soon
    )
    impact_receipts = F.least(F.col("impact_tx_count"), receipts.cast("long"))
    return candidates.where(gate).select(
        "chain", "year", "failure_class", "evidence_tier", "boundary_tx_hash", "first_impact_tx",
        F.slice("leading_impact_txs", F.lit(1), receipts).alias("minimal_replay_txs"),
        F.lit(1).cast("long").alias("estimated_trigger_receipts"),
        impact_receipts.alias("estimated_impact_receipts"),
        (impact_receipts + 1).alias("estimated_total_rpc_requests"),
        lookups.cast("long").alias("estimated_abi_requests"),
        "trigger_to_impact_seconds", "protocol_cluster_id", "matched_rule",
        F.lit("download_minimal_causal_trace").alias("materialization_action"),
    )


def case_hit_validation(evidence: DataFrame, logs: DataFrame, topic_rules: DataFrame) -> DataFrame:
    """Per known transaction: its logs, the logs a rule matches, and whether any is semantic.

    ``evidence``: case_id, chain, failure_class, evidence_scope, expected_rule, tx_hash, tx_date.
    ``topic_rules``: topic0, rule_id, semantic_boundary.
    """
    group = ["case_id", "chain", "failure_class", "evidence_scope", "expected_rule", "tx_hash"]
    found = logs.select(
        F.col("blockchain").alias("chain"), "tx_hash", F.col("block_date").alias("tx_date"), "topic0", "contract_address", "log_index"
    )
    hits = found.join(evidence, ["chain", "tx_hash", "tx_date"]).join(topic_rules, "topic0", "left")
    semantic = F.count_if(F.coalesce("semantic_boundary", F.lit(False)))
    counted = hits.groupBy(*group).agg(
        F.count("topic0").alias("receipt_log_count"),
        F.count("rule_id").alias("matched_log_count"),
        semantic.alias("semantic_log_count"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ", ").alias("matched_rules"),
        (semantic > 0).alias("covered_by_minimal_filter"),
    )
    return _with_all(evidence, group, counted)


def _with_all(evidence: DataFrame, group: Sequence[str], counted: DataFrame) -> DataFrame:
    """``counted`` with a row of zeros, empty texts and false for evidence that met no log.

    Counting joins inner first: a left join from the small side could not broadcast it, so all logs would move.
    """
    spine = evidence.select(*[F.col(c).alias(f"_{c}") for c in group]).distinct()
    blank = {"bigint": 0, "string": "", "boolean": False}
    rest = [F.coalesce(c, F.lit(blank[kind]).cast(kind)).alias(c) for c, kind in counted.dtypes if c not in group]
    joined = spine.join(counted, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in group], "left")
    return joined.select(*[F.col(f"_{c}").alias(c) for c in group], *rest)


def topic0_case_coverage(evidence: DataFrame, logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Per known transaction: which of its topics the rules know, and whether the expected scope is seen."""
    found = logs.select(F.col("blockchain").alias("chain"), "tx_hash", F.col("block_date").alias("tx_date"), "topic0")
    group = ["case_id", "chain", "tx_hash", "expected_scope_class"]
    hits = found.join(evidence, ["chain", "tx_hash", "tx_date"]).join(
        rules.select("topic0", "rule_id", "scope_class"), "topic0", "left"
    )
    per_topic = hits.groupBy(*group, "topic0", "rule_id", "scope_class").agg(F.count("topic0").alias("logs"))
    known = F.col("rule_id").isNotNull()
    counted = per_topic.groupBy(*group).agg(
        F.sum("logs").alias("receipt_log_count"),
        F.sum(F.when(known, F.col("logs")).otherwise(0)).alias("matched_log_count"),
        F.count("topic0").alias("unique_topic0_count"),
        F.count(F.when(known, F.col("topic0"))).alias("matched_topic0_count"),
        F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("matched_rules"),
        F.array_join(F.array_sort(F.collect_set(F.when(~known, F.col("topic0")))), ",").alias("unmatched_topic0s"),
        F.array_join(F.array_sort(F.collect_set("scope_class")), ",").alias("matched_scope_classes"),
        F.bool_or(F.coalesce(F.col("scope_class") == F.col("expected_scope_class"), F.lit(False))).alias("expected_scope_matched"),
    )
    return _with_all(evidence, group, counted)
