"""Ordered scans that stay parallel when one key holds a large share of all rows.

A plain window partitioned by a key sends that whole key to one task. Here a
timeline is first cut by range over (hash of the key, order), so a hot key becomes many
chunks of similar size; each chunk is scanned on its own, the chunk totals of the keys
that a bound may part (one row per key and chunk) are scanned per key, and the total of
the earlier chunks is joined back. Sums, counts, extremes and "latest value" all combine this way.

Sliding-window results are computed from these scans and never from
(trigger, event) pairs, so work grows with events, not with events squared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwake.storage import write_table

CHUNK = "_chunk"
#: Chunk of the keys that no bound parts.
WHOLE = -1


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is sum, count, min, max or last (latest non-null)."""

    name: str
    kind: str
    value: Column


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut ``df`` by range over (hash of the keys, order) and fix each row's chunk number.

    The chunk numbers come from sampled range bounds, so they are written down
    once; every later stage then sees the same cut. A key that lies in several chunks
    has the first hash of all but one of them, so only keys of these hashes (one for each
    chunk) keep their number; all others are ``WHOLE`` and need no total of earlier chunks.
    """
    place = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    ranged = df.withColumn("_place", place).repartitionByRange("_place", *order)
    chunks = write_table(ranged.withColumn(CHUNK, F.spark_partition_id()))
    firsts = {r["first"] for r in chunks.groupBy(CHUNK).agg(F.min("_place").alias("first")).collect()}
    return chunks.withColumn(CHUNK, F.when(F.col("_place").isin(*firsts), F.col(CHUNK)).otherwise(WHOLE)).drop("_place")


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


def _chunk_total(kind: str, value: Column, order: Sequence[str], descending: bool) -> Column:
    if kind == "last":
        position = F.when(value.isNotNull(), F.struct(*order))
        return F.min_by(value, position) if descending else F.max_by(value, position)
    return _fold(kind, value)


def _across_chunks(kind: str, total: Column) -> Column:
    return F.sum(total) if kind == "count" else _fold(kind, total)


def _merge(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, earlier)
    if kind == "count":
        return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
    if kind == "sum":
        return F.coalesce(here + earlier, here, earlier)
    return F.least(here, earlier) if kind == "min" else F.greatest(here, earlier)


def running(
    chunks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    *,
    strict: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add one running value per scan to a table made by :func:`cut`.

    ``strict`` leaves the current row out; ``descending`` scans from the end.
    ``order`` must order the rows of a key totally.
    """
    part = [*keys, CHUNK]
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    local_window = (
        Window.partitionBy(*part).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    local = chunks.select("*", *[_fold(s.kind, s.value).over(local_window).alias(f"_here_{s.name}") for s in scans])
    totals = chunks.where(F.col(CHUNK) != WHOLE).groupBy(*part).agg(
        *[_chunk_total(s.kind, s.value, order, descending).alias(f"_total_{s.name}") for s in scans]
    )
    chunk_order = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    chunk_window = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part, *[_across_chunks(s.kind, F.col(f"_total_{s.name}")).over(chunk_window).alias(f"_earlier_{s.name}") for s in scans]
    )
    kept = [c for c in chunks.columns]
    return local.join(carry, part, "left").select(
        *kept, *[_merge(s.kind, F.col(f"_earlier_{s.name}"), F.col(f"_here_{s.name}")).alias(s.name) for s in scans]
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    payload: Column,
    into: str,
    *,
    ties: Sequence[str] = (),
    forward: bool = False,
    equal: bool = True,
    within: int | None = None,
) -> DataFrame:
    """Add to each left row the nearest right ``payload`` of the same key, or NULL.

    Backward takes the latest right row at or before the left row, forward the
    first one at or after it; ``equal=False`` excludes the same instant. Right rows of
    one instant are ordered by ``ties``. ``within`` bounds the distance, in the
    unit of the two ``*_at`` columns (longs). Left rows with a NULL key find nothing.
    """
    left_first = equal == forward
    rest = [c for c in left.columns if c not in keys]
    left_rows = left.select(
        *[F.col(k) for k in keys],
        left_at.cast("long").alias("_at"),
        F.lit(0 if left_first else 2).alias("_side"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(f"_tie{i}") for i, t in enumerate(ties)],
        (F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None)).alias("_left"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    right_rows = right.select(
        *[F.col(k) for k in keys],
        right_at.cast("long").alias("_at"),
        F.lit(1).alias("_side"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)],
        F.struct(right_at.cast("long").alias("at"), payload.alias("payload")).alias("_right"),
        F.lit(0).cast("long").alias("_salt"),
    )
    known = right_rows.where(F.col("_at").isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    order = ["_at", "_side", *[f"_tie{i}" for i in range(len(ties))], "_salt"]
    chunks = cut(left_rows.unionByName(known, allowMissingColumns=True), keys, order)
    scanned = running(chunks, keys, order, [Scan("_found", "last", F.col("_right"))], descending=forward)
    distance = (F.col("_found.at") - F.col("_at")) if forward else (F.col("_at") - F.col("_found.at"))
    found = F.col("_found.payload")
    if within is not None:
        found = F.when(distance <= F.lit(within), found)
    own = [F.col(c).cast(left.schema[c].dataType) if c in keys else F.col(f"_left.{c}").alias(c) for c in left.columns]
    return scanned.where(F.col("_side") != 1).select(*own, found.alias(into))


def distinct_steps(right: DataFrame, keys: Sequence[str], right_at: Column, widths: Sequence[int], distinct: dict[str, str], closed: str = "right") -> DataFrame:
    """Per key and moment ``_at``, by how much the distinct counts of the windows that open there change.

    ``distinct`` maps names to right columns; the change for the i-th width is ``_step_{name}_{i}``. A value is visible from a moment while some
    occurrence lies in its window. Occurrences of a value that are no further apart than the width make one span, so a count is the number of
    spans opened minus the number closed so far, and over a whole key the changes add up to zero. In a tile as wide as the narrowest window
    only the first and the last occurrence can bound a span, so a frequent value leaves no more than one row a tile before anything is shuffled.
    """
    shift = 0 if closed == "right" else 1
    events = right.select(
        *[F.col(k) for k in keys],
        right_at.cast("long").alias("_at"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("dim"), F.col(c).cast("string").alias("value")) for name, c in distinct.items()
        ])).alias("_seen"),
    ).select(*keys, "_at", F.col("_seen.dim").alias("_dim"), F.col("_seen.value").alias("_value"))
    events = events.where(F.col("_value").isNotNull() & F.col("_at").isNotNull())
    value_keys = [*keys, "_dim", "_value"]
    tile = F.col("_at") - F.pmod(F.col("_at"), F.lit(max(1, min(widths))).cast("long"))  # in whole numbers: a quotient is rounded
    tiles = events.groupBy(*value_keys, tile.alias("_tile")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    in_order = Window.partitionBy(*value_keys).orderBy("_tile")
    spans = tiles.select(
        *keys, "_dim", "_first", "_last", F.lag("_last").over(in_order).alias("_before"), F.lead("_first").over(in_order).alias("_after")
    )
    edges = []
    for i, width in enumerate(widths):
        opened, closes = F.col("_first") - F.lit(width), F.col("_last")
        opens_here = F.col("_before").isNull() | (F.col("_before") < opened)
        closes_here = F.col("_after").isNull() | (F.col("_after") - F.lit(width) > closes)
        for here, at, step in ((opens_here, opened, 1), (closes_here, closes, -1)):
            edges.append(F.when(here, F.struct(F.lit(i).alias("width"), (at + F.lit(shift)).alias("at"), F.lit(step).cast("long").alias("step"))))
    deltas = spans.select(*keys, "_dim", F.explode(F.array(*edges)).alias("_edge")).where(F.col("_edge").isNotNull())
    return deltas.groupBy(*keys, F.col("_edge.at").alias("_at")).agg(*[
        F.sum(F.when((F.col("_dim") == name) & (F.col("_edge.width") == i), F.col("_edge.step"))).alias(f"_step_{name}_{i}")
        for i in range(len(widths)) for name in distinct
    ])


def window_distinct_counts(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    width: int,
    distinct: dict[str, str],
    *,
    closed: str = "right",
) -> DataFrame:
    """Count distinct right values in the window that opens at each left row.

    ``distinct`` maps output name to a right column. ``closed`` is ``right`` for
    ``(t, t+width]`` or ``left`` for ``[t, t+width)``. See :func:`distinct_steps`.
    """
    steps = distinct_steps(right, keys, right_at, [width], distinct, closed)
    step_rows = steps.withColumn("_side", F.lit(0)).withColumn("_salt", F.lit(0).cast("long"))
    left_rows = left.select(
        *[F.col(k) for k in keys],
        left_at.cast("long").alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    order = ["_at", "_side", "_salt"]
    chunks = cut(left_rows.unionByName(step_rows, allowMissingColumns=True), keys, order)
    scanned = running(chunks, keys, order, [Scan(name, "sum", F.col(f"_step_{name}_0")) for name in distinct])
    return scanned.where(F.col("_side") == 1).select(
        *[F.col(f"_left.{c}").alias(c) for c in left.columns],
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in distinct],
    )


def window_fold(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_at: Column,
    right_at: Column,
    width: int,
    folds: Sequence[Scan],
    *,
    closed: str = "right",
    distinct_left: bool = False,
) -> DataFrame:
    """Fold right rows over the window that opens at each left row (sum, count, min, max).

    Left rows are numbered and written first, unless they are told to be distinct.

    Time is tiled into blocks as wide as the window. Any window then covers the tail of one
    block and the head of the next, so two running scans per block give the exact result.
    """
    lo_open = closed == "right"
    tiled = right.select(
        *[F.col(k) for k in keys],
        F.floor(right_at.cast("long") / F.lit(width)).cast("long").alias("_block"),
        right_at.cast("long").alias("_at"),
        F.lit(1).alias("_side"),
        *[s.value.alias(f"_v_{s.name}") for s in folds],
        F.monotonically_increasing_id().alias("_salt"),
    )
    if distinct_left:
        numbered = left.withColumn("_left_id", F.struct(*left.columns)).withColumn("_at", left_at.cast("long"))
    else:
        numbered = write_table(left.withColumn("_left_id", F.monotonically_increasing_id()).withColumn("_at", left_at.cast("long")))
    block = F.floor(F.col("_at") / F.lit(width)).cast("long")
    probes = numbered.select(
        *keys,
        F.col("_left_id"),
        F.explode(F.array(
            F.struct(block.alias("block"), F.col("_at").alias("at"), F.lit("tail").alias("part")),
            F.struct((block + 1).alias("block"), (F.col("_at") + F.lit(width)).alias("at"), F.lit("head").alias("part")),
        )).alias("_probe"),
    ).select(
        *keys,
        F.col("_probe.block").alias("_block"),
        F.col("_probe.at").alias("_at"),
        F.lit(2 if lo_open else 0).alias("_side"),
        F.col("_probe.part").alias("_part"),
        "_left_id",
        (F.xxhash64("_left_id") if distinct_left else F.col("_left_id")).alias("_salt"),
    )
    block_keys = [*keys, "_block"]
    order = ["_at", "_side", "_salt"]
    chunks = cut(probes.unionByName(tiled, allowMissingColumns=True), block_keys, order)
    values = [Scan(s.name, s.kind, F.col(f"_v_{s.name}")) for s in folds]
    half = lambda part, descending: running(
        chunks.where(F.coalesce(F.col("_part") == part, F.lit(True))), block_keys, order, values, descending=descending).where(F.col("_part") == part)
    head, tail = half("head", False), half("tail", True)
    halves = head.select("_left_id", *[s.name for s in folds]).unionByName(tail.select("_left_id", *[s.name for s in folds]))
    merged = halves.groupBy("_left_id").agg(
        *[(F.sum if s.kind in ("sum", "count") else F.min if s.kind == "min" else F.max)(s.name).alias(s.name) for s in folds]
    )
    if distinct_left:
        return merged.select("_left_id.*", *[s.name for s in folds])
    # shuffled first, so that the join is chosen by the size of the rows and not of the packed files
    return numbered.repartition("_left_id").join(merged, "_left_id").drop("_left_id", "_at")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key 1..n by ``order`` (ascending; negate a column for descending).

    A row's place in its chunk is fixed when the sorted chunk is written, so rows are shuffled once; what is added to it is one
    number for each key and chunk.
    """
    place = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    ranged = df.withColumn("_place", place).repartitionByRange("_place", *order).sortWithinPartitions("_place", *keys, *order)
    rows = write_table(ranged.drop("_place").withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn(CHUNK, F.shiftright("_row", 33))  # the id's upper bits number the task
    spans = rows.groupBy(*keys, CHUNK).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    named = [F.col(c).alias(f"_of{i}") for i, c in enumerate([*keys, CHUNK])]
    added = write_table(spans.select(*named, (F.coalesce(before, F.lit(0)) + 1 - F.col("_first")).alias("_added")))
    on = [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate([*keys, CHUNK])]
    kept = [F.col(c) for c in df.columns if c != name]
    return rows.join(added, on).select(*kept, (F.col("_row") + F.col("_added")).alias(name))
