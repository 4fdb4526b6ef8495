"""Mixing of sources to target weights by balanced sampling (the cube method)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedwake.llm.common import WORD
from feedwake.storage import write_table

#: Weights that repeat over the sources in code point order, the mix as a share of all words, and the most copies of a word.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents that one task balances together; at most two of them stay undecided and go on to the next level.
BLOCK = 2000
#: Equal rows that one row stands for until they are dealt out.
RUN = 10_000
EDGE = 1e-9


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``n_docs`` and ``target`` of each source of (source, size) rows.

    Targets are proportional to the weights and sum to ``share`` of all sizes; a target stops at ``most`` times its source's
    size and what it leaves goes to the others by weight. In order of (stop / weight), the first source that does not reach its
    stop fixes the common factor for all that follow. The windows run over one row for each source, never over documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    stops = sources.withColumns({"weight": weight, "stop": most * F.col("source_size")})
    order = [F.col("stop") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last()]
    before, after, everything = (
        Window.orderBy(*order).rowsBetween(*bounds)
        for bounds in ((Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing))
    )
    factor = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = stops.withColumn("factor", factor).withColumn("open", F.when(F.col("stop") > F.col("factor") * F.col("weight"), F.col("factor")))
    common = F.first("open", ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.withColumn("common", common).select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("common") * F.col("weight"), "stop"), "stop").alias("target"))


def fly(sizes: np.ndarray, chances: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Flight: move ``chances`` inside the null space of both totals (words, documents) until at most two are open.

    Three open documents leave one direction that changes neither total. Along it the walk goes to the nearest border forward
    or backward, with the odds that keep every chance's expectation; each step decides one document at least.
    """
    chance = [0.0 if p < EDGE else 1.0 if p > 1 - EDGE else float(p) for p in chances]
    size = [float(s) for s in sizes]
    held: list[int] = []
    draws = iter(random.random(len(chance)).tolist())
    for unit, p in enumerate(chance):
        if not 0 < p < 1:
            continue
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = (size[k] for k in held)
        step = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        forward = min((1 - chance[k]) / s if s > 0 else -chance[k] / s for k, s in zip(held, step, strict=True) if s)
        backward = min(chance[k] / s if s > 0 else (chance[k] - 1) / s for k, s in zip(held, step, strict=True) if s)
        go = forward if next(draws) * (forward + backward) < backward else -backward
        for k, s in zip(held, step, strict=True):
            moved = chance[k] + go * s
            chance[k] = 0.0 if moved < EDGE else 1.0 if moved > 1 - EDGE else moved
        held = [k for k in held if 0 < chance[k] < 1]
    return np.array(chance)


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Landing: the last open units (two at most) take the outcome whose words, then documents, come nearest to what they should be."""
    still = np.flatnonzero((chances > 0) & (chances < 1))
    outcomes = np.array(list(product((0.0, 1.0), repeat=len(still)))).reshape(2 ** len(still), len(still))
    missed = outcomes - chances[still]
    best = np.lexsort((np.abs(missed.sum(axis=1)), np.abs(missed @ sizes[still])))[0]
    landed = chances.copy()
    landed[still] = outcomes[best]
    return landed


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def numbered(sizes: DataFrame) -> DataFrame:
    """The rows (doc_id, source, size) with ``number`` 1, 2, 3 ... among equal ones, so that each draws for itself.

    Equal rows are counted before the shuffle and made again from their count, in runs of ``RUN`` that are dealt out; so a document that a
    third of all rows repeat, or a third without an id, is no group of its own.
    """
    keys = ["doc_id", "source", "size"]
    counted = sizes.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    dealt = runs.repartition(F.col("doc_id"), F.col("size"), F.col("run"))
    last = F.least(F.col("times"), (F.col("run") + 1) * RUN)
    return dealt.select(*keys, F.explode(F.sequence(F.col("run") * RUN + 1, last)).alias("number"))


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``sizes`` (doc_id, source, size): with ``source_size``, ``target``, ``copies`` and ``taken``.

    The ratio of a source's target to its size is the wanted number of copies of each of its documents. Its whole part is
    taken, its fraction is the chance of one more copy, so no document is taken more than ``most`` times. Chances are balanced
    in blocks of a source's documents; what stays open moves to blocks of the next level, until one block a source is left.
    A hot source is many blocks. Draws depend only on the rows and ``seed``, so reruns agree.

    A null source is a source of its own, after all others. Null or empty texts have size 0 and take 0. Repeated rows count as
    often as they occur. A table without words gives targets of 0; an empty table an empty result.
    """
    want = targets(sizes, weights, share, most)
    wanted = want.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    named = wanted.withColumnRenamed("source", "its_source")
    rows = numbered(sizes).join(named, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    rows = rows.withColumns({"whole": F.floor("ratio").cast("int"), "chance": F.col("ratio") - F.floor("ratio"), "blocks": F.ceil(F.col("n_docs") / block).cast("long")})
    first = F.col("number") == 1
    draw = F.when(first, F.xxhash64(F.lit(seed), "doc_id", "size")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "size", "number"))
    rows = rows.withColumn("draw", draw).drop("n_docs", "ratio", "number")
    largest = want.agg(F.max("n_docs")).first()[0] or 0
    schema = rows.withColumn("home", F.lit(0).cast("long")).schema

    def level(number: int, last: bool):
        def balance(pdf: pd.DataFrame) -> pd.DataFrame:
            # large documents are decided first, so that what lands at the end is small
            pdf = pdf.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            random = np.random.default_rng([seed, number, int(pdf["home"].iloc[0]), *np.frombuffer(pdf["draw"].to_numpy()[:1].tobytes(), np.uint32).tolist()])
            sizes, chances = pdf["size"].to_numpy(float), pdf["chance"].to_numpy(float)
            chances = fly(sizes, chances, random)
            pdf["chance"] = land(sizes, chances) if last else chances
            return pdf.astype({"doc_id": "Int64"})

        return balance

    done, number = [], 0
    while True:
        last = largest <= block
        homed = rows.withColumn("home", F.pmod(F.xxhash64(F.lit(number), "draw"), F.greatest("blocks", F.lit(1))))
        flown = write_table(homed.groupBy("source", "home").applyInPandas(level(number, last), schema))
        open_rows = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.where(~open_rows))
        if last:
            break
        # a block leaves two open documents at most; those of the next level share blocks of the same size
        largest, number = 2 * -(-largest // block), number + 1
        rows = flown.where(open_rows).drop("home").withColumn("blocks", F.ceil(2 * F.col("blocks") / block).cast("long"))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    copies = (F.col("whole") + F.col("chance").cast("int")).cast("int")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
