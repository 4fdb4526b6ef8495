"""Joins that Spark has no strategy for, written as equi joins on derived keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwake.operators.timeline import asof
from feedwake.storage import write_table

#: Hex digits of a block (any 40-digit run holds one aligned block of 20 in full), and what stands before and behind the digits.
GRAM, OUTSIDE = 20, "\u0001"
#: Characters of a gram.
Q = 3
#: Places of the bitmap that goes before a join: 8 MB, so Spark sends it to all tasks.
PLACES = 1 << 26
#: Tiles of a window and pairs of a block in a dense interval join; a task forms the pairs of eight blocks.
STEPS, SHARE = 8, 1 << 18


def in_bits(bits: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` holds a position."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def marked(rows: DataFrame, known: DataFrame, tried: Sequence[Sequence[Column | str]]) -> tuple[DataFrame, list[Column]]:
    """``rows`` beside a bitmap of the hashes of ``known``, and for each column list whether the bitmap holds it.

    The bitmap is sent to all tasks whatever the session's threshold is: its size is bounded by ``PLACES``.
    """
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(PLACES))
    at = place(known.columns)
    placed = known.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).repartition("_bucket")
    held = write_table(placed.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    met, hits = rows, []
    for i, columns in enumerate(tried):
        here = place(columns)
        bits = F.broadcast(held.select(F.col("_bucket").alias(f"_bucket{i}"), F.col("_bits").alias(f"_bits{i}")))
        met = met.withColumns({f"_bucket{i}": F.bitmap_bucket_number(here), f"_bit{i}": F.bitmap_bit_position(here)}).join(bits, f"_bucket{i}", "left")
        hits.append(F.coalesce(in_bits(F.col(f"_bits{i}"), F.col(f"_bit{i}")), F.lit(False)))
    return met, hits


def likely(rows: DataFrame, known: DataFrame, *tried: Sequence[Column | str]) -> DataFrame:
    """Rows of which one of the column lists ``tried`` may equal a row of ``known``; all others surely equal none.

    The hashes of ``known`` are a written bitmap whose size is bounded, so rows without a partner go before a join shuffles them. The join
    itself must follow. Columns of both sides must have the same types.
    """
    met, hits = marked(rows, known, tried)
    return met.where(reduce(or_, hits)).select(*rows.columns)


def unlikely(rows: DataFrame, known: DataFrame, *tried: Sequence[Column | str]) -> DataFrame:
    """The rows that :func:`likely` drops: they surely equal no row of ``known``."""
    met, hits = marked(rows, known, tried)
    return met.where(~reduce(or_, hits)).select(*rows.columns)


def interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_at: Column, right_at: Column, lo: int, hi: int, closed: str = "right"
) -> DataFrame:
    """Pairs with ``left_at + lo`` .. ``left_at + hi`` around ``right_at``; ``closed`` is right, left or both.

    The result is the pairs themselves, so use it where each left row has few partners (account
    or transaction keys); for dense keys use the window scans of ``timeline``. Time is tiled by the
    interval's width: a left row meets two tiles, a right row lies in one, so no pair comes twice.
    """
    width = max(1, hi - lo)  # a point in time still needs tiles
    start = left_at.cast("long") + F.lit(lo)
    tile = F.floor(start / F.lit(width)).cast("long")
    spread = left.withColumn("_start", start).withColumn("_tile", F.explode(F.array(tile, tile + 1)))
    placed = right.withColumn("_right_at", right_at.cast("long"))
    placed = placed.withColumn("_tile", F.floor(F.col("_right_at") / F.lit(width)).cast("long"))
    gap = F.col("_right_at") - F.col("_start")
    after = gap > 0 if closed == "right" else gap >= 0
    before = gap < hi - lo if closed == "left" else gap <= hi - lo
    return spread.join(placed, [*on, "_tile"]).where(after & before).drop("_start", "_tile", "_right_at")


def dense_interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_at: Column, right_at: Column, width: int, closed: str = "right"
) -> DataFrame:
    """Pairs of :func:`interval_join` from ``left_at`` to ``left_at + width`` where most rows have many partners; ``closed`` is right or left.

    Both sides are read twice. Tiles are a part of the window's width, so few pairs are formed in vain. The pairs of each tile are
    counted first: dense tiles are dealt out in blocks of left rows, and tasks follow the count of pairs, not the bytes of the two sides.
    """
    step = -(-width // STEPS)
    tile = lambda at: at - F.pmod(at, F.lit(step).cast("long"))
    opens, at = left_at.cast("long"), right_at.cast("long")
    spread = left.withColumn("_opens", opens).withColumn("_tile", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(STEPS)), lambda i: tile(F.col("_opens")) + i.cast("long") * F.lit(step))))
    placed = right.withColumn("_at", at).withColumn("_tile", tile(at))
    keys = [*on, "_tile"]
    counts = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lefts")).join(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rights")), keys)
    made = F.col("_lefts").cast("double") * F.col("_rights")
    least = F.greatest(F.lit(float(SHARE)), F.col("_rights") * F.lit(64.0))  # a block holds no fewer left rows, so copies of right ones stay few
    blocks = write_table(counts.select(*keys, F.ceil(made / least).cast("int").alias("_blocks"), made.alias("_made")))
    tasks = int((blocks.agg(F.sum("_made").alias("made")).first()["made"] or 0) // (8 * SHARE)) + 1
    blocks = blocks.drop("_made")
    dealt = spread.join(blocks, keys).withColumn("_block", F.pmod(F.xxhash64(*left.columns), F.col("_blocks")).cast("int"))
    copied = placed.join(blocks, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = [*keys, "_block"]
    gap = F.col("_at") - F.col("_opens")
    inside = (gap > 0) & (gap <= width) if closed == "right" else (gap >= 0) & (gap < width)
    paired = dealt.drop("_blocks").repartition(tasks, *pair).join(copied.drop("_blocks").repartition(tasks, *pair), pair)
    return paired.where(inside).drop("_tile", "_block", "_opens", "_at")


def latest_prior(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_at: Column, right_at: Column, within: int, payload: Column, into: str,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Latest right row at or before each left row, not older than ``within``; left rows without one are dropped."""
    found = asof(left, right, on, left_at, right_at, payload, into, ties=ties, equal=True, within=within)
    return found.where(F.col(into).isNotNull())


def first_match(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_seq: Column, right_seq: Column, payload: Column, into: str
) -> DataFrame:
    """Right row with the smallest sequence at or after each left row; NULL if there is none."""
    return asof(left, right, on, left_seq, right_seq, payload, into, forward=True, equal=True)


def or_join(left: DataFrame, right: DataFrame, on: Sequence[str], any_of: Sequence[tuple[str, str]], right_id: Sequence[str]) -> DataFrame:
    """Rows that share ``on`` and at least one of the (left, right) column pairs, each pair of rows once.

    An OR condition would be a nested loop; each alternative is an equi join of its own instead.
    ``right_id`` and the left columns identify a pair of rows.
    """
    left_id = [c for c in left.columns]
    parts = []
    for left_col, right_col in any_of:
        shared = right.withColumn("_match", F.col(right_col))
        joined = left.withColumn("_match", F.col(left_col)).join(shared, [*on, "_match"])
        parts.append(joined.drop("_match"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.dropDuplicates([*left_id, *[c for c in right_id if c not in left_id]])


def _digits(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "^0x", "")


def _even(block: Column) -> Column:
    """Whether a text is one character repeated, as most blocks of call data are (zeros)."""
    return F.replace(block, F.substring(block, 1, 1), F.lit("")) == ""


def _hex_index(data: Column) -> Column:
    """Distinct entries of the aligned blocks of ``data``, in one pass over it.

    An entry is a block between its neighbours (60 digits), in which any needle over the block lies; the block is its key. A block of one
    repeated digit says little: it stands for the ``GRAM`` windows of 40 digits that hold it and start within the block before it, or at its own
    start, each the key of itself. Equal windows of a long run are one entry, so entries grow with the length of ``data`` at most.
    """
    body = _digits(data)
    width = (F.ceil(F.length(body) / GRAM) * GRAM).cast("int")
    blocks = F.regexp_extract_all(F.concat(F.lit(OUTSIDE * GRAM), F.rpad(body, width, OUTSIDE), F.lit(OUTSIDE * GRAM)), F.lit(f"(?s).{{{GRAM}}}"), F.lit(0))
    inner = F.greatest(F.size(blocks) - 2, F.lit(0))
    # zipped, not looked up by place: a function of each element must not name the whole list
    beside = F.arrays_zip(*[F.slice(blocks, k, inner) for k in (1, 2, 3)])

    def entries(three: Column) -> Column:
        around = F.concat(three["0"], three["1"], three["2"])
        windows = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda o: F.substring(around, o + 1, F.lit(2 * GRAM)))
        run = F.array(F.substring(around, 1, 2 * GRAM))
        return F.when(~_even(three["1"]), F.array(around)).when(_even(around), run).otherwise(windows)

    return F.array_distinct(F.flatten(F.when(F.length(body) >= 2 * GRAM, F.transform(beside, entries))))


def _key(entry: Column) -> Column:
    return F.when(F.length(entry) == 2 * GRAM, entry).otherwise(F.substring(entry, GRAM + 1, GRAM))


def contains_hex(
    haystacks: DataFrame, needles: DataFrame, on: Sequence[str], data: str, needle: str, keep: Sequence[str]
) -> DataFrame:
    """Pairs where 40-digit hex ``needle`` occurs anywhere in hex ``data``, aligned or not; without ``data``, one row for each ``keep``.

    An occurrence holds an aligned block of 20 digits in full, at one of 20 offsets, between parts of the two blocks beside it. So
    ``data`` becomes an index of its blocks (see ``_hex_index``) that carries the other columns but not ``data``, and a match is proved from
    the 60 digits of an entry. Needles meet it by 20 slices each; a slice of one repeated digit asks for the whole needle instead,
    so the zeros that fill call data are no common key.
    """
    columns = [c for c in haystacks.columns if c != data]
    index = haystacks.select(*columns, F.explode(_hex_index(F.col(data))).alias("_around")).withColumn("_key", _key(F.col("_around")))
    digits = _digits(F.col(needle))

    def asked(o: Column) -> Column:
        piece = F.substring(digits, o + 1, F.lit(GRAM))
        return F.when(_even(piece), F.struct(digits.alias("key"), F.lit(0).alias("at"))).otherwise(F.struct(piece.alias("key"), (F.lit(GRAM) - o).alias("at")))

    slices = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(GRAM - 1)), asked))
    keyed = needles.where(F.length(digits) == 2 * GRAM).withColumn("_asked", F.explode(slices))
    keyed = keyed.withColumns({"_key": F.col("_asked.key"), "_at": F.col("_asked.at"), "_digits": digits}).drop("_asked")
    # few entries meet a needle: the others go before anything is shuffled, and those that stay are written
    met = write_table(likely(index, keyed.select(*on, "_key"), [*on, "_key"]))
    # merged: the estimate of a side does not count what the explode makes of a row, so many needles would go through the driver
    found = met.hint("merge").join(keyed.repartition(*on, "_key"), [*on, "_key"]).where(F.substring(F.col("_around"), F.col("_at") + 1, F.lit(2 * GRAM)) == F.col("_digits"))
    return found.drop("_key", "_around", "_at", "_digits").dropDuplicates(list(keep))


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a lower-case text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def rarest_grams(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``word`` and the gram by which it is looked up: of all its grams the one that fewest of the ``texts`` (``low``) hold.

    Only grams of some word are counted. A word with a gram that no text holds is in none and is left out. Words of one or two characters are
    their own gram.
    """
    own = F.when(F.length("low_word") >= Q, _grams(F.col("low_word"), Q)).otherwise(F.array("low_word"))
    asked = words.select("word", "low_word", F.explode(own).alias("gram"))
    sizes = [n for n in range(1, Q + 1)]
    held = texts.select(F.explode(F.concat(*[_grams(F.col("low"), n) for n in sizes])).alias("gram"))
    counts = held.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    met = asked.join(counts, "gram", "left").groupBy("word", "low_word").agg(
        F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.min("texts").alias("texts"), F.count_if(F.col("texts").isNull()).alias("missing")
    )
    return met.where("missing = 0").select("word", "low_word", "gram", "texts")


def contains_text(haystacks: DataFrame, needles: DataFrame, text: str, word: str) -> DataFrame:
    """Distinct (text, word) with lower-case ``word`` inside lower-case ``text``.

    Both sides are reduced to distinct values. Texts are indexed by their runs of three characters, and each word meets them on its
    rarest run, so words that share a common beginning do not meet all texts that hold it.
    """
    texts = haystacks.select(F.col(text)).where(F.col(text).isNotNull()).distinct().withColumn("low", F.lower(F.col(text)))
    words = needles.select(F.col(word).alias("word")).where(F.coalesce(F.col(word), F.lit("")) != "").distinct().withColumn("low_word", F.lower("word"))
    rare = rarest_grams(texts, words)
    sizes = range(1, Q + 1)
    index = texts.select(F.col(text), "low", F.explode(F.concat(*[_grams(F.col("low"), n) for n in sizes])).alias("gram"))
    found = index.join(rare, "gram").where(F.contains(F.col("low"), F.col("low_word")))
    return found.select(text, F.col("word").alias(word))
