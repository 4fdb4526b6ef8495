"""256-bit hex words as Spark columns.

A word is 64 lower-case hex digits. The text is the truth; doubles are approximate above
2^53 and DECIMAL(38,0) is NULL above 38 digits, as Spark has no wider exact number; the ``_text``
functions give all digits.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = "0123456789abcdef"
HEX_COMPLEMENT = "fedcba9876543210"
TWO_POW_60 = 1 << 60
LARGEST = Decimal("9" * 38)


def hex_body(value: Column) -> Column:
    """Lower-case hex digits without the ``0x`` prefix; NULL becomes empty."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(text.startswith("0x"), F.substr(text, F.lit(3))).otherwise(text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(data: Column) -> Column:
    """Split call or log data into its 32-byte words; a short last word is kept."""

    def split(body: Column) -> Column:
        count = F.ceil(F.length(body) / F.lit(64)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(body, (i - 1) * 64 + 1, F.lit(64)).cast("string"))

    # as bytes, since a place in a text is found by walking there
    return F.filter(bind(hex_body(data).cast("binary"), split), lambda w: w != "")


def word_at(data: Column, index: int) -> Column:
    """Word ``index`` (from 0) of ``data``, NULL if the data is too short."""
    return F.nullif(F.substring(hex_body(data), 64 * index + 1, 64), F.lit(""))


def pad_word(value: Column) -> Column:
    """Left-pad to 64 digits (empty or NULL reads as zero)."""
    return F.lpad(hex_body(value), 64, "0")


def _part(word: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(word, start, digits), 16, 10)


def _complement(word: Column) -> tuple[Column, Column, Column]:
    """(is negative, digits of the magnitude less the correction, correction) of a two's-complement word."""
    negative = F.substring(word, 1, 1) >= F.lit("8")
    body = F.when(negative, F.translate(word, HEX_DIGITS, HEX_COMPLEMENT)).otherwise(word)
    return negative, body, F.when(negative, F.lit(1)).otherwise(F.lit(0))


def _double(word: Column) -> Column:
    """Digits as 4 + 4 x 15, so that each part fits a long."""
    total = _part(word, 1, 4).cast("double")
    for start in (5, 20, 35, 50):
        total = total * F.lit(float(TWO_POW_60)) + _part(word, start, 15).cast("double")
    return total


def _decimal(word: Column) -> Column:
    """The low 128 bits as 2 + 15 + 15 digits; more would not fit 38 decimal digits."""
    high, middle, low = (_part(word, s, n).cast("decimal(38,0)") for s, n in ((33, 2), (35, 15), (50, 15)))
    scale = F.lit(TWO_POW_60).cast("decimal(38,0)")
    upper = F.try_add(F.try_multiply(high, scale), middle)
    value = F.try_add(F.try_multiply(upper, scale), low)
    return F.when(F.substring(word, 1, 32) == "0" * 32, value)


def word_decimal(word: Column) -> Column:
    """Unsigned value of a full 64-digit word, NULL above 38 decimal digits."""
    return _decimal(word)


def word_int_decimal(word: Column) -> Column:
    """Two's-complement value of a full 64-digit word, NULL above 38 decimal digits."""
    negative, body, one = _complement(word)
    digits = _decimal(body)
    magnitude = F.when(digits < F.lit(LARGEST), digits + one.cast("decimal(38,0)"))
    # 0 - x, because negating a decimal rounds it to 34 digits
    return F.when(negative, F.lit(0).cast("decimal(38,0)") - magnitude).otherwise(digits)


LIMB, LIMBS = 10**9, 9  # base and number of the decimal limbs of 256 bits
PIECES = [(58 - 7 * j, 7) for j in range(9)] + [(1, 1)]  # first digit and number of digits of 28 bits, the lowest first


def _digits(word: Column, extra: Column) -> Column:
    """Plain decimal digits of a 64-digit word plus ``extra``.

    Up to 60 bits are one number. Else pieces of 28 bits meet the decimal limbs of their powers of two: ten products below 2^58 stay a long, and
    one pass carries from limb to limb.
    """
    powers = [[2 ** (28 * j) // LIMB**i % LIMB for i in range(LIMBS)] for j in range(len(PIECES))]

    def sums(pieces: Column) -> Column:
        limbs = []
        for i in range(LIMBS):
            total = F.lit(0).cast("long")
            for j, power in enumerate(powers):
                if power[i]:
                    total = total + F.get(pieces, F.lit(j)) * F.lit(power[i]).cast("long")
            limbs.append(total)
        return F.array(*limbs)

    def carry(state: Column, limb: Column) -> Column:
        total = state["carry"] + limb
        text = F.lpad((total % LIMB).cast("string"), 9, "0")
        return F.struct(F.call_function("div", total, F.lit(LIMB)).alias("carry"), F.concat(text, state["text"]).alias("text"))

    def wide(w: Column) -> Column:
        read = [_part(w, *place).cast("long") for place in PIECES]
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))
        said = F.aggregate(bind(F.array(read[0] + extra, *read[1:]), sums), start, carry, lambda state: state["text"])
        return F.coalesce(F.nullif(F.ltrim(said, F.lit("0")), F.lit("")), F.lit("0"))

    return bind(word, lambda w: F.when(F.substring(w, 1, 49) == "0" * 49, (_part(w, 50, 15).cast("long") + extra).cast("string")).otherwise(wide(w)))


def word_text(word: Column) -> Column:
    """Exact unsigned value of a full 64-digit word as decimal text."""
    return F.coalesce(_decimal(word).cast("string"), _digits(word, F.lit(0)))


def word_int_text(word: Column) -> Column:
    """Exact two's-complement value of a full 64-digit word as decimal text."""
    negative, body, one = _complement(word)
    wide = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), _digits(body, one))
    return F.coalesce(word_int_decimal(word).cast("string"), wide)


def number_text(word: Column, signed: Column) -> Column:
    """Exact value of a full 64-digit word as decimal text, two's complement where ``signed``."""

    def text(w: Column) -> Column:
        negative = signed & (F.substring(w, 1, 1) >= F.lit("8"))
        body = F.when(negative, F.translate(w, HEX_DIGITS, HEX_COMPLEMENT)).otherwise(w)
        digits = _digits(body, F.when(negative, F.lit(1)).otherwise(F.lit(0)))
        return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), digits)

    return bind(word, text)


def uint_text(value: Column) -> Column:
    return word_text(pad_word(value))


def int_text(value: Column) -> Column:
    return word_int_text(pad_word(value))


def uint_double(value: Column) -> Column:
    return _double(pad_word(value))


def uint_decimal(value: Column) -> Column:
    """Exact unsigned value as DECIMAL(38,0), NULL when it needs more digits."""
    return _decimal(pad_word(value))


def int_double(value: Column) -> Column:
    negative, body, one = _complement(pad_word(value))
    magnitude = _double(body) + one
    return F.when(negative, -magnitude).otherwise(magnitude)


def int_decimal(value: Column) -> Column:
    """Exact two's-complement value as DECIMAL(38,0), NULL when it needs more digits."""
    return word_int_decimal(pad_word(value))


def scaled(value: Column, decimals: Column | int) -> Column:
    """Raw token units to a double amount; ``decimals`` may vary by row."""
    power = decimals if isinstance(decimals, Column) else F.lit(decimals)
    return value.cast("double") / F.pow(F.lit(10.0), power)


def decimal_text(value: Column, places: int = 6) -> Column:
    """Half-even rounding to ``places`` and plain digits without trailing zeros."""
    text = F.bround(value.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.when(F.instr(text, ".") > 0, trimmed).otherwise(text)


def word_address(word: Column) -> Column:
    """The address held in the low 20 bytes of a word or topic."""
    return F.concat(F.lit("0x"), F.right(pad_word(word), F.lit(40)))


def address_topic(address: Column) -> Column:
    return F.concat(F.lit("0x"), pad_word(address))


def _fits(value: Column) -> Column:
    """A length or offset as long, NULL where it is beyond any data."""
    return F.when(value < F.lit(2**29), value).cast("long")


def small_number(word: Column) -> Column:
    """A word as a long that is a length or offset, NULL where it is beyond any data."""
    low = lambda w: F.when(F.substring(w, 1, 56) == "0" * 56, _fits(_part(w, 57, 8).cast("long")))
    return F.when(word.isNotNull(), bind(pad_word(word), low))


def _tail(body: Column, word: Column) -> tuple[Column, Column]:
    """Of a dynamic value: the digit at which its content starts (from 1) and its length word."""
    offset = _fits(_decimal(pad_word(word)))
    length = _fits(_decimal(F.substring(body, (offset * 2 + 1).cast("int"), F.lit(64))))
    return offset * 2 + 65, length


def dynamic_bytes(body: Column, word: Column) -> Column:
    """Hex digits of the ABI bytes whose offset is ``word``; NULL if they are not all there."""
    start, length = _tail(body, word)
    raw = F.substring(body, start.cast("int"), (length * 2).cast("int"))
    return F.when(F.length(raw) == length * 2, raw)


def dynamic_text(body: Column, word: Column) -> Column:
    """The same read as UTF-8; bytes that are no text are replaced, as contracts may emit any."""
    return F.make_valid_utf8(F.unhex(dynamic_bytes(body, word)).cast("string"))


def dynamic_words(body: Column, word: Column) -> Column:
    """Words of the ABI array of one-word elements whose offset is ``word``; NULL if they are not all there."""
    start, length = _tail(body, word)
    whole = F.length(body) >= start - 1 + length * 64
    items = F.transform(F.sequence(F.lit(1).cast("long"), length), lambda i: F.substring(body, (start + (i - 1) * 64).cast("int"), F.lit(64)))
    return F.when(whole & (length > 0), items).when(whole, F.array().cast("array<string>"))


def dynamic_string(data: Column, head: int = 0) -> Column:
    """Text of an ABI dynamic string whose offset is in word ``head``; NULL if the bytes are missing."""
    body = hex_body(data)
    return dynamic_text(body, F.substring(body, 64 * head + 1, 64))
