"""Tolerant text parsing: symbols, addresses, hashes, numbers, times and lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedwake.functions.words import hex_body

# Chain names as exported by other tools, and the names shown to readers.
CHAIN_ALIASES = {"bsc": "bnb", "avalanche": "avalanche_c", "eth": "ethereum"}
CHAIN_DISPLAY = {"bnb": "bsc", "avalanche_c": "avalanche"}
TRUE_WORDS = ("1", "true", "t", "yes", "y")
EPOCH_START = "1970-01-01T00:00:00Z"

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def symbol_key(value: Column) -> Column:
    """Comparison key of an asset, feed or actor name: lower case, no blanks; NULL becomes empty."""
    return F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit(""))


def first_text(*values: Column) -> Column:
    """First value that is neither NULL nor empty, else empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def address(value: Column) -> Column:
    """Lower-case ``0x`` address padded or cut to its low 20 bytes; empty stays empty."""
    body = hex_body(value)
    padded = F.concat(F.lit("0x"), F.right(F.lpad(body, F.greatest(F.length(body), F.lit(40)), F.lit("0")), F.lit(40)))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(padded)


def strict_address(value: Column) -> Column:
    """The lower-case address if it has the full 42 characters, else empty text."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when((F.length(text) == 42) & text.startswith("0x"), text).otherwise(F.lit(""))


def is_hash(value: Column, nbytes: int = 32) -> Column:
    return F.coalesce(F.lower(value).rlike(f"^0x[0-9a-f]{{{2 * nbytes}}}$"), F.lit(False))


def is_address(value: Column) -> Column:
    return is_hash(value, 20)


def is_placeholder_address(value: Column) -> Column:
    """True for an address made of one repeated digit."""
    return F.coalesce(F.lower(value).rlike(r"^0x([0-9a-f])\1{39}$"), F.lit(False))


def is_placeholder_tx(value: Column) -> Column:
    """True for a hash of one digit, or of at most two digits that opens with 40 equal ones."""
    body = F.substring(F.lower(value), 3, 64)
    few = F.size(F.array_distinct(F.split(body, ""))) <= 2
    opens = body.rlike(r"^([0-9a-f])\1{39}")
    return F.coalesce(is_hash(value) & few & opens, F.lit(False))


def chain_name(value: Column) -> Column:
    """Canonical chain name."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for alias, name in CHAIN_ALIASES.items():
        text = F.when(text == alias, F.lit(name)).otherwise(text)
    return text


def chain_display(value: Column) -> Column:
    shown = value
    for name, display in CHAIN_DISPLAY.items():
        shown = F.when(value == name, F.lit(display)).otherwise(shown)
    return shown


def parse_chains(values: str | Iterable[str] | None) -> list[str]:
    """Canonical, distinct chain names in the order given."""
    raw = values.split(",") if isinstance(values, str) else list(values or [])
    names = [CHAIN_ALIASES.get(v.strip().lower(), v.strip().lower()) for v in raw]
    return list(dict.fromkeys(n for n in names if n))


def chain_filter_names(chains: Iterable[str]) -> list[str]:
    """Names to accept in tables that still carry the old name of a chain."""
    accepted = set(chains)
    return sorted(accepted | {alias for alias, name in CHAIN_ALIASES.items() if name in accepted and alias == "avalanche"})


def to_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_double(value: Column, default: float | None = None) -> Column:
    """Number from text, NULL (or ``default``) for anything that is not plainly a number."""
    text = value.cast("string")
    number = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(default))


def to_long(value: Column, default: int | None = None) -> Column:
    """Integer part of a number given as text; NULL (or ``default``) for one that a long can't hold."""
    number = to_double(value)
    part = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
    whole = F.coalesce(F.trim(value.cast("string")).try_cast("long"), F.when(F.abs(part) < F.lit(2.0**63), part).cast("long"))
    whole = F.when(number.isNotNull(), whole)
    return whole if default is None else F.coalesce(whole, F.lit(default).cast("long"))


def loose_amount(value: Column) -> Column:
    """Amount from text with thousands commas; blank, ``unknown`` and junk read as zero."""
    return F.coalesce(to_double(F.replace(value, F.lit(","), F.lit(""))), F.lit(0.0))


def text_list(value: Column) -> Column:
    """Items of a ``;`` list (or ``,`` list when there is no ``;``), trimmed, blanks dropped."""
    text = F.coalesce(value, F.lit(""))
    items = F.when(F.instr(text, ";") > 0, F.split(text, ";")).otherwise(F.split(text, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def parse_time(value: Column) -> Column:
    """Timestamp from unix seconds or ISO text ending in Z, `` UTC``, an offset or nothing (read as UTC)."""
    text = F.trim(value.cast("string"))
    unix = F.timestamp_seconds(F.when(text.rlike(r"^\d+$"), text.try_cast("long")))
    iso = F.regexp_replace(F.regexp_replace(text, r"\s*(UTC|Z)$", ""), " ", "T")
    zoned = F.when(iso.rlike(r"[+-]\d\d:?\d\d$"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    return F.coalesce(unix, F.try_to_timestamp(F.when(iso != "", zoned)))


def parse_time_or_epoch(value: Column) -> Column:
    return F.coalesce(parse_time(value), F.timestamp_seconds(F.lit(0)))


def micros(value: Column) -> Column:
    return F.unix_micros(value)


def seconds(value: Column) -> Column:
    return F.unix_seconds(value)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, cut toward zero like a date difference."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("long")


def log_key(tx_hash: Column, log_index: Column) -> Column:
    return F.concat_ws(":", tx_hash, log_index.cast("string"))


def stable_log_key(case: Column, chain: Column, tx: Column, contract: Column, topic0: Column, index: Column) -> Column:
    """Six-field identity of a sampled log, used as the sampling hash input."""
    blank = F.lit("")
    parts = [F.coalesce(case, blank), F.coalesce(chain, blank)]
    parts += [F.lower(F.coalesce(c, blank)) for c in (tx, contract, topic0)]
    return F.concat_ws("|", *parts, F.coalesce(index.cast("string"), blank))


def hash_buckets(count: int) -> list[str]:
    """Evenly spaced two-digit hex prefixes; 256 keeps every hash."""
    count = max(1, min(256, count))
    return sorted({f"{int(i * 256 / count):02x}" for i in range(count)})


def in_hash_buckets(tx_hash: Column, count: int) -> Column:
    if count >= 256:
        return F.lit(True)
    return F.substring(F.lower(tx_hash), 3, 2).isin(*hash_buckets(count))


def selector(calldata: Column) -> Column:
    """Four-byte selector, ``0x`` and eight digits."""
    return F.substring(F.lower(calldata), 1, 10)


def rate(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", value * 100))
