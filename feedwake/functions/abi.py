"""ABI types as a small grammar, and the column expression that reads a value of a type from hex data.

A type is a word type (``uint256``, ``address``, ``bool``, ``bytes32`` ...), ``string``, ``bytes``, a tuple ``(t,u)``, ``t[]`` or ``t[k]``. A value of a type whose
size is not fixed lies in the tail: its place in the head holds the offset from the start of what encloses it. All places are
digits from the start of the data, and each step binds its place to a name, so that an expression grows with its type alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedwake.functions import words as W

WORD = 64
SPLIT_DEPTH = {"(": 1, ")": -1}


@dataclass(frozen=True)
class Kind:
    """A parsed type: a word type or text (``name``), a tuple (``parts``), or an array of ``element`` (``length`` None: as many as the data says)."""

    name: str = ""
    parts: tuple[Kind, ...] | None = None
    element: Kind | None = None
    length: int | None = None

    @property
    def in_tail(self) -> bool:
        if self.parts is not None:
            return any(p.in_tail for p in self.parts)
        if self.element is not None:
            return self.length is None or self.element.in_tail
        return self.name in ("string", "bytes")

    @property
    def head_words(self) -> int:
        """Words that a value takes in the head of what encloses it."""
        if self.in_tail:
            return 1
        if self.parts is not None:
            return sum(p.head_words for p in self.parts)
        return self.length * self.element.head_words if self.element is not None else 1


def parse(text: str) -> Kind:
    """The kind of a type text; a malformed one raises ``ValueError``."""
    text = text.replace(" ", "")
    if text.endswith("]"):
        inner, _, size = text[:-1].rpartition("[")
        if not inner or (size and not size.isdigit()):
            raise ValueError(f"no type: {text}")
        return Kind(element=parse(inner), length=int(size) if size else None)
    if text.startswith("("):
        if not text.endswith(")"):
            raise ValueError(f"no type: {text}")
        parts, depth, begin = [], 0, 1
        for at, ch in enumerate(text[1:-1], 1):
            depth += SPLIT_DEPTH.get(ch, 0)
            if ch == "," and depth == 0:
                parts.append(text[begin:at])
                begin = at + 1
        return Kind(parts=tuple(parse(p) for p in [*parts, text[begin:-1]] if p or parts))
    if not text or not text.isalnum():
        raise ValueError(f"no type: {text}")
    return Kind(name=text)


def is_word(text: str) -> bool:
    """Whether values of a type are one word."""
    return not ("(" in text or "[" in text or text in ("string", "bytes"))


def word_value(name: Column, word: Column) -> Column:
    """Text of a value of a word type."""
    return (
        F.when(name == "address", W.word_address(word)).when(name == "bool", F.when(W.uint_double(word) != 0, F.lit("true")).otherwise(F.lit("false")))
        .when(name.rlike("^u?int"), W.number_text(W.pad_word(word), name.startswith("int"))).otherwise(word)
    )


def _word(body: Column, at: Column) -> Column:
    """The word at a place, NULL if it is not all there."""
    word = F.substring(body, (at + 1).cast("int"), F.lit(WORD))
    return W.bind(word, lambda w: F.when(F.length(w) == WORD, w.cast("string")))


def _count(body: Column, at: Column) -> Column:
    """A length or offset in bytes, NULL where it is missing or beyond any data."""
    return W.bind(_word(body, at), W.small_number)


def _joined(items: Column, opening: str, closing: str) -> Column:
    """Texts in brackets; NULL if one of them is."""
    return W.bind(items, lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), F.concat(F.lit(opening), F.array_join(t, ","), F.lit(closing))))


def _tail_start(body: Column, base: Column, at: Column) -> Column:
    return base + 2 * _count(body, at)


def read(kind: Kind, body: Column, base: Column, at: Column) -> Column:
    """Text of a value in ``body``, the digits as bytes (a place in a text is found by walking there): its head is at ``at``, offsets count from ``base`` (both digits, long); ``[a,b]`` for arrays, ``(a,b)`` for tuples. NULL if bytes are missing."""
    if kind.element is not None:
        return _array(kind, body, base, at)
    if kind.parts is not None:
        start = _tail_start(body, base, at) if kind.in_tail else at

        def fields(begin: Column) -> Column:
            texts, place = [], 0
            for part in kind.parts:
                texts.append(read(part, body, begin, begin + place * WORD))
                place += part.head_words
            return _joined(F.array(*texts), "(", ")")

        return W.bind(start, fields)
    if kind.name in ("string", "bytes"):
        def content(start: Column) -> Column:
            sized = F.struct((start + WORD + 1).cast("int").alias("begin"), (_count(body, start) * 2).cast("int").alias("size"))
            raw = W.bind(sized, lambda s: F.struct(F.substring(body, s["begin"], s["size"]).cast("string").alias("raw"), s["size"].alias("size")))
            whole = W.bind(raw, lambda r: F.when(F.length(r["raw"]) == r["size"], r["raw"]))
            return F.make_valid_utf8(F.unhex(whole).cast("string")) if kind.name == "string" else F.concat(F.lit("0x"), whole)

        return W.bind(_tail_start(body, base, at), content)
    return W.bind(_word(body, at), lambda word: word_value(F.lit(kind.name), word))


def _array(kind: Kind, body: Column, base: Column, at: Column) -> Column:
    width = kind.element.head_words * WORD

    def elements(start: Column, count: Column) -> Column:
        # a count is believed only as far as the data has places for it
        fits = (count >= 0) & (count * max(width, 1) <= F.length(body) - start)
        numbers = F.when(fits & (count > 0), F.sequence(F.lit(0).cast("long"), count - 1)).when(fits, F.array().cast("array<bigint>"))
        places = F.transform(numbers, lambda i: F.struct(start.alias("base"), (start + i * width).alias("at")))
        return _joined(F.transform(places, lambda p: read(kind.element, body, p["base"], p["at"])), "[", "]")

    if kind.length is not None:
        start = _tail_start(body, base, at) if kind.in_tail else at
        return W.bind(start, lambda s: elements(s, F.lit(kind.length).cast("long")))
    return W.bind(_tail_start(body, base, at), lambda s: W.bind(F.struct((s + WORD).alias("start"), _count(body, s).alias("count")), lambda t: elements(t["start"], t["count"])))
