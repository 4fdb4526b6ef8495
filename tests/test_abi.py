"""Nested ABI values against an encoder of their own."""

import random
import time

import pytest
from pyspark.sql import functions as F

from feedwake.functions import abi as ABI
from feedwake.functions import words as W
from feedwake.operators.decode import decode_by_abi


def encode(kind, value):
    """Bytes of a value as it stands in the tail, or in the head if its size is fixed."""
    word = lambda n: (n % 2**256).to_bytes(32, "big")
    if kind.parts is not None:
        return enclosed(list(kind.parts), value)
    if kind.element is not None:
        inside = enclosed([kind.element] * len(value), value)
        return inside if kind.length is not None else word(len(value)) + inside
    if kind.name in ("string", "bytes"):
        raw = value.encode() if kind.name == "string" else value
        return word(len(raw)) + raw + bytes(-len(raw) % 32)
    return value.rjust(32, b"\0") if isinstance(value, bytes) else word(int(value))


def enclosed(kinds, values):
    head, tail, size = [], b"", 32 * sum(k.head_words for k in kinds)
    for kind, value in zip(kinds, values, strict=True):
        if kind.in_tail:
            head.append((size + len(tail)).to_bytes(32, "big"))
            tail += encode(kind, value)
        else:
            head.append(encode(kind, value))
    return b"".join(head) + tail


def invent(kind, draw):
    if kind.parts is not None:
        return [invent(p, draw) for p in kind.parts]
    if kind.element is not None:
        return [invent(kind.element, draw) for _ in range(draw.randint(0, 3) if kind.length is None else kind.length)]
    return {
        "string": lambda: "".join(draw.choice("ab é日") for _ in range(draw.randint(0, 40))), "bytes": lambda: draw.randbytes(draw.randint(0, 70)), "bool": lambda: draw.random() < 0.5,
        "address": lambda: draw.randbytes(20), "int64": lambda: draw.randint(-(2**63), 2**63), "uint256": lambda: draw.randint(0, 2**200),
    }[kind.name]()


def text(kind, value):
    if kind.parts is not None:
        return "(" + ",".join(text(k, v) for k, v in zip(kind.parts, value, strict=True)) + ")"
    if kind.element is not None:
        return "[" + ",".join(text(kind.element, v) for v in value) + "]"
    return "0x" + value.hex() if isinstance(value, bytes) else str(value).lower() if isinstance(value, bool) else str(value)


TYPES = [
    "uint256[3]", "string[]", "bytes[]", "uint256[][]", "int64[2][]", "string[2]", "(uint256,string)", "(address,bool)[]", "(string,(int64,bytes)[],uint256[2])[2]",
    "((string,uint256)[],string)", "uint256[][2]", "()", "bool[0]", "string[][]",
]


@pytest.mark.parametrize("kind", TYPES)
def test_values_of_nested_types(spark, kind):
    draw, parsed = random.Random(kind), ABI.parse(kind)
    before, after = ABI.parse("uint256[2]"), ABI.parse("string")
    rows = []
    for i in range(25):
        value = invent(parsed, draw)
        data = enclosed([before, parsed, after], [[1, 2], value, "end"])
        cut = draw.randint(0, len(data)) if i % 5 == 4 else len(data)
        rows.append((i, data[:cut].hex(), text(parsed, value), cut == len(data)))
    at = F.lit(2 * ABI.WORD).cast("long")
    found = spark.createDataFrame(rows, "i long, data string, want string, whole boolean").withColumn("got", ABI.read(parsed, W.hex_body(F.col("data")), F.lit(0).cast("long"), at))
    for r in found.collect():
        assert r["got"] == r["want"] if r["whole"] else r["got"] in (r["want"], None), (kind, r["i"])


def test_hostile_lengths_give_null(spark):
    word = lambda n: f"{n:064x}"
    data = [word(32) + word(2**255), word(32) + word(10**9), word(2**200), word(0), word(32) + word(1) + word(2**64), "", "zz"]
    for kind in ("uint256[][]", "string[]", "(string,uint256)[]", "()[]"):
        rows = spark.createDataFrame([(d,) for d in data], "data string").withColumn("got", ABI.read(ABI.parse(kind), W.hex_body(F.col("data")), F.lit(0).cast("long"), F.lit(0).cast("long")))
        rows.collect()


@pytest.mark.parametrize("bad", ["", "(", "uint256[", "a]", "uint256[x]", "(uint256"])
def test_no_types(bad):
    with pytest.raises(ValueError):
        ABI.parse(bad)


def test_long_data_is_cut_once_for_all_arguments(spark):
    """A log of many wide numbers: the words were cut again for each argument, and each number went through a loop of 144 steps."""
    n_args, n_logs = 100, 300
    tops = [2**256 - 1 - i * 10**30 for i in range(n_args)]
    data = "0x" + "".join(f"{n:064x}" for n in tops)
    logs = spark.range(0, n_logs, 1, 1).select(
        "id", F.lit("0xaa").alias("topic0"), *[F.lit(None).cast("string").alias(f"topic{i}") for i in (1, 2, 3)], F.concat(F.lit(data), F.lpad(F.hex("id"), 64, "0")).alias("data"))
    inputs = [(f"a{i}", "uint256" if i % 2 else "int256", False) for i in range(n_args)] + [("id", "uint64", False)]
    abi = spark.createDataFrame([("0xaa", "Wide", inputs)], "topic0 string, event_name string, inputs array<struct<name:string,type:string,indexed:boolean>>")
    began = time.time()
    rows = decode_by_abi(logs, abi).select("id", F.transform("args", lambda a: a["value"]).alias("values")).collect()
    assert time.time() - began < 12
    want = [str(n if i % 2 else n - 2**256) for i, n in enumerate(tops)]
    assert len(rows) == n_logs and all(r["values"] == [*want, str(r["id"])] for r in rows)
