"""Typed number rules against exact decimals: the text of each number decides."""

import decimal
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpact.functions.exact import Num
from sparkpact.operators.numeric import Number

D = decimal.Decimal
BOUNDS = [
    "0", "0.1", "1e-13", "1e400", "-1e400", "1e-400", "-1e-400", "0.30000000000000004", "0.3", "2.5", "1e30", "1e22", "9007199254740993", "9007199254740992.5",
    "3.3", "33", "0.1000000000000000055511151231257827", "16777217", "0.02", "0.5", "7", "1e3", "1.1", "1234567.891", "1e-7", "1e999999999", "1e-999999999",
]


def doubles():
    rng = random.Random(1)
    xs = [0.0, -0.0, 1e-13, 1e30, 5e-324, -5e-324, 1.7976931348623157e308, 0.1, 0.3, 2.5, 1e15, 1e16, 123456789012345678.0, 9007199254740993.0, 0.1 + 0.2]
    xs += [1e22, 1e23, 33.0, 3.3, math.nan, math.inf, -math.inf, 2.0**63, -(2.0**63), 2.0**31, 1e-7, 1e-5]
    xs += [rng.uniform(-100, 100) for _ in range(20)] + [round(rng.uniform(-100, 100), 2) for _ in range(40)]
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(40)]
    return xs + [round(rng.uniform(0, 1), 1) * 10 ** rng.randrange(-20, 40) for _ in range(40)]


def floats():
    with np.errstate(all="ignore"):
        return [float(np.float32(x)) for x in doubles()]


CASES = [
    (T.DoubleType(), doubles(), repr),
    (T.FloatType(), floats(), lambda x: str(np.float32(x))),
    (T.DecimalType(20, 4), [D("0"), D("1.1000"), D("-3.3000"), D("2.5"), D("1234567.8910"), D("9999999999999999.9999"), D("0.0002")], lambda x: format(x, "f")),
    (T.LongType(), [0, 7, -7, 33, 10**18, 2**63 - 1, -(2**63), 1000], str),
    (T.ByteType(), [0, 7, -128, 127, 33], str),
]


@pytest.mark.parametrize(("kind", "values", "spell"), CASES)
def test_rules_are_those_of_the_text(spark, kind, values, spell):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", kind)])
    df = spark.createDataFrame(list(enumerate(values)), schema)
    n, bounds = Number(F.col("x"), kind), [Num.parse(b) for b in BOUNDS]
    found = [n.finite.alias("finite"), n.is_integer().alias("integer")]
    for k, b in enumerate(bounds):
        tests = {"lt": n.below(b, False), "le": n.below(b, True), "gt": n.above(b, False), "ge": n.above(b, True), "eq": n.equals(b)}
        if not b.sign and b.digits != "0":
            tests["of"] = n.is_multiple_of(b)
        found += [c.alias(f"{name}{k}") for name, c in tests.items()]
    for r in df.select("i", *found).collect():
        x = values[r["i"]]
        assert r["finite"] == (not isinstance(x, float) or math.isfinite(x))
        if not r["finite"]:
            continue
        text = Num.parse(spell(x))
        assert r["integer"] == text.is_integer(), x
        for k, b in enumerate(bounds):
            c = text.compare(b)
            want = {"lt": c < 0, "le": c <= 0, "gt": c > 0, "ge": c >= 0, "eq": c == 0}
            if f"of{k}" in r:
                want["of"] = text.is_multiple_of(b)
            assert {name: r[f"{name}{k}"] for name in want} == want, (x, b.lexeme)
