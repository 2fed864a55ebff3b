import random
import re

import pytest
from pyspark.sql import functions as F

from nodeloom.functions import casts, codec


def texts():
    rng = random.Random(1)
    alphabet = ["a", "Z", "0", "9", "_", " ", "-", "#", "é", "中", "😀", "\n", "\x00", "be", "_be_", "_1f600_", "_d800_", "_ffffffffff_"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(500)] + ["1-URGENT", "4-NOT SPECIFIED", "Brand#12", ""]


def test_encode_and_decode_equal_python(spark):
    rows = [(x,) for x in texts()] + [(None,)]
    frame = spark.createDataFrame(rows, "x string")
    got = frame.select("x", codec.encode(F.col("x")).alias("e"), codec.decode(F.col("x")).alias("d"), codec.decode(F.col("x"), compat=True).alias("c")).collect()
    for r in got:
        if r.x is None:
            assert (r.e, r.d) == (None, None)
            continue
        want = re.sub(r"^[0-9]|[^A-Za-z0-9]", lambda m: f"_{ord(m[0]):x}_", r.x)
        assert r.e == want == codec.encode_name(r.x)
        assert r.d == codec.decode_name(r.x), r.x


def test_known_names():
    assert codec.encode_name("1-URGENT") == "_31__2d_URGENT"
    assert codec.encode_name("a_b") == "a_5f_b"
    assert codec.decode_name("_31__2d_URGENT") == "1-URGENT"
    assert codec.encode_name("\n") == "_a_" and codec.decode_name("_a_") == "_a_"  # one digit is not decoded
    assert codec.decode_name(codec.encode_name("😀")) == "😀"
    assert codec.decode_name("_1f600_", compat=True) == "ὠ0"


@pytest.mark.parametrize("kind,value,want", [("string", "", None), ("string", " ", " "), ("double", "1e3", 1000.0), ("double", "Null", None), ("double", "x", None), ("long", "7", 7), ("long", "", None), ("boolean", "TRUE", True), ("boolean", "t", None), ("boolean", "False", False), ("array", "[a]", "[a]")])
def test_typed(spark, kind, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(casts.typed(F.col("v"), kind)).first()[0] == want


def test_strict_long_raises(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("",)], "v string").select(casts.typed(F.col("v"), "long", strict=True)).collect()


def test_arrays(spark):
    row = spark.createDataFrame([("['a', 'b']",)], "v string").select(casts.array_parse(F.col("v")), casts.array_elements(F.col("v"))).first()
    assert list(row) == [["a'", " 'b"], ["a", "b"]]
