import base64
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinlink.functions import codec, compare, shares
from kinlink.plans.config import FieldSpec
from kinlink.plans.precision import Precision
from pyspark.sql import functions as F


def values(spark, kind, xs, *cols):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def spec(t, bits, comparator="binary"):
    return FieldSpec("f", 0.1, 0.01, comparator, t, bits)


def encoded(spark, kind, xs, s):
    return [None if r[0] is None else bytes(r[0]) for r in values(spark, kind, xs, codec.encode(F.col("x"), s))]


def test_base64(spark):
    xs = ["", "AA==", "////", "TWFu", "TWE=", "TQ", "TWFuT", "TW*u", "=TWF", None]
    got = [None if r[0] is None else bytes(r[0]) for r in values(spark, "string", xs, codec.base64_decode(F.col("x")))]
    assert got == [b"", b"\0", b"\xff\xff\xff", b"Man", b"Ma", b"M", b"Man", b"M", b"", None]


def test_bitmask_is_padded_and_cleared(spark):
    xs = [base64.b64encode(b).decode() for b in (b"\xff\xff", b"\x01", b"")] + [None]
    assert encoded(spark, "string", xs, spec("bitmask", 12)) == [b"\xff\x0f", b"\x01\x00", b"\x00\x00", None]
    with pytest.raises(Exception, match="3 bytes, at most 2 fit"):
        encoded(spark, "string", [base64.b64encode(b"abc").decode()], spec("bitmask", 12))


def test_integers_keep_whole_bytes(spark):
    xs = [0, 1, -1, 70000, 2**31 - 1, None]
    assert encoded(spark, "bigint", xs, spec("integer", 29)) == [None if x is None else struct.pack("<i", x) for x in xs]
    assert encoded(spark, "bigint", xs, spec("integer", 12)) == [None if x is None else struct.pack("<i", x)[:2] for x in xs]


def test_numbers(spark):
    xs = [0.0, -0.0, 1.5, -3.25e300, float("inf"), None]
    assert encoded(spark, "double", xs, spec("number", 64)) == [None if x is None else struct.pack("<d", x) for x in xs]
    assert encoded(spark, "double", [1.5], spec("number", 20)) == [struct.pack("<d", 1.5)[:3]]


def test_strings(spark):
    xs = ["abc", "abcdef", "é", "", " \t\n", None]
    assert encoded(spark, "string", xs, spec("string", 32)) == [b"abc\0", b"abcd", "é".encode() + b"\0\0", None, None, None]


def test_bits_and_words(spark):
    rows = values(spark, "array<boolean>", [[True, False, True], [False] * 9 + [True], []], codec.bits_to_mask(F.col("x"), 10))
    assert [bytes(r[0]) for r in rows] == [b"\x05\x00", b"\x00\x02", b"\x00\x00"]
    raw = bytes(range(1, 13))
    (words, hw), = values(spark, "binary", [raw], codec.mask_words(F.col("x"), 2), compare.hamming_weight(codec.mask_words(F.col("x"), 2)))
    assert [w & 2**64 - 1 for w in words] == [int.from_bytes(raw[:8], "big"), int.from_bytes(raw[8:] + b"\0" * 4, "big")]
    assert hw == sum(bin(x).count("1") for x in raw)
    assert [bytes(r[0]) for r in values(spark, "boolean", [True, False], codec.repeat_bit(F.col("x"), 11))] == [b"\xff\x07", b"\0\0"]


def test_trim(spark):
    got = values(spark, "string", [" \t a b\n\v", ""], *[codec.trim(F.col("x"), s) for s in ("both", "left", "right")])
    assert got == [("a b", "a b\n\v", " \t a b"), ("", "", "")]


def test_dice_rounds_half_up_and_zero_masks(spark):
    p = Precision(32, 4, 3)
    df = spark.createDataFrame([(b, t) for t in range(0, 12) for b in range(t // 2 + 1)], "b bigint, t bigint")
    for r in df.select("b", "t", compare.dice(F.col("b"), F.col("t"), p).alias("d"), compare.dice(F.col("b"), F.col("t"), Precision(None)).alias("e")).collect():
        assert r["d"] == (0 if r["t"] == 0 else ((r["b"] << 5) + (r["t"] >> 1)) // r["t"])
        assert r["e"] == (0 if r["t"] == 0 else 2 * r["b"] / r["t"])


def test_registry_takes_new_comparators():
    compare.register("never", lambda b, s: {"b": b}, lambda left, right, s, p: F.lit(0))
    assert "never" in compare.REGISTRY
    del compare.REGISTRY["never"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=20))
def test_share_algebra(spark, pairs):
    m, S = 2**32 - 1, shares.Share
    a, b = S(F.col("a")), S(F.col("b"))
    cols = [a + b, a - b, a * b, a & b, a | b, a ^ b, ~a, a << 5, a >> 5, a.equals(b), a.greater(b), a.less(b), a.greater(b).mux(a, b), a.resized(7), a.hamming_weight()]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.select("a", "b", *[c.col.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
        x, y = r["a"], r["b"]
        want = [x + y & m, x - y & m, x * y & m, x & y, x | y, x ^ y, ~x & m, x << 5 & m, x >> 5, x == y, x > y, x < y, max(x, y), x & 127, bin(x).count("1")]
        assert list(r[2:]) == [int(w) for w in want]


def test_share_vectors(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<bigint>")
    row = df.select(shares.split_parts(F.col("x"), 2).alias("p"), shares.vcombine(F.col("x"), F.col("x")).alias("v"), shares.Share.constant(9, 3).repeated(2).alias("r")).first()
    assert row["p"] == [[1, 2], [3, 4], [5]] and row["v"] == [1, 2, 3, 4, 5] * 2 and row["r"] == [1, 1]
    with pytest.raises(ValueError):
        shares.Share(F.lit(1), 33)


def test_bit_text(spark):
    assert values(spark, "binary", [b"\x05\xff", b"\x00", b""], codec.bit_text(F.col("x"))) == [("00000101 11111111",), ("00000000",), ("",)]
