"""From values to bytes at rest, and from bytes to the words that are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from kinlink.plans.config import FieldSpec, bitbytes

SPACE = r"[ \t\n\x0B\f\r]"


def base64_encode(b: Column) -> Column:
    return F.base64(b)


def base64_decode(s: Column) -> Column:
    """Bytes up to the first padding sign or sign outside the alphabet."""
    good = F.regexp_extract(s, "^[A-Za-z0-9+/]*", 0)
    # One sign more than whole bytes holds no byte.
    whole = F.when(F.length(good) % 4 == 1, F.substring(good, F.lit(1), F.length(good) - 1)).otherwise(good)
    return F.unbase64(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "="))


def fixed(b: Column, n: int) -> Column:
    """Exactly ``n`` bytes: cut or padded with zero bytes."""
    return F.rpad(F.substring(b, 1, n), n, F.lit(b"\0"))


def byte(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 2, "0"))


def mask_bits(b: Column, bits: int) -> Column:
    """Clear the bits from ``bits`` on in the last byte of ``bitbytes(bits)``."""
    if bits % 8 == 0:
        return b
    last = F.conv(F.hex(F.substring(b, bitbytes(bits), 1)), 16, 10).cast("int").bitwiseAND((1 << bits % 8) - 1)
    return F.concat(F.substring(b, 1, bitbytes(bits) - 1), byte(last))


def int_bytes(x: Column, n: int) -> Column:
    """The first ``n`` bytes of the little-endian two's complement of an integer."""
    x = x.cast("bigint")
    return F.concat(*[byte(F.shiftright(x, 8 * i).bitwiseAND(255)) for i in range(n)])


@F.pandas_udf(BinaryType())
def double_bytes(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The 8 little-endian bytes of doubles; no built-in function shows them."""
    for x in xs:
        raw = x.to_numpy(dtype=np.float64, na_value=np.nan).astype("<f8").tobytes()
        yield pd.Series([None if null else raw[8 * i:8 * i + 8] for i, null in enumerate(x.isna())], dtype=object)


def encode(value: Column, spec: FieldSpec) -> Column:
    """A field's JSON value (as its own type, or as a string) in bytes; null stays null."""
    if spec.ftype == "bitmask":
        raw = base64_decode(value.cast("string"))
        fits = F.when(F.length(raw) <= spec.nbytes, raw).otherwise(
            F.raise_error(F.concat(F.lit(f"field {spec.name}: mask of "), F.length(raw).cast("string"), F.lit(f" bytes, at most {spec.nbytes} fit"))).cast("binary"))
        return F.when(value.isNotNull(), mask_bits(fixed(fits, spec.nbytes), spec.bitsize))
    if spec.ftype == "integer":
        return int_bytes(value, spec.nbytes)
    if spec.ftype == "number":
        return fixed(double_bytes(value.cast("double")), spec.nbytes)
    blank = F.regexp_replace(value.cast("string"), SPACE, "") == ""
    return F.when(~blank, fixed(F.encode(value.cast("string"), "UTF-8"), spec.nbytes))


def trim(s: Column, side: str = "both") -> Column:
    """White space of the C locale off the ends."""
    left, right = f"^{SPACE}+", f"{SPACE}+$"
    return F.regexp_replace(s, {"left": left, "right": right, "both": f"{left}|{right}"}[side], "")


def bits_to_mask(bits: Column, n: int) -> Column:
    """An array of booleans as bytes, the first in the lowest bit of the first byte."""
    size = bitbytes(n)
    signs = F.array_join(F.transform(bits, lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), "")
    text = F.rpad(signs, 8 * size, "0")
    return F.unhex(F.concat(*[F.lpad(F.conv(F.reverse(F.substring(text, 8 * k + 1, 8)), 2, 16), 2, "0") for k in range(size)]))


def repeat_bit(bit: Column, n: int) -> Column:
    return mask_bits(F.unhex(F.repeat(F.when(bit, F.lit("FF")).otherwise(F.lit("00")), bitbytes(n))), n)


def word_column(b: Column, i: int) -> Column:
    """Bytes 8 i to 8 i + 7 as one signed number (missing bytes are zero)."""
    part = F.rpad(F.hex(F.substring(b, 8 * i + 1, 8)), 16, "0")
    return F.when(b.isNotNull(), F.conv(part, 16, -10).cast("bigint"))


def bit_text(b: Column) -> Column:
    """Bytes as text of eight binary digits each, parted by spaces."""
    one = F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.lpad(F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 2), 8, "0"))
    return F.when(F.length(b) == 0, F.lit("")).otherwise(F.array_join(one, " "))


def n_words(spec: FieldSpec) -> int:
    return -(-spec.nbytes // 8)


def mask_words(b: Column, words: int) -> Column:
    return F.array(*[word_column(b, i) for i in range(words)])
