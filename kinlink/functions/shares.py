"""Expressions over vectors of unsigned numbers of a fixed width, and XOR sharing.

Arithmetic is modulo 2^bits on longs; the widths here are at most 32, so that no
intermediate product leaves a long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, eq=False)
class Share:
    """A column of unsigned numbers of ``bits`` bits."""

    col: Column
    bits: int = 32

    def __post_init__(self):
        if not 1 <= self.bits <= 32:
            raise ValueError("shares have 1 to 32 bits")

    @classmethod
    def constant(cls, value: int, bits: int = 32) -> Share:
        return cls(F.lit(value & ((1 << bits) - 1)).cast("bigint"), bits)

    def _same(self, other: Share) -> None:
        if self.bits != other.bits:
            raise ValueError("shares differ in bits")

    def _wrap(self, col: Column) -> Share:
        return Share(col.bitwiseAND((1 << self.bits) - 1), self.bits)

    def __add__(self, o: Share) -> Share:
        self._same(o)
        return self._wrap(self.col + o.col)

    def __sub__(self, o: Share) -> Share:
        self._same(o)
        return self._wrap(self.col - o.col)

    def __mul__(self, o: Share) -> Share:
        self._same(o)
        # Halves, as a product of two numbers of 32 bits may pass a signed long.
        half = (1 << 16) - 1
        low, high = o.col.bitwiseAND(half), F.shiftright(o.col, 16)
        return self._wrap(self.col * low + F.shiftleft((self.col * high).bitwiseAND((1 << self.bits) - 1), 16))

    def __and__(self, o: Share) -> Share:
        self._same(o)
        return Share(self.col.bitwiseAND(o.col), self.bits)

    def __or__(self, o: Share) -> Share:
        self._same(o)
        return Share(self.col.bitwiseOR(o.col), self.bits)

    def __xor__(self, o: Share) -> Share:
        self._same(o)
        return Share(self.col.bitwiseXOR(o.col), self.bits)

    def __invert__(self) -> Share:
        return self._wrap(F.bitwise_not(self.col))

    def __lshift__(self, n: int) -> Share:
        return self._wrap(F.shiftleft(self.col, n))

    def __rshift__(self, n: int) -> Share:
        return Share(F.shiftrightunsigned(self.col, n), self.bits)

    def equals(self, o: Share) -> Share:
        return Share((self.col == o.col).cast("bigint"), 1)

    def greater(self, o: Share) -> Share:
        return Share((self.col > o.col).cast("bigint"), 1)

    def less(self, o: Share) -> Share:
        return Share((self.col < o.col).cast("bigint"), 1)

    def mux(self, true: Share, false: Share) -> Share:
        """This single bit chooses between two shares."""
        true._same(false)
        return Share(F.when(self.col == 1, true.col).otherwise(false.col), true.bits)

    def resized(self, bits: int) -> Share:
        return Share(self.col.bitwiseAND((1 << bits) - 1), bits)

    def hamming_weight(self) -> Share:
        return Share(F.bit_count(self.col).cast("bigint"), self.bits)

    def divided(self, o: Share, precision: int) -> Share:
        """((x << precision) + y / 2) / y in whole numbers; 0 where y is 0."""
        top = F.shiftleft(self.col, precision) + F.shiftright(o.col, 1)
        return self._wrap(F.coalesce(F.call_function("div", top, F.nullif(o.col, F.lit(0))), F.lit(0)))

    def repeated(self, n: int) -> Column:
        return F.array_repeat(self.col, n)


def total(*shares: Share) -> Share:
    """Sum of a vector of shares, modulo 2^bits."""
    return reduce(lambda a, b: a + b, shares)


def largest(*shares: Share) -> Share:
    return Share(F.greatest(*[s.col for s in shares]), shares[0].bits) if len(shares) > 1 else shares[0]


def unrolled(df: DataFrame, values: str, place: str) -> DataFrame:
    """An array as one row for each of its values, with its place."""
    keep = [F.col(c) for c in df.columns if c != values]
    return df.select(*keep, F.posexplode(values).alias(place, values))


def split_parts(values: Column, size: int) -> Column:
    """An array in parts of ``size`` values; the last may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.slice(values, s, F.lit(size)))


def vcombine(*parts: Column) -> Column:
    return F.concat(*parts)


def xor_split(col: Column, seed: int, *key: Column, bits: int = 32) -> tuple[Column, Column]:
    """Two columns whose XOR is ``col``; the first is a keyed hash and tells nothing alone."""
    pad = F.xxhash64(F.lit(seed), *key).bitwiseAND((1 << bits) - 1)
    return pad, pad.bitwiseXOR(col.cast("bigint"))


def xor_combine(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)
