"""Quotients as pairs of numerator and denominator: an orderable key, folds, argmax.

Quotients are never divided for the result; they are ordered by exact keys:

* ``packed_key``: one long with the quotient's whole and fractional part (twice the
  denominator's bits, which tells any two different quotients apart) and then the
  denominator.  A maximum of longs is a hash aggregate.
* ``long_key``: long division in three steps, for wide numbers.
* ``float_key``: the quotient as a double, for exact mode; two candidates that
  differ in the last unit only may tie or swap.

Equal quotients: the larger denominator is the larger one (``tie`` folds) or the
first by position wins (folds without tie).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.compare import int_div
from kinlink.plans.config import LinkageConfig
from kinlink.plans.precision import Precision, ceil_log2

OPS = ("MIN", "MIN_TIE", "MAX", "MAX_TIE")


@dataclass(frozen=True)
class PackedKey:
    """Layout of a quotient in one long: ``whole`` + 2 ``den`` bits of quotient, ``den`` bits."""

    whole: int
    den: int

    @classmethod
    def of(cls, p: Precision, config: LinkageConfig) -> PackedKey | None:
        if p.exact:
            return None
        den = (len(config.fields) * ((1 << p.weight) - 1)).bit_length()
        key = cls(p.dice + 1, den)
        # At least 12 bits stay for a row's place, and shifts stay inside a long.
        return key if key.bits <= 51 and p.dice + 3 * den <= 62 else None

    @property
    def bits(self) -> int:
        return self.whole + 3 * self.den

    def pack(self, num: Column, den: Column) -> Column:
        """0 for denominator 0, which is below everything."""
        q = F.coalesce(int_div(F.shiftleft(num, 2 * self.den), den), F.lit(0).cast("bigint"))
        return F.shiftleft(q, self.den).bitwiseOR(den)

    def den_of(self, key: Column) -> Column:
        return key.bitwiseAND((1 << self.den) - 1)

    def num_of(self, key: Column) -> Column:
        """The numerator, back from the rounded quotient (exact, see the bits)."""
        q, unit = F.shiftright(key, self.den), 1 << 2 * self.den
        return F.shiftright(q * self.den_of(key) + F.lit(unit - 1), 2 * self.den)


def long_key(num: Column, den: Column) -> Column:
    """(whole, 32 bits, 32 bits, den) of num / den; den below 2^31."""
    some = F.nullif(den, F.lit(0))
    r1 = F.shiftleft(num % some, 32)
    r2 = F.shiftleft(r1 % some, 32)
    zero = F.lit(0).cast("bigint")
    return F.struct(F.coalesce(int_div(num, den), F.lit(-1).cast("bigint")).alias("k0"), F.coalesce(int_div(r1, den), zero).alias("k1"),
                    F.coalesce(int_div(r2, den), zero).alias("k2"), den.alias("k3"))


def float_key(num: Column, den: Column) -> Column:
    return F.struct(F.when(den > 0, num / den).otherwise(F.lit(-1.0)).alias("k0"), den.alias("k3"))


def check_long(p: Precision, n_fields: int) -> None:
    if not p.exact and p.weight + ceil_log2(n_fields) > 31:
        raise ValueError("denominators of more than 31 bits have no exact key")


def fold(df: DataFrame, op: str, num: str, den: str, *targets: str, by: list[str] = (), place: str | None = None) -> DataFrame:
    """Per ``by`` the row whose quotient wins: num, den and targets.

    Without _TIE, rows with equal quotients are told apart by ``place`` alone; the
    first place wins all ties that are left.
    """
    if op not in OPS:
        raise ValueError(f"unknown fold {op!r}")
    exact = dict(df.dtypes)[den] == "double"
    n, d = F.col(num), F.col(den)
    key = (float_key if exact else long_key)(n, d)
    parts = [key.getField(k) for k in (("k0",) if exact else ("k0", "k1", "k2"))]
    if op.endswith("_TIE"):
        parts.append(key.getField("k3"))
    order = parts + ([F.col(place) * (1 if op.startswith("MIN") else -1)] if place else [])
    pick = F.min_by if op.startswith("MIN") else F.max_by
    won = pick(F.struct(*[F.col(c) for c in (num, den, *targets)]), F.struct(*order)).alias("__won")
    return (df.groupBy(*by) if by else df).agg(won).select(*by, "__won.*")


def select_quotient(op: str, first: tuple[Column, Column], second: tuple[Column, Column], exact: bool = False) -> Column:
    """Struct (num, den) of the quotient that wins; ``first`` wins what is left equal."""
    if op not in OPS:
        raise ValueError(f"unknown fold {op!r}")
    names = ("k0",) if exact else ("k0", "k1", "k2")
    names += ("k3",) if op.endswith("_TIE") else ()
    a, b = (F.struct(*[(float_key if exact else long_key)(n, d).getField(k) for k in names]) for n, d in (first, second))
    x, y = (F.struct(n.alias("num"), d.alias("den")) for n, d in (first, second))
    return F.when(a > b if op.startswith("MIN") else a < b, y).otherwise(x)


def accumulate(df: DataFrame, value: str, op: str, by: list[str] = ()) -> DataFrame:
    """Sum or maximum of a column of numbers."""
    how = {"sum": F.sum, "max": F.max}[op]
    return (df.groupBy(*by) if by else df).agg(how(value).cast("bigint").alias(value))


def select_target(df: DataFrame, value: str, target: str, by: list[str] = (), place: str | None = None) -> DataFrame:
    """The largest value and the target that comes with it (first place on ties)."""
    order = F.struct(F.col(value), -F.col(place)) if place else F.col(value)
    won = F.max_by(F.struct(value, target), order).alias("__won")
    return (df.groupBy(*by) if by else df).agg(won).select(*by, "__won.*")
