"""Comparisons of encoded fields; a registry maps comparator names to them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.codec import n_words, word_column
from kinlink.plans.config import FieldSpec
from kinlink.plans.precision import Precision


def hamming_weight(words: Column) -> Column:
    """Ones in an array of 64-bit words."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w).cast("bigint"))


def mask_and(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseAND(b))


def dice(both: Column, total: Column, p: Precision) -> Column:
    """From ones in common and ones of both sides: 2 both / total, 0 if there are none."""
    if p.exact:
        return both * 2 / F.greatest(total, F.lit(1).cast("bigint"))
    # Without ones on either side the dividend is 0, so any divisor will do.
    rounded = F.shiftleft(both, p.dice + 1) + F.shiftright(total, 1)
    return F.call_function("div", rounded, F.greatest(total, F.lit(1).cast("bigint")))


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient of longs; null where b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def equal(left: Column, right: Column, p: Precision) -> Column:
    one, none = (F.lit(1.0), F.lit(0.0)) if p.exact else (F.lit(1 << p.dice).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(left == right, one).otherwise(none)


def scale(x: Column, p: Precision) -> Column:
    return x if p.exact else F.shiftleft(x.cast("bigint"), p.dice)


# A comparator has two parts: the columns it needs from one side, made once per
# record before any pairing, and the comparison of such columns of two sides.
Prepare = Callable[[Column, FieldSpec], dict[str, Column]]
Compare = Callable[[Callable[[str], Column], Callable[[str], Column], FieldSpec, Precision], Column]
REGISTRY: dict[str, tuple[Prepare, Compare]] = {}


def register(name: str, prepare: Prepare, compare: Compare) -> None:
    REGISTRY[name] = (prepare, compare)


def _dice_columns(b: Column, spec: FieldSpec) -> dict[str, Column]:
    # Never null (an empty field has no ones, and its term is 0 anyway): the code for
    # pairs needs no branches then.
    zero = F.lit(0).cast("bigint")
    words = {f"w{i}": F.coalesce(word_column(b, i), zero) for i in range(n_words(spec))}
    ones = reduce(lambda a, c: a + c, [F.bit_count(w).cast("bigint") for w in words.values()])
    return {**words, "hw": ones}


def _dice_compare(left, right, spec: FieldSpec, p: Precision) -> Column:
    both = reduce(lambda a, c: a + c, [F.bit_count(left(f"w{i}").bitwiseAND(right(f"w{i}"))).cast("bigint") for i in range(n_words(spec))])
    return dice(both, left("hw") + right("hw"), p)


register("dice", _dice_columns, _dice_compare)
register("binary", lambda b, spec: {"b": F.coalesce(b, F.lit(b""))}, lambda left, right, spec, p: equal(left("b"), right("b"), p))
