"""Scores of pairs: field terms, exchange groups, sums, thresholds.

A pair is a row with prepared columns of both sides, named ``l_<field>_<part>`` and
``r_<field>_<part>``.  Every term (left field, right field) is projected once; the
permutations of a group reuse those columns.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.compare import REGISTRY
from kinlink.operators.fold import PackedKey, float_key, long_key
from kinlink.plans.config import LinkageConfig
from kinlink.plans.precision import Precision

#: From this group size on, permutations become an array instead of single columns.
UNROLLED = 4


def prepared(df: DataFrame, config: LinkageConfig, side: str, keep: list[str]) -> DataFrame:
    """The columns that comparisons need, made once per record and before any pairing."""
    out = [F.col(c) for c in keep]
    for name, spec in config.fields.items():
        made = REGISTRY[spec.comparator][0](F.col(f"`{name}`"), spec)
        out += [c.alias(f"{side}_{name}_{part}") for part, c in made.items()]
        out.append(F.col(f"`{name}`").isNotNull().alias(f"{side}_{name}_here"))
    return df.select(*out)


def term_pairs(config: LinkageConfig) -> list[tuple[str, str]]:
    pairs = [(n, n) for n in config.single_fields]
    for g in config.groups:
        pairs += [(a, b) for a in g for b in g]
    return pairs


def field_term(config: LinkageConfig, p: Precision, left: str, right: str) -> tuple[Column, Column]:
    """(comparison times weight, weight), both 0 where a side is empty."""
    spec, weight = config.fields[left], p.pair_weight(config, left, right)
    here = F.col(f"`l_{left}_here`") & F.col(f"`r_{right}_here`")
    same = REGISTRY[spec.comparator][1](lambda part: F.col(f"`l_{left}_{part}`"), lambda part: F.col(f"`r_{right}_{part}`"), spec, p)
    w = F.lit(weight) if p.exact else F.lit(weight).cast("bigint")
    none = F.lit(0.0) if p.exact else F.lit(0).cast("bigint")
    return F.when(here, same * w).otherwise(none), F.when(here, w).otherwise(none)


def field_terms(pairs: DataFrame, config: LinkageConfig, p: Precision, keep: list[str]) -> DataFrame:
    """``keep`` and for each term the columns f_<left>_<right> and w_<left>_<right>."""
    out = [F.col(c) for c in keep]
    for a, b in term_pairs(config):
        f, w = field_term(config, p, a, b)
        out += [f.alias(f"f_{a}_{b}"), w.alias(f"w_{a}_{b}")]
    return pairs.select(*out)


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, c: a + c, columns)


def group_best(config: LinkageConfig, p: Precision, group: tuple[str, ...]) -> Column:
    """Struct (key, f, w) of the group's best permutation, from its term columns."""
    layout = PackedKey.of(p, config)
    options = []
    for perm in permutations(group):
        f = _add([F.col(f"`f_{a}_{b}`") for a, b in zip(group, perm)])
        w = _add([F.col(f"`w_{a}_{b}`") for a, b in zip(group, perm)])
        key = layout.pack(f, w) if layout else (float_key if p.exact else long_key)(f, w)
        options.append(F.struct(key.alias("key"), f.alias("f"), w.alias("w")))
    if len(options) == 1:
        return options[0]
    return F.greatest(*options) if len(group) < UNROLLED else F.array_max(F.array(*options))


def pair_scores(terms: DataFrame, config: LinkageConfig, p: Precision, keep: list[str]) -> DataFrame:
    """``keep``, num and den: sums over single fields and best permutations."""
    layout = PackedKey.of(p, config)
    keep_c = [F.col(c) for c in keep]
    singles = config.single_fields
    f = [F.col(f"`f_{n}_{n}`") for n in singles]
    w = [F.col(f"`w_{n}_{n}`") for n in singles]
    mid = []
    for k, g in enumerate(config.groups):
        if layout and len(g) < UNROLLED:
            # The best key alone tells numerator and denominator: longs, no structs.
            keys = []
            for perm in permutations(g):
                keys.append(layout.pack(_add([F.col(f"`f_{a}_{b}`") for a, b in zip(g, perm)]), _add([F.col(f"`w_{a}_{b}`") for a, b in zip(g, perm)])))
            mid.append((keys[0] if len(keys) == 1 else F.greatest(*keys)).alias(f"g{k}"))
            f.append(layout.num_of(F.col(f"g{k}")))
            w.append(layout.den_of(F.col(f"g{k}")))
        else:
            mid.append(group_best(config, p, g).alias(f"g{k}"))
            f.append(F.col(f"g{k}.f"))
            w.append(F.col(f"g{k}.w"))
    if mid:
        terms = terms.select(*keep_c, *[F.col(f"`{x}_{n}_{n}`") for n in singles for x in "fw"], *mid)
    return terms.select(*keep_c, _add(f).alias("num"), _add(w).alias("den"))


def passes(num: Column, den: Column, p: Precision, threshold: float) -> Column:
    """The strict test threshold * den < num."""
    return F.lit(p.limit(threshold)) * den < num


def score(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def deviation_percent(value: Column, reference: Column) -> Column:
    return F.try_divide(value - reference, reference) * 100
