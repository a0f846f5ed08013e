"""Fixed-point model: bits for comparisons and weights, rescaled weights, thresholds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from kinlink.plans.config import LinkageConfig


def ceil_log2(n: int) -> int:
    if n < 1:
        raise ValueError("ceil_log2 needs a positive number")
    return (n - 1).bit_length()


def ceil_log2_min1(n: int) -> int:
    return max(1, ceil_log2(n))


def hw_size(bits: int) -> int:
    """Bits that hold the number of ones of a mask of ``bits`` bits."""
    return ceil_log2_min1(bits + 1)


def half_away(x: float) -> int:
    """Rounded to the nearest integer, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


@dataclass(frozen=True)
class Precision:
    """``bits`` per number: 8, 16, 32, 64, or None for doubles."""

    bits: int | None
    dice: int = 0
    weight: int = 0

    @property
    def exact(self) -> bool:
        return self.bits is None

    @classmethod
    def ideal(cls, bits: int, n_fields: int) -> Precision:
        """Comparison, weight and weight again, and room for sums over all fields."""
        room = bits - ceil_log2(n_fields * n_fields)
        if room < 3:
            raise ValueError(f"{bits} bits are too few for {n_fields} fields")
        third, rest = divmod(room, 3)
        return cls(bits, third + (rest == 1), third + (rest == 2))

    @classmethod
    def of(cls, mode: str, config: LinkageConfig, dice: int | None = None, weight: int | None = None) -> Precision:
        """``mode``: int8, int16, int32, int64 or exact; bits can be given explicitly."""
        if mode == "exact":
            return cls(None)
        if mode not in ("int8", "int16", "int32", "int64"):
            raise ValueError(f"unknown mode {mode!r}")
        bits = int(mode[3:])
        if dice is None and weight is None:
            return cls.ideal(bits, len(config.fields))
        if dice is None or weight is None:
            raise ValueError("give both precisions or none")
        if dice < 1 or weight < 1 or dice + 2 * weight + ceil_log2(len(config.fields) ** 2) > bits:
            raise ValueError(f"precisions {dice} and {weight} don't fit {bits} bits")
        return cls(bits, dice, weight)

    def rescaled(self, weight: float, most: float) -> int:
        return half_away(weight / most * ((1 << self.weight) - 1))

    def pair_weight(self, config: LinkageConfig, left: str, right: str) -> float | int:
        """Weight of comparing two fields: their average, rescaled unless exact."""
        w = config.fields[left].weight
        if left != right:
            w = (w + config.fields[right].weight) / 2
        return w if self.exact else self.rescaled(w, config.max_weight)

    def limit(self, threshold: float) -> float | int:
        return threshold if self.exact else half_away(threshold * (1 << self.dice))
