"""Arrays, maps and texts: what records and their decoding are put together from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_vec(*parts: Column) -> Column:
    return F.concat(*parts)


def repeat_vec(values: Column, n: int) -> Column:
    """The whole array ``n`` times over."""
    return F.flatten(F.array_repeat(values, n))


def transform_vec(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(values, f)


def transform_map(entries: Column, f: Callable[[Column], Column]) -> Column:
    """A map with ``f`` of its values."""
    return F.transform_values(entries, lambda _, v: f(v))


def map_keys(entries: Column) -> Column:
    """Keys in ascending order, whatever order the map was built in."""
    return F.array_sort(F.map_keys(entries))


def contains(values: Column, x: Column) -> Column:
    return F.array_contains(values, x)


def split_text(s: Column, sign: str) -> Column:
    """Parts between single signs; a trailing sign starts no further part."""
    parts = F.split(s, re.escape(sign))
    return F.when(F.endswith(s, F.lit(sign)), F.slice(parts, F.lit(1), F.size(parts) - 1)).when(s == "", F.array().cast("array<string>")).otherwise(parts)


def text_lines(s: Column) -> Column:
    """Lines that end in LF, CR LF or CR."""
    return F.split(s, "\r\n|\r|\n")


def left_fold(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(... f(f(first, second), third) ...); null for an empty array."""
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), f))
