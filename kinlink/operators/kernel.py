"""Best rows for wide configurations, vectorised over Arrow batches.

One whole-stage method for a pair of, say, eight fields with 500-bit masks and a
group of three passes the JVM's limits for compiled code and then runs
interpreted.  Here a few records of one side meet a batch of the other at a time: each
step is one vector operation, pairs never become rows, and only the best per record
leaves a partition.  All pairs get a bound of their quotient in single precision, on
short numbers; only those that may still be taken are scored, with whole numbers or
doubles.  Several precisions share the comparisons of a pair.  Numbers are the same as in
``operators.score``, and so are the orders of quotients.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions.codec import n_words, word_column
from kinlink.operators.fold import PackedKey
from kinlink.plans.config import LinkageConfig
from kinlink.plans.precision import Precision

#: Pairs that are scored at once, and whose bounds are made at once, of so many rows at most.
PAIRS, BOUNDED, WIDE = 1 << 17, 1 << 18, 1 << 12
EDGES, HEAP = 16, 24 << 20


def narrow(df: DataFrame, config: LinkageConfig, key: str) -> DataFrame:
    """key and, per field, whether it is there, its words, and ones or length."""
    zero, out = F.lit(0).cast("bigint"), [F.col(key).alias("key")]
    for name, spec in config.fields.items():
        b = F.col(f"`{name}`")
        words = [F.coalesce(word_column(b, i), zero) for i in range(n_words(spec))]
        extra = F.coalesce(F.length(b).cast("bigint"), zero)
        if spec.comparator == "dice":
            extra = sum((F.bit_count(w).cast("bigint") for w in words[1:]), F.bit_count(words[0]).cast("bigint"))
        out += [b.isNotNull().alias(f"{name}_here"), extra.alias(f"{name}_extra"), *[w.alias(f"{name}_w{i}") for i, w in enumerate(words)]]
    return df.select(*out)


class Side:
    """Columns of one side as arrays; records that have the same fields stand together."""

    def __init__(self, data: pa.RecordBatch | pa.Table, config: LinkageConfig):
        col = lambda c: data.column(c).to_numpy() if isinstance(data, pa.Table) else data.column(data.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        here = {n: col(f"{n}_here").astype(bool) for n in config.names}
        order = np.lexsort([here[n] for n in config.names])
        self.key = col("key")[order]
        self.here = {n: h[order] for n, h in here.items()}
        edges = [np.diff(h.view(np.int8)) != 0 for h in self.here.values()]
        self.edges = (np.flatnonzero(reduce(np.logical_or, edges)) + 1).tolist() if len(order) > 1 else []
        self.extra = {n: col(f"{n}_extra")[order] for n in config.names}
        # Unsigned: numpy counts the ones of a signed number's magnitude.
        self.words = {n: [col(f"{n}_w{i}")[order].view(np.uint64) for i in range(n_words(s))] for n, s in config.fields.items()}
        # For bounds: the bytes of a short field as a short number, counts as floats.
        self.short, self.count = {}, {n: x.astype(np.float32) for n, x in self.extra.items()}
        for n, s in config.fields.items():
            bits = next((k for k in (8, 16, 32) if 8 * s.nbytes <= k), 64)
            self.short[n] = [(w >> np.uint64(64 - bits)).astype(f"u{bits // 8}") for w in self.words[n]]

    def slices(self, most: int) -> list[slice]:
        """The records in runs, of the same fields each where that makes few runs more."""
        n = len(self.key)
        ends = [0, *(self.edges if len(self.edges) < EDGES else []), n]
        return [slice(lo, min(lo + most, hi)) for a, hi in zip(ends, ends[1:]) for lo in range(a, hi, most)]


class Kernel:
    """Scores of pairs under one precision, their order for one fold, and quick bounds of them."""

    def __init__(self, config: LinkageConfig, p: Precision, op: str = "MAX_TIE"):
        self.config, self.p, self.op, self.layout = config, p, op, PackedKey.of(p, config)
        self.kind = np.float64 if p.exact else np.int64
        #: Few bits: bounds round comparisons as scores do; else that rounding is part of the slack.
        self.coarse = not p.exact and p.dice < 8
        self.near = 2e-6 + (0.0 if p.exact or self.coarse else 2.0 ** -p.dice)
        #: Permutations whose denominators differ by rounding alone count as one.
        self.alike = 1e-5 if p.exact else 2.0 ** (1 - p.weight) if p.weight > 4 else 0.0
        self.slack = np.float32(1e-5 + 2 * self.near + 2 * self.alike)

    def _compare(self, raw: tuple[np.ndarray, ...] | np.ndarray) -> np.ndarray:
        """From what two fields have in common, see ``Pairs``."""
        p = self.p
        if isinstance(raw, tuple):
            both, total = raw
            # Quotients of numbers this small are exact to the unit as doubles.
            return 2 * both / total if p.exact else (((both << p.dice + 1) + (total >> 1)) / total).astype(np.int64) if p.dice <= 24 else ((both << p.dice + 1) + (total >> 1)) // total
        return raw.astype(self.kind) if p.exact else raw.astype(np.int64) << p.dice

    def keys(self, num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arrays that order quotients when compared one after the other."""
        some = np.maximum(den, 1) if not self.p.exact else np.where(den > 0, den, 1.0)
        if self.p.exact:
            return np.where(den > 0, num / some, -1.0), den
        if self.layout:
            d = self.layout.den
            return (((num << 2 * d) / some).astype(np.int64) << d | den,)
        q, r = np.divmod(num, some)
        q1, r = np.divmod(r << 32, some)
        return np.where(den > 0, q, -1), np.where(den > 0, q1, 0), np.where(den > 0, (r << 32) // some, 0), den

    def order(self, num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arrays that are largest for the pair that the fold takes."""
        keys = self.keys(num, den)
        if self.op == "MAX_TIE":
            return keys
        parts = (np.where(den > 0, keys[0] >> self.layout.den, -1),) if self.layout else keys[:-1]
        parts = (*parts, den) if self.op.endswith("_TIE") else parts
        return tuple(-k for k in parts) if self.op.startswith("MIN") else parts

    def value(self, num: np.ndarray, den: np.ndarray) -> np.ndarray:
        """Quotients as ``bound`` bounds them: -1 without a denominator, negative for minima."""
        v = np.where(den > 0, num / np.maximum(den, 1e-300) / (1 if self.p.exact else 1 << self.p.dice), -1.0).astype(np.float32)
        return -v if self.op.startswith("MIN") else v

    @staticmethod
    def above(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
        out = a[-1] > b[-1]
        for x, y in zip(a[-2::-1], b[-2::-1]):
            out = (x > y) | (x == y) & out
        return out

    def scores(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """Numerators and denominators of all pairs."""
        terms = {}

        def term(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
            if (a, b) not in terms:
                weight = pairs.here(a, b) * self.kind(self.p.pair_weight(self.config, a, b))
                terms[a, b] = self._compare(pairs.common(a, b)) * weight, weight
            return terms[a, b]

        num = den = np.zeros(pairs.shape, dtype=self.kind)
        for n in self.config.single_fields:
            f, w = term(n, n)
            num, den = num + f, den + w
        for g in self.config.groups:
            best = None
            for perm in permutations(g):
                f, w = (sum(term(*x)[k] for x in zip(g, perm)) for k in (0, 1))
                k = self.keys(f, w)
                if best is None:
                    best = f, w, k
                    continue
                up = self.above(k, best[2])
                best = np.where(up, f, best[0]), np.where(up, w, best[1]), tuple(np.where(up, x, y) for x, y in zip(k, best[2]))
            num, den = num + best[0], den + best[1]
        return num, den

    def bound(self, pairs: Pairs) -> np.ndarray:
        """``value`` of each pair in single precision, at most ``slack`` too small.

        Weights are plain numbers where all records of a block have a field.  A group's
        permutation is not known where several are about as good: the quotient of the sums is
        then between those with the least and the greatest of their denominators.
        """
        terms = {}

        def term(a: str, b: str) -> tuple:
            if (a, b) not in terms:
                weight = float(self.p.pair_weight(self.config, a, b)) * pairs.all_here(a, b)
                unit = 2.0 if self.config.fields[a].comparator == "dice" else 1.0
                terms[a, b] = (pairs.share(a, b, self.p.dice if self.coarse else None) * (unit * weight) if np.ndim(weight) or weight else 0.0), weight
            return terms[a, b]

        def ratio(f, w):
            if np.ndim(w):
                return np.where(w > 0, f / np.maximum(w, np.float32(1e-30)), np.float32(-1))
            return f * (1.0 / w) if w else -1.0

        num = den = 0.0
        for n in self.config.single_fields:
            f, w = term(n, n)
            num, den = num + f, den + w
        ends = [(num, den)]
        for g in self.config.groups:
            options: list[tuple] = []
            for perm in permutations(g):
                f, w = (reduce(add, [term(*x)[k] for x in zip(g, perm)]) for k in (0, 1))
                same = next((k for k, o in enumerate(options) if not np.ndim(w) and not np.ndim(o[1]) and abs(o[1] - w) <= self.alike * w), None)
                if same is None:
                    options.append((f, w))
                else:
                    options[same] = np.maximum(options[same][0], f), options[same][1]
            if len(options) == 1:
                ends = [(n + options[0][0], d + options[0][1]) for n, d in ends]
                continue
            ratios = [ratio(*o) for o in options]
            top = reduce(np.maximum, ratios)
            near = [r >= top - np.float32(self.near) for r in ratios]
            least = reduce(np.minimum, [np.where(x, np.float32(1) * w, np.float32(np.inf)) for x, (_, w) in zip(near, options)])
            most = reduce(np.maximum, [np.where(x, np.float32(1) * w, np.float32(0)) for x, (_, w) in zip(near, options)])
            top = np.maximum(top, np.float32(0))
            ends = [(n + top * w, d + w) for n, d in ends for w in (least, most)]
        low = self.op.startswith("MIN")
        v = reduce(np.minimum if low else np.maximum, [ratio(*e) for e in ends])
        return np.broadcast_to(np.float32(-1) * v if low else np.float32(1) * v, pairs.shape)


class Pairs:
    """Some records of the left side with some of the right: what their fields have in common.

    ``i`` and ``j`` are slices, each record of which meets each, or lists of the same length.
    """

    def __init__(self, config: LinkageConfig, left: Side, i: slice | np.ndarray, right: Side, j: slice | np.ndarray):
        self.config, self.left, self.i, self.right, self.j = config, left, i, right, j
        self.listed = not isinstance(i, slice)
        self.shape = (len(i),) if self.listed else (len(left.key[i]), len(right.key[j]))
        self._common: dict[tuple[str, str], tuple | np.ndarray] = {}
        self._share: dict[tuple[str, str, int | None], np.ndarray] = {}

    def some(self, x: np.ndarray, y: np.ndarray) -> Pairs:
        return Pairs(self.config, self.left, self.i.start + x, self.right, self.j.start + y)

    def _l(self, values: np.ndarray) -> np.ndarray:
        return values[self.i] if self.listed else values[self.i, None]

    def _r(self, values: np.ndarray) -> np.ndarray:
        return values[self.j] if self.listed else values[None, self.j]

    def here(self, a: str, b: str) -> np.ndarray:
        return self._l(self.left.here[a]) & self._r(self.right.here[b])

    def all_here(self, a: str, b: str) -> float | np.ndarray:
        """1 or 0 where it holds for all pairs, else an array."""
        x, y = self.left.here[a][self.i], self.right.here[b][self.j]
        return 1.0 if x.all() and y.all() else 0.0 if not (x.any() and y.any()) else self.here(a, b).astype(np.float32)

    def share(self, a: str, b: str, rounded: int | None) -> np.ndarray:
        """Comparisons (half of a Dice's) in single precision, as they are or rounded to so many bits."""
        if (a, b, rounded) not in self._share:
            x, y = self._l(self.left.count[a]), self._r(self.right.count[b])
            words = [(self._l(u), self._r(v)) for u, v in zip(self.left.short[a], self.right.short[b])]
            if self.config.fields[a].comparator == "dice":
                both, total = np.bitwise_count(words[0][0] & words[0][1]).astype(np.float32), x + y
                for u, v in words[1:]:
                    both += np.bitwise_count(u & v)
                if x.min() + y.min() < 1:
                    np.maximum(total, np.float32(1), out=total)
                if rounded is None:
                    both /= total
                else:
                    both *= np.float32(2 << rounded)
                    both += np.floor(total * np.float32(0.5))
                    both = np.floor(both / total) * np.float32(0.5 ** (rounded + 1))
            else:
                both = x == y
                for u, v in words:
                    both = both & (u == v)
                both = both.astype(np.float32)
            self._share[a, b, rounded] = both
        return self._share[a, b, rounded]

    def common(self, a: str, b: str) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """Ones in common and ones of both sides, or whether the bytes are equal."""
        if (a, b) not in self._common:
            words = [(self._l(x), self._r(y)) for x, y in zip(self.left.words[a], self.right.words[b])]
            x, y = self._l(self.left.extra[a]), self._r(self.right.extra[b])
            if self.config.fields[a].comparator == "dice":
                both = np.zeros(self.shape, dtype=np.int64)
                for u, v in words:
                    both += np.bitwise_count(u & v)
                self._common[a, b] = both, np.maximum(x + y, 1)
            else:
                same = x == y
                for u, v in words:
                    same &= u == v
                self._common[a, b] = same
        return self._common[a, b]


class Best:
    """The row of each client record that the fold takes so far, under one precision."""

    def __init__(self, kernel: Kernel, records: np.ndarray):
        self.kernel, self.records = kernel, records
        self.found: tuple[np.ndarray, ...] | None = None
        self.seen = np.zeros(len(records), dtype=bool)
        self.top = np.full(len(records), -np.inf, dtype=np.float32)

    def add(self, pairs: Pairs) -> None:
        """Scores those pairs that can still be taken by their bounds."""
        bound, top = self.kernel.bound(pairs), self.top[pairs.i]
        most = bound.max(axis=1)
        up = np.flatnonzero(most > top)
        if len(up):
            self._take(pairs, up, bound[up].argmax(axis=1))
        least = self.top[pairs.i] - self.kernel.slack
        live = np.flatnonzero(most >= least)
        if len(live):
            x, y = np.nonzero(bound[live] >= least[live, None])
            for lo in range(0, len(x), PAIRS):
                self._take(pairs, live[x[lo:lo + PAIRS]], y[lo:lo + PAIRS])

    def _take(self, pairs: Pairs, x: np.ndarray, y: np.ndarray) -> None:
        some = pairs.some(x, y)
        num, den = self.kernel.scores(some)
        keys = (*self.kernel.order(num, den), -some.right.key[some.j])
        by = np.lexsort((*keys[::-1], some.i))
        by = by[np.flatnonzero(np.diff(some.i[by], append=-1))]
        i, new = some.i[by], tuple(k[by] for k in (*keys, num, den))
        if self.found is None:
            self.found = tuple(np.zeros(len(self.records), dtype=k.dtype) for k in new)
        old = tuple(k[i] for k in self.found)
        up = ~self.seen[i] | self.kernel.above(new[:-2], old[:-2])
        for k, v in zip(self.found, new):
            k[i[up]] = v[up]
        self.seen[i] = True
        self.top[i[up]] = self.kernel.value(num[by], den[by])[up]

    def rows(self) -> tuple[np.ndarray, ...]:
        """record_idx, row_idx, num, den of the records that met a row."""
        if self.found is None:
            return (self.records[:0],) * 4
        s = self.seen
        return self.records[s], -self.found[-3][s], self.found[-2][s], self.found[-1][s]


def meet(kernels: list[Kernel], client: Side, batches: Iterator[Side]) -> list[Best]:
    """Client records against a stream of server rows."""
    out = [Best(k, client.key) for k in kernels]
    np.empty(HEAP, dtype=np.uint8)  # once freed, the allocator keeps blocks of that size for the next ones
    for rows in batches:
        for j in rows.slices(WIDE):
            for i in client.slices(max(1, BOUNDED // (j.stop - j.start))):
                pairs = Pairs(kernels[0].config, client, i, rows, j)
                for b in out:
                    b.add(pairs)
    return out


def _batches(best: list[Best]) -> Iterator[pa.RecordBatch]:
    """Rows (mode, record_idx, row_idx, and num and den as longs or doubles)."""
    for mode, b in enumerate(best):
        record, row, num, den = b.rows()
        n = len(record)
        if not n:
            continue
        gone = pa.nulls(n, pa.int64() if b.kernel.p.exact else pa.float64())
        values = [pa.array(num), pa.array(den)]
        longs, doubles = ([gone, gone], values) if b.kernel.p.exact else (values, [gone, gone])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, mode, dtype=np.int32)), pa.array(record), pa.array(row), *longs, *doubles], COLUMNS)


COLUMNS = ["mode", "record_idx", "row_idx", "num", "den", "num_exact", "den_exact"]
SCHEMA = "mode int, record_idx bigint, row_idx bigint, num bigint, den bigint, num_exact double, den_exact double"


def of_mode(found: DataFrame, p: Precision, mode: int = 0) -> DataFrame:
    """record_idx, row_idx, num, den of one precision."""
    num, den = ("num_exact", "den_exact") if p.exact else ("num", "den")
    return found.filter(F.col("mode") == mode).select("record_idx", "row_idx", F.col(num).alias("num"), F.col(den).alias("den"))


def local_best(client: DataFrame, server: DataFrame, config: LinkageConfig, ps: list[Precision], client_is_small: bool, op: str = "MAX_TIE") -> DataFrame:
    """The small side (of checked size) goes to all tasks; candidates per record and partition."""
    kernels = [Kernel(config, p, op) for p in ps]
    small = narrow(client if client_is_small else server, config, "record_idx" if client_is_small else "row_idx").toArrow()
    large = narrow(server if client_is_small else client, config, "row_idx" if client_is_small else "record_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = Side(small, config)
        if client_is_small:
            yield from _batches(meet(kernels, few, (Side(b, config) for b in batches)))
            return
        for b in batches:
            if b.num_rows:
                yield from _batches(meet(kernels, Side(b, config), iter([few])))

    return large.mapInArrow(run, SCHEMA)


def block_best(client: DataFrame, server: DataFrame, config: LinkageConfig, ps: list[Precision], blocks: tuple[int, int], op: str = "MAX_TIE") -> DataFrame:
    """Both sides large: each pair of blocks is one task."""
    kernels, (lb, rb) = [Kernel(config, p, op) for p in ps], blocks
    zero = F.lit(0).cast("bigint")
    left = narrow(client, config, "record_idx").withColumn("lb", F.pmod(F.xxhash64("key"), F.lit(lb))).withColumn("rb", F.explode(F.sequence(zero, F.lit(rb - 1).cast("bigint"))))
    right = narrow(server, config, "row_idx").withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(rb))).withColumn("lb", F.explode(F.sequence(zero, F.lit(lb - 1).cast("bigint"))))

    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        found = []
        if few.num_rows and many.num_rows:
            found = list(_batches(meet(kernels, Side(few, config), (Side(pa.Table.from_batches([b]), config) for b in many.to_batches(max_chunksize=10_000)))))
        return pa.Table.from_batches(found, KINDS)

    return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(run, SCHEMA)


KINDS = pa.schema([(c, pa.int32() if c == "mode" else pa.float64() if c.endswith("_exact") else pa.int64()) for c in COLUMNS])
