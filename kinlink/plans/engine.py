"""Linkage and counting as plans over two DataFrames of encoded records.

``client``: record_idx bigint and one binary column per field.
``server``: row_idx bigint, id string and one binary column per field.

All client records meet all server rows; that product is what linkage means here.
The plan keeps it cheap:

* Both sides are prepared (popcounts, words) before they meet, and carry nothing
  else.
* The smaller side is broadcast if its counted rows, times the fixed width of a
  prepared row, are at most ``BROADCAST_BYTES`` (and ``broadcast_rows``); beyond that both sides are dealt to blocks and each pair of
  blocks is one task's join, so no side has to fit anywhere as a whole.
* Where all pairs are the result, they are made in tiles of a few rows by a few records, which take less room on disk.
* Narrow configurations (``kernel="sql"``): rows meet in whole-stage code up to the
  score, which goes into one long: quotient, denominator and place within a run of
  server rows.  The best of a run is a maximum of longs, a hash aggregate that is
  complete on the map side; only records times runs go through the shuffle.  Wide
  and exact modes use structs instead.
* Configurations of a few fields compared by equality alone need no pairs: server rows
  are grouped by which fields they have and by their values in every subset of these,
  each group with its first row, and a record looks up its own subsets.  What is
  looked up scores at most as much as it is worth, and the best row is found with
  all fields that it shares.
* Others without groups first look for a row that equals a record in all its fields,
  which no other row can beat; only records without one meet all rows, by either kernel.
* Wide ones (``kernel="arrow"``), whose code would pass the JVM's limits, those with
  exchange groups and modes without such a long go through vector operations on Arrow batches
  (``operators.kernel``).  Results are equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.codec import n_words
from kinlink.operators.fold import PackedKey, check_long, float_key, fold, long_key
from kinlink.operators.kernel import block_best, local_best, of_mode
from kinlink.operators.score import field_terms, pair_scores, passes, prepared, term_pairs
from kinlink.plans.config import LinkageConfig
from kinlink.plans.precision import Precision

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows of a block where no side may be broadcast.
BLOCK_ROWS = 100_000
#: Rows of either side that meet at a time where all pairs are the result.
TILE_ROWS = 128
#: Fields up to which rows may be looked up by every subset of them.
SUBSET_FIELDS = 6
#: Words that a pair compares, up to which whole-stage code stays small.
SQL_WORDS = 12
MODES = ("int8", "int16", "int32", "int64", "exact")


def check_columns(df: DataFrame, config: LinkageConfig, key: str) -> None:
    missing = [c for c in [key, *config.names] if c not in df.columns]
    if missing:
        raise ValueError(f"records lack the columns {missing}")
    wrong = [c for c, t in df.dtypes if c in config.fields and t != "binary"]
    if wrong:
        raise ValueError(f"fields {wrong} aren't encoded")


@dataclass(frozen=True)
class LinkageEngine:
    """Links client records to server rows under one configuration."""

    config: LinkageConfig
    mode: str = "int32"
    dice_precision: int | None = None
    weight_precision: int | None = None
    broadcast_rows: int = BROADCAST_ROWS
    kernel: str = "auto"

    @property
    def uses_arrow(self) -> bool:
        if self.kernel != "auto":
            return self.kernel == "arrow"
        words = sum(n_words(self.config.fields[a]) for a, _ in term_pairs(self.config))
        return bool(self.config.groups) or words > SQL_WORDS or PackedKey.of(self.precision, self.config) is None

    @property
    def uses_subsets(self) -> bool:
        c = self.config
        return self.kernel == "auto" and not c.groups and len(c.fields) <= SUBSET_FIELDS and all(f.comparator == "binary" for f in c.fields.values())

    @property
    def most_broadcast(self) -> int:
        """Rows that may be broadcast: prepared fields have fixed sizes."""
        width = 16 + sum(8 * n_words(f) + f.nbytes + 24 for f in self.config.fields.values())
        return min(self.broadcast_rows, BROADCAST_BYTES // width)

    @property
    def precision(self) -> Precision:
        p = Precision.of(self.mode, self.config, self.dice_precision, self.weight_precision)
        check_long(p, len(self.config.fields))
        return p

    def pairs(self, client: DataFrame, server: DataFrame, tiled: bool = False) -> DataFrame:
        """Every client record with every server row, as prepared columns."""
        check_columns(client, self.config, "record_idx")
        check_columns(server, self.config, "row_idx")
        left = prepared(client, self.config, "l", ["record_idx"])
        right = prepared(server, self.config, "r", ["row_idx"])
        n, d = client.select("record_idx").count(), server.select("row_idx").count()
        if min(n, d) <= self.most_broadcast:
            small, large = (left, right) if n <= d else (right, left)
            if tiled:
                return self._tiles(small, large, ("record_idx", "row_idx") if n <= d else ("row_idx", "record_idx"), (min(n, d), max(n, d)))
            large = self._spread(large, max(n, d), "row_idx" if n <= d else "record_idx")
            return large.crossJoin(F.broadcast(small))
        lb, rb = -(-n // BLOCK_ROWS), -(-d // BLOCK_ROWS)
        left = left.withColumn("__lb", F.pmod(F.xxhash64("record_idx"), F.lit(lb))).withColumn("__rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rb - 1).cast("bigint"))))
        right = right.withColumn("__rb", F.pmod(F.xxhash64("row_idx"), F.lit(rb))).withColumn("__lb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lb - 1).cast("bigint"))))
        return left.join(right, ["__lb", "__rb"]).drop("__lb", "__rb")

    def scores(self, client: DataFrame, server: DataFrame, tiled: bool = False) -> DataFrame:
        """record_idx, row_idx, num, den for every pair.  ``tiled``: in the order of ``_tiles``, to be written."""
        p, keys = self.precision, ["record_idx", "row_idx"]
        return pair_scores(field_terms(self.pairs(client, server, tiled), self.config, p, keys), self.config, p, keys)

    def link(self, client: DataFrame, server: DataFrame) -> DataFrame:
        """One row per client record: its best row, flags, and the scaled sums.

        record_idx, best_index, best_id, match, tentative_match,
        sum_field_weights, sum_weights.  Over an empty server best_index is null
        and nothing matches.
        """
        p, config = self.precision, self.config
        best = self._best(self._candidates(client, server, p), p)
        ids = server.select(F.col("row_idx").alias("best_index"), (F.col("id") if "id" in server.columns else F.lit(None)).cast("string").alias("best_id"))
        out = client.select("record_idx").join(best, "record_idx", "left").join(ids, "best_index", "left")
        zero = F.lit(0.0) if p.exact else F.lit(0).cast("bigint")
        num, den = F.coalesce("num", zero), F.coalesce("den", zero)
        return out.select(
            "record_idx", "best_index", "best_id",
            passes(num, den, p, config.threshold).alias("match"), passes(num, den, p, config.tentative_threshold).alias("tentative_match"),
            num.alias("sum_field_weights"), (den if p.exact else F.shiftleft(den, p.dice)).alias("sum_weights"))

    def _candidates(self, client: DataFrame, server: DataFrame, p: Precision) -> DataFrame:
        """Scores of all pairs, or of those that may still be best."""
        if self.uses_subsets:
            return self._by_subsets(client, server, p)
        if self._equal_wins(p):
            return self._equal_first(client, server, p)
        return self._all_pairs(client, server, p)

    def _all_pairs(self, client: DataFrame, server: DataFrame, p: Precision) -> DataFrame:
        return of_mode(self._found(client, server, [p]), p) if self.uses_arrow else self.scores(client, server)

    def _by_subsets(self, client: DataFrame, server: DataFrame, p: Precision) -> DataFrame:
        """record_idx, row_idx, num, den: per record, kind of row (the fields it has) and
        subset of fields, the first row of that kind that agrees on the subset."""
        check_columns(client, self.config, "record_idx")
        check_columns(server, self.config, "row_idx")
        keys = ["subset", *[f"v{k}" for k in range(len(self.config.names))]]
        first = self._subsets(server, "row_idx", "kind").groupBy("kind", *keys).agg(F.min("row_idx").alias("row_idx"))
        met = self._subsets(client, "record_idx", "own").join(first, keys)
        return self._worth(met, F.col("subset"), F.col("own").bitwiseAND(F.col("kind")), p)

    def _subsets(self, df: DataFrame, key: str, code: str, whole: bool = False) -> DataFrame:
        """A row for each subset of the fields that are there (``whole``: of all of them only), with their values."""
        names, values = self.config.names, [f"v{k}" for k in range(len(self.config.names))]
        here = reduce(lambda a, c: a + c, [F.when(F.col(f"`{n}`").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names)])
        own = df.select(key, here.alias(code), *[F.col(f"`{n}`").alias(v) for n, v in zip(names, values)])
        if whole:
            own = own.withColumn("subset", F.col(code))
        else:
            own = own.groupBy(code, *values).agg(F.min(key).alias(key)) if code == "kind" else own
            own = own.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)))).filter(F.col("subset").bitwiseAND(F.col(code)) == F.col("subset"))
        return own.withColumns({v: F.when(F.col("subset").bitwiseAND(1 << k) != 0, F.col(v)).otherwise(F.lit(b"")) for k, v in enumerate(values)})

    def _worth(self, met: DataFrame, equal: Column, both: Column, p: Precision) -> DataFrame:
        """Scores of rows that agree on the fields ``equal``, of those that both sides have."""
        zero = F.lit(0.0) if p.exact else F.lit(0).cast("bigint")
        num, den = [], []
        for k, n in enumerate(self.config.names):
            w = p.pair_weight(self.config, n, n)
            num.append(F.when(equal.bitwiseAND(1 << k) != 0, F.lit(w) if p.exact else F.lit(w << p.dice).cast("bigint")).otherwise(zero))
            den.append(F.when(both.bitwiseAND(1 << k) != 0, F.lit(w) if p.exact else F.lit(w).cast("bigint")).otherwise(zero))
        return met.select("record_idx", "row_idx", reduce(lambda a, c: a + c, num).alias("num"), reduce(lambda a, c: a + c, den).alias("den"))

    def _equal_wins(self, p: Precision) -> bool:
        """Whether only a row that equals all of a record's fields has the greatest quotient and denominator:
        no weight is lost, and no comparison of different masks is rounded up to 1."""
        fields = self.config.fields
        weights = [p.pair_weight(self.config, n, n) for n in fields]
        return (self.kernel == "auto" and not self.config.groups and len(fields) <= SUBSET_FIELDS and min(weights) > 1e-6 * max(weights)
                and all(f.comparator == "binary" or p.exact or f.bitsize < 1 << p.dice for f in fields.values()))

    def _equal_first(self, client: DataFrame, server: DataFrame, p: Precision) -> DataFrame:
        """Records that some row equals have the first such row; the others meet all rows."""
        check_columns(client, self.config, "record_idx")
        check_columns(server, self.config, "row_idx")
        keys = ["subset", *[f"v{k}" for k in range(len(self.config.names))]]
        first = self._subsets(server, "row_idx", "kind").groupBy(*keys).agg(F.min("row_idx").alias("row_idx"))
        # Two masks without ones compare as 0.
        blank = reduce(lambda a, c: a | c, [F.coalesce(F.ltrim(F.hex(f"v{k}"), F.lit("0")) == "", F.lit(False)) & (F.col("own").bitwiseAND(1 << k) != 0)
                                            for k, f in enumerate(self.config.fields.values()) if f.comparator == "dice"], F.lit(False))
        met = self._subsets(client, "record_idx", "own", whole=True).join(first, keys, "left")
        met = met.select("record_idx", "own", F.when(~blank, F.col("row_idx")).alias("row_idx")).persist()
        won = self._worth(met.filter(F.col("row_idx").isNotNull()), F.col("own"), F.col("own"), p)
        rest = met.filter(F.col("row_idx").isNull()).select("record_idx")
        if not rest.count():
            return won
        return won.unionByName(self._all_pairs(client.join(rest, "record_idx", "left_semi"), server, p))

    def _found(self, client: DataFrame, server: DataFrame, ps: list[Precision], op: str = "MAX_TIE") -> DataFrame:
        """What the arrow kernel leaves of all pairs under some precisions."""
        check_columns(client, self.config, "record_idx")
        check_columns(server, self.config, "row_idx")
        n, d = client.select("record_idx").count(), server.select("row_idx").count()
        if min(n, d) <= self.most_broadcast:
            return local_best(self._spread(client, n, "record_idx"), self._spread(server, d, "row_idx"), self.config, ps, n <= d, op)
        return block_best(client, server, self.config, ps, (-(-n // BLOCK_ROWS), -(-d // BLOCK_ROWS)), op)

    def fold(self, client: DataFrame, server: DataFrame, op: str) -> DataFrame:
        """record_idx, num, den, row_idx: per record the row that a fold over its scores takes."""
        p = self.precision
        return fold(of_mode(self._found(client, server, [p], op), p), op, "num", "den", "row_idx", by=["record_idx"], place="row_idx")

    def _tiles(self, small: DataFrame, large: DataFrame, keys: tuple[str, str], rows: tuple[int, int]) -> DataFrame:
        """All pairs, about ``TILE_ROWS`` by as many at a time: numbers that come again soon take little room where all pairs are written."""
        blocks, chunks = (max(1, -(-n // TILE_ROWS)) for n in rows)
        dealt = lambda key, n: F.coalesce(F.pmod(F.col(key), F.lit(n).cast("bigint")), F.lit(0).cast("bigint"))
        parts = max(2 * large.sparkSession.sparkContext.defaultParallelism, -(-rows[1] // BLOCK_ROWS))
        chunk = large.withColumn("__chunk", dealt(keys[1], chunks)).repartition(min(parts, chunks), "__chunk").groupBy("__chunk").agg(F.collect_list(F.struct(*large.columns)).alias("__rows"))
        met = chunk.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("__block"), "__rows").select("__block", F.inline("__rows"))
        return met.join(F.broadcast(small.withColumn("__block", dealt(keys[0], blocks))), "__block").drop("__block")

    def _spread(self, df: DataFrame, rows: int, key: str) -> DataFrame:
        """Few rows in one file would otherwise be one task."""
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(2 * cores, key) if rows <= cores * BLOCK_ROWS else df

    def _best(self, scores: DataFrame, p: Precision) -> DataFrame:
        layout = PackedKey.of(p, self.config)
        if layout is None:
            key = (float_key if p.exact else long_key)(F.col("num"), F.col("den"))
            top = F.max(F.struct(key.alias("k"), (-F.col("row_idx")).alias("i"), F.col("num"), F.col("den"))).alias("t")
            return scores.groupBy("record_idx").agg(top).select("record_idx", (-F.col("t.i")).alias("best_index"), "t.num", "t.den")
        low = min(63 - layout.bits, 24)
        mask = (1 << low) - 1
        run = F.shiftright("row_idx", low)
        packed = F.shiftleft(layout.pack(F.col("num"), F.col("den")), low).bitwiseOR(F.lit(mask).cast("bigint") - F.col("row_idx").bitwiseAND(mask))
        runs = scores.groupBy("record_idx", run.alias("run")).agg(F.max(packed).alias("m"))
        top = F.max(F.struct(F.shiftright("m", low).alias("k"), (-(F.shiftleft("run", low) + mask - F.col("m").bitwiseAND(mask))).alias("i"))).alias("t")
        return (runs.groupBy("record_idx").agg(top)
                .select("record_idx", (-F.col("t.i")).alias("best_index"), layout.num_of(F.col("t.k")).alias("num"), layout.den_of(F.col("t.k")).alias("den")))

    def count(self, client: DataFrame, server: DataFrame) -> DataFrame:
        """One row: how many client records match, and tentatively match.

        The test is monotone in the quotient, so the best row passes if any does:
        no argmax, two booleans per record (the arrow kernel has the best rows anyway).
        """
        p = self.precision
        if self.uses_arrow or self.uses_subsets:
            best = self._best(self._candidates(client, server, p), p)
            test = lambda t: F.coalesce(F.sum(passes(F.col("num"), F.col("den"), p, t).cast("bigint")), F.lit(0)).cast("bigint")
            return best.agg(test(self.config.threshold).alias("matches"), test(self.config.tentative_threshold).alias("tentative_matches"))

        def any_passes(threshold: float) -> Column:
            return F.max(passes(F.col("num"), F.col("den"), p, threshold).cast("int"))

        per = self.scores(client, server).groupBy("record_idx").agg(any_passes(self.config.threshold).alias("m"), any_passes(self.config.tentative_threshold).alias("t"))
        return per.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("matches"), F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("tentative_matches"))


def score_table(config: LinkageConfig, client: DataFrame, server: DataFrame, modes=("int16", "int32", "int64", "exact")) -> DataFrame:
    """Best sums per record and mode, side by side: num_<mode>, den_<mode>.

    All modes share one pass over the pairs and their comparisons.
    """
    engines = [LinkageEngine(config, m) for m in modes]
    ps = [e.precision for e in engines]
    found = engines[0]._found(client, server, ps)
    best = []
    for i, (m, p) in enumerate(zip(modes, ps)):
        num, den = (F.col("num_exact"), F.col("den_exact")) if p.exact else (F.col("num"), F.col("den"))
        order = F.struct((float_key if p.exact else long_key)(num, den).alias("k"), (-F.col("row_idx")).alias("i"), num.alias("num"), den.alias("den"))
        best.append(F.max(F.when(F.col("mode") == i, order)).alias(m))
    out = client.select("record_idx").join(found.groupBy("record_idx").agg(*best), "record_idx", "left")
    columns = []
    for m, p in zip(modes, ps):
        zero = F.lit(0.0) if p.exact else F.lit(0).cast("bigint")
        den = F.coalesce(F.col(f"{m}.den"), zero)
        columns += [F.coalesce(F.col(f"{m}.num"), zero).alias(f"num_{m}"), (den if p.exact else F.shiftleft(den, p.dice)).alias(f"den_{m}")]
    return out.select("record_idx", *columns)
