"""Uniform shuffle into shards of exact sizes by a communication matrix.

1. Rows fall into ``partitions`` logical partitions by a hash of doc_id and text, so
   the outcome depends neither on files nor on the cluster, and rows without or of
   one doc_id spread like others.
2. The driver draws from the partitions' counts how many rows each partition
   sends to each cell: every partition's row of the matrix is a multivariate
   hypergeometric draw from the room that is left.  The matrix has partitions
   times cells numbers, whatever the table holds.
3. Each partition permutes its rows (seeded hash order) and deals them by its
   row of the matrix; rows are exchanged; each cell permutes again.

A shard is ``cells`` cells whose sizes are fixed beforehand, so that a row's slot
is its cell's offset plus its rank there, and no task sorts a whole shard.  Unless
given, partitions and cells grow with the table: about ``TASK_ROWS`` rows each, as
long as the matrix has at most ``MATRIX`` numbers (some 4 billion rows); beyond that
the sorts grow, and spill.

Law: ``rows``.  Shard sizes differ by one row at most.  Equal texts are single
rows and spread like all others: a group of copies may hold a third of all rows,
which no shard of equal rows could take.

Defined results: a null text has size 16 and crc 0; equal rows get slots of their
own; rows with the same doc_id and text share a partition; an empty table gives an empty result; input columns named like
a result column are replaced, all others stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlink.llm.scratch import keeps_names, others, tables

SHARDS = 40
#: Fewest and most partitions, fewest cells of a shard; rows of each that are aimed at;
#: the most numbers of the matrix, which the driver draws.
PARTITIONS, MOST_PARTITIONS, CELLS, TASK_ROWS, MATRIX = 1024, 1 << 14, 8, 2_000_000, 1 << 22
SEED = 20240501
#: numpy draws hypergeometric numbers up to this population.
NUMPY_LIMIT = 10**9 - 1
MADE = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among ``draws`` taken without replacement, for any population.

    Beyond numpy's limit: rejection by ratio of uniforms around the mode.
    """
    if good + bad <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if good + bad else 0
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    log_p = lambda k: _log_choose(good, k) + _log_choose(bad, draws - k)
    top = log_p(mode)
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    # A hat that covers sqrt(p) on both sides of the mode.
    width = 1.8 * spread + 2
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mode + 0.5 + width * (v - 0.5) * 2 / u)
        if low <= k <= high and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int = SEED) -> np.ndarray:
    """Rows: partitions. Columns: cells. Row and column sums are exact."""
    if sum(counts) != sum(sizes):
        raise ValueError("partitions and cells must hold equally many rows")
    rng, room = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        if n and room.sum() <= NUMPY_LIMIT:
            out[p] = rng.multivariate_hypergeometric(room, n, method="marginals")
        elif n:
            left, rest = n, int(room.sum())
            for s, r in enumerate(room.tolist()):
                rest -= r
                out[p, s] = hypergeometric(rng, r, rest, left) if left else 0
                left -= int(out[p, s])
        room -= out[p]
    return out


def layout(rows: int, shards: int) -> tuple[int, int]:
    """Partitions (a power of two), and cells of a shard, for a table of so many rows."""
    cells = max(CELLS, min(-(-rows // (shards * TASK_ROWS)), math.isqrt(MATRIX) // shards))
    partitions = PARTITIONS
    while partitions < MOST_PARTITIONS and partitions * TASK_ROWS < rows and 2 * partitions * cells * shards <= MATRIX:
        partitions *= 2
    return partitions, cells


@keeps_names
def shard(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None, cells: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    draw, fine = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), partitions or MOST_PARTITIONS
    found = {r["p"]: r["n"] for r in docs.groupBy(F.pmod(draw, F.lit(fine)).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = layout(sum(found.values()), shards)
    partitions, cells = partitions or some[0], cells or some[1]
    part, counts = F.pmod(draw, F.lit(partitions)).cast("int"), [0] * partitions
    for p, n in found.items():
        counts[p % partitions] += n
    per_shard = [shard_sizes(n, cells) for n in shard_sizes(sum(counts), shards)]
    flat = [c for row in per_shard for c in row]
    offsets = [sum(row[:i]) for row in per_shard for i in range(cells)]
    bounds = communication_matrix(counts, flat, seed).cumsum(axis=1)
    # partitions x (shards x cells) numbers: bounded by MATRIX, not by rows.
    deal = spark.createDataFrame([(p, bounds[p].tolist(), bounds[p][cells - 1::cells].tolist()) for p in range(partitions)],
                                 "__p int, __bounds array<bigint>, __ends array<bigint>")
    crc = F.coalesce(F.crc32(F.encode(F.col("text"), "UTF-8")), F.lit(0)).cast("bigint")
    rows = docs.select(
        *others(docs, MADE),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), crc.alias("text_crc32"), part.alias("__p"))
    once = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    # First the shard, then the cell in it: two short searches instead of one long one.
    dealt = (rows.withColumn("__rank", F.row_number().over(once)).join(F.broadcast(deal), "__p")
             .withColumn("__shard", F.expr("size(filter(__ends, b -> b < __rank))"))
             .withColumn("__cell", F.expr(f"__shard * {cells} + size(filter(slice(__bounds, __shard * {cells} + 1, {cells}), b -> b < __rank))"))
             .drop("__bounds", "__ends", "__p", "__rank", "__shard"))
    again = Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    offset = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), F.col("__cell") + 1)
    return (dealt.withColumn("__at", F.row_number().over(again))
            .withColumns({"law": F.lit("rows"), "shard": F.expr(f"__cell div {cells}").cast("int"),
                          "slot": (offset + F.col("__at") - 1).cast("bigint"), "grown_shard": F.lit(None).cast("int")})
            .drop("__cell", "__at"))


def op2_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    # The text is dropped before the first exchange: only its digest travels.
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
