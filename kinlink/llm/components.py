"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kinlink.llm.scratch import cut


def _anew(key: Column) -> Column:
    """The same number, which Spark doesn't know to be dealt out already."""
    return key.bitwiseXOR(F.lit(0).cast("bigint"))


def _cut_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges (u, v), cut, with a mark that tells whether they have changed."""
    seen = Observation()
    e = edges.filter("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h"))
    e = cut(e)
    return e, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (u, v); root is the smallest id.

    Large-star moves a node's larger neighbours to its smallest one.  A node with very
    many neighbours is one key there: minima are taken on the map side first, and the
    join back to the edges has a plain exchange on either side (``_anew``), so that
    Spark splits the key's edges over tasks (``merge``: broadcasts of what happens to be
    small only cost the driver memory).  Small-star does the same to the smaller
    neighbours; of these a node has few.  Every round is cut.
    """
    e, seen = _cut_edges(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(_anew(F.col("u")).alias("k"), F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        e, now = _cut_edges(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("z")).select("z.u", "z.v"))
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))\
        .union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
