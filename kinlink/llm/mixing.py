"""Mixing sources to target weights by Sainte-Lague apportionment.

Only DataFrame functions are used, all inside the JVM.

* Targets: weights are water-filled, so that no source passes ``max_epochs``
  times its own words.  Over sources sorted by cap / weight the capped ones are
  a prefix, so running sums find the level without a loop.
* Quotas: the mix is cut into blocks of ``block`` words, in ``shards`` shards.  Blocks
  go to sources by the highest quotients target / (2 s + 1).  The method is
  house-monotone: shard k gets what the first k shards' blocks add over the first
  k - 1, so quotas per shard are integers and add up.  Only the last block of a
  source that is taken in full may be shorter.
* Blocks: the documents of a source lie on a line in seeded order (md5 of seed,
  doc_id and text).  From a seeded start the shards' quotas follow each other around
  that line, so each shard's quota selects the blocks of its own stretch.  What a
  shard takes of a document is the overlap with its stretch, in closed form;
  ``shard_taken`` has it by shard and ``taken`` is its sum.

Skew: sums on a line are taken in two levels, first per (source, leading hex
digits of the order key), then inside; a source with a third of all rows is
spread over 4096 parts, and so are rows without or of one doc_id.

Defined results: a null text has no words and takes none; sources order by code
point with null last, and null is a source of its own; equal rows are placed one
after the other; an empty table gives an empty result; input columns named like a
result column are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.scratch import cut, keeps_names, others, tables

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
BLOCK = 32
SHARDS = 8
MAX_EPOCHS = 3
SUB_DIGITS = 3
MADE = {"size", "source_size", "target", "taken", "shard_taken"}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_key(text: Column) -> Column:
    """Eight digits of the text's md5, which tell rows of one doc_id apart."""
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8)


def _line(df: DataFrame, seed: str, size: Column, key: Column) -> DataFrame:
    return df.withColumns({
        "__skey": F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n")),
        "__size": size,
        "__okey": F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), key)),
    }).withColumn("__sub", F.substring("__okey", 1, SUB_DIGITS))


def source_targets(parts: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: weight, size, target (water-filled)."""
    by_name = Window.orderBy(F.col("__skey") == "n", "__skey")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    src = (parts.groupBy("__skey").agg(F.sum("__part").alias("source_size"))
           .withColumn("weight", pick.cast("bigint"))
           .withColumn("cap", F.col("source_size") * max_epochs))
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("__skey") == "n", "__skey")
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(Window.partitionBy()) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))).cast("double")
             / F.sum("weight").over(rest))
    src = src.withColumn("level", level).withColumn("free", F.col("cap").cast("double") > F.col("level") * F.col("weight"))
    # The first source that is not capped fixes the level of all that follow it.
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap").cast("double") / F.col("weight"), F.col("__skey") == "n", F.col("__skey"), F.col("level")))).over(Window.partitionBy())
    src = src.withColumn("__first", first)
    return src.select(
        "__skey", "source_size", "weight",
        F.when(F.col("__first").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("__first.level") * F.col("weight"))).alias("target"),
    )


def shard_quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Sainte-Lague: rows (shard, __skey, quota, __words) with integer quotas of blocks,
    and the words that the shards up to this one take of the source.

    Seats below the tail follow from rounding with a common divisor; only the
    quotients of the tail (about three per source and shard) are ranked.
    """
    every = Window.partitionBy()
    t = (targets.withColumn("__t", F.sum("source_size").over(every)).withColumn("__n", F.count(F.lit(1)).over(every))
         .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
         .withColumn("__house", F.floor(F.floor(F.col("__t") / F.lit(block)) * F.col("shard") / F.lit(shards)).cast("bigint"))
         .withColumn("__share", F.when(F.col("__t") > 0, F.col("target") / F.col("__t")).otherwise(F.lit(0.0))))
    base = F.greatest(F.floor(F.col("__share") * (F.col("__house") - F.col("__n")) + F.lit(0.5)), F.lit(0)).cast("bigint")
    t = t.withColumn("__base", base)
    tail = F.col("__house") - F.sum("__base").over(Window.partitionBy("shard"))
    t = t.withColumn("__tail", F.greatest(tail, F.lit(0)).cast("bigint"))
    more = F.ceil(F.col("__share") * F.col("__tail")).cast("bigint") + 2
    seats = (t.filter(F.col("target") > 0)
             .withColumn("__seat", F.explode(F.sequence(F.col("__base"), F.col("__base") + more)))
             .withColumn("__quotient", F.col("target") / (2 * F.col("__seat") + 1)))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("__quotient"), F.col("__skey") == "n", "__skey", "__seat"))
    won = (seats.withColumn("__rank", rank)
           .groupBy("shard", "__skey", "source_size", "__base")
           .agg(F.sum((F.col("__rank") <= F.col("__tail")).cast("bigint")).alias("__won")))
    most = F.col("source_size") * max_epochs
    cum = F.least(F.col("__base") + F.col("__won"), F.call_function("div", most + (block - 1), F.lit(block).cast("bigint")))
    won = won.withColumn("__cum", cum)
    before = F.coalesce(F.lag("__cum").over(Window.partitionBy("__skey").orderBy("shard")), F.lit(0))
    return won.select((F.col("shard") - 1).alias("shard"), "__skey", (F.col("__cum") - before).cast("bigint").alias("quota"), F.least(F.col("__cum") * block, most).alias("__words"))


@keeps_names
def mix(docs: DataFrame, weights=WEIGHTS, seed: str = SEED, block: int = BLOCK, shards: int = SHARDS, max_epochs: int = MAX_EPOCHS,
        size: Column | None = None, key: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words, repeats counted) and
    shard_taken (the same by shard).

    ``size`` and ``key`` stand for ``n_words`` and ``text_key`` of the text where a caller
    has them already.
    """
    keep = others(docs, MADE)
    line = _line(docs, seed, n_words(F.col("text")) if size is None else size, text_key(F.col("text")) if key is None else key)
    parts = line.groupBy("__skey", "__sub").agg(F.sum("__size").alias("__part"))
    targets = source_targets(parts, weights, max_epochs)
    # The words of a source's run at which each shard's stretch ends: as many as shards.
    cuts = (shard_quotas(targets, block, shards, max_epochs).groupBy("__skey")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "__words"))), lambda x: x["__words"]).alias("__cuts")))
    ahead = Window.partitionBy("__skey").orderBy("__sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|start|"), F.col("__skey"))), 1, 8), 16, 10).cast("bigint")
    offsets = (parts.withColumn("__ahead", F.sum("__part").over(ahead) - F.col("__part"))
               .join(targets, "__skey").join(cuts, "__skey", "left")
               .withColumn("__cuts", F.coalesce("__cuts", F.array_repeat(F.lit(0).cast("bigint"), shards)))
               .withColumn("__start", F.when(F.col("source_size") > 0, start % F.col("source_size")).otherwise(F.lit(0)))
               .select("__skey", "__sub", "__ahead", "source_size", "target", "__start", "__cuts"))
    inside = Window.partitionBy("__skey", "__sub").orderBy("__okey", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (line.withColumn("__end", F.sum("__size").over(inside)).drop("source_size", "target")
              .join(offsets, ["__skey", "__sub"])
              .withColumn("__b", F.col("__ahead") + F.col("__end")).withColumn("__a", F.col("__b") - F.col("__size")))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.least(F.col("__b"), hi) - F.greatest(F.col("__a"), lo), F.lit(0))

    def within(x: Column) -> Column:
        """Words of the document in the first x words of its source's run."""
        around = F.greatest(F.col("source_size"), F.lit(1))
        end = F.col("__start") + x % around
        return F.call_function("div", x, around) * F.col("__size") + overlap(F.col("__start"), F.least(end, F.col("source_size"))) + overlap(F.lit(0), end - F.col("source_size"))

    # A generator of one row keeps Spark from working the array out twice.
    by_end = F.explode(F.array(F.transform("__cuts", lambda x: within(x).cast("bigint")))).alias("__by")
    before = lambda x, i: x - F.when(i > 0, F.element_at("__by", i)).otherwise(F.lit(0))
    return placed.select(*keep, F.col("__size").alias("size"), "source_size", "target", by_end).select(
        *keep, "size", "source_size", "target", F.element_at("__by", -1).alias("taken"), F.transform("__by", before).alias("shard_taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: what the mix needs of them is small and cut."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"), text_key(F.col("text")).alias("text_key"))
    got = mix(cut(docs), size=F.col("words"), key=F.col("text_key"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str = "documents", weights=WEIGHTS, seed: str = SEED, block: int = BLOCK, shards: int = SHARDS, max_epochs: int = MAX_EPOCHS, by_shard: bool = False) -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken over ``docs``; with ``by_shard``
    also shard_taken, joined by commas."""
    more = f""", array_to_string(list_transform(range(1, {shards + 1}), lambda i: f[i] - CASE WHEN i > 1 THEN f[i - 1] ELSE 0 END), ',') AS shard_taken""" if by_shard else ""
    w = ", ".join(map(str, weights))
    within = """(x // around) * size
        + greatest(least(b, least(st + x % around, source_size)) - greatest(b - size, st), 0)
        + greatest(least(b, st + x % around - source_size) - greatest(b - size, 0), 0)"""
    return rf"""
    WITH sized AS (
      SELECT doc_id, coalesce('v' || source, 'n') AS skey,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || left(md5(coalesce(text, '')), 8)) AS okey
      FROM {docs}),
    s0 AS (
      SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
    s1 AS (
      SELECT *, CAST([{w}][1 + (row_number() OVER (ORDER BY skey = 'n', skey) - 1) % {len(weights)}] AS BIGINT) AS weight,
             source_size * {max_epochs} AS cap FROM s0),
    s2 AS (
      SELECT *, CAST(cap AS DOUBLE) / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n FROM s1),
    s3 AS (
      SELECT *, CAST(total - (sum(cap) OVER (ORDER BY ratio, skey = 'n', skey ROWS UNBOUNDED PRECEDING) - cap) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY ratio, skey = 'n', skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s2),
    s4 AS (
      SELECT level FROM s3 WHERE CAST(cap AS DOUBLE) > level * weight ORDER BY ratio, skey = 'n', skey LIMIT 1),
    s5 AS (
      SELECT s3.*, CASE WHEN s4.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), s4.level * weight) END AS target
      FROM s3 LEFT JOIN s4 ON true),
    s6 AS (
      SELECT s5.*, k, (total // {block}) * k // {shards} AS house, CASE WHEN total > 0 THEN target / total ELSE 0.0 END AS share FROM s5, range(1, {shards + 1}) t(k)),
    s7 AS (
      SELECT *, CAST(greatest(floor(share * (house - n) + 0.5), 0) AS BIGINT) AS base FROM s6),
    s8 AS (
      SELECT *, CAST(greatest(house - sum(base) OVER (PARTITION BY k), 0) AS BIGINT) AS tail FROM s7),
    seats AS (
      SELECT skey, k, target, tail, unnest(range(base, base + CAST(ceil(share * tail) AS BIGINT) + 3)) AS seat FROM s8 WHERE target > 0),
    ranked AS (
      SELECT skey, k, tail, row_number() OVER (PARTITION BY k ORDER BY target / (2 * seat + 1) DESC, skey = 'n', skey, seat) AS rk FROM seats),
    won AS (
      SELECT skey, k, count(*) FILTER (WHERE rk <= tail) AS won FROM ranked GROUP BY skey, k),
    cuts AS (
      SELECT skey, list(CAST(least(least(base + won, (source_size * {max_epochs} + {block - 1}) // {block}) * {block}, source_size * {max_epochs}) AS BIGINT) ORDER BY k) AS cuts
      FROM s8 JOIN won USING (skey, k) GROUP BY skey),
    s9 AS (
      SELECT s5.skey, source_size, target, greatest(source_size, 1) AS around, coalesce(cuts, list_resize(CAST([] AS BIGINT[]), {shards}, 0)) AS cuts,
             CASE WHEN source_size > 0 THEN CAST('0x' || substr(md5('{seed}|start|' || s5.skey), 1, 8) AS BIGINT) % source_size ELSE 0 END AS st
      FROM s5 LEFT JOIN cuts USING (skey)),
    placed AS (
      SELECT doc_id, size, source_size, target, cuts, st, around,
             CAST(sum(size) OVER (PARTITION BY skey ORDER BY okey, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b
      FROM sized JOIN s9 USING (skey)),
    done AS (
      SELECT doc_id, size, source_size, target, list_transform(cuts, lambda x: CAST({within} AS BIGINT)) AS f FROM placed)
    SELECT doc_id, size, source_size, target, f[{shards}] AS taken{more}
    FROM done"""
