"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, langid, mixing, neardup, sharding
from kinlink.llm.scratch import checkpoint_dir, keeps_names, quoted, remove, tables

#: A document goes if no language can be told: no letter, no language that leads an even
#: share by this much, or less of its words known than this in any language. Documents
#: of learned languages have 0.97 and more, Polish or keyboard rows 0.2 and less.
LEAD, KNOWN = 0.01, 0.25


@keeps_names
def _told(docs: DataFrame) -> DataFrame:
    model = langid.fit(docs)
    least = 1 / len(model.langs) + LEAD if len(model.langs) > 1 else 0.0
    told = langid.predict(docs, model, ("__lang", "__score", "__known"))
    good = (F.col("__lang") != "und") & (F.col("__score") > least) & (F.col("__known") >= KNOWN)
    return told.filter(good).drop("__lang", "__score", "__known")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    A null, empty or letterless text goes, as does one in a language that no label names;
    so does every one if no row has a label.
    Repeated rows stay, an empty table gives an empty result, all columns are kept.
    """
    del spark, sf_dir
    return _told(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Texts without words and rows without a doc_id are in no group and stay; of rows
    with one doc_id and text one stays.
    """
    del spark, sf_dir
    return neardup.keep_one(docs).select(*map(quoted, docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as do repeated rows; an empty benchmark
    leaves all.
    """
    return decontaminate.without_leaks(docs, tables(spark, sf_dir, "benchmark"))


@keeps_names
def _repeated(docs: DataFrame) -> DataFrame:
    # The text travels once, in the row; the mix needs its words and key only.
    words, key = mixing.n_words(F.col("text")), mixing.text_key(F.col("text"))
    small = docs.select("doc_id", "source", words.alias("words"), key.alias("key"), F.struct(*map(quoted, docs.columns)).alias("__row"))
    got = mixing.mix(small, size=F.col("words"), key=F.col("key"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return got.select("__row", F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).select("__row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (to the nearest whole number).

    Texts without words go, as the mix takes none; rows without a source are a source
    of their own; columns named like the mix's own keep their values.
    """
    del spark, sf_dir
    return _repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with size, text_crc32, law, shard, slot and grown_shard.

    Columns of these names are replaced; null texts have size 16 and crc 0.
    """
    del spark, sf_dir
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
    ("sharding", shards),
]

#: No stage but mixing can be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; between them tables in the shared folder.

    A stage's table goes once the next one is written; the last is the result's input.
    """
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = tables(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{home}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
