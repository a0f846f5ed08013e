"""Linkage inputs derived from whole tables, and the same inputs as DuckDB SQL.

A view has a configuration, two DataFrames of encoded fields, and two SQL CTE
bodies with raw values: integers and strings as such, masks as BIT strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from kinlink.functions.codec import bits_to_mask, encode
from kinlink.plans.config import FieldSpec, LinkageConfig

Load = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class View:
    config: LinkageConfig
    client: Load
    server: Load
    client_sql: str
    server_sql: str


def _number(df: DataFrame, key: str, idx: str) -> DataFrame:
    """Rows numbered from 0 in order of ``key``, which is a whole number.

    Numbers are ranks inside buckets of the key plus the buckets' offsets, so that
    no task sorts the whole table.
    """
    bucket = F.shiftright(F.col(key).cast("bigint"), 16)
    sizes = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return df.withColumn("__b", bucket).join(offsets, "__b").withColumn(idx, (inside + F.col("__o")).cast("bigint")).drop("__b", "__o")


def _encoded(df: DataFrame, config: LinkageConfig, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return df.select(*keys, *[encode(v, config.fields[n]).alias(n) for n, v in values.items()])


# --- person: suppliers against customers ---------------------------------------------------

PERSON = LinkageConfig.of([
    FieldSpec("nation", 0.04, 0.01, "binary", "integer", 5), FieldSpec("number", 0.001, 0.02, "binary", "string", 80),
    FieldSpec("balance", 0.09, 0.05, "binary", "integer", 12), FieldSpec("group", 0.2, 0.01, "binary", "integer", 3),
], 0.8, 0.5)


def _person(key: str, name: str, nation: str, balance: str, null_every: int) -> dict[str, Column]:
    k = F.col(key)
    return {
        "nation": F.when(k % null_every != 0, F.col(nation)),
        "number": F.substring_index(F.col(name), "#", -1).cast("bigint").cast("string"),
        "balance": F.when(k % (null_every + 2) != 1, F.floor(F.col(balance) / 500)),
        "group": F.when(F.col(balance) >= 0, k % 5),
    }


def person_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "supplier"), "s_suppkey", "record_idx")
    return _encoded(t, PERSON, ["record_idx"], _person("s_suppkey", "s_name", "s_nationkey", "s_acctbal", 7))


def person_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "customer"), "c_custkey", "row_idx").withColumn("id", F.col("c_name"))
    return _encoded(t, PERSON, ["row_idx", "id"], _person("c_custkey", "c_name", "c_nationkey", "c_acctbal", 11))


def _person_sql(tab: str, p: str, key: str, idx: str, null_every: int, ident: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {key}) - 1 AS {idx}, {ident}
      CASE WHEN {key} % {null_every} <> 0 THEN {p}_nationkey END AS nation,
      CAST(CAST(string_split({p}_name, '#')[-1] AS BIGINT) AS VARCHAR) AS number,
      CASE WHEN {key} % {null_every + 2} <> 1 THEN CAST(floor({p}_acctbal / 500) AS BIGINT) END AS balance,
      CASE WHEN {p}_acctbal >= 0 THEN {key} % 5 END AS "group" FROM {tab}"""


# --- vec and swap: embeddings as sign masks ------------------------------------------------

VEC = LinkageConfig.of([
    FieldSpec("mask", 0.0001, 0.01, "dice", "bitmask", 64), FieldSpec("label", 0.1, 0.02, "binary", "integer", 4),
], 0.9, 0.7)
SWAP = LinkageConfig.of([
    FieldSpec("part_a", 0.001, 0.01, "dice", "bitmask", 16), FieldSpec("part_b", 0.0005, 0.02, "dice", "bitmask", 16),
    FieldSpec("part_c", 0.002, 0.01, "dice", "bitmask", 16), FieldSpec("rest", 0.003, 0.03, "dice", "bitmask", 16),
    FieldSpec("label", 0.1, 0.02, "binary", "integer", 4),
], 0.9, 0.7, [["part_a", "part_b", "part_c"]])


def _signs(lo: int, n: int, least: float) -> Column:
    return bits_to_mask(F.transform(F.slice("embedding", lo + 1, n), lambda x: x > least), n)


def _signs_sql(lo: int, n: int, least: float) -> str:
    return f"CAST(array_to_string(list_transform(embedding[{lo + 1}:{lo + n}], lambda x: CASE WHEN x > CAST({least} AS FLOAT) THEN '1' ELSE '0' END), '') AS BIT)"


def _label(spec_config: LinkageConfig, c: Column) -> Column:
    return encode(c, spec_config.fields["label"]).alias("label")


def vec_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "embeddings"), "vec_id", "record_idx")
    return t.select("record_idx", _label(VEC, F.when(F.col("vec_id") % 9 != 4, F.col("label"))), _signs(0, 64, 0.03125).alias("mask"))


def vec_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "embeddings"), "vec_id", "row_idx")
    return t.select("row_idx", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), _label(VEC, F.col("label")), F.when(F.col("vec_id") % 13 != 6, _signs(0, 64, 0.0)).alias("mask"))


def swap_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "embeddings"), "vec_id", "record_idx")
    return t.select("record_idx", _label(SWAP, F.col("label")), _signs(16, 16, 0.03125).alias("part_a"), F.when(F.col("vec_id") % 5 != 2, _signs(32, 16, 0.03125)).alias("part_b"),
                    _signs(0, 16, 0.03125).alias("part_c"), _signs(48, 16, 0.03125).alias("rest"))


def swap_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _number(table(spark, sf_dir, "embeddings"), "vec_id", "row_idx")
    return t.select("row_idx", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), _label(SWAP, F.col("label")), _signs(0, 16, 0.0).alias("part_a"), _signs(16, 16, 0.0).alias("part_b"),
                    F.when(F.col("vec_id") % 7 != 3, _signs(32, 16, 0.0)).alias("part_c"), _signs(48, 16, 0.0).alias("rest"))


_N = "row_number() OVER (ORDER BY vec_id) - 1"
_VEC_CLIENT = f"SELECT {_N} AS record_idx, CASE WHEN vec_id % 9 <> 4 THEN label END AS label, {_signs_sql(0, 64, 0.03125)} AS mask FROM embeddings"
_VEC_SERVER = f"SELECT {_N} AS row_idx, 'v' || vec_id AS id, label, CASE WHEN vec_id % 13 <> 6 THEN {_signs_sql(0, 64, 0.0)} END AS mask FROM embeddings"
_SWAP_CLIENT = f"""SELECT {_N} AS record_idx, label, {_signs_sql(16, 16, 0.03125)} AS part_a, CASE WHEN vec_id % 5 <> 2 THEN {_signs_sql(32, 16, 0.03125)} END AS part_b,
      {_signs_sql(0, 16, 0.03125)} AS part_c, {_signs_sql(48, 16, 0.03125)} AS rest FROM embeddings"""
_SWAP_SERVER = f"""SELECT {_N} AS row_idx, 'v' || vec_id AS id, label, {_signs_sql(0, 16, 0.0)} AS part_a, {_signs_sql(16, 16, 0.0)} AS part_b,
      CASE WHEN vec_id % 7 <> 3 THEN {_signs_sql(32, 16, 0.0)} END AS part_c, {_signs_sql(48, 16, 0.0)} AS rest FROM embeddings"""


# --- doc: labelled documents against all documents, as Bloom masks of their words ------------

DOC_BITS = 512
#: Words whose bits a task keeps.
DOC_KEPT = 1 << 18
DOC = LinkageConfig.of([
    FieldSpec("words", 0.0001, 0.01, "dice", "bitmask", DOC_BITS), FieldSpec("lang", 0.3, 0.01, "binary", "string", 16),
    FieldSpec("source", 0.05, 0.02, "binary", "string", 48),
], 0.9, 0.7)


class _Bits(dict):
    """Bits of words; so many are kept that they stay small."""

    def __missing__(self, word: bytes) -> int:
        bit = (int.from_bytes(md5(word).digest()[:4], "big") >> 4) % DOC_BITS
        if len(self) < DOC_KEPT:
            self[word] = bit
        return bit


@F.arrow_udf(BinaryType())
def _bloom(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A bit for the md5 of every word of the whole text: of what stands between runs of blanks and line ends, as a split has it.  A null has none, as in the SQL twin."""
    bits, blanks = _Bits(), bytes.maketrans(b"\n\r\t", b"   ")
    for batch in texts:
        out = []
        for text in batch.cast(pa.large_binary()):
            if not text.is_valid:
                out.append(bytes(DOC_BITS // 8))
                continue
            text = text.as_py().translate(blanks)
            words = set(text.split(b" "))
            if text and text[0] != 32 and text[-1] != 32:
                words.discard(b"")  # from inside a run; else there is an empty word at an end
            flags = np.zeros(DOC_BITS, dtype=bool)
            flags[list(map(bits.__getitem__, words))] = True
            out.append(np.packbits(flags, bitorder="little").view("<u8").astype(">u8").tobytes())
        yield pa.array(out, pa.binary())


def _doc(df: DataFrame, key: str) -> DataFrame:
    """key, words, lang, source; no words where nobody asks for them."""
    return df.select(F.col("doc_id").alias(key), _bloom(F.lower("text")).alias("words"), encode(F.col("lang"), DOC.fields["lang"]).alias("lang"), encode(F.col("source"), DOC.fields["source"]).alias("source"))


def doc_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the documents that have a label, as in the SQL twin; the server side is all documents."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return _doc(t, "record_idx")


def doc_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc(table(spark, sf_dir, "documents"), "row_idx").withColumn("id", F.concat(F.lit("d"), F.col("row_idx").cast("string")))


_BLOOM_SQL = f"""(SELECT CAST(string_agg(CASE WHEN list_contains(b, k) THEN '1' ELSE '0' END, '' ORDER BY k) AS BIT)
      FROM (SELECT list_distinct(list_transform(list_distinct(regexp_split_to_array(lower(d.text), '[ \\n\\r\\t]+')),
            lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % {DOC_BITS})) AS b) z, range({DOC_BITS}) r(k))"""
_DOC_CLIENT = f"SELECT doc_id AS record_idx, {_BLOOM_SQL} AS words, lang, source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)"
_DOC_SERVER = f"SELECT doc_id AS row_idx, 'd' || doc_id AS id, {_BLOOM_SQL} AS words, lang, source FROM documents d"

VIEWS = {
    "person": View(PERSON, person_client, person_server, _person_sql("supplier", "s", "s_suppkey", "record_idx", 7, ""), _person_sql("customer", "c", "c_custkey", "row_idx", 11, "c_name AS id,")),
    "vec": View(VEC, vec_client, vec_server, _VEC_CLIENT, _VEC_SERVER),
    "swap": View(SWAP, swap_client, swap_server, _SWAP_CLIENT, _SWAP_SERVER),
    "doc": View(DOC, doc_client, doc_server, _DOC_CLIENT, _DOC_SERVER),
}
