"""JSON records: database pages, requests, and their decoding into encoded fields."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions.codec import encode
from kinlink.plans.config import LinkageConfig

_FIELDS = T.MapType(T.StringType(), T.StringType())
_RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", _FIELDS)])
PAGE = T.StructType([
    T.StructField("localId", T.StringType()), T.StructField("remoteId", T.StringType()),
    T.StructField("currentPageNumber", T.LongType()), T.StructField("lastPageNumber", T.LongType()),
    T.StructField("records", T.ArrayType(_RECORD)),
])
REQUEST = T.StructType([
    T.StructField("fields", _FIELDS), T.StructField("records", T.ArrayType(_RECORD)),
    T.StructField("requests", T.ArrayType(_RECORD)),
])


def decoded(fields: Column, config: LinkageConfig, missing: str = "error") -> list[Column]:
    """One encoded column per configured field out of a map of JSON values.

    A missing key is an error unless ``missing="null"``; an unknown key always is.
    """
    known = F.array(*[F.lit(n) for n in config.names])
    extra = F.array_except(F.map_keys(fields), known)
    lacks = F.array_except(known, F.map_keys(fields))
    bad = F.size(extra) > 0 if missing == "null" else (F.size(extra) > 0) | (F.size(lacks) > 0)
    what = F.concat(F.lit("unknown fields: "), F.array_join(extra, ","), F.lit("; missing fields: "), F.array_join(lacks, ","))
    checked = F.when(bad, F.raise_error(what).cast(_FIELDS)).otherwise(fields)
    return [encode(F.element_at(checked, F.lit(n)), spec).alias(n) for n, spec in config.fields.items()]


def _single_line(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def numbered_rows(pages: DataFrame) -> DataFrame:
    """(row_idx, id, fields) from rows (page, records): page order, then position.

    Offsets are running sums over page sizes, so no task sees all records.
    """
    size = F.coalesce(F.size("records"), F.lit(0))
    ahead = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    at = pages.select("page", size.alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint")).select("page", "offset")
    return (pages.join(at, "page").select("offset", F.posexplode("records").alias("pos", "r"))
            .select((F.col("offset") + F.col("pos")).alias("row_idx"), F.col("r.id").alias("id"), F.col("r.fields").alias("fields")))


def read_pages(spark: SparkSession, path: str, config: LinkageConfig, missing: str = "error") -> DataFrame:
    """A server database from JSON page files, wrapped in arrays or not.

    An id stays with its record, whatever the number of pages.
    """
    pages = _single_line(spark, path, PAGE)
    pages = pages.select(F.coalesce("currentPageNumber", F.lit(1)).alias("page"), "localId", "remoteId", "lastPageNumber", "records")
    bad = F.concat(F.lit("page lacks "), F.when(F.col("records").isNull(), "records").when(F.col("localId").isNull(), "localId").otherwise("remoteId"))
    pages = pages.withColumn("records", F.when(F.col("records").isNull() | F.col("localId").isNull() | F.col("remoteId").isNull(), F.raise_error(bad).cast(PAGE["records"].dataType)).otherwise(F.col("records")))
    rows = numbered_rows(pages)
    checked = F.when(F.col("id").isNull() | F.col("fields").isNull(), F.raise_error(F.lit("record lacks id or fields")).cast(_FIELDS)).otherwise(F.col("fields"))
    return rows.select("row_idx", "id", *decoded(checked, config, missing))


def read_requests(spark: SparkSession, path: str, config: LinkageConfig, missing: str = "error") -> DataFrame:
    """Client records from a request file: ``fields``, ``records[]`` or ``requests[]``."""
    docs = _single_line(spark, path, REQUEST).select(F.input_file_name().alias("page"), F.when(
        F.col("fields").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col("fields").alias("fields")))).otherwise(F.coalesce("records", "requests")).alias("records"))
    return numbered_rows(docs).select(F.col("row_idx").alias("record_idx"), *decoded(F.col("fields"), config, missing))


def records_from_json(spark: SparkSession, doc: str | dict, config: LinkageConfig, missing: str = "error") -> DataFrame:
    """Client records from the body of one request."""
    doc = json.loads(doc) if isinstance(doc, str) else doc
    rows = [doc] if "fields" in doc else doc.get("records", doc.get("requests"))
    if rows is None:
        raise ValueError("request has neither fields nor records")
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    data = [(i, {k: text(v) for k, v in r["fields"].items()}) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, T.StructType([T.StructField("record_idx", T.LongType()), T.StructField("fields", _FIELDS)]))
    return df.select("record_idx", *decoded(F.col("fields"), config, missing))


def union_pages(*pages: DataFrame) -> DataFrame:
    """Bag union of encoded pages in order; ``row_idx`` goes on from page to page."""
    out = None
    for k, page in enumerate(pages):
        page = page.withColumn("__page", F.lit(k))
        out = page if out is None else out.unionByName(page)
    sizes = out.groupBy("__page").agg((F.max("row_idx") + 1).alias("__n"))
    ahead = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(Window.orderBy("__page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (out.join(ahead.select("__page", "__offset"), "__page").withColumn("row_idx", (F.col("row_idx") + F.col("__offset")).cast("bigint")).drop("__page", "__offset"))
