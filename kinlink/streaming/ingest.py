"""Requests as a stream of files, linked batch by batch to a static database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.plans.config import LinkageConfig
from kinlink.plans.engine import LinkageEngine
from kinlink.sources.records import _FIELDS, decoded


def link_stream(spark: SparkSession, path: str, config: LinkageConfig, server: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "int32") -> StreamingQuery:
    """Each line of a file under ``path`` is a record {"record_idx": n, "fields": {...}}.

    ``sink(links, batch_id)`` gets the results of a batch; with the batch's number
    and an overwriting sink a repeated batch after a failure has no further effect.
    """
    schema = f"record_idx bigint, fields {_FIELDS.simpleString()}"
    lines = spark.readStream.schema(schema).json(path)
    engine = LinkageEngine(config, mode)

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(engine.link(batch.select("record_idx", *decoded(F.col("fields"), config)), server), batch_id)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
