"""Shared scratch space: the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import functools
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset and driver and
    executors are one process (tests) a temporary folder of this machine is set;
    on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="kinlink-")
        _OWN[app] = found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A reliable checkpoint: later stages survive the loss of any executor.  The files go
    with the folder, or with the last reference to them where the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators over ``docs``, whose own columns begin with two underscores:
    columns of the input that do so too get other names meanwhile, and so do those
    with signs that Spark's functions over batches don't take."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **more) -> DataFrame:
        taken, back = {c.lower() for c in docs.columns}, {}
        for k, c in enumerate(docs.columns):
            if c.startswith("__") or not c.isidentifier():
                other = f"in{k}_"
                while other.lower() in taken:
                    other += "_"
                taken.add(other.lower())
                back[other] = c
        if not back:
            return operator(docs, *args, **more)
        return operator(docs.withColumnsRenamed({c: o for o, c in back.items()}), *args, **more).withColumnsRenamed(back)

    return run


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def others(df: DataFrame, made: set[str]) -> list[str]:
    """Quoted names of the columns of ``df`` that no made column replaces."""
    low = {m.lower() for m in made}
    return [quoted(c) for c in df.columns if c.lower() not in low]
