"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only where that is unset and all run in one process a temporary folder of this
    machine serves; on a cluster the missing setting is an error.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        home = _OWN.get(app) or tempfile.mkdtemp(prefix="kinlink-")
        _OWN[app] = home
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
