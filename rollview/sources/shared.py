"""A folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import InvalidOperation


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names for checkpoints; a temporary one if Spark runs on this machine only."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise InvalidOperation("set spark.checkpoint.dir to a folder that the driver and all executors share")
        home = tempfile.mkdtemp(prefix="rollview-")
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"
