"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set, as in tests."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()
