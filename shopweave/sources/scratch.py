"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir as the session names it; only where that is unset and the session runs on this machine alone,
    as in tests, a folder of this machine is made and set. What is written there stays until the caller clears it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shopweave-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table on disk, for what several branches of a plan read: its lineage is cut, and it is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
