"""What the corpus operators share: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in spark.checkpoint.dir as the session names it. Only where that is unset and the session runs on this machine alone
    (as tests do) a folder of this machine is made and set. What is written there stays until the caller clears it: results
    are read from it when they are asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shopweave-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df as a written table: its lineage is cut, and a lost executor costs no second run of what made it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, path: str) -> DataFrame:
    """(kept: all columns, row) as a written table: a second scan of docs may be dealt to other partitions, and would number other rows."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    return saved(docs.select(kept, F.monotonically_increasing_id().alias("row")), path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_null(df: DataFrame, column: str) -> DataFrame:
    """Null texts count as empty."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
