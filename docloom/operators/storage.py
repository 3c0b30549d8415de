"""Tables in the folder that the cluster shares, and small ones over all cores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/docloom-checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where that is unset, a local one, which only a local session can use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or LOCAL_CHECKPOINTS).rstrip("/")


def shared_path(spark: SparkSession, what: str = "table") -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/docloom/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the folder that the cluster shares (spark.checkpoint.dir)."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """Rows of a small table over all cores: a file of one row group would be one task, whatever is computed on its texts. Larger tables have many row groups and stay as they are read."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df
