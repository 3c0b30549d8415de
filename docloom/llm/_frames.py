"""Shared plumbing of the training-data operators: shared storage, checkpoints written as tables, and column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no ``spark.checkpoint.dir``, as in local tests.
LOCAL_SHARED = "/tmp/docloom-shared"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``; where it is unset, a local one, which only a local session can use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (root or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/docloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage of ``df`` with a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df[f"`{name}`"]


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key (long) and the text (null: empty) of ``df``, under fixed names, whatever else it holds."""
    small_batches(df.sparkSession)
    return df.select(column(df, id_col).cast("long").alias("doc_id"), F.coalesce(column(df, text_col), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bounds the Arrow batches that go to Python workers by bytes: rows of long texts would otherwise make batches of many times a worker's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(limit):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
