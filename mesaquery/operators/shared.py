"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local default only where driver and executors are one machine's process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:/tmp/checkpoints"


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write once and read back: no lineage, no second computation, nothing lost with an executor."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def stands(df: DataFrame) -> bool:
    """Whether what ``cut`` wrote is still there."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


def discard(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote and nothing will read again."""
    for df in frames:
        if path := getattr(df, "_folder", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def batched(df: DataFrame) -> DataFrame:
    """``df``, whose Arrow batches stay of bounded size; a limit given to the application stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(16 << 20))
    return df
