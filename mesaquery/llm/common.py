"""Shared helpers: table access, word expressions, shared-storage materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    """Read ``name`` and keep only ``columns`` (space separated), so that extra columns never clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns.split())


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    # Whitespace other than single spaces is rare: plain replacements, and a regular expression only
    # where spaces still stand in a row, let split() take its fast single-character path.
    t = F.coalesce(text, F.lit(""))
    for c in WHITE[1:]:
        t = F.replace(t, F.lit(c), F.lit(" "))
    t = let(t, lambda x: F.btrim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x), F.lit(" ")))
    return let(t, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once: Catalyst would inline a plain alias into every use."""
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local default only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:/tmp/checkpoints"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor and, unlike
    ``checkpoint()``, doesn't compute the plan twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of materialised frames that nothing will read again."""
    for df in frames:
        if folder := getattr(df, "_folder", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of a batch that goes to Python: texts may be very long, and several batches are in memory at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded memory; limits that were given to the application stay."""
    spark = df.sparkSession
    for key, value in BATCH.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    return df.mapInArrow(f, schema)
