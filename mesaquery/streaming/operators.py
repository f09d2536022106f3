"""Streaming operators. Each takes a streaming (or batch) DataFrame of calls with a timestamp ``ts``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_folder(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, bytes_per_trigger: str | None = None, done: str | None = None) -> DataFrame:
    """New JSON files of a folder as a stream, so many files or bytes a trigger.

    Files whose names begin with a dot or an underscore aren't seen, so a writer
    that renames when it is done needs no waiting time. ``done`` names a folder
    that finished files move to; a trigger that fails is run again from its offsets.
    """
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", bytes_per_trigger)
    if done:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return r.json(path)


def sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(actor, start, end, n): sessions that a silence of ``gap`` ends."""
    w = F.session_window("ts", gap)
    return calls.withWatermark("ts", late).groupBy("actor", w.alias("w")).agg(F.count("*").alias("n")).select("actor", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def error_pattern(calls: DataFrame, least: int = 3, length: str = "30 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(tool, start, n): sliding windows in which an actor had ``least`` errors."""
    g = calls.where(~F.col("ok")).withWatermark("ts", late).groupBy("actor", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("actor", F.col("w.start").alias("start"), "n")


def distinct_within(calls: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def activity(calls: DataFrame, length: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(tool, start, n): touches a tool and day."""
    g = calls.withWatermark("ts", late).groupBy("tool", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return g.select("tool", F.col("w.start").alias("start"), "n")


def idempotent_sink(path: str, keys: list[str], look_back: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key isn't stored yet; a batch that is replayed writes the same folder again.

    Only keys are read of what is stored, and with ``look_back`` only those of so
    many batches: give the number that the stream's watermark spans.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            stored = spark.read.parquet(path).where(F.col("batch") != batch_id)
            seen = (stored if look_back is None else stored.where(F.col("batch") >= batch_id - look_back)).select(*keys)
            new = new.join(seen, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_to_table(stream: DataFrame, checkpoint: str, target: str, mode: str = "append") -> None:
    """Drain what is there and stop; offsets and state live in the checkpoint folder, so a restart goes on where it was."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", target).start().awaitTermination()
