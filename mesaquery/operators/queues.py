"""Queues, outboxes and logs as tables: claims, replays, retention, coalesced counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_state(log: DataFrame, key: str, order: Column, state: str) -> DataFrame:
    """(key, state, changes): the last state of each item of an append-only log; a maximum, so a hot item is reduced before the shuffle."""
    return log.groupBy(key).agg(F.max_by(state, order).alias(state), F.count("*").alias("changes"))


def claim(items: DataFrame, now: Column, lease_seconds: int, most: int, order: list, status: str = "status", leased_at: str = "leased_at") -> DataFrame:
    """The next ``most`` items to work on, with status processing and a new lease: pending ones, and those whose lease has run out."""
    due = (F.col(status) == "pending") | ((F.col(status) == "processing") & (F.unix_micros(now) - F.unix_micros(F.col(leased_at)) > lease_seconds * 1_000_000))
    return items.where(due).orderBy(*order).limit(most).withColumn(status, F.lit("processing")).withColumn(leased_at, now)


def replayable(intents: DataFrame, committed: DataFrame, key: str, at: str, now: Column, grace_seconds: int) -> DataFrame:
    """One intent a key, the first, that no commit carries and whose grace is over: what a restart must do again, once."""
    old = intents.where(F.unix_micros(now) - F.unix_micros(F.col(at)) > grace_seconds * 1_000_000)
    first = old.groupBy(key).agg(F.min_by(F.struct(*(c for c in intents.columns if c != key)), F.struct(*(c for c in intents.columns if c != key))).alias("_i"))
    return first.join(committed.select(key).distinct(), key, "left_anti").select(key, "_i.*")


def retained(log: DataFrame, group: str, at: str, ties: str, days: int, most: int, now: Column) -> DataFrame:
    """Rows no older than ``days``, and of these the newest ``most`` of a group."""
    fresh = log.where(F.unix_micros(now) - F.unix_micros(F.col(at)) <= days * 86_400_000_000)
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.col(at).desc(), F.col(ties).desc()))).where(F.col("_n") <= most).drop("_n")


def coalesced(touches: DataFrame, key: str, at: str, millis: int = 250) -> DataFrame:
    """(key, flush, n): touches of a key counted once a flush interval."""
    return touches.groupBy(key, F.floor(F.unix_micros(F.col(at)) / (millis * 1000)).alias("flush")).agg(F.count("*").alias("n"))


def distinct_after(log: DataFrame, keys: list[str], at: str, ties: str, seconds: int) -> DataFrame:
    """Rows whose key wasn't seen in the ``seconds`` before, whether that row was kept or not (as a watermark that each sight renews)."""
    was = F.lag(at).over(W.partitionBy(*keys).orderBy(at, ties))
    return log.withColumn("_was", was).where(F.col("_was").isNull() | (F.unix_micros(F.col(at)) - F.unix_micros(F.col("_was")) > seconds * 1_000_000)).drop("_was")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that have to be computed."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
