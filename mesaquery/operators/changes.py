"""Change logs: incremental merge of snapshots, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_changes(base: DataFrame, log: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """``base`` after a log of upserts and deletes: the last change of a key counts.

    ``log`` has the columns of ``base`` plus ``seq`` and ``op`` ('upsert' or
    'delete'). The last change is a maximum, so a key with millions of changes
    is reduced before the shuffle.
    """
    names = base.columns
    last = log.groupBy(key).agg(F.max_by(F.struct(op, *(c for c in names if c != key)), F.col(seq)).alias("_l"))
    new = last.where(F.col(f"_l.{op}") == "upsert").select(*(F.col(key) if c == key else F.col(f"_l.{c}").alias(c) for c in names))
    return base.join(last.select(key), key, "left_anti").select(*names).unionByName(new)


def backoff(attempts: Column, base: int = 30, most: int = 3600) -> Column:
    """Seconds to wait before the next try: doubling, up to a limit."""
    return F.least(F.lit(most), base * F.pow(F.lit(2), attempts)).cast("long")


def stale(leased_at: Column, now: str, seconds: int) -> Column:
    """Whether a lease has run out."""
    return F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(leased_at) > seconds
