"""Bitemporal facts, as-of and interval joins, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_validity(facts: DataFrame, key: tuple[str, ...] = ("subject", "predicate"), start: str = "valid_from", ties: str = "id") -> DataFrame:
    """Add valid_to: the start of the next assertion of the same key, null while open; out-of-order inserts need nothing else."""
    return facts.withColumn("valid_to", F.lead(start).over(W.partitionBy(*key).orderBy(start, ties)))


def as_of(facts: DataFrame, moment: str | Column) -> DataFrame:
    """Facts valid at a moment, half open: start <= moment < end."""
    t = F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment
    return facts.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, old, new and change (added, removed, changed) between two snapshots with one row a key."""
    b = before.select(*key, F.col(value).alias("old"))
    a = after.select(*key, F.col(value).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, key, "full").withColumn("change", change).where("change IS NOT NULL")


def asof_join(probe: DataFrame, build: DataFrame, key: tuple[str, str], at: tuple[str, str], value: str) -> DataFrame:
    """Each probe row with the build row of its key that is latest at or before its time.

    One union and one window instead of a range join: each key's rows are sorted
    once, and no pair of rows is ever made.
    """
    p = probe.select(F.col(key[0]).alias("_k"), F.col(at[0]).alias("_t"), F.lit(1).alias("_side"), F.struct(*probe.columns).alias("_p"), F.lit(None).cast(build.schema[value].dataType).alias("_v"), F.lit(None).cast(build.schema[at[1]].dataType).alias("_at"))
    b = build.select(F.col(key[1]).alias("_k"), F.col(at[1]).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.col(value).alias("_v"), F.col(at[1]).alias("_at"))
    w = W.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(b).withColumn("matched", F.last("_v", ignorenulls=True).over(w)).withColumn("matched_at", F.last("_at", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_p.*", "matched", "matched_at")


def overlap_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], days: int = 30) -> DataFrame:
    """Pairs whose half-open ranges overlap, by an equi-join on the day buckets both cover; a pair counts in its first common bucket only."""
    width = days * 86400
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c)) / width)
    spread = lambda d, a, b: d.withColumn("_b", F.explode(F.sequence(bucket(a), bucket(b))))
    j = spread(left, lo[0], hi[0]).join(spread(right, lo[1], hi[1]), "_b")
    ok = (F.col(lo[0]) < F.col(hi[1])) & (F.col(lo[1]) < F.col(hi[0])) & (F.col("_b") == F.greatest(bucket(lo[0]), bucket(lo[1])))
    return j.where(ok).drop("_b")


def episodes(events: DataFrame, key: str, at: str, gap_seconds: int = 3600, ties: str = "id") -> DataFrame:
    """Add episode: a number that rises where more than the gap lies between a key's neighbours."""
    w = W.partitionBy(key).orderBy(at, ties)
    gap = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(w))
    start = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_s", start).withColumn("episode", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def neighbours(turns: DataFrame, session: str, order: list[str], value: str) -> DataFrame:
    """Add previous and next value within the session."""
    w = W.partitionBy(session).orderBy(*order)
    return turns.withColumn("previous", F.lag(value).over(w)).withColumn("next", F.lead(value).over(w))


def daily_series(events: DataFrame, at: str, group: str, first: str, last: str) -> DataFrame:
    """(group, day, n) for every day of a stated range, zeros included."""
    counts = events.groupBy(F.col(group), F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    days = events.select(group).distinct().withColumn("day", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))))
    return days.join(counts, [group, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def topic_episodes(records: DataFrame, key: str, at: str, vector: str, tags: str, gap_seconds: int = 3600, drop: float = 0.30, ties: str = "id") -> DataFrame:
    """Add episode: a number that rises at a silence, a drop in cosine of more than ``drop``, or where neighbours share no tag; each only where both sides have what it needs."""
    from ..functions import scoring as S

    w = W.partitionBy(key).orderBy(at, ties)
    r = records.withColumn("_t", F.lag(at).over(w)).withColumn("_v", F.lag(vector).over(w)).withColumn("_g", F.lag(tags).over(w))
    silent = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")) > gap_seconds * 1_000_000
    turned = 1 - S.cosine(S.as_double(F.col(vector)), S.as_double(F.col("_v"))) > drop
    others = (F.size("_g") > 0) & (F.size(tags) > 0) & ~F.arrays_overlap("_g", tags)
    start = F.when(F.col("_t").isNull() | F.coalesce(silent, F.lit(False)) | F.coalesce(turned, F.lit(False)) | F.coalesce(others, F.lit(False)), 1).otherwise(0)
    return r.withColumn("_s", start).withColumn("episode", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s", "_t", "_v", "_g")


def chains(pointers: DataFrame) -> DataFrame:
    """(id, origin, latest, depth) from pointers (id, next): both ends of each record's chain and its distance from the origin.

    Pointers are doubled: a chain of n records takes log n rounds of equi-joins.
    Records that form a ring have no end; their rounds stop when steps outgrow the table.
    """
    from .shared import cut

    p = cut(pointers.select("id", "next"))
    n = p.count()

    def ends(of: DataFrame) -> DataFrame:
        step = cut(of.where("next IS NOT NULL").select("id", F.col("next").alias("far"), F.lit(1).cast("long").alias("steps")))
        reach = 1
        while reach < n:
            onward = step.select(F.col("id").alias("far"), F.col("far").alias("_far"), F.col("steps").alias("_steps"))
            j = step.join(onward, "far", "left")
            if j.where("_far IS NOT NULL").isEmpty():
                break
            step = cut(j.select("id", F.coalesce("_far", "far").alias("far"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
            reach *= 2
        return step

    down = ends(p).select("id", F.col("far").alias("latest"))
    up = ends(p.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("next"))).select("id", F.col("far").alias("origin"), F.col("steps").alias("depth"))
    return p.select("id").join(down, "id", "left").join(up, "id", "left").select("id", F.coalesce("origin", "id").alias("origin"), F.coalesce("latest", "id").alias("latest"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
