"""Statistics of many small groups, as column expressions and windows over one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k, summed from the smaller side."""
    m = F.least(k, n - k)
    return F.when(m == 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(n - m + i) - F.log(i)))


def binomial_p(k: Column, n: Column, p: float = 0.5) -> Column:
    """Two-sided exact binomial test: the summed probability of outcomes no likelier than ``k`` (up to a relative 1e-7)."""
    import math

    log_of = lambda i: log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)
    terms = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0))), log_of)
    total = F.aggregate(F.filter(terms, lambda x: x <= log_of(k) + 1e-7), F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), total))


def benjamini_hochberg(tests: DataFrame, p: str, id_: str, out: str = "q") -> DataFrame:
    """Add ``out``: adjusted p values. One row a test reaches one task, as ranks over all tests need; tests are rules, not events."""
    up = W.orderBy(F.col(p), F.col(id_))
    down = W.orderBy(F.col(p).desc(), F.col(id_).desc()).rowsBetween(W.unboundedPreceding, 0)
    t = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count("*").over(W.partitionBy(F.lit(1))))
    return t.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def ranked_values(rows: DataFrame, group: str, value: str, ranks: DataFrame, bins: int = 4096) -> DataFrame:
    """(group, name, v): the value at each wanted rank (group, name, rank from 1), without gathering a group.

    A histogram finds the bin of each rank, and only that bin is ranked, by its
    distinct values. ``ranks`` holds a few rows a group.
    """
    r = rows.where(F.col(value).isNotNull()).select(group, value)
    span = r.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))).otherwise(F.lit(0))
    binned = r.join(span, group).withColumn("_bin", at)
    counts = binned.groupBy(group, "_bin").agg(F.count("*").alias("_c"), F.min(value).alias("_a"), F.max(value).alias("_z"))
    counts = counts.withColumn("_upto", F.sum("_c").over(W.partitionBy(group).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)))  # at most ``bins`` rows a group
    picks = ranks.join(counts, group).where("_upto >= rank AND _upto - _c < rank").select(group, "name", "_bin", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("_k"), "_a", "_z")
    known = picks.where("_a = _z").select(group, "name", F.col("_a").alias("v"))
    open_ = picks.where("_a <> _z")
    inside = binned.select(group, "_bin", value).join(open_.select(group, "_bin").distinct(), [group, "_bin"], "left_semi")
    each = inside.groupBy(group, "_bin", value).agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(W.partitionBy(group, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    found = each.join(open_, [group, "_bin"]).where("_upto >= _k AND _upto - _c < _k").select(group, "name", F.col(value).alias("v"))
    return known.unionByName(found)


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, n, name ...) nearest-rank percentiles."""
    n = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    ranks = n.select(group, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.ceil(F.lit(p) * F.col("n")).alias("rank")) for k, p in wanted.items()))).alias("x")).select(group, "x.name", "x.rank")
    v = ranked_values(rows, group, value, ranks)
    return v.groupBy(group).agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted)).join(n, group).select(group, "n", *wanted)


def interpolated(rows: DataFrame, counts: DataFrame, group: str, value: str, at: Column) -> DataFrame:
    """(group, value): linear interpolation at the place ``at`` (from 0) of ``counts`` (group, ...), between the ranks around it."""
    two = counts.select(group, at.alias("_at"))
    ranks = two.select(group, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (f("_at") + 1).cast("long").alias("rank")) for k, f in (("lo", F.floor), ("hi", F.ceil))))).alias("x")).select(group, "x.name", "x.rank")
    v = ranked_values(rows, group, value, ranks).groupBy(group).agg(F.max(F.when(F.col("name") == "lo", F.col("v"))).alias("_lo"), F.max(F.when(F.col("name") == "hi", F.col("v"))).alias("_hi"))
    return v.join(two, group).select(group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("value"))
