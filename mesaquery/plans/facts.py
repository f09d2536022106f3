"""Bitemporal facts, intervals and calendars."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import temporal
from ..session import assertions, table, with_
from .registry import query

A = with_("facts") + ", v AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, id) AS valid_to FROM facts)"


def _valid(spark, d):
    return temporal.with_validity(assertions(spark, d))


@query("fact_as_of", f"{A} SELECT id, subject, object FROM v WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01')")
def fact_as_of(spark, d):
    """Facts valid at a moment."""
    return temporal.as_of(_valid(spark, d), "1998-06-01").select("id", "subject", "object")


@query("fact_current", f"{A} SELECT id, subject, object FROM v WHERE valid_to IS NULL")
def fact_current(spark, d):
    """Facts that are still open."""
    return _valid(spark, d).where("valid_to IS NULL").select("id", "subject", "object")


@query("fact_timeline", f"{A} SELECT subject, id, object, valid_from, valid_to FROM v WHERE subject IN (7, 8, 9)")
def fact_timeline(spark, d):
    """A subject's facts with their validity; the subjects are pushed into the scan."""
    f = temporal.with_validity(assertions(spark, d).where(F.col("subject").isin(7, 8, 9)))
    return f.select("subject", "id", "object", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


@query("fact_diff", f"""{A}, a AS (SELECT subject, object FROM v WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')), b AS (SELECT subject, object FROM v WHERE valid_from <= TIMESTAMP '1999-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1999-01-01'))
SELECT coalesce(a.subject, b.subject) AS subject, a.object AS old, b.object AS new, CASE WHEN a.subject IS NULL THEN 'added' WHEN b.subject IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.subject = b.subject WHERE a.object IS DISTINCT FROM b.object""")
def fact_diff(spark, d):
    """What changed between two snapshots."""
    v = _valid(spark, d)
    return temporal.snapshot_diff(temporal.as_of(v, "1996-01-01"), temporal.as_of(v, "1999-01-01"), ["subject"], "object")


@query("fact_stats", f"{A} SELECT count(*) AS total, count(*) FILTER (WHERE valid_to IS NULL) AS current_n, count(*) FILTER (WHERE valid_to IS NOT NULL) AS closed_n, count(DISTINCT subject) AS subjects FROM v")
def fact_stats(spark, d):
    """Facts in all, open, closed, and their subjects, in one pass over the validity."""
    v = _valid(spark, d)
    return v.agg(F.count("*").alias("total"), F.count_if(F.col("valid_to").isNull()).alias("current_n"), F.count_if(F.col("valid_to").isNotNull()).alias("closed_n"), F.countDistinct("subject").alias("subjects"))


@query("fact_invalidate", f"{A} SELECT id, least(coalesce(valid_to, TIMESTAMP '1997-03-01'), CASE WHEN object = 'P' AND valid_from < TIMESTAMP '1997-03-01' THEN TIMESTAMP '1997-03-01' END) AS valid_to FROM v WHERE object = 'P' AND valid_from < TIMESTAMP '1997-03-01'")
def fact_invalidate(spark, d):
    """Close open facts of one object at a moment: tombstones cap the validity."""
    t = F.lit("1997-03-01").cast("timestamp")
    v = _valid(spark, d).where((F.col("object") == "P") & (F.col("valid_from") < t))
    return v.select("id", F.least(F.coalesce("valid_to", t), t).cast("timestamp_ntz").alias("valid_to"))


_PAIR = """p AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS a1, o_orderdate + to_days(CAST(o_orderkey % 90 + 1 AS INTEGER)) AS a2 FROM orders),
q AS (SELECT id, a1, a2, lead(a1) OVER w AS b1, lead(a2) OVER w AS b2 FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY a1, id)),
r AS (SELECT id, CASE WHEN a2 < b1 THEN 'before' WHEN a2 = b1 THEN 'meets' WHEN b2 < a1 THEN 'after' WHEN b2 = a1 THEN 'met_by' WHEN a1 = b1 AND a2 = b2 THEN 'equals' WHEN a1 = b1 AND a2 < b2 THEN 'starts' WHEN a1 = b1 THEN 'started_by'
  WHEN a2 = b2 AND a1 > b1 THEN 'finishes' WHEN a2 = b2 THEN 'finished_by' WHEN a1 > b1 AND a2 < b2 THEN 'during' WHEN a1 < b1 AND a2 > b2 THEN 'contains' WHEN a1 < b1 THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM q WHERE b1 IS NOT NULL)"""


def _pairs(spark, d, last: bool = False):
    """Each interval with its successor; the last of a key has none and stays if asked for."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("a1"))
    o = o.withColumn("a2", F.col("a1") + (F.col("id") % 90 + 1) * 86400)
    w = W.partitionBy("o_custkey").orderBy("a1", "id")
    pairs = o.withColumn("b1", F.lead("a1").over(w)).withColumn("b2", F.lead("a2").over(w))
    return pairs if last else pairs.where("b1 IS NOT NULL")


@query("allen_relations", f"WITH {_PAIR} SELECT id, relation FROM r")
def allen_relations(spark, d):
    """The relation of each interval to its successor."""
    return _pairs(spark, d).select("id", I.allen(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("relation"))


@query("calendar_durations", """WITH p AS (SELECT o_orderkey AS id, o_orderdate AS a, TIMESTAMP '2000-02-29' AS b FROM orders WHERE o_orderdate < TIMESTAMP '2000-02-29'), m AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) AS n FROM p)
SELECT id, date_diff('day', a, b) AS days, date_diff('day', a, b) // 7 AS weeks, CAST(CASE WHEN a + to_months(CAST(n AS INTEGER)) > b THEN n - 1 ELSE n END AS BIGINT) AS months, CAST(CASE WHEN a + to_months(CAST(n AS INTEGER)) > b THEN n - 1 ELSE n END // 12 AS BIGINT) AS years FROM m""")
def calendar_durations(spark, d):
    """Whole days, weeks, months and years; months by clamped anniversaries."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("a")).withColumn("b", F.lit("2000-02-29").cast("timestamp")).where("a < b")
    a, b = F.col("a"), F.col("b")
    return o.select("id", I.whole_days(a, b).alias("days"), F.floor(I.whole_days(a, b) / 7).alias("weeks"), I.whole_months(a, b).cast("long").alias("months"), I.whole_years(a, b).cast("long").alias("years"))


@query("range_distance", "SELECT o_orderkey AS id, greatest(0, date_diff('day', o_orderdate, TIMESTAMP '1997-01-01'), date_diff('day', TIMESTAMP '1997-06-30', o_orderdate)) AS days, round(greatest(0, 1 - greatest(0, date_diff('day', o_orderdate, TIMESTAMP '1997-01-01'), date_diff('day', TIMESTAMP '1997-06-30', o_orderdate)) / 180.0::DOUBLE), 6) AS near FROM orders")
def range_distance(spark, d):
    """Days to a query's date range, and the proximity score."""
    dist = I.range_distance(F.to_date("o_orderdate"), F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1997-06-30")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dist.cast("long").alias("days"), F.round(I.proximity(dist), 6).alias("near"))


@query("calendar_periods", "SELECT date_trunc('week', ts)::DATE AS week, date_trunc('month', ts)::DATE AS month, count(*) AS n FROM events GROUP BY 1, 2")
def calendar_periods(spark, d):
    """Events by calendar week and month."""
    return table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.count("*").alias("n"))


@query("duration_text", "SELECT o_orderkey AS id, CASE WHEN x = 0 THEN '0 days' WHEN x >= 30 THEN m || CASE WHEN m = 1 THEN ' month' ELSE ' months' END || CASE WHEN r = 0 THEN '' ELSE ' ' || r || CASE WHEN r = 1 THEN ' day' ELSE ' days' END END ELSE x || CASE WHEN x = 1 THEN ' day' ELSE ' days' END END AS said FROM (SELECT o_orderkey, o_orderkey % 100 AS x, (o_orderkey % 100) // 30 AS m, (o_orderkey % 100) % 30 AS r FROM orders)")
def duration_text(spark, d):
    """Durations in English words, two units at most."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), I.human(F.col("o_orderkey") % 100).alias("said"))
