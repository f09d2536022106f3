"""Quality of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, query: str, k: int = 10) -> DataFrame:
    """r1, r5, mrr and ndcg10 over (query, rank, relevant); one row of sums a query, no list is gathered."""
    gain = F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    m = ranked.groupBy(query).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.least(F.lit(k), F.count_if("relevant")).cast("int").alias("g"))
    ideal = F.when(F.col("g") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("g"), F.lit(1))), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))).otherwise(0.0)
    m = m.withColumn("idcg", ideal)
    hit = lambda n: F.round(F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0)), 6)
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return m.agg(hit(1).alias("r1"), hit(5).alias("r5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(ndcg), 6).alias("ndcg10"))
