"""Greedy groups over links: who leads, who follows; the same outcome as one pass in order, in parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def greedy_groups(links: DataFrame) -> DataFrame:
    """(id, leader) from links (a, b), a < b: as if ids came in order, and each one not yet taken took all later ones it is linked to.

    In a round every id whose earlier neighbours are all settled is settled: taken
    by the smallest leader among them, or a leader itself. Chains of undecided
    ids are what rounds are needed for, not the size of a group.
    """
    l = cut(links.select("a", "b").distinct())
    open_ = cut(l.select(F.col("a").alias("id")).unionByName(l.select(F.col("b").alias("id"))).distinct())
    settled = cut(open_.limit(0).select("id", F.col("id").alias("leader")))
    while not open_.isEmpty():
        before = l.join(open_.select(F.col("id").alias("b")), "b", "left_semi")
        state = before.join(settled.select(F.col("id").alias("a"), F.col("leader")), "a", "left").groupBy(F.col("b").alias("id")).agg(
            F.min(F.when(F.col("leader") == F.col("a"), F.col("a"))).alias("taken"), F.min(F.when(F.col("leader").isNull(), F.col("a"))).alias("undecided")
        )
        now = open_.join(state, "id", "left")
        # an undecided neighbour that comes before the leader might still become an earlier leader
        ready = now.where("undecided IS NULL OR taken < undecided").select("id", F.coalesce("taken", "id").alias("leader"))
        ready = cut(ready)
        rest = cut(open_.join(ready.select("id"), "id", "left_anti"))
        more = cut(settled.unionByName(ready))
        discard(open_, settled, ready)
        open_, settled = rest, more
    return settled


def chunked(components: DataFrame, most: int) -> DataFrame:
    """(node, component, part): components cut, in node order, into parts of at most ``most`` nodes.

    Places come from a count over the sorted component; a component too large for
    a task should be kept from arising by its links.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("component").orderBy("node")) - 1
    return components.withColumn("part", F.floor(place / most).cast("long"))
