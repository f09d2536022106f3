"""Graph operators over edge tables (src, dst, weight).

Iterative ones cut their lineage by writing each round to the shared folder of
``spark.checkpoint.dir``; frontiers and labels stay distributed throughout.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, discard


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; the stronger weight where both exist."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select("src", "dst", "weight").unionByName(rev).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength) over undirected edges."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` hops of each seed, by frontier joins that leave out what was seen."""
    adj = cut(undirected(edges).select("src", "dst"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(adj, frontier["node"] == adj["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by label propagation with pointer jumps until nothing changes."""
    adj = cut(undirected(edges).select("src", "dst"))
    labels = cut(adj.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = adj.join(labels, adj["dst"] == labels["node"]).groupBy(adj["src"].alias("node")).agg(F.min("component").alias("c"))
        step = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component")))
        changed = not new.join(labels.select("node", F.col("component").alias("was")), "node").where("component <> was").isEmpty()
        labels = new
        if not changed:
            return labels


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, least_change: float = 0.0) -> DataFrame:
    """(node, rank): weighted undirected PageRank, normalised to sum one.

    Links are partitioned by source once and kept so: a round shuffles ranks
    only. Every five rounds lineage is cut, and the ranks that moved less than
    ``least_change`` in sum end the rounds early.
    """
    adj = undirected(edges)
    out = adj.groupBy("src").agg(F.sum("weight").alias("total"))
    stored = cut(adj.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = stored.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)  # what an executor loses is read again from the folder
    n = links.select("src").distinct().count()
    ranks = links.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    last = None
    for i in range(rounds):
        flow = links.join(ranks, links["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        ranks = flow.select("node", ((1 - damping) / n + damping * F.col("in")).alias("rank"))
        if i % 5 == 4 or i == rounds - 1:
            ranks = cut(ranks, "ranks")
            if last is not None and least_change and (ranks.join(last.withColumnRenamed("rank", "_was"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("_was")))).first()[0] or 0.0) < least_change:
                break
            last = ranks
    links.unpersist()
    discard(stored)
    return ranks.crossJoin(F.broadcast(ranks.agg(F.sum("rank").alias("_all")))).select("node", (F.col("rank") / F.col("_all")).alias("rank"))  # the sum: one row


def cooccurrence(links: DataFrame, record: str, node: str, least: int) -> DataFrame:
    """(a, b, n): nodes that share at least ``least`` records, a < b. Records link a bounded number of nodes."""
    x = links.select(F.col(record).alias("_r"), F.col(node).alias("a")).distinct()
    y = x.select("_r", F.col("a").alias("b"))
    return x.join(y, "_r").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spread(edges: DataFrame, seeds: DataFrame, hops: tuple[float, ...] = (0.7, 0.4), threshold: float = 0.3, bonus: tuple[float, ...] = (1.0, 1.2, 1.5, 1.8, 2.0), hub: int = 200, frontier_cap: int = 200) -> DataFrame:
    """(node, activation) of the nodes that activation reaches from the seeds, seeds left out.

    A hop hands on its own activation times the hop's fade times the edge's weight
    (1 at most); what falls below the threshold is no path. A node keeps the best
    activation of its paths; at the end, several paths multiply it, up to 1. Hubs
    pass nothing on, and of a frontier the ``frontier_cap`` most active nodes do.
    """
    adj = undirected(edges)
    deg = adj.groupBy("src").agg(F.count("*").alias("d"))
    adj = cut(adj.join(deg, "src").where(F.col("d") <= hub).select("src", "dst", F.least("weight", F.lit(1.0)).alias("weight")))
    seed = seeds.select(F.col("seed").alias("node")).distinct()
    known = cut(seed.select("node", F.lit(1.0).alias("activation"), F.lit(1).cast("long").alias("paths")))
    frontier = known
    for fade in hops:
        active = frontier.where(F.col("activation") >= threshold).orderBy(F.desc("activation"), "node").limit(frontier_cap)
        new = active.join(adj, active["node"] == adj["src"]).select(F.col("dst").alias("node"), (F.col("activation") * fade * F.col("weight")).alias("a"))
        new = new.where(F.col("a") >= threshold).join(seed, "node", "left_anti").groupBy("node").agg(F.max("a").alias("a"), F.count("*").alias("p"))
        step = known.join(new, "node", "full").select("node", F.greatest("activation", "a").alias("activation"), (F.coalesce("paths", F.lit(0)) + F.coalesce("p", F.lit(0))).alias("paths"), (F.col("a").isNotNull() & (F.col("activation").isNull() | (F.col("a") > F.col("activation")))).alias("fresh"))
        step = cut(step)
        known, frontier = step.drop("fresh"), step.where("fresh")
    factor = F.get(F.array(*(F.lit(x) for x in bonus)), F.least(F.col("paths"), F.lit(len(bonus))).cast("int") - 1)
    return known.join(seed, "node", "left_anti").select("node", F.round(F.least(F.lit(1.0), F.col("activation") * factor), 4).alias("activation")).where(F.col("activation") >= threshold)


def transitive(edges: DataFrame) -> DataFrame:
    """(src, dst, via): two-hop connections of directed edges that have no direct edge yet; via is the smallest between."""
    a, b = edges.select("src", F.col("dst").alias("via")), edges.select(F.col("src").alias("via"), "dst")
    two = a.join(b, "via").where("src <> dst").groupBy("src", "dst").agg(F.min("via").alias("via"))
    return two.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(ends, "node", "left_anti")


def chain(records: DataFrame, group: str, order: list[str], id_: str) -> DataFrame:
    """(src, dst): each record to the next of its group."""
    nxt = F.lead(id_).over(W.partitionBy(group).orderBy(*order))
    return records.select(F.col(id_).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def reinforce(log: DataFrame, start: float = 1.0, step: float = 0.1, most: float = 10.0) -> DataFrame:
    """(src, dst, weight, n) from a log of repeated edges: each repeat strengthens, up to a limit."""
    n = F.col("n")
    return log.groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("weight", F.least(F.lit(most), start + step * (n - 1)))


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops, path): one shortest path to every node within ``depth``; of equals the one through the smallest predecessor."""
    adj = cut(undirected(edges).select("src", "dst"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"), F.array("seed").alias("path"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(adj, frontier["node"] == adj["src"]).join(seen.select("seed", F.col("node").alias("dst")), ["seed", "dst"], "left_anti")
        best = step.groupBy("seed", F.col("dst").alias("node")).agg(F.min_by("path", "src").alias("path"))
        frontier = cut(best.select("seed", "node", F.lit(hop).alias("hops"), F.concat("path", F.array("node")).alias("path")))
        seen = seen.unionByName(frontier)
    return seen
