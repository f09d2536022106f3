"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import graph_edges, table, with_
from .registry import query

E = with_("edges") + ", adj AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1, 2)"


def _seeds(spark, *names: str):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}')" for n in names) + " AS s(seed)")


@query("graph_degrees", f"{E} SELECT src AS node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM adj GROUP BY src")
def graph_degrees(spark, d):
    """Neighbours and summed weights of every node, edges read both ways."""
    return G.degrees(graph_edges(spark, d))


@query("cooccurrence", "WITH l AS (SELECT DISTINCT l_orderkey AS r, l_suppkey AS n FROM lineitem) SELECT x.n AS a, y.n AS b, count(*) AS n FROM l x JOIN l y ON x.r = y.r AND x.n < y.n GROUP BY 1, 2 HAVING count(*) >= 25")
def cooccurrence(spark, d):
    """Suppliers that share at least 25 orders."""
    return G.cooccurrence(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 25)


@query("k_hop", f"{E}, h1 AS (SELECT DISTINCT dst AS node FROM adj WHERE src = 'p1'), h2 AS (SELECT DISTINCT dst AS node FROM adj WHERE src IN (SELECT node FROM h1) AND dst <> 'p1' AND dst NOT IN (SELECT node FROM h1)) SELECT 'p1' AS seed, 'p1' AS node, 0 AS hops UNION ALL SELECT 'p1', node, 1 FROM h1 UNION ALL SELECT 'p1', node, 2 FROM h2")
def k_hop(spark, d):
    """Nodes within two hops of a seed, each with its distance."""
    return G.k_hop(graph_edges(spark, d), _seeds(spark, "p1"), 2)


@query("shortest_path", f"{E}, h1 AS (SELECT DISTINCT dst AS node FROM adj WHERE src = 'p1'), h2 AS (SELECT dst AS node, min(src) AS via FROM adj WHERE src IN (SELECT node FROM h1) AND dst <> 'p1' AND dst NOT IN (SELECT node FROM h1) GROUP BY dst) SELECT node, 0::BIGINT AS hops, 'p1' AS path FROM (VALUES ('p1')) v(node) UNION ALL SELECT node, 1, 'p1>' || node FROM h1 UNION ALL SELECT node, 2, 'p1>' || via || '>' || node FROM h2")
def shortest_path(spark, d):
    """One shortest path to each node within two hops."""
    return G.shortest_paths(graph_edges(spark, d), _seeds(spark, "p1"), 2).select("node", F.col("hops").cast("long").alias("hops"), F.array_join("path", ">").alias("path"))


@query("components", "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders) SELECT a AS node, least(a, a) AS component FROM e GROUP BY a UNION ALL SELECT b, min(a) FROM e GROUP BY b")
def components(spark, d):
    """Connected components of customers and their orders: stars around customers, named by their smallest node."""
    e = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit(1).alias("weight"))
    return G.components(e)


_ROUNDS = ", ".join(f"r{i} AS (SELECT l.dst AS node, 0.15::DOUBLE / n.n + 0.85::DOUBLE * sum(r.rank * l.share) AS rank FROM links l JOIN r{i - 1} r ON r.node = l.src, n GROUP BY l.dst, n.n)" for i in range(1, 21))


@query("pagerank", f"{E}, links AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM adj), n AS (SELECT count(DISTINCT src) AS n FROM links), r0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE / n AS rank FROM links, n), {_ROUNDS} SELECT node, round(rank / (SELECT sum(rank) FROM r20), 8) AS rank FROM r20")
def pagerank(spark, d):
    """Twenty rounds of weighted undirected PageRank."""
    return G.pagerank(graph_edges(spark, d)).select("node", F.round("rank", 8).alias("rank"))


WEIGHED = """we AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, avg(l_quantity) / 40 AS weight FROM lineitem GROUP BY 1, 2),
wa AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM we UNION ALL SELECT dst, src, weight FROM we) GROUP BY 1, 2), wd AS (SELECT src, count(*) AS g FROM wa GROUP BY src),
ok AS (SELECT wa.src, dst, least(weight, 1) AS weight FROM wa JOIN wd ON wd.src = wa.src WHERE g <= 200),
h1 AS (SELECT dst AS node, max(0.7::DOUBLE * weight) AS a, count(*) AS p FROM ok WHERE src IN ('p1', 'p2') AND dst NOT IN ('p1', 'p2') AND 0.7::DOUBLE * weight >= 0.3 GROUP BY dst),
f1 AS (SELECT node, a FROM h1 ORDER BY a DESC, node LIMIT 200),
h2 AS (SELECT dst AS node, max(a * 0.4::DOUBLE * weight) AS a, count(*) AS p FROM ok JOIN f1 ON node = src WHERE dst NOT IN ('p1', 'p2') AND a * 0.4::DOUBLE * weight >= 0.3 GROUP BY dst),
lv AS (SELECT node, max(a) AS a, sum(p) AS p FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node),
act AS (SELECT node, round(least(1, a * CASE least(p, 5) WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.2 WHEN 3 THEN 1.5 WHEN 4 THEN 1.8 ELSE 2.0 END), 4) AS activation FROM lv)"""


def weighed_edges(spark, d):
    """Part -> supplier edges weighted by mean quantity, mostly below 1."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg((F.avg("l_quantity") / 40).alias("weight"))


@query("spread_activation", f"WITH {WEIGHED} SELECT node, activation FROM act WHERE activation >= 0.3")
def spread_activation(spark, d):
    """Two hops of fading activation over weighted edges; several paths add, hubs pass nothing on."""
    return G.spread(weighed_edges(spark, d), _seeds(spark, "p1", "p2"))


@query("transitive_infer", "WITH e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) SELECT a.src, b.dst, min(a.dst) AS via FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2")
def transitive_infer(spark, d):
    """Two-hop relations without a direct one."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return G.transitive(c.unionByName(n))


@query("induced_subgraph", f"{E}, k AS (SELECT node FROM (SELECT src AS node, count(*) AS g FROM adj GROUP BY 1) WHERE g >= 30) SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def induced_subgraph(spark, d):
    """Edges between nodes of thirty neighbours or more."""
    e = graph_edges(spark, d)
    return G.induced(e, G.degrees(e).where("degree >= 30").select("node")).select("src", "dst", "weight")


@query("orphan_nodes", "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_nodes(spark, d):
    """Nodes without a strong edge."""
    nodes = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    li = table(spark, d, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return G.orphans(nodes, li)


@query("node_upsert", "SELECT p_type AS kind, lower(trim(p_name)) AS name_norm, min(p_partkey) AS node, count(*) AS mentions FROM part GROUP BY 1, 2")
def node_upsert(spark, d):
    """Nodes unique by kind and normalised name, with mention counts."""
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind"), F.lower(F.trim("p_name")).alias("name_norm")).agg(F.min("p_partkey").alias("node"), F.count("*").alias("mentions"))


@query("edge_reinforce", "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n, round(least(10, 1 + 0.1::DOUBLE * (count(*) - 1)), 6) AS weight FROM lineitem GROUP BY 1, 2")
def edge_reinforce(spark, d):
    """Edge weights from a log: each repeat strengthens, up to a limit."""
    e = G.reinforce(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    return e.withColumn("weight", F.round("weight", 6))


@query("chain_edges", "SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL")
def chain_edges(spark, d):
    """Edges from each record to the next of its key."""
    return G.chain(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("concept_neighbours", f"{E} SELECT dst AS node, max(weight) AS weight FROM adj WHERE src IN ('p1', 'p2', 'p3') GROUP BY dst")
def concept_neighbours(spark, d):
    """The strongest edge to each neighbour of named nodes; names reach the edge scan."""
    adj = G.undirected(graph_edges(spark, d)).where(F.col("src").isin("p1", "p2", "p3"))
    return adj.groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("weight"))


@query("common_reach", f"{E} SELECT dst AS node FROM adj WHERE src IN ('p1', 'p2') GROUP BY dst HAVING count(DISTINCT src) = 2")
def common_reach(spark, d):
    """Nodes that all seeds reach in one hop."""
    r = G.k_hop(graph_edges(spark, d), _seeds(spark, "p1", "p2"), 1).where("hops = 1")
    return r.groupBy("node").agg(F.countDistinct("seed").alias("n")).where("n = 2").select("node")


@query("activated_records", "SELECT l_orderkey AS record, round(sum(CASE l_partkey WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5 ELSE 0.25 END * l_quantity / 50), 6) AS score FROM lineitem WHERE l_partkey IN (1, 2, 3) GROUP BY 1")
def activated_records(spark, d):
    """Activation times link strength, summed by record; the activation map is an inline table."""
    a = F.broadcast(spark.sql("SELECT * FROM VALUES (1L, 1.0D), (2L, 0.5D), (3L, 0.25D) AS a(l_partkey, act)"))  # three rows
    return table(spark, d, "lineitem").join(a, "l_partkey").groupBy(F.col("l_orderkey").alias("record")).agg(F.round(F.sum(F.col("act") * F.col("l_quantity") / 50), 6).alias("score"))


@query("greedy_cover")
def greedy_cover(spark, d):
    """Up to five suppliers that together cover most part types of a brand, picked greedily; each group is one brand's small matrix of types."""
    import pandas as pd

    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    cells = li.join(p, li["l_partkey"] == p["p_partkey"]).select("p_brand", "l_suppkey", "p_type").distinct()
    sets = cells.groupBy("p_brand", "l_suppkey").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    # suppliers with the same types are interchangeable: one each, so a group holds as many rows as there are type sets
    sets = sets.groupBy("p_brand", "types").agg(F.min("l_suppkey").alias("supplier"))

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        left, out = {t for ts in g.types for t in ts}, []
        rows = sorted(zip(g.supplier, g.types, strict=True), key=lambda r: r[0])
        while left and len(out) < 5:
            s, ts = max(rows, key=lambda r: len(left.intersection(r[1])))
            out.append((g.p_brand.iloc[0], len(out) + 1, int(s), len(left.intersection(ts))))
            left -= set(ts)
        return pd.DataFrame(out, columns=["p_brand", "position", "supplier", "covers"])

    return sets.groupBy("p_brand").applyInPandas(pick, "p_brand string, position long, supplier long, covers long")
