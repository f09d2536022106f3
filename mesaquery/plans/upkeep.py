"""The write path: repeats, value updates, merges, entities, tags; upkeep of graph and periods."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import text as T
from ..operators import dedup as D
from ..operators import graph as G
from ..operators import grouping, temporal, vectors
from ..session import graph_edges, knowledge, table, tool_calls, with_
from .registry import query
from .retrieval import _COS, TOK

K, C, E = with_("knowledge"), with_("calls"), with_("edges")
_WORDS = r"list_distinct(string_split(regexp_replace(trim(lower(text)), '\s+', ' ', 'g'), ' '))"


def _word_sets(spark, d):
    """Records as sets of blank-separated words, in groups of one project and type."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("id"), F.struct("source", "lang").alias("block"), F.split(T.normalised(F.col("text")), " ").alias("items"), F.length("text").alias("n"))


_PAIRS = rf"""w AS (SELECT min(doc_id) AS id, source, lang, list_sort({_WORDS}) AS s FROM documents WHERE trim(text) <> '' GROUP BY source, lang, s), x AS (SELECT id, source, lang, len(s) AS c, unnest(s) AS t FROM w),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.c) AS ca, any_value(b.c) AS cb FROM x a JOIN x b ON a.t = b.t AND a.source = b.source AND a.lang = b.lang AND a.id < b.id GROUP BY 1, 2), l AS (SELECT a, b FROM p WHERE k::DOUBLE / (ca + cb - k) > 0.75)"""


@query("similar_groups", f"WITH {_PAIRS} SELECT a, b FROM l")
def similar_groups(spark, d):
    """Pairs of different word sets of one project and type that share more than three quarters of their words."""
    k = _word_sets(spark, d).where(F.size(F.filter("items", lambda x: x != "")) > 0)
    return D.similar_sets(k, 0.75)[0]


@query("group_consolidation")
def group_consolidation(spark, d):
    """Greedy groups of similar records of one project and type: the longest is kept, the others are consolidated into it."""
    k = _word_sets(spark, d).where(F.size(F.filter("items", lambda x: x != "")) > 0)
    return D.consolidate(k, 0.75)


@query("cosine_merges", """WITH RECURSIVE r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings),
f AS (SELECT label, rn, vec_id AS id, NULL::BIGINT AS keeper, [{'id': vec_id, 'e': e}] AS kept FROM r WHERE rn = 1
UNION ALL SELECT label, rn, id, hit, CASE WHEN hit IS NULL THEN list_append(kept, {'id': id, 'e': e}) ELSE kept END FROM (SELECT f.label, r.rn, r.vec_id AS id, r.e, f.kept, list_filter(f.kept, lambda k: list_cosine_similarity(k.e, r.e) >= 0.3)[1].id AS hit FROM f JOIN r ON r.label = f.label AND r.rn = f.rn + 1 WHERE r.rn <= 200))
SELECT id, keeper FROM f WHERE keeper IS NOT NULL""")
def cosine_merges(spark, d):
    """Older vectors of each label's newest two hundred, merged into a newer kept one; unrelated vectors are near at 0.3 already."""
    return vectors.window_dedup(table(spark, d, "embeddings"), "label", "vec_id", least=0.3)


@query("vector_band_join", "SELECT q.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON v.vec_id > q.vec_id WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) BETWEEN 0.3 AND 0.95")
def vector_band_join(spark, d):
    """All pairs of vectors within a band of similarity, block by block, far blocks left out."""
    return vectors.band_pairs(table(spark, d, "embeddings"), 0.3, 0.95).select("a", "b", F.round("score", 6).alias("score"))


@query("fact_merge")
def fact_merge(spark, d):
    """Related but not equal records in clusters of at most five: a band of similarity, components, parts in order."""
    p = vectors.band_pairs(table(spark, d, "embeddings"), 0.4, 0.95)
    c = G.components(p.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("weight")))
    parts = grouping.chunked(c, 5)
    size = parts.groupBy("component", "part").agg(F.count("*").alias("members")).where("members > 1")
    return parts.join(size, ["component", "part"]).select(F.col("node").alias("id"), "component", "part", "members")


_STATE = "SELECT p_partkey AS id, 'the ' || p_name || ' of ' || p_brand || ' is ' || lower(p_type) AS said, p_name, p_brand, lower(p_type) AS v FROM part"


@query("value_supersede", f"WITH s AS ({_STATE}), n AS (SELECT id, v, lead(id) OVER w AS by_id, lead(v) OVER w AS now FROM s WINDOW w AS (PARTITION BY p_name, p_brand ORDER BY id)) SELECT id, by_id AS superseded_by FROM n WHERE now IS NOT NULL AND now <> v")
def value_supersede(spark, d):
    """Statements whose value a later one of the same opening updates; candidates share their opening words, so no pairs are made but neighbours."""
    p = table(spark, d, "part")
    said = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand", F.lit(" is "), F.lower("p_type"))
    s = p.select(F.col("p_partkey").alias("id"), T.statement_tokens(said).alias("t"))
    opening = F.slice("t", F.lit(1), F.greatest(F.lit(1), F.size("t") - 1))
    w = W.partitionBy(opening).orderBy("id")
    n = s.withColumn("superseded_by", F.lead("id").over(w)).withColumn("u", F.lead("t").over(w)).where("u IS NOT NULL")
    return n.where(T.updates_value(F.col("u"), F.col("t"))).select("id", "superseded_by")


@query("tag_canonical", "WITH v(word) AS (VALUES ('economy'), ('standard'), ('small'), ('promo'), ('large')), a(alias, word) AS (VALUES ('medium', 'standard')), t AS (SELECT DISTINCT lower(p_type) AS tag FROM part), l AS (SELECT tag, word, 1 - levenshtein(tag, word)::DOUBLE / greatest(length(tag), length(word)) AS r FROM t, v), b AS (SELECT tag, arg_max(word, (r, word)) AS near, max(r) AS r FROM l GROUP BY tag), s AS (SELECT tag, min(word) AS part FROM t, v WHERE contains(tag, word) OR contains(word, tag) GROUP BY tag) SELECT t.tag, coalesce(x.word, a.word, part, CASE WHEN r >= 0.5 THEN near END, t.tag) AS canonical, CASE WHEN x.word IS NOT NULL THEN 'exact' WHEN a.word IS NOT NULL THEN 'alias' WHEN part IS NOT NULL THEN 'substring' WHEN r >= 0.5 THEN 'edit' ELSE 'new' END AS how FROM t LEFT JOIN v x ON x.word = t.tag LEFT JOIN a ON a.alias = t.tag LEFT JOIN s ON s.tag = t.tag LEFT JOIN b ON b.tag = t.tag")
def tag_canonical(spark, d):
    """Tags to a small vocabulary: exact, alias, part of a word, edit distance, else new."""
    words = ("economy", "standard", "small", "promo", "large")
    t = table(spark, d, "part").select(F.lower("p_type").alias("tag")).distinct()
    tag, aliases = F.col("tag"), {"medium": "standard"}
    exact = F.when(tag.isin(*words), tag)
    alias = F.coalesce(*(F.when(tag == a, F.lit(w)) for a, w in aliases.items()))
    part = F.array_min(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(tag, w) | F.contains(w, tag)))
    near = F.array_max(F.transform(F.array(*map(F.lit, words)), lambda w: F.struct(T.levenshtein_ratio(tag, w).alias("r"), w.alias("w"))))
    edit = F.when(near["r"] >= 0.5, near["w"])
    how = F.when(exact.isNotNull(), "exact").when(alias.isNotNull(), "alias").when(part.isNotNull(), "substring").when(edit.isNotNull(), "edit").otherwise("new")
    return t.select("tag", F.coalesce(exact, alias, part, edit, tag).alias("canonical"), how.alias("how"))


@query("entity_dedup", f"WITH c AS (SELECT q.vec_id AS tag, v.vec_id AS entity, round({_COS}, 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 50 AND v.vec_id % 100 <> 50), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, entity) AS rn FROM c) SELECT tag, CASE WHEN score >= 0.35 THEN entity END AS entity, round(score, 6) AS score FROM r WHERE rn = 1")
def entity_dedup(spark, d):
    """New entities matched to the nearest known one, if it is near enough."""
    from ..operators import retrieval as R

    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    s = R.cosine_scores(v.where("vec_id % 100 <> 50"), q).withColumn("score", F.round("score", 9))
    return R.top_k(s, 1).select(F.col("query_id").alias("tag"), F.when(F.col("score") >= 0.35, F.col("id")).alias("entity"), F.round("score", 6).alias("score"))


@query("canonical_merge", "WITH m AS (SELECT p_name, p_brand, min(p_partkey) AS keep FROM part GROUP BY 1, 2) SELECT p_partkey AS alias, keep AS entity FROM part JOIN m USING (p_name, p_brand) WHERE p_partkey <> keep")
def canonical_merge(spark, d):
    """Aliases repointed to the entity kept of each group of equals."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    keep = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("entity"))
    return p.join(keep, ["p_name", "p_brand"]).where("p_partkey <> entity").select(F.col("p_partkey").alias("alias"), "entity")


@query("mention_keys", r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS mention_md5 FROM documents")
def mention_keys(spark, d):
    """Mentions as keys: marks folded, punctuation as blanks, lower case."""
    key = F.trim(F.regexp_replace(F.lower(T.fold_accents(F.col("text"))), r"[^\p{L}\p{N}]+", " "))
    return table(spark, d, "documents").select("doc_id", F.md5(key).alias("mention_md5"))


@query("private_sections", r"WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '<private>' || text || '</private> kept' ELSE text END AS x FROM conversations) SELECT conv_id, turn, md5(regexp_replace(x, '(?s)<private>.*?</private>', '[PRIVATE]', 'g')) AS clean_md5, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n FROM t")
def private_sections(spark, d):
    """Private sections replaced and counted."""
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<private>"), "text", F.lit("</private> kept"))).otherwise(F.col("text"))
    t = table(spark, d, "conversations").select("conv_id", "turn", x.alias("x"))
    return t.select("conv_id", "turn", F.md5(T.strip_private(F.col("x"), "[PRIVATE]")).alias("clean_md5"), T.count_private(F.col("x")).alias("n"))


@query("importance_summary", "SELECT user_id, ts::DATE AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS level, count(*) AS asked, greatest(count(*) - 2, 0) AS lowered FROM events GROUP BY 1, 2, 3")
def importance_summary(spark, d):
    """What was asked of each level a user and day, and how much of it was lowered."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("level"))
    return e.groupBy("user_id", "day", "level").agg(F.count("*").alias("asked"), F.greatest(F.count("*") - 2, F.lit(0)).alias("lowered"))


@query("archive_by_source", "SELECT doc_id AS id, round(pow(2, -greatest(0, date_diff('day', TIMESTAMP '2024-01-01' + to_hours(doc_id), TIMESTAMP '2024-12-01') - 10 * (doc_id % 4)) / 90.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * (doc_id % 10) / 10) * CASE WHEN lang = 'en' THEN 1.2::DOUBLE WHEN lang = 'de' THEN 0.8 ELSE 1 END, 9) AS keep FROM documents")
def archive_by_source(spark, d):
    """2 ** -(age, less ten days a use, over the half-life), by confidence and by how far the source is trusted."""
    k = knowledge(spark, d)
    age = F.greatest(F.lit(0), F.datediff(F.to_date(F.lit("2024-12-01")), F.to_date("created_at")) - 10 * (F.col("id") % 4))
    source = F.when(F.col("type") == "en", 1.2).when(F.col("type") == "de", 0.8).otherwise(1.0)
    return k.select("id", F.round(F.pow(F.lit(2.0), -age / 90.0) * (0.5 + 0.5 * (F.col("id") % 10) / 10) * source, 9).alias("keep"))


# --- graph -------------------------------------------------------------------


@query("edge_prune", "SELECT l_partkey AS src, l_suppkey AS dst, round(avg(l_quantity) / 50 * CASE WHEN max(l_shipdate) < TIMESTAMP '2000-01-01' THEN 0.5::DOUBLE ELSE 1 END, 6) AS weight FROM lineitem GROUP BY 1, 2 HAVING avg(l_quantity) / 50 * CASE WHEN max(l_shipdate) < TIMESTAMP '2000-01-01' THEN 0.5::DOUBLE ELSE 1 END >= 0.4")
def edge_prune(spark, d):
    """Edges without recent use are weakened; those under the least weight go."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((F.avg("l_quantity") / 50).alias("w"), F.max("l_shipdate").alias("last"))
    w = F.col("w") * F.when(F.col("last") < F.lit("2000-01-01").cast("timestamp_ntz"), 0.5).otherwise(1.0)
    return e.withColumn("w", w).where("w >= 0.4").select("src", "dst", F.round("w", 6).alias("weight"))


@query("stale_nodes", "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AND p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2001-06-01' AND count(*) <= 30)")
def stale_nodes(spark, d):
    """Nodes not seen lately, without a strong link and with few mentions: to be archived."""
    li = table(spark, d, "lineitem")
    old = li.groupBy(F.col("l_partkey").alias("node")).agg(F.max("l_shipdate").alias("last"), F.count("*").alias("n")).where((F.col("last") < F.lit("2001-06-01").cast("timestamp_ntz")) & (F.col("n") <= 30)).select("node")
    return old.join(table(spark, d, "part").select(F.col("p_partkey").alias("node")), "node", "left_semi").join(li.where("l_quantity >= 49").select(F.col("l_partkey").alias("node")), "node", "left_anti")


@query("adjacency_cells", f"{E}, g AS (SELECT src AS node, sum(weight) AS m FROM edges GROUP BY 1 UNION ALL SELECT dst, sum(weight) FROM edges GROUP BY 1), t AS (SELECT node, row_number() OVER (ORDER BY m DESC, node) - 1 AS i FROM g), k AS (SELECT * FROM t WHERE i < 200) SELECT a.i AS i, b.i AS j, weight FROM edges JOIN k a ON a.node = src JOIN k b ON b.node = dst")
def adjacency_cells(spark, d):
    """The two hundred most mentioned nodes, numbered, and the cells of their matrix."""
    e = graph_edges(spark, d)
    m = e.select(F.col("src").alias("node"), "weight").unionByName(e.select(F.col("dst").alias("node"), "weight")).groupBy("node").agg(F.sum("weight").alias("m"))
    top = m.orderBy(F.desc("m"), "node").limit(200)
    k = top.select("node", (F.row_number().over(W.orderBy(F.desc("m"), "node")) - 1).cast("long").alias("i"))  # two hundred rows
    a, b = F.broadcast(k.select(F.col("node").alias("src"), "i")), F.broadcast(k.select(F.col("node").alias("dst"), F.col("i").alias("j")))
    return e.join(a, "src").join(b, "dst").select("i", "j", "weight")


_ROUND = 20


@query("pagerank_importance", f"""{E}, adj AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY 1, 2), links AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS share FROM adj), n AS (SELECT count(DISTINCT src) AS n FROM links), r0 AS (SELECT DISTINCT src AS node, 1.0::DOUBLE / n AS rank FROM links, n),
{", ".join(f"r{i} AS (SELECT l.dst AS node, 0.15::DOUBLE / n.n + 0.85::DOUBLE * sum(r.rank * l.share) AS rank FROM links l JOIN r{i - 1} r ON r.node = l.src, n GROUP BY l.dst, n.n)" for i in range(1, _ROUND + 1))} SELECT node, round(rank / (SELECT max(rank) FROM r{_ROUND}), 4) AS importance FROM r{_ROUND}""")
def pagerank_importance(spark, d):
    """Ranks as shares of the greatest, to be written back as importance."""
    r = G.pagerank(graph_edges(spark, d), _ROUND)
    return r.join(F.broadcast(r.agg(F.max("rank").alias("_m")))).select("node", F.round(F.col("rank") / F.col("_m"), 4).alias("importance"))  # one row


_SPARSE = "se AS (SELECT DISTINCT l_orderkey % 400 AS a, 400 + l_partkey % 397 AS b FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1 AND l_orderkey % 7 = 0)"


@query("communities", f"WITH RECURSIVE {_SPARSE}, u AS (SELECT a AS x, b AS y FROM se UNION SELECT b, a FROM se), r AS (SELECT DISTINCT x AS node, x AS reach FROM u UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.reach), c AS (SELECT node, min(reach) AS community FROM r GROUP BY node), s AS (SELECT community, count(*) AS members FROM c GROUP BY 1 HAVING count(*) >= 3) SELECT node, community, members FROM c JOIN s USING (community)")
def communities(spark, d):
    """Components of three nodes or more in a sparse graph of chains and cycles."""
    li = table(spark, d, "lineitem").where("l_quantity = 50 AND l_linenumber = 1 AND l_orderkey % 7 = 0")
    e = li.select((F.col("l_orderkey") % 400).alias("src"), (400 + F.col("l_partkey") % 397).alias("dst"), F.lit(1).alias("weight")).distinct()
    c = G.components(e)
    s = c.groupBy("component").agg(F.count("*").alias("members")).where("members >= 3")
    return c.join(s, "component").select("node", F.col("component").alias("community"), "members")


@query("associative_recall", f"WITH {__import__('mesaquery.plans.graphs', fromlist=['WEIGHED']).WEIGHED}, full_ AS (SELECT node, activation FROM act WHERE activation >= 0.3 UNION ALL SELECT 'p1', 1.0 UNION ALL SELECT 'p2', 1.0), m AS (SELECT l_orderkey AS record, round(sum(activation * l_quantity / 50), 9) AS score FROM full_ JOIN lineitem ON node = 'p' || l_partkey GROUP BY 1) SELECT record, round(score, 6) AS score FROM m ORDER BY score DESC, record LIMIT 20")
def associative_recall(spark, d):
    """From concepts in a question to seed nodes, over spreading activation, to the records linked most strongly."""
    from .graphs import _seeds, weighed_edges

    seeds = _seeds(spark, "p1", "p2")
    active = G.spread(weighed_edges(spark, d), seeds).unionByName(seeds.select(F.col("seed").alias("node"), F.lit(1.0).alias("activation")))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.concat(F.lit("p"), "l_partkey").alias("node"), (F.col("l_quantity") / 50).alias("strength"))
    m = links.join(active, "node").groupBy("record").agg(F.round(F.sum(F.col("activation") * F.col("strength")), 9).alias("score"))
    return m.orderBy(F.desc("score"), "record").limit(20).select("record", F.round("score", 6).alias("score"))


@query("coverage_matrix", "SELECT p_brand, l_suppkey AS supplier, count(DISTINCT p_type) AS covers, list_sort(list(DISTINCT p_type)) AS types FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def coverage_matrix(spark, d):
    """Which concepts each record of a brand covers."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    g = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("supplier")).join(p, "l_partkey").groupBy("p_brand", "supplier").agg(F.array_sort(F.collect_set("p_type")).alias("types"))  # types are a small domain
    return g.select("p_brand", "supplier", F.size("types").cast("long").alias("covers"), "types")


@query("unlinked_nodes", "SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_tax > 0.07 AND l_partkey IS NOT NULL)")
def unlinked_nodes(spark, d):
    """Nodes without an edge and without a record: one anti join against the union of both."""
    li = table(spark, d, "lineitem")
    used = li.where("l_quantity > 49").select("l_partkey").unionByName(li.where("l_tax > 0.07").select("l_partkey")).distinct()
    return table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.concat(F.lit("p"), "p_partkey").alias("node"))


@query("edges_by_relation", "SELECT DISTINCT l_suppkey AS other, l_returnflag AS relation, 'out' AS direction FROM lineitem WHERE l_partkey = 1 AND l_returnflag IN ('R', 'A') UNION ALL SELECT DISTINCT l_partkey, l_returnflag, 'in' FROM lineitem WHERE l_suppkey = 1 AND l_returnflag IN ('R', 'A')")
def edges_by_relation(spark, d):
    """A node's edges of some relations, in both directions."""
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    side = lambda own, other, name: li.where(F.col(own) == 1).select(F.col(other).alias("other"), F.col("l_returnflag").alias("relation"), F.lit(name).alias("direction")).distinct()
    return side("l_partkey", "l_suppkey", "out").unionByName(side("l_suppkey", "l_partkey", "in"))


@query("name_lookup", "SELECT p_partkey AS id FROM part WHERE lower(trim(p_name)) = lower(trim('  Red WIDGET '))")
def name_lookup(spark, d):
    """Nodes by their normalised name."""
    return table(spark, d, "part").where(F.lower(F.trim("p_name")) == F.lower(F.trim(F.lit("  Red WIDGET ")))).select(F.col("p_partkey").alias("id"))


@query("error_listing", f"{C} SELECT id, actor, k FROM calls WHERE NOT ok AND k >= 5 ORDER BY ts DESC, id LIMIT 25 OFFSET 5")
def error_listing(spark, d):
    """Errors by severity, newest first, a page."""
    return tool_calls(spark, d).where(~F.col("ok") & (F.col("k") >= 5)).orderBy(F.desc("ts"), "id").offset(5).limit(25).select("id", "actor", "k")


@query("lateral_neighbours", "WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), a AS (SELECT a.conv_id, a.turn AS anchor, b.turn, abs(b.n - a.n) AS distance, b.n > a.n AS later FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.n <> a.n AND abs(b.n - a.n) <= 2 WHERE a.turn % 3 = 1), d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY distance, anchor) AS seen FROM a) SELECT conv_id, anchor, turn, row_number() OVER (PARTITION BY conv_id, anchor ORDER BY distance, later) AS place FROM d WHERE seen = 1")
def lateral_neighbours(spark, d):
    """Two neighbours on both sides of each anchor, nearest first; one that several anchors have goes to the nearest."""
    c = table(spark, d, "conversations").select("conv_id", "turn").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    offsets = F.explode(F.array(*(F.lit(o) for o in (-2, -1, 1, 2))))
    a = c.where("turn % 3 = 1").select("conv_id", F.col("turn").alias("anchor"), F.col("n").alias("at"), offsets.alias("o"))
    near = a.withColumn("n", F.col("at") + F.col("o")).join(c, ["conv_id", "n"]).select("conv_id", "anchor", "turn", F.abs("o").alias("distance"), (F.col("o") > 0).alias("later"))
    once = near.withColumn("seen", F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("distance", "anchor"))).where("seen = 1")
    return once.select("conv_id", "anchor", "turn", F.row_number().over(W.partitionBy("conv_id", "anchor").orderBy("distance", "later")).cast("long").alias("place"))


@query("version_chain", "SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS origin, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_chain(spark, d):
    """Origin, latest version and depth of every record, by walking superseded-by pointers in both directions; each round doubles the step."""
    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pointers = o.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"))
    return temporal.chains(pointers).select("id", "origin", "latest", "depth")


@query("episode_boundaries", f"""{K}, j AS (SELECT id, project, type, created_at, embedding FROM knowledge JOIN embeddings ON vec_id = id), l AS (SELECT *, lag(created_at) OVER w AS was, lag(type) OVER w AS before, lag(embedding) OVER w AS pv FROM j WINDOW w AS (PARTITION BY project ORDER BY created_at, id)),
b AS (SELECT id, project, created_at, CASE WHEN was IS NULL OR epoch(created_at) - epoch(was) > 86400 OR 1 - list_cosine_similarity(embedding::DOUBLE[], pv::DOUBLE[]) > 1.1 OR before <> type THEN 1 ELSE 0 END AS s FROM l) SELECT id, sum(s) OVER (PARTITION BY project ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM b""")
def episode_boundaries(spark, d):
    """Episodes end at a long silence, at a drop in similarity, or where no tag is shared."""
    k = knowledge(spark, d)
    j = k.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id").withColumn("tags", F.array("type"))
    return temporal.topic_episodes(j, "project", "created_at", "embedding", "tags", gap_seconds=86400, drop=1.1).select("id", F.col("episode").cast("long").alias("episode"))


@query("newest_per_project", f"{K} SELECT project, arg_max(id, (created_at, id)) AS id, max(created_at) AS newest FROM knowledge GROUP BY project")
def newest_per_project(spark, d):
    """The newest record of each project."""
    g = knowledge(spark, d).groupBy("project").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("newest"))
    return g.select("project", "id", F.col("newest").cast("timestamp_ntz").alias("newest"))


@query("event_times", """WITH x AS (SELECT event_id, ts::DATE AS o, CASE event_id % 7 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'today' WHEN 2 THEN 'last week' WHEN 3 THEN 'this week' WHEN 4 THEN 'last year' WHEN 5 THEN strftime(ts, '%Y-%m') ELSE 'some day' END AS e FROM events)
SELECT event_id, CASE e WHEN 'yesterday' THEN o - 1 WHEN 'today' THEN o WHEN 'last week' THEN date_trunc('week', o)::DATE - 7 WHEN 'this week' THEN date_trunc('week', o)::DATE WHEN 'last year' THEN make_date(year(o) - 1, 1, 1) WHEN 'some day' THEN NULL ELSE date_trunc('month', o)::DATE END AS first_day, CASE e WHEN 'yesterday' THEN o - 1 WHEN 'today' THEN o WHEN 'last week' THEN date_trunc('week', o)::DATE - 1 WHEN 'this week' THEN date_trunc('week', o)::DATE + 6 WHEN 'last year' THEN make_date(year(o) - 1, 12, 31) WHEN 'some day' THEN NULL ELSE last_day(o) END AS last_day, CASE e WHEN 'yesterday' THEN 'day' WHEN 'today' THEN 'day' WHEN 'last week' THEN 'week' WHEN 'this week' THEN 'week' WHEN 'last year' THEN 'year' WHEN 'some day' THEN 'unknown' ELSE 'month' END AS precision FROM x""")
def event_times(spark, d):
    """Time expressions with the day they were said on, as first day, last day and precision."""
    said = F.element_at(F.array(*(F.lit(x) for x in ("yesterday", "today", "last week", "this week", "last year")), F.date_format("ts", "yyyy-MM"), F.lit("some day")), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", F.to_date("ts").alias("o"), said.alias("e"))
    x = I.event_time(F.col("e"), F.col("o"))
    return e.select("event_id", x["first"].alias("first_day"), x["last"].alias("last_day"), x["precision"].alias("precision"))


@query("temporal_index", r"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '[2023-05-0' || (conv_id % 9 + 1) || '] ' || text WHEN 1 THEN text || ' on 2022-03-1' || (conv_id % 9) || ' and 2022-11-20' ELSE text END AS x, CASE WHEN turn % 4 = 2 THEN 'Q' || (conv_id % 4 + 1) || '-2021' ELSE 'none' END AS tag FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN make_date(2023, 5, (conv_id % 9 + 1)::INTEGER) WHEN 1 THEN make_date(2022, 3, (10 + conv_id % 9)::INTEGER) WHEN 2 THEN make_date(2021, ((conv_id % 4) * 3 + 1)::INTEGER, 1) END AS first_day, CASE turn % 4 WHEN 0 THEN make_date(2023, 5, (conv_id % 9 + 1)::INTEGER) WHEN 1 THEN DATE '2022-11-20' WHEN 2 THEN last_day(make_date(2021, ((conv_id % 4) * 3 + 3)::INTEGER, 1)) END AS last_day, CASE turn % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'content' ELSE 'tag' END AS source FROM c WHERE turn % 4 < 3""")
def temporal_index(spark, d):
    """The best date range of each record: its entry stamp, else the span of dates it names, else its tags."""
    c, t = F.col("conv_id"), F.col("turn") % 4
    x = F.when(t == 0, F.concat(F.lit("[2023-05-0"), (c % 9 + 1).cast("string"), F.lit("] "), "text")).when(t == 1, F.concat("text", F.lit(" on 2022-03-1"), (c % 9).cast("string"), F.lit(" and 2022-11-20"))).otherwise(F.col("text"))
    tag = F.when(t == 2, F.concat(F.lit("Q"), (c % 4 + 1).cast("string"), F.lit("-2021"))).otherwise("none")
    r = table(spark, d, "conversations").select("conv_id", "turn", I.best_range(x, F.array(tag)).alias("r")).where("r IS NOT NULL")
    return r.select("conv_id", "turn", F.col("r.first").alias("first_day"), F.col("r.last").alias("last_day"), F.col("r.source").alias("source"))


@query("predicate_canonical", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'sees' WHEN event_type IN ('purchase', 'signup') THEN 'joins' ELSE event_type END AS predicate FROM events")
def predicate_canonical(spark, d):
    """Predicates by their alias group; unknown ones stand for themselves, normalised."""
    form = F.regexp_replace(F.lower(F.trim("event_type")), r"[\s\-]+", "_")
    groups = {"sees": ("click", "view"), "joins": ("purchase", "signup")}
    out = form
    for name, forms in groups.items():
        out = F.when(form.isin(*forms), name).otherwise(out)
    return table(spark, d, "events").select("event_id", out.alias("predicate"))


@query("interval_check", "SELECT o_orderkey AS id, CASE WHEN b < a THEN 'invalid' WHEN b = a AND NOT (cs AND ce) THEN 'invalid' WHEN b = a THEN 'instant' ELSE 'interval' END AS kind, CASE WHEN b >= a AND (b > a OR (cs AND ce)) THEN ((x > a OR (x = a AND cs)) AND (x < b OR (x = b AND ce))) END AS holds FROM (SELECT o_orderkey, o_orderkey % 10 AS a, (o_orderkey // 10) % 10 AS b, o_orderkey % 2 = 0 AS cs, o_orderkey % 3 = 0 AS ce, 5 AS x FROM orders)")
def interval_check(spark, d):
    """Intervals with open or closed ends: whether they are valid, and whether they hold a point; one of no length needs both ends closed."""
    k = F.col("o_orderkey")
    i = I.interval(k % 10, F.floor(k / 10) % 10, k % 2 == 0, k % 3 == 0)
    return table(spark, d, "orders").select(k.alias("id"), I.interval_kind(i).alias("kind"), F.when(I.interval_kind(i) != "invalid", I.holds(i, F.lit(5))).alias("holds"))


@query("timestamp_forms", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def timestamp_forms(spark, d):
    """Written timestamps of several forms (blank or T, Z or an offset, with or without seconds' parts) as one UTC time."""
    t = F.date_trunc("second", "ts").cast("timestamp")
    form = F.col("event_id") % 4
    raw = (
        F.when(form == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.concat(F.date_format(t + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    return table(spark, d, "events").select("event_id", I.canonical_time(raw).cast("timestamp_ntz").alias("at"))
