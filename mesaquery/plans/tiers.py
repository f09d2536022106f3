"""Tiers of recall: lexical terms, entities, episodes, directives, sub-queries, re-ranking and evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..functions import scoring as S
from ..functions import text as T
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.lexicon import lexicon
from ..session import graph_edges, knowledge, table, with_
from .registry import query
from .retrieval import _COS, QUERY, TOK, _queries, _vector_queries

K = with_("knowledge")
_TK = rf"{K}, tk AS (SELECT id, project, type, {TOK.format('content')} AS ts FROM knowledge), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM tk)"


def _bm(tag: str, text: str) -> str:
    """BM25 of one literal query over tk, as common table expressions that end in bm{tag}."""
    return rf"""qt{tag} AS (SELECT DISTINCT unnest({TOK.format(repr(text))}) AS term), po{tag} AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM qt{tag}) GROUP BY 1, 2),
df{tag} AS (SELECT term, count(*) AS df FROM po{tag} GROUP BY 1), bm{tag} AS (SELECT id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM po{tag} JOIN df{tag} USING (term), st GROUP BY 1)"""


def _lexical(spark, d, *texts: str):
    return R.bm25(knowledge(spark, d), _queries(spark, *texts)).withColumn("score", F.round("score", 9))


def _cosine(spark, d, query_id: int = 0):
    return R.cosine_scores(table(spark, d, "embeddings"), _vector_queries(spark, d).where(F.col("query_id") == query_id)).withColumn("score", F.round("score", 9))


_STOP = ", ".join(f"'{w}'" for w in sorted(Q.STOP))
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*')"


@query("term_extraction", f"WITH t AS (SELECT item_id, unnest({_TERMS}) AS term, generate_subscripts({_TERMS}, 1) AS pos FROM benchmark), f AS (SELECT item_id, term, min(pos) AS pos FROM t WHERE term NOT IN ({_STOP}) GROUP BY 1, 2), r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS place FROM f) SELECT item_id, place, term FROM r WHERE place <= 32")
def term_extraction(spark, d):
    """The first 32 lexical terms of every query: stop words gone, compounds whole, in order, without repeats."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*"), F.lit(0))
    kept = F.slice(F.array_distinct(F.filter(found, lambda x: ~x.isin(*Q.STOP))), 1, 32)
    return table(spark, d, "benchmark").select("item_id", F.posexplode(kept).alias("p", "term")).select("item_id", (F.col("p") + 1).cast("long").alias("place"), "term")


@query("folded_tokens", rf"SELECT doc_id, md5(array_to_string({TOK.format('strip_accents(text)')}, ' ')) AS tokens_md5 FROM documents")
def folded_tokens(spark, d):
    """Index tokens with accents folded, so that "cafe" finds "café"."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.tokens(T.fold_accents(F.col("text"))), " ")).alias("tokens_md5"))


@query("hyde_fusion", f"WITH q AS (SELECT v.vec_id AS id, round({_COS}, 9) AS score, q.vec_id AS q FROM embeddings v JOIN embeddings q ON q.vec_id IN (0, 100)), r AS (SELECT id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM q) SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS fused FROM r WHERE rk <= 100 GROUP BY id")
def hyde_fusion(spark, d):
    """A query's vector and a hypothetical answer's, given by the caller, fused by rank."""
    v = R.cosine_scores(table(spark, d, "embeddings"), _vector_queries(spark, d).where("query_id IN (0, 100)")).withColumn("score", F.round("score", 9))
    tier = lambda q: R.top_k(v.where(F.col("query_id") == q), 100).withColumn("query_id", F.lit(0))
    return R.rrf([(tier(0), 1.0), (tier(100), 1.0)]).select("id", F.round("fused", 6).alias("fused"))


_REL = "rel AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber = 1), both_ AS (SELECT a AS x, b AS y FROM rel UNION SELECT b, a FROM rel)"


def _relations(spark, d):
    """Explicit links between records, in both directions."""
    r = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("y"))
    return r.unionByName(r.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


_TOP5 = "top5 AS (SELECT id, 2 * score / max(score) OVER () AS score FROM bm0 ORDER BY score DESC, id LIMIT 5)"


def _seeds(spark, d, lexical=None):
    top = R.top_k(lexical or _lexical(spark, d, QUERY), 5)
    return R.max_normalised(top).select("id", (2 * F.col("normalised")).alias("score"))


@query("relation_tier", f"{_TK}, {_bm('0', QUERY)}, {_TOP5}, {_REL} SELECT y AS id, round(max(0.4::DOUBLE * score), 6) AS score FROM top5 JOIN both_ ON x = id WHERE y NOT IN (SELECT id FROM top5) AND y IN (SELECT id FROM knowledge) GROUP BY y")
def relation_tier(spark, d):
    """Records one explicit link from the five best, at four tenths of the best one's score."""
    return _linked(spark, d)


def _linked(spark, d, lexical=None):
    s = _seeds(spark, d, lexical)
    near = _relations(spark, d).join(F.broadcast(s), F.col("x") == F.col("id")).groupBy(F.col("y").alias("id")).agg(F.round(F.max(0.4 * F.col("score")), 6).alias("score"))  # five seeds
    return near.join(s.select("id"), "id", "left_anti").join(knowledge(spark, d).select("id"), "id", "left_semi")


@query("multi_hop", f"{_TK}, {_bm('0', QUERY)}, {_TOP5}, {_REL}, h1 AS (SELECT y AS id, max(score) * 0.4::DOUBLE AS score FROM top5 JOIN both_ ON x = id WHERE y NOT IN (SELECT id FROM top5) GROUP BY y), h2 AS (SELECT y AS id, max(score) * 0.2::DOUBLE AS score FROM h1 JOIN both_ ON x = id WHERE y NOT IN (SELECT id FROM top5) AND y NOT IN (SELECT id FROM h1) GROUP BY y) SELECT id, 1 AS hop, round(score, 6) AS score FROM h1 UNION ALL SELECT id, 2, round(score, 6) FROM h2")
def multi_hop(spark, d):
    """Two hops from the five best; a hop hands on 0.4 and 0.2 of the best parent's score, what was seen stays out."""
    rel, layer = _relations(spark, d), _seeds(spark, d)
    seen, out = layer.select("id"), None
    for hop in (1, 2):
        step = rel.join(layer, F.col("x") == F.col("id")).groupBy(F.col("y").alias("id")).agg((F.max("score") * (0.4 / hop)).alias("score")).join(seen, "id", "left_anti")
        layer = G.cut(step)
        seen = seen.unionByName(layer.select("id"))
        named = layer.select("id", F.lit(hop).alias("hop"), F.round("score", 6).alias("score"))
        out = named if out is None else out.unionByName(named)
    return out


@query("comention_search", "WITH p AS (SELECT l_orderkey AS r, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT r AS record FROM p WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY r HAVING count(DISTINCT p_brand) = 2")
def comention_search(spark, d):
    """Events that name both entities of a question: two semi joins, no pairs."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    of = lambda brand: li.join(table(spark, d, "part").where(F.col("p_brand") == brand).select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_orderkey").alias("record"))
    return of("Brand#2").distinct().join(of("Brand#17"), "record", "left_semi")


@query("graph_expand", """WITH l AS (SELECT l_orderkey AS r, l_partkey AS n, max(l_quantity / 50) AS s FROM lineitem GROUP BY 1, 2), e AS (SELECT l_partkey AS a, l_suppkey AS b, avg(l_quantity) / 50 AS w FROM lineitem GROUP BY 1, 2),
nb AS (SELECT DISTINCT b FROM e WHERE a IN (SELECT n FROM l WHERE r IN (1, 2, 3)) AND w >= 0.3), c AS (SELECT l_orderkey AS id, max(w) AS score FROM e JOIN nb USING (b) JOIN lineitem ON l_partkey = a AND l_suppkey = b WHERE w >= 0.3 AND l_orderkey NOT IN (1, 2, 3) GROUP BY 1)
SELECT id, round(score, 6) AS score FROM c ORDER BY round(score, 9) DESC, id LIMIT 10""")
def graph_expand(spark, d):
    """From three seed records over their nodes and strong edges to a budget of ten other records."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    e = li.groupBy("l_partkey", "l_suppkey").agg((F.avg("l_quantity") / 50).alias("w")).where("w >= 0.3")
    seeds = li.where(F.col("l_orderkey").isin(1, 2, 3)).select("l_partkey").distinct()
    near = e.join(seeds, "l_partkey", "left_semi").select("l_suppkey").distinct()
    hit = li.where(~F.col("l_orderkey").isin(1, 2, 3)).join(e.join(near, "l_suppkey", "left_semi"), ["l_partkey", "l_suppkey"])
    c = hit.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.max("w"), 9).alias("score"))
    return c.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


_CONV = rf"cv AS (SELECT conv_id, turn, {TOK.format('text')} AS ts FROM conversations), cl AS (SELECT conv_id AS id, sum(len(ts)) AS dl FROM cv GROUP BY 1), cs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM cl)"
EPISODE = "the of and that what was said in on"


@query("episode_tier", rf"""WITH {_CONV}, qt AS (SELECT DISTINCT unnest({TOK.format(repr(EPISODE))}) AS term), po AS (SELECT conv_id AS id, term, count(*) AS tf FROM (SELECT conv_id, unnest(ts) AS term FROM cv) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bm AS (SELECT id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM po JOIN df USING (term) JOIN cl USING (id), cs GROUP BY 1),
ce AS (SELECT v.vec_id AS id, round({_COS}, 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 0 WHERE v.vec_id IN (SELECT id FROM cl)),
t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM ce), f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS fused FROM t WHERE rk <= 50 GROUP BY id), k AS (SELECT id, row_number() OVER (ORDER BY fused DESC, id) AS place FROM f)
SELECT conv_id, turn, round(1.0::DOUBLE / place, 6) AS score FROM k JOIN conversations ON conv_id = id WHERE place <= 10""")
def episode_tier(spark, d):
    """Whole episodes ranked by words and by vectors, fused, then opened into their turns by the episode's place."""
    c = table(spark, d, "conversations")
    f = _episodes(spark, d, EPISODE)
    best = F.broadcast(R.top_k(f, 10, by="fused"))  # ten rows
    return c.join(best, c["conv_id"] == best["id"]).select("conv_id", "turn", F.round(1 / F.col("rank"), 6).alias("score"))


@query("episode_substring", "WITH q AS (SELECT unnest(['license', 'the', 'der', 'apache']) AS w), h AS (SELECT c.conv_id, c.turn, count(*) AS hits FROM conversations c, q WHERE contains(lower(c.text), w) GROUP BY 1, 2) SELECT conv_id, max(hits) AS hits FROM h GROUP BY 1")
def episode_substring(spark, d):
    """Without an index: how many distinct query words a text holds, anywhere in it."""
    words = ("license", "the", "der", "apache")
    hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(hits).alias("hits")).where("hits > 0")


def _episodes(spark, d, text: str, near=None):
    """Whole episodes (id) ranked by words and by vectors, fused."""
    c = table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("id"), F.col("text").alias("content"))
    b = R.bm25(turns, _queries(spark, text), index=lexicon(turns, parts=True)).withColumn("score", F.round("score", 9))
    v = (near or _cosine(spark, d)).join(c.select(F.col("conv_id").alias("id")).distinct(), "id", "left_semi")
    return R.rrf([(R.top_k(b, 50), 1.0), (R.top_k(v, 50), 1.0)]).withColumn("fused", F.round("fused", 9))


def _directives(spark, d, lexical=None, near=None):
    ids = knowledge(spark, d).where("project = 'src3'").select("id")
    b = R.max_normalised((lexical or _lexical(spark, d, QUERY)).join(ids, "id", "left_semi")).select("id", (0.5 * F.col("normalised")).alias("score"))
    return b.unionByName((near or _cosine(spark, d)).join(ids, "id", "left_semi").select("id", "score")).groupBy("id").agg(F.round(F.max("score"), 9).alias("score"))


@query("directive_tier", f"{_TK}, {_bm('0', QUERY)}, s AS (SELECT bm0.id, score FROM bm0 JOIN knowledge k ON k.id = bm0.id WHERE project = 'src3'), a AS (SELECT id, 0.5::DOUBLE * score / max(score) OVER () AS score FROM s UNION ALL SELECT v.vec_id, round({_COS}, 9) FROM embeddings v JOIN embeddings q ON q.vec_id = 0 WHERE v.vec_id IN (SELECT id FROM knowledge WHERE project = 'src3')), m AS (SELECT id, round(max(score), 9) AS score FROM a GROUP BY id) SELECT id, round(score, 6) AS score FROM m ORDER BY score DESC, id LIMIT 10")
def directive_tier(spark, d):
    """Conventions only: the better of half the normalised lexical score and the cosine."""
    return _directives(spark, d).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


PARTS = ("what is the license", "who wrote the theaterand work")


@query("multi_query", f"{_TK}, {_bm('0', PARTS[0])}, {_bm('1', PARTS[1])}, t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm0 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM bm1), f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS fused FROM t WHERE rk <= 50 GROUP BY id) SELECT id, round(fused, 6) AS fused FROM f ORDER BY fused DESC, id LIMIT 20")
def multi_query(spark, d):
    """The parts of a compound question, each searched by itself in one plan, fused by rank."""
    parts = Q.parts("What is the license, and who wrote the theaterand work?")
    top = R.top_k(_lexical(spark, d, *(p.lower() for p in parts)), 50).withColumn("query_id", F.lit(0))
    f = R.rrf([(top, 1.0)]).withColumn("fused", F.round("fused", 9))
    return R.top_k(f, 20, by="fused").select("id", F.round("fused", 6).alias("fused"))


#: Weights of the tiers in the fused ranking: fixed values.
WEIGHTS = {"lexical": 1.0, "semantic": 1.2, "hypothetical": 1.0, "views": 1.0, "graph": 0.3, "episode": 0.9, "directive": 1.0}
_EPI = rf"""{_CONV}, eqt AS (SELECT DISTINCT unnest({TOK.format(repr(QUERY))}) AS term), epo AS (SELECT conv_id AS id, term, count(*) AS tf FROM (SELECT conv_id, unnest(ts) AS term FROM cv) WHERE term IN (SELECT term FROM eqt) GROUP BY 1, 2), edf AS (SELECT term, count(*) AS df FROM epo GROUP BY 1),
ebm AS (SELECT id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM epo JOIN edf USING (term) JOIN cl USING (id), cs GROUP BY 1),
et AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM ebm UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM cos0 WHERE id IN (SELECT id FROM cl)), ef AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM et WHERE rk <= 50 GROUP BY id)"""
_AGE = "greatest(0.01::DOUBLE, exp(-floor((epoch(TIMESTAMP '2025-01-01') - epoch(created_at)) / 86400) * ln(2) / 90))"


@query("hybrid_recall", f"""{_TK}, {_bm('0', QUERY)}, cos0 AS (SELECT v.vec_id AS id, v.label, round({_COS}, 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 0), cos1 AS (SELECT v.vec_id AS id, round({_COS}, 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 100), {_TOP5}, {_REL}, {_EPI},
vw AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rk FROM cos0), gr AS (SELECT y AS id, round(max(0.4::DOUBLE * score), 6) AS score FROM top5 JOIN both_ ON x = id WHERE y NOT IN (SELECT id FROM top5) AND y IN (SELECT id FROM knowledge) GROUP BY y),
ds AS (SELECT bm0.id, score FROM bm0 JOIN knowledge k ON k.id = bm0.id WHERE project = 'src3'), dr AS (SELECT id, round(max(score), 9) AS score FROM (SELECT id, 0.5::DOUBLE * score / max(score) OVER () AS score FROM ds UNION ALL SELECT id, score FROM cos0 WHERE id IN (SELECT id FROM knowledge WHERE project = 'src3')) GROUP BY id),
al AS (SELECT 1.0::DOUBLE AS w, id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm0 UNION ALL SELECT 1.2, id, row_number() OVER (ORDER BY score DESC, id) FROM cos0 UNION ALL SELECT 1.0, id, row_number() OVER (ORDER BY score DESC, id) FROM cos1 UNION ALL SELECT 1.0, id, row_number() OVER (ORDER BY rk, id) FROM vw
UNION ALL SELECT 0.3, id, row_number() OVER (ORDER BY score DESC, id) FROM gr UNION ALL SELECT 0.9, id, row_number() OVER (ORDER BY score DESC, id) FROM ef UNION ALL SELECT 1.0, id, row_number() OVER (ORDER BY score DESC, id) FROM dr),
fz AS (SELECT id, sum(w / (60 + rk)) AS fused FROM al WHERE rk <= 100 GROUP BY id),
j AS (SELECT fz.id, fused * CASE WHEN type = 'en' THEN greatest({_AGE}, 0.85::DOUBLE) ELSE {_AGE} END * CASE WHEN type = 'en' THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN l.quality = 1 THEN 1.3::DOUBLE ELSE 1 END AS score FROM fz JOIN knowledge k ON k.id = fz.id LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = fz.id)
SELECT id, round(score, 6) AS score FROM j ORDER BY round(score, 9) DESC, id LIMIT 20""")
def hybrid_recall(spark, d):
    """The whole ranking: seven tiers with their weights, fused by rank, then decay with floors and boosts."""
    # both are read by several tiers
    lexical, near = G.cut(_lexical(spark, d, QUERY)), G.cut(_cosine(spark, d))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    views = near.join(labels, "id").withColumn("rk", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "id")))
    scored = {
        "lexical": lexical,
        "semantic": near,
        "hypothetical": _cosine(spark, d, 100),
        "views": views.withColumn("score", -F.col("rk")),
        "graph": _linked(spark, d, lexical),
        "episode": _episodes(spark, d, QUERY, near).withColumn("score", F.col("fused")),
        "directive": _directives(spark, d, lexical, near),
    }
    tiers = [(R.top_k(t.withColumn("query_id", F.lit(0)), 100), WEIGHTS[name]) for name, t in scored.items()]
    fused = F.broadcast(R.rrf(tiers))  # seven times a hundred rows
    k = knowledge(spark, d).select("id", "type", "created_at").join(fused, "id")
    lab = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    age = S.decay_floor(S.decay(F.col("created_at"), "2025-01-01", 90), F.col("type"), ("en",))
    boost = F.when(F.col("type") == "en", 1.1).otherwise(1.0) * F.when(F.col("quality") == 1, 1.3).otherwise(1.0)
    j = k.join(lab, "id", "left").withColumn("score", F.round(F.col("fused") * age * boost, 9))
    return R.top_k(j, 20).select("id", F.round("score", 6).alias("score"))


VIEWS = {"raw": 180, "keywords": 90, "compressed": 60, "questions": 45, "summary": 30}


@query("view_decay", "SELECT vec_id, view, round(greatest(0.01::DOUBLE, exp(-(vec_id % 400) * ln(2) / half)), 6) AS decay FROM embeddings, (VALUES " + ", ".join(f"('{v}', {h})" for v, h in VIEWS.items()) + ") t(view, half)")
def view_decay(spark, d):
    """Each view of a record ages at its own half-life."""
    age = F.col("vec_id") % 400
    views = F.array(*(F.struct(F.lit(v).alias("view"), F.round(F.greatest(F.lit(0.01), F.exp(-age * F.log(F.lit(2.0)) / h)), 6).alias("decay")) for v, h in VIEWS.items()))
    return table(spark, d, "embeddings").select("vec_id", F.explode(views).alias("x")).select("vec_id", "x.view", "x.decay")


@query("cross_rerank", rf"""{_TK}, {_bm('0', QUERY)}, w AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM bm0), top50 AS (SELECT * FROM w WHERE i < 50), q AS (SELECT list_distinct({TOK.format(repr(QUERY))}) AS t),
s AS (SELECT top50.id, i, round(len(list_intersect(list_distinct(ts), t))::DOUBLE / len(list_distinct(list_concat(ts, t))), 9) AS model FROM top50 JOIN tk ON tk.id = top50.id, q), r AS (SELECT id, i, row_number() OVER (ORDER BY model DESC, i) - 1 AS j FROM s)
SELECT id, row_number() OVER (ORDER BY round(1.0::DOUBLE / (61 + i) + 2.0::DOUBLE / (61 + j), 9) DESC, i) AS place FROM r""")
def cross_rerank(spark, d):
    """A second scorer over the first fifty: ranks fused, the scorer weighing double. The scorer is any column; here word overlap."""
    top = R.top_k(_lexical(spark, d, QUERY), 50)
    q = F.array_distinct(T.tokens(F.lit(QUERY)))
    k = knowledge(spark, d).select("id", F.round(T.jaccard(F.array_distinct(T.tokens(F.col("content"))), q), 9).alias("model"))
    return R.rerank(k.join(F.broadcast(top), "id"), "model").select("id", "place")  # fifty rows


@query("evidence_novelty", rf"""{_TK}, qt AS (SELECT DISTINCT item_id AS q, unnest({TOK.format('text')}) AS term FROM benchmark), po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bm AS (SELECT q, id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM bm), e AS (SELECT q, r.id, rk, list_distinct(ts) AS s FROM r JOIN tk ON tk.id = r.id WHERE rk <= 5),
o AS (SELECT a.q, a.id, a.rk, max(len(list_intersect(a.s, b.s))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.s, b.s))))) AS o FROM e a LEFT JOIN e b ON a.q = b.q AND b.rk < a.rk GROUP BY 1, 2, 3)
SELECT q AS query_id, id, rk AS rank, round(greatest(0.25::DOUBLE, (1 - coalesce(o, 0)) / rk), 6) AS weight FROM o""")
def evidence_novelty(spark, d):
    """Weights of each query's five best records: less for what earlier ones say already, a quarter at least."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    k = knowledge(spark, d)
    top = R.top_k(R.bm25(k, q).withColumn("score", F.round("score", 9)), 5).select("query_id", "id", "rank")
    return E.novelty(top.join(k.select("id", F.array_distinct(T.tokens(F.col("content"))).alias("s")), "id"))


@query("edge_semantic", f"WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 10 = 0), c AS (SELECT a, b, round({_COS}, 9) AS score FROM e JOIN embeddings v ON v.vec_id = (a + b) % (SELECT count(*) FROM embeddings) JOIN embeddings q ON q.vec_id = 0) SELECT a, b, round(score, 6) AS score FROM c ORDER BY score DESC, a, b LIMIT 20")
def edge_semantic(spark, d):
    """Edges by the cosine of their text's vector to a query's."""
    e = table(spark, d, "lineitem").where("l_partkey % 10 = 0").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    n = table(spark, d, "embeddings").count()
    s = e.withColumn("id", (F.col("a") + F.col("b")) % n).join(_cosine(spark, d), "id")
    return s.orderBy(F.desc("score"), "a", "b").limit(20).select("a", "b", F.round("score", 6).alias("score"))


RULE_QUERY = "always check the license of a file before it is used in this work"


@query("rule_surfacing", rf"""WITH r AS (SELECT item_id, list_distinct({TOK.format('text')}) AS t FROM benchmark), n AS (SELECT count(*) AS n FROM r), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM r) GROUP BY 1), q AS (SELECT DISTINCT unnest({TOK.format(repr(RULE_QUERY))}) AS term),
s AS (SELECT item_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 9) AS score FROM (SELECT item_id, unnest(t) AS term FROM r) JOIN q USING (term) JOIN df USING (term), n GROUP BY 1) SELECT item_id, round(score, 6) AS score FROM s ORDER BY score DESC, item_id LIMIT 10""")
def rule_surfacing(spark, d):
    """Rules that share words with what is being done, by the summed rarity of those words among the rules."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    index = lexicon(b)
    q = sorted(set(RULE_QUERY.split()))  # the query's own words
    hits, df = index.of(q)
    s = hits.join(df, "term").groupBy("id").agg(F.round(F.sum(F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))), 9).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("item_id"), F.round("score", 6).alias("score"))


@query("recall_at_k", "WITH r AS (SELECT user_id AS q, event_id, event_type = 'purchase' AS gold, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM events), m AS (SELECT q, count(*) FILTER (WHERE gold) AS g, count(*) FILTER (WHERE gold AND rk <= 5) AS h FROM r GROUP BY q) SELECT q, CASE WHEN h > 0 THEN 1 ELSE 0 END AS any5, CASE WHEN g > 0 AND h = g THEN 1 ELSE 0 END AS all5 FROM m")
def recall_at_k(spark, d):
    """Whether any, and whether all, of a query's gold records stand among its first five."""
    e = table(spark, d, "events")
    r = e.select(F.col("user_id").alias("q"), (F.col("event_type") == "purchase").alias("gold"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rk"))
    m = r.groupBy("q").agg(F.count_if("gold").alias("g"), F.count_if(F.col("gold") & (F.col("rk") <= 5)).alias("h"))
    return m.select("q", (F.col("h") > 0).cast("int").alias("any5"), ((F.col("g") > 0) & (F.col("h") == F.col("g"))).cast("int").alias("all5"))


@query("prevention_check", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND contains(props, '7')) > 0 THEN 1 ELSE 0 END AS warned, round(avg(CASE WHEN event_type = 'error' THEN CASE WHEN contains(props, '7') THEN 1.0 ELSE 0.0 END END), 6) AS share FROM events GROUP BY user_id")
def prevention_check(spark, d):
    """Whether a warning held what was looked for, and in how many of them."""
    hit = F.contains("props", F.lit("7"))
    err = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id").agg((F.count_if(err & hit) > 0).cast("int").alias("warned"), F.round(F.avg(F.when(err, hit.cast("double"))), 6).alias("share"))


@query("category_metrics", "WITH r AS (SELECT event_type AS category, user_id, min(rk) FILTER (WHERE gold) AS f FROM (SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) = 1 AS gold, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS rk FROM events) GROUP BY 1, 2) SELECT category, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM r GROUP BY category")
def category_metrics(spark, d):
    """Recall at 1, 5 and 10 and the mean reciprocal rank by question category."""
    e = table(spark, d, "events")
    rk = F.row_number().over(W.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id"))
    r = e.select(F.col("event_type").alias("category"), "user_id", (F.get_json_object("props", "$.k").cast("int") == 1).alias("gold"), rk.alias("rk"))
    f = r.groupBy("category", "user_id").agg(F.min(F.when(F.col("gold"), F.col("rk"))).alias("f"))
    hit = lambda n: F.round(F.avg(F.when(F.col("f") <= n, 1.0).otherwise(0.0)), 6).alias(f"r{n}")
    return f.groupBy("category").agg(hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr"))


_SELF = r"array_to_string(list_slice(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), 1, 12), ' ')"


@query("self_retrieval", rf"""{_TK}, qt AS (SELECT DISTINCT id AS q, unnest(list_slice(ts, 1, 12)) AS term FROM tk WHERE id % 100 = 0), po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bm AS (SELECT q, id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2),
r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rk FROM bm) SELECT q AS query_id, rk AS rank, round(1.0::DOUBLE / rk, 6) AS reciprocal FROM r WHERE id = q AND rk <= 10""")
def self_retrieval(spark, d):
    """Records found again by their own first words (a stated query set: ids divisible by 100)."""
    k = knowledge(spark, d)
    own = k.where("id % 100 = 0").withColumn("asked", F.slice(T.tokens(F.col("content")), 1, 12))
    top = R.bm25_own_rank(k, own, 10)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), F.round(1 / F.col("rank"), 6).alias("reciprocal"))


@query("federated_merge", "WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events), g AS (SELECT event_id, event_type, row_number() OVER (ORDER BY value DESC, event_type, event_id) AS place FROM r WHERE rn <= 20) SELECT place, event_type AS scope, event_id FROM g WHERE place <= 50")
def federated_merge(spark, d):
    """Each workspace's best twenty, united and ranked once more."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    best = e.withColumn("rn", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where("rn <= 20")
    top = best.orderBy(F.desc("value"), "event_type", "event_id").limit(50)
    place = F.row_number().over(W.orderBy(F.desc("value"), "event_type", "event_id")).cast("long")  # fifty rows
    return top.select(place.alias("place"), F.col("event_type").alias("scope"), "event_id")
