"""Retrieval: lexical, vector, fused and graph-backed ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import content_hash, jaccard, tokens
from ..operators import retrieval as R
from ..operators.lexicon import lexicon
from ..session import knowledge, table, with_
from .registry import query

K = with_("knowledge")
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
QUERY = "the license of this work is Apache and the theaterand"
_BM25 = rf"""{K}, tk AS (SELECT id, project, {TOK.format('content')} AS ts FROM knowledge), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM tk),
qt AS (SELECT DISTINCT unnest({TOK.format("'" + QUERY + "'")}) AS term), po AS (SELECT id, project, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, project, len(ts) AS dl, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bm AS (SELECT id, project, sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM po JOIN df USING (term), st GROUP BY 1, 2)"""


def _queries(spark, *texts: str):
    rows = ", ".join(f"({i}L, '{t}')" for i, t in enumerate(texts))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS q(query_id, text)")


def _vector_queries(spark, d, every: int = 100):
    """The stated query set: vectors whose id is divisible by ``every``."""
    return table(spark, d, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("token_stats", rf"{K} SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest({TOK.format('content')}) AS term FROM knowledge) GROUP BY term HAVING count(*) >= 200")
def token_stats(spark, d):
    """Term and document frequencies; tf is summed per document first, so nothing distinct is shuffled."""
    p = lexicon(knowledge(spark, d)).postings
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).where("tf >= 200")


@query("bm25_topk", f"{_BM25} SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_topk(spark, d):
    """The twenty best records for one question, from the stored index."""
    b = R.bm25(knowledge(spark, d), _queries(spark, QUERY)).withColumn("score", F.round("score", 9))
    return R.top_k(b, 20).select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_scoped", f"{_BM25} SELECT id, round(score, 6) AS score FROM bm WHERE project = 'src3' ORDER BY round(score, 9) DESC, id LIMIT 10")
def bm25_scoped(spark, d):
    """Statistics over the whole corpus, results from one project."""
    k = knowledge(spark, d)
    b = R.bm25(k, _queries(spark, QUERY), scope=k.where("project = 'src3'").select("id")).withColumn("score", F.round("score", 9))
    return R.top_k(b, 10).select("id", F.round("score", 6).alias("score"))


@query("bm25_many", rf"""{K}, tk AS (SELECT id, {TOK.format('content')} AS ts FROM knowledge), st AS (SELECT count(*) AS n_docs, avg(len(ts)) AS avgdl FROM tk), qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark)),
po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
bm AS (SELECT query_id, id, sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2)
SELECT query_id, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rn FROM bm) WHERE rn <= 3""")
def bm25_many(spark, d):
    """Every benchmark item as a query, in one plan."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    b = R.bm25(knowledge(spark, d), q).withColumn("score", F.round("score", 9))
    return R.top_k(b, 3).select("query_id", "id", F.round("score", 5).alias("score"))


@query("vocab_overlap", rf"{K}, v AS (SELECT DISTINCT unnest({TOK.format('content')}) AS term FROM knowledge), q AS (SELECT item_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark) SELECT item_id, count(*) FILTER (WHERE term IN (SELECT term FROM v)) AS known, CASE WHEN count(*) FILTER (WHERE term IN (SELECT term FROM v)) = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight FROM q GROUP BY item_id")
def vocab_overlap(spark, d):
    """Damp lexical weight where no query word is in the vocabulary."""
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    v = lexicon(knowledge(spark, d)).terms.select("term", F.lit(1).alias("has"))
    g = q.join(v, "term", "left").groupBy("item_id").agg(F.count("has").alias("known"))
    return g.withColumn("weight", F.when(F.col("known") == 0, 0.3).otherwise(1.0))


_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query("cosine_topk", f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rn FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0) WHERE rn <= 10")
def cosine_topk(spark, d):
    """Exact cosine of the stated queries against all vectors."""
    s = R.cosine_scores(table(spark, d, "embeddings"), _vector_queries(spark, d)).withColumn("score", F.round("score", 9))
    return R.top_k(s, 10).select("query_id", "id", F.round("score", 6).alias("score"))


_BITS = "list_reduce(list_prepend(0::HUGEINT, list_transform({0}.embedding, lambda x: CASE WHEN x > 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, b: a * 2 + b)"


@query("hamming_topk", f"WITH b AS (SELECT v.vec_id, {_BITS.format('v')} AS bits FROM embeddings v) SELECT query_id, id, distance FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, bit_count(xor(q.bits, v.bits))::BIGINT AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.bits, v.bits)), v.vec_id) AS rn FROM b v JOIN b q ON q.vec_id % 100 = 0) WHERE rn <= 50")
def hamming_topk(spark, d):
    """Nearest sign bits, the candidates for exact re-ranking."""
    return R.hamming_candidates(table(spark, d, "embeddings"), _vector_queries(spark, d), 50).select("query_id", "id", F.col("distance").cast("long").alias("distance"))


@query("hamming_rerank", f"WITH b AS (SELECT v.vec_id, {_BITS.format('v')} AS bits FROM embeddings v), c AS (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.bits, v.bits)), v.vec_id) AS rn FROM b v JOIN b q ON q.vec_id % 100 = 0), r AS (SELECT query_id, id, round({_COS}, 9) AS score FROM c JOIN embeddings v ON v.vec_id = id JOIN embeddings q ON q.vec_id = query_id WHERE rn <= 200), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) SELECT query_id, id, round(score, 6) AS score, rank FROM t WHERE rank <= 10")
def hamming_rerank(spark, d):
    """Sign-bit candidates re-ranked by exact cosine."""
    v, q = table(spark, d, "embeddings"), _vector_queries(spark, d)
    c = R.hamming_candidates(v, q, 200).select("query_id", "id")
    s = R.cosine_scores(v, q).join(c, ["query_id", "id"], "left_semi").withColumn("score", F.round("score", 9))
    return R.top_k(s, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("per_label_topn", f"SELECT label, id, round(score, 6) AS score FROM (SELECT v.label, v.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY v.label ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rn FROM embeddings v JOIN embeddings q ON q.vec_id = 0) WHERE rn <= 3")
def per_label_topn(spark, d):
    """The best of each space for one query vector."""
    v = table(spark, d, "embeddings")
    s = R.cosine_scores(v, _vector_queries(spark, d).where("query_id = 0")).withColumn("score", F.round("score", 9))
    return R.top_k(s.join(v.select(F.col("vec_id").alias("id"), "label"), "id"), 3, group="label").select("label", "id", F.round("score", 6).alias("score"))


_TIERS = f"""{_BM25}, t1 AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rk FROM bm), cs AS (SELECT v.vec_id AS id, round({_COS}, 9) AS score FROM embeddings v JOIN embeddings q ON q.vec_id = 0), t2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM cs),
fz AS (SELECT id, sum(p) AS fused FROM (SELECT id, 1.0::DOUBLE / (60 + rk) AS p FROM t1 WHERE rk <= 100 UNION ALL SELECT id, 1.2::DOUBLE / (60 + rk) FROM t2 WHERE rk <= 100) GROUP BY id)"""


def _fused(spark, d):
    b = R.bm25(knowledge(spark, d), _queries(spark, QUERY)).withColumn("score", F.round("score", 9))
    c = R.cosine_scores(table(spark, d, "embeddings"), _vector_queries(spark, d).where("query_id = 0")).withColumn("score", F.round("score", 9))
    return R.rrf([(R.top_k(b, 100), 1.0), (R.top_k(c, 100), 1.2)])


@query("rrf_two_tiers", f"{_TIERS} SELECT id, round(fused, 6) AS fused FROM fz ORDER BY round(fused, 9) DESC, id LIMIT 30")
def rrf_two_tiers(spark, d):
    """Lexical and vector ranks fused."""
    f = _fused(spark, d).withColumn("fused", F.round("fused", 9))
    return R.top_k(f, 30, by="fused").select("id", F.round("fused", 6).alias("fused"))


_DECAY = "greatest(0.01::DOUBLE, exp(-floor((epoch(TIMESTAMP '2025-01-01') - epoch(created_at)) / 86400) * ln(2) / 90))"


@query("decay_scores", f"{K} SELECT id, round(CASE WHEN type = 'en' THEN greatest({_DECAY}, 0.85::DOUBLE) ELSE {_DECAY} END, 6) AS decay FROM knowledge")
def decay_scores(spark, d):
    """Exponential decay with floors, from a given moment."""
    k = knowledge(spark, d)
    return k.select("id", F.round(S.decay_floor(S.decay(F.col("created_at"), "2025-01-01", 90), F.col("type"), ("en",)), 6).alias("decay"))


@query("temporal_rerank", f"{K} SELECT id, round(0.5::DOUBLE * least(1, length(content) / 5000.0::DOUBLE) + 0.5::DOUBLE * greatest(0, 1 - greatest(0, date_diff('day', created_at, TIMESTAMP '2024-01-20'), date_diff('day', TIMESTAMP '2024-01-25', created_at)) / 180.0::DOUBLE), 6) AS score FROM knowledge")
def temporal_rerank(spark, d):
    """Half relevance, half nearness to the query's dates."""
    from ..functions.intervals import proximity, range_distance

    near = proximity(range_distance(F.to_date("created_at"), F.to_date(F.lit("2024-01-20")), F.to_date(F.lit("2024-01-25"))))
    return knowledge(spark, d).select("id", F.round(0.5 * F.least(F.lit(1.0), F.length("content") / 5000.0) + 0.5 * near, 6).alias("score"))


@query("shared_entity", """WITH b AS (SELECT l_orderkey AS r, l_partkey AS n, max(l_quantity / 50) AS s FROM lineitem GROUP BY 1, 2), deg AS (SELECT n, count(*) AS g FROM b GROUP BY 1),
sd AS (SELECT n, max(0.4::DOUBLE * s) AS w FROM b WHERE r IN (1, 2, 3) GROUP BY 1), kept AS (SELECT sd.n, w / ln(1 + g) AS w FROM sd JOIN deg ON deg.n = sd.n WHERE g BETWEEN 2 AND 200 ORDER BY g, sd.n LIMIT 16),
sc AS (SELECT r, round(sum(w * s), 9) AS score FROM b JOIN kept ON kept.n = b.n WHERE r NOT IN (1, 2, 3) GROUP BY 1) SELECT r AS record, round(score, 6) AS score FROM sc WHERE score >= 0.5 * (SELECT max(score) FROM sc)""")
def shared_entity(spark, d):
    """Records that share entities with seed records: hubs and loners cut, the sixteen most specific kept, those at half the best score or more."""
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("r"), F.col("l_partkey").alias("n")).agg(F.max(F.col("l_quantity") / 50).alias("s"))
    seed = b.where(F.col("r").isin(1, 2, 3)).groupBy("n").agg(F.max(0.4 * F.col("s")).alias("w"))
    deg = b.join(seed.select("n"), "n", "left_semi").groupBy("n").agg(F.count("*").alias("g")).where("g BETWEEN 2 AND 200")
    kept = seed.join(deg, "n").orderBy("g", "n").limit(16).select("n", (F.col("w") / F.log1p("g")).alias("w"))
    sc = b.where(~F.col("r").isin(1, 2, 3)).join(F.broadcast(kept), "n").groupBy(F.col("r").alias("record")).agg(F.round(F.sum(F.col("w") * F.col("s")), 9).alias("score"))  # sixteen nodes
    best = sc.agg(F.max("score").alias("best"))  # one row
    return sc.join(F.broadcast(best), F.col("score") >= 0.5 * F.col("best")).select("record", F.round("score", 6).alias("score"))


@query("query_entity", """WITH b AS (SELECT DISTINCT l_orderkey AS r, p_brand AS e FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT e, count(*) AS n FROM b GROUP BY 1), k AS (SELECT e, 1 / ln(2 + n) AS idf FROM m WHERE e IN ('Brand#2', 'Brand#17', 'Brand#9')),
h AS (SELECT r, sum(idf) * (1 + 0.5::DOUBLE * (count(*) - 1)) AS w FROM b JOIN k USING (e) GROUP BY 1) SELECT r AS record, round(w / (1 + w), 6) AS score FROM h""")
def query_entity(spark, d):
    """Records by the entities a query names: rare ones weigh more, several of them more than their sum."""
    p = table(spark, d, "part").where(F.col("p_brand").isin("Brand#2", "Brand#17", "Brand#9")).select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("e"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), "l_partkey").join(p, "l_partkey").select("record", "e").distinct()
    idf = b.groupBy("e").agg((1 / F.log(2 + F.count("*"))).alias("idf"))
    w = b.join(F.broadcast(idf), "e").groupBy("record").agg((F.sum("idf") * (1 + 0.5 * (F.count("*") - 1))).alias("w"))  # a row an entity named
    return w.select("record", F.round(F.col("w") / (1 + F.col("w")), 6).alias("score"))


@query("analogy_search", rf"{K}, t AS (SELECT id, project, list_distinct({TOK.format('content')}) AS s FROM knowledge), q AS (SELECT s, project FROM t WHERE id = 0) SELECT t.id, round(len(list_intersect(t.s, q.s))::DOUBLE / len(list_distinct(list_concat(t.s, q.s))), 6) AS similarity FROM t, q WHERE t.project <> q.project AND len(list_intersect(t.s, q.s))::DOUBLE / len(list_distinct(list_concat(t.s, q.s))) >= 0.1")
def analogy_search(spark, d):
    """Records of other projects with a similar word set to one record."""
    k = knowledge(spark, d).select("id", "project", F.array_distinct(tokens(F.col("content"))).alias("s"))
    q = F.broadcast(k.where("id = 0").select(F.col("s").alias("qs"), F.col("project").alias("qp")))  # one record
    return k.join(q, k["project"] != F.col("qp")).select("id", F.round(jaccard(F.col("s"), F.col("qs")), 6).alias("similarity")).where("similarity >= 0.1")


@query("negative_decision", "SELECT vec_id, CASE WHEN c >= 0.9 THEN 'hard' WHEN c >= 0.6 THEN 'soft' ELSE 'none' END AS decision FROM (SELECT v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings v JOIN embeddings q ON q.vec_id = 0)")
def negative_decision(spark, d):
    """Thresholds on a score."""
    s = R.cosine_scores(table(spark, d, "embeddings"), _vector_queries(spark, d).where("query_id = 0"))
    return s.select(F.col("id").alias("vec_id"), F.when(F.col("score") >= 0.9, "hard").when(F.col("score") >= 0.6, "soft").otherwise("none").alias("decision"))


@query("boost_blend", "SELECT event_id, round(greatest(value / 500, 0.4::DOUBLE / (1 + exp(-(value - 20) / 10)) + 0.6::DOUBLE * value / 500), 6) AS blended FROM events")
def boost_blend(spark, d):
    """A re-ranker that may only raise: max(score, .4 sigmoid + .6 score)."""
    base = F.col("value") / 500
    return table(spark, d, "events").select("event_id", F.round(F.greatest(base, 0.4 * S.sigmoid((F.col("value") - 20) / 10) + 0.6 * base), 6).alias("blended"))


@query("compound_slots", "SELECT part, id FROM (SELECT event_type AS part, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def compound_slots(spark, d):
    """The best record of each part of a compound query: one struct maximum a part."""
    best = F.max_by(F.col("event_id"), F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("part")).agg(best.alias("id"))


@query("view_fusion", f"SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS fused FROM (SELECT v.label AS view, v.vec_id AS id, row_number() OVER (PARTITION BY v.label ORDER BY round({_COS}, 9) DESC, v.vec_id) AS rk FROM embeddings v JOIN embeddings q ON q.vec_id = 100) GROUP BY id")
def view_fusion(spark, d):
    """Reciprocal ranks by view (representation), then summed."""
    v = table(spark, d, "embeddings")
    s = R.cosine_scores(v, _vector_queries(spark, d).where("query_id = 100")).join(v.select(F.col("vec_id").alias("id"), "label"), "id").withColumn("score", F.round("score", 9))
    rk = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "id"))
    return s.select("id", (1 / (60 + rk)).alias("p")).groupBy("id").agg(F.round(F.sum("p"), 6).alias("fused"))


@query("context_expand", """WITH e AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS w, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1, 2)
SELECT s AS node, round(max(w * least(1, greatest(0.05::DOUBLE, exp(-date_diff('day', last_at, TIMESTAMP '2001-12-01') * ln(2) / 60)))), 6) AS score FROM e WHERE p IN (1, 2, 3, 4, 5) GROUP BY 1""")
def context_expand(spark, d):
    """One hop from seeds, strength by freshness."""
    e = table(spark, d, "lineitem").where(F.col("l_partkey").isin(1, 2, 3, 4, 5)).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("w"), F.max("l_shipdate").alias("t"))
    age = F.datediff(F.to_date(F.lit("2001-12-01")), F.to_date("t"))
    return e.groupBy(F.col("l_suppkey").alias("node")).agg(F.round(F.max(F.col("w") * S.freshness(age)), 6).alias("score"))


@query("mmr_window")
def mmr_window(spark, d):
    """Maximal marginal relevance over each query's top fifty."""
    v = table(spark, d, "embeddings")
    return R.mmr(R.cosine_scores(v, _vector_queries(spark, d)), v)


@query("passages")
def passages(spark, d):
    """Whole texts cut into evidence passages at sentence ends."""
    return R.passages(knowledge(spark, d))


@query("difflib_ratio")
def difflib_ratio(spark, d):
    """Sequence ratio of distinct part names that begin with the same word."""
    n = table(spark, d, "part").select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("k")).distinct()
    return R.sequence_ratio(n.join(n.select(F.col("a").alias("b"), "k"), "k").where("a < b").select("a", "b"), "a", "b")
