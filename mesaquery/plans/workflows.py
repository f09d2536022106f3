"""Composite jobs: filters by enrichment, evidence, updates, analytics of logs, upkeep of the graph."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..functions import text as T
from ..operators import graph as G
from ..operators import retrieval as R
from ..session import assertions, graph_edges, knowledge, table, tool_calls, with_
from .registry import query

K, C, E = with_("knowledge"), with_("calls"), with_("edges")
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query("boolean_search", rf"{K}, t AS (SELECT id, {TOK.format('content')} AS ts FROM knowledge) SELECT id FROM t WHERE (list_contains(ts, 'license') AND contains(' ' || array_to_string(ts, ' ') || ' ', ' version 2 ')) OR (list_contains(ts, 'reserved') AND NOT list_contains(ts, 'the'))")
def boolean_search(spark, d):
    """Words, phrases, AND, OR, NOT."""
    return knowledge(spark, d).where(Q.boolean_filter('license "version 2" OR (reserved NOT the)', F.col("content"))).select("id")


@query("date_filter", f"{K} SELECT id FROM knowledge WHERE created_at::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-17' OR created_at::DATE BETWEEN DATE '2023-12-31' AND DATE '2024-01-06' OR created_at::DATE = DATE '2024-02-01' OR created_at::DATE = DATE '2024-01-28'")
def date_filter(spark, d):
    """Records whose date a query's phrases name."""
    keep = F.lit(False)
    for lo, hi in Q.date_ranges("what was said last week, two weeks ago, on 2024-02-01 or on 28 Jan 2024", date(2024, 1, 17)):
        keep = keep | F.to_date("created_at").between(F.lit(lo), F.lit(hi))
    return knowledge(spark, d).where(keep).select("id")


@query("enrichment_filter", "SELECT event_id FROM events WHERE list_has_any([event_type], ['click', 'error']) AND CAST(json_extract_string(props, '$.k') AS INTEGER) IN (1, 2, 3)")
def enrichment_filter(spark, d):
    """Topics OR, entities OR, both AND."""
    e = table(spark, d, "events")
    return e.where(F.arrays_overlap(F.array("event_type"), F.array(F.lit("click"), F.lit("error"))) & F.get_json_object("props", "$.k").cast("int").isin(1, 2, 3)).select("event_id")


@query("phase_routing", "SELECT doc_id FROM documents WHERE len(list_filter([source, lang], lambda x: starts_with(x, 'src1'))) = 0 OR list_contains([source, lang], 'src12')")
def phase_routing(spark, d):
    """Rules without a phase tag, or with the phase asked for."""
    tags = F.array("source", "lang")
    return table(spark, d, "documents").where((F.size(F.filter(tags, lambda x: F.startswith(x, F.lit("src1")))) == 0) | F.array_contains(tags, "src12")).select("doc_id")


@query("idle_with_cooldown", "WITH l AS (SELECT c_custkey, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01') SELECT c_custkey FROM l WHERE (last_at IS NULL OR last_at < TIMESTAMP '2001-06-01') AND c_custkey NOT IN (SELECT o_custkey FROM r)")
def idle_with_cooldown(spark, d):
    """Keys without recent activity that weren't handled lately."""
    o = table(spark, d, "orders")
    last = table(spark, d, "customer").select("c_custkey").join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_at")), "c_custkey", "left")
    recent = o.where("o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey"))
    return last.where("last_at IS NULL OR last_at < TIMESTAMP_NTZ '2001-06-01 00:00:00'").join(recent, "c_custkey", "left_anti").select("c_custkey")


@query("evidence_chain", "WITH f AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem WHERE l_quantity >= 49) SELECT b.r AS record, count(*) AS shared FROM f a JOIN f b ON a.f = b.f AND b.r <> a.r WHERE a.r < 200 GROUP BY 1")
def evidence_chain(spark, d):
    """Records that share a source with a seed set."""
    f = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("r"), F.col("l_partkey").alias("f")).distinct()
    seeds = f.where("r < 200").select(F.col("r").alias("s"), "f")
    return f.join(seeds, "f").where("r <> s").groupBy(F.col("r").alias("record")).agg(F.count("*").alias("shared"))


@query("version_history", "SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS origin, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_history(spark, d):
    """Origin and version number of each record in its chain of replacements."""
    w = W.partitionBy("subject").orderBy("valid_from", "id")
    return assertions(spark, d).select("id", F.first("id").over(w).alias("origin"), F.row_number().over(w).cast("long").alias("version"))


@query("value_updates", "WITH v AS (SELECT o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) SELECT o_orderkey AS id, was AS old_value, o_orderstatus AS new_value FROM v WHERE was IS NOT NULL AND was <> o_orderstatus")
def value_updates(spark, d):
    """Assertions that change a subject's value."""
    was = F.lag("object").over(W.partitionBy("subject", "predicate").orderBy("valid_from", "id"))
    return assertions(spark, d).withColumn("old_value", was).where("old_value IS NOT NULL AND old_value <> object").select("id", "old_value", F.col("object").alias("new_value"))


@query("filter_savings", r"SELECT count(*) AS applied, (sum(length(text)) - sum(length(regexp_replace(text, '\s+', ' ', 'g'))))::BIGINT AS saved, round((sum(length(text)) - sum(length(regexp_replace(text, '\s+', ' ', 'g'))))::DOUBLE / sum(length(text)) * 100, 4) AS percent FROM documents")
def filter_savings(spark, d):
    """Characters that a filter saves."""
    k = table(spark, d, "documents").select(F.length("text").alias("a"), F.length(F.regexp_replace("text", r"\s+", " ")).alias("b"))
    return k.agg(F.count("*").alias("applied"), (F.sum("a") - F.sum("b")).alias("saved"), F.round((F.sum("a") - F.sum("b")) / F.sum("a") * 100, 4).alias("percent"))


@query("slot_guarantee", "WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY value DESC, event_id) AS place, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS inside FROM events), s AS (SELECT *, row_number() OVER (ORDER BY (inside > 1)::INT, place) AS seat FROM r) SELECT event_id FROM s WHERE seat <= 12")
def slot_guarantee(spark, d):
    """Top twelve with the best of each kind seated first; twelve of each kind, and no more, are ranked together."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    inside = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    few = e.withColumn("inside", inside).where("inside <= 12")
    return few.orderBy((F.col("inside") > 1).cast("int"), F.desc("value"), "event_id").limit(12).select("event_id")


@query("risk_context", f"{C} SELECT actor, round(1 - exp(-sum(CASE WHEN NOT ok THEN k / 100.0::DOUBLE ELSE 0 END) / 3), 6) AS risk, count(*) FILTER (WHERE NOT ok) AS warnings FROM calls GROUP BY actor")
def risk_context(spark, d):
    """Risk from summed severities."""
    sev = F.sum(F.when(~F.col("ok"), F.col("k") / 100.0).otherwise(0.0))
    return tool_calls(spark, d).groupBy("actor").agg(F.round(1 - F.exp(-sev / 3), 6).alias("risk"), F.count_if(~F.col("ok")).alias("warnings"))


@query("archive_score", f"{K} SELECT id, round(pow(2, -date_diff('day', created_at, TIMESTAMP '2024-12-01') / 90.0::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * (id % 10) / 10), 9) AS keep FROM knowledge")
def archive_score(spark, d):
    """2 ** -(age / half-life) by confidence."""
    age = F.datediff(F.to_date(F.lit("2024-12-01")), F.to_date("created_at"))
    return knowledge(spark, d).select("id", F.round(F.pow(F.lit(2.0), -age / 90.0) * (0.5 + 0.5 * (F.col("id") % 10) / 10), 9).alias("keep"))


@query("shared_concepts", "SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS shared FROM (SELECT DISTINCT p_brand, p_name FROM part) a JOIN (SELECT DISTINCT p_brand, p_name FROM part) b ON a.p_name = b.p_name AND a.p_brand < b.p_brand GROUP BY 1, 2 HAVING count(*) >= 5")
def shared_concepts(spark, d):
    """Projects joined by the concepts they share."""
    return G.cooccurrence(table(spark, d, "part").select("p_name", "p_brand"), "p_name", "p_brand", 5).select("a", "b", F.col("n").alias("shared"))


@query("error_then_fix", f"{C}, s AS (SELECT actor, id, ok, lead(id) OVER w AS nxt, lead(ok) OVER w AS nxt_ok FROM calls WINDOW w AS (PARTITION BY actor ORDER BY ts, id)) SELECT id AS src, nxt AS dst FROM s WHERE NOT ok AND nxt_ok")
def error_then_fix(spark, d):
    """Edges from an error to the success that follows it."""
    w = W.partitionBy("actor").orderBy("ts", "id")
    s = tool_calls(spark, d).select("ok", F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lead("ok").over(w).alias("_ok"))
    return s.where(~F.col("ok") & F.col("_ok")).select("src", "dst")


@query("edge_upsert", f"{E}, n AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, least(0.5::DOUBLE + 0.1::DOUBLE * count(*), 5) AS w FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) SELECT coalesce(e.src, n.src) AS src, coalesce(e.dst, n.dst) AS dst, round(greatest(coalesce(weight::DOUBLE, 0), coalesce(w, 0)), 6) AS weight FROM edges e FULL JOIN n ON e.src = n.src AND e.dst = n.dst")
def edge_upsert(spark, d):
    """Co-occurrence edges merged into the graph: the stronger weight stays."""
    li = table(spark, d, "lineitem").where("l_quantity > 45")
    n = li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.least(0.5 + 0.1 * F.count("*"), F.lit(5.0)).alias("w"))
    j = graph_edges(spark, d).join(n, ["src", "dst"], "full")
    return j.select("src", "dst", F.round(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.coalesce("w", F.lit(0.0))), 6).alias("weight"))


@query("graph_delta", "WITH n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01') SELECT 'edge' AS kind, 'p' || l_partkey || '>s' || l_suppkey AS name FROM n UNION ALL SELECT DISTINCT 'node', 'p' || l_partkey FROM n UNION ALL SELECT DISTINCT 'node', 's' || l_suppkey FROM n")
def graph_delta(spark, d):
    """Edges changed since a moment, with their ends."""
    n = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '2001-10-01 00:00:00'").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    node = lambda c: n.select(F.lit("node").alias("kind"), F.col(c).alias("name")).distinct()
    return n.select(F.lit("edge").alias("kind"), F.concat_ws(">", "a", "b").alias("name")).unionByName(node("a")).unionByName(node("b"))


@query("node_merge", "WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS keep FROM part) SELECT keep AS src, l_suppkey AS dst, count(*) AS weight FROM lineitem JOIN m ON p_partkey = l_partkey GROUP BY 1, 2")
def node_merge(spark, d):
    """Duplicate nodes folded into the smallest, edges rewired."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    keep = p.join(p.groupBy("p_name").agg(F.min("p_partkey").alias("src")), "p_name").select("p_partkey", "src")
    li = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n"))
    return li.join(keep, li["l_partkey"] == keep["p_partkey"]).groupBy("src", "dst").agg(F.sum("n").alias("weight"))


@query("vector_band", "SELECT q.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id WHERE list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) BETWEEN 0.2 AND 0.95")
def vector_band(spark, d):
    """Vectors within a band of similarity to a stated query set."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    s = R.cosine_scores(v, q).where((F.col("score") >= 0.2) & (F.col("score") <= 0.95) & (F.col("id") != F.col("query_id")))
    return s.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"))


@query("resume_picker", "SELECT conv_id, arg_max(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def resume_picker(spark, d):
    """The latest summary of each project."""
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("rule_token_idf", rf"WITH t AS (SELECT item_id, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark) SELECT term, round(ln(n::DOUBLE / count(*)), 6) AS idf FROM t, n GROUP BY term, n")
def rule_token_idf(spark, d):
    """Inverse document frequency over a small corpus."""
    b = table(spark, d, "benchmark")
    t = b.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return t.crossJoin(F.broadcast(b.agg(F.count("*").alias("n")))).select("term", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))  # one row


@query("fan_out", "SELECT doc_id, criterion FROM (SELECT doc_id, unnest([source, lang]) AS criterion FROM documents)")
def fan_out(spark, d):
    """One record to a row for each of its criteria."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.array("source", "lang")).alias("criterion"))


@query("subject_lookup", "SELECT o_orderkey AS id, o_totalprice AS weight FROM orders WHERE starts_with(o_custkey::VARCHAR, '12') AND o_orderstatus = 'F'")
def subject_lookup(spark, d):
    """Facts by a subject's prefix and a value."""
    return table(spark, d, "orders").where(F.startswith(F.col("o_custkey").cast("string"), F.lit("12")) & (F.col("o_orderstatus") == "F")).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("weight"))


@query("federated_order", "SELECT event_id, rn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20")
def federated_order(spark, d):
    """Per scope the best twenty, to be listed by (scope, rank)."""
    rn = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).cast("long")
    return table(spark, d, "events").select("event_id", rn.alias("rn")).where("rn <= 20")


@query("passage_ranking")
def passage_ranking(spark, d):
    """Each benchmark item against all passages of all records: the best three by BM25."""
    p = R.passages(knowledge(spark, d)).withColumn("pid", F.concat_ws("#", "id", "ordinal"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_best(p, q, 3, ["pid"], "passage").select("query_id", F.col("pid").alias("passage_id"), F.round("score", 6).alias("score"), "rank")


_NEWTON = ", ".join(f"s{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((p - y) * x) AS g1, sum(p - y) AS g0, sum(p * (1 - p) * x * x) AS h11, sum(p * (1 - p) * x) AS h10, sum(p * (1 - p)) AS h00 FROM (SELECT x, y, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM xy, p{i})), p{i + 1} AS (SELECT a - (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS a, b - (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS b FROM s{i})" for i in range(8))


@query("platt_fit", f"{C}, xy AS (SELECT duration_ms / 100 AS x, CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END AS y FROM calls), p0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b), {_NEWTON} SELECT round(a, 6) AS slope, round(b, 6) AS shift FROM p8")
def platt_fit(spark, d):
    """Slope and shift of a logistic calibration by Newton steps; each is one aggregate of five sums over all rows."""
    c = tool_calls(spark, d).select((F.col("duration_ms") / 100).alias("x"), F.col("ok").cast("double").alias("y"))
    a = b = 0.0
    for _ in range(8):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b))))
        w, e = p * (1 - p), p - F.col("y")
        s = c.select(F.sum(e * F.col("x")).alias("g1"), F.sum(e).alias("g0"), F.sum(w * F.col("x") * F.col("x")).alias("h11"), F.sum(w * F.col("x")).alias("h10"), F.sum(w).alias("h00")).first()
        det = (s.h11 or 0) * (s.h00 or 0) - (s.h10 or 0) ** 2
        if det <= 1e-12:
            break
        a, b = a - (s.h00 * s.g1 - s.h10 * s.g0) / det, b - (s.h11 * s.g0 - s.h10 * s.g1) / det
    return spark.range(1).select(F.round(F.lit(a), 6).alias("slope"), F.round(F.lit(b), 6).alias("shift"))
