"""Shapes of questions, splitting, stems, chunks of logs and code, retrieval in rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..functions import text as T
from ..operators import evidence as E
from ..operators import retrieval as R
from ..session import knowledge, table, with_
from .registry import query
from .retrieval import QUERY, TOK, _queries
from .tiers import _TK, _bm

K = with_("knowledge")


def _sql(cues: str) -> str:
    return f"regexp_matches(lower(text), '{cues}')"


@query("question_shapes", "SELECT ordering, historical, debug, relational, advice, count(*) AS n FROM (SELECT " + ", ".join(f"{_sql(c)} AS {k}" for k, c in T.CUES.items()) + " FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT 'why did it crash before the ' || p_name || ' was first used to ship' FROM part)) GROUP BY ALL")
def question_shapes(spark, d):
    """What a question asks for, by the cues in it: an order, an earlier value, a fault, a relation, advice."""
    said = F.concat(F.lit("why did it crash before the "), "p_name", F.lit(" was first used to ship"))
    t = table(spark, d, "documents").select("text").unionByName(table(spark, d, "conversations").select("text")).unionByName(table(spark, d, "part").select(said.alias("text")))
    return t.select(*(T.has_cue(F.col("text"), k).alias(k) for k in T.CUES)).groupBy(*T.CUES).agg(F.count("*").alias("n"))


@query("question_routes", "SELECT route, count(*) AS n FROM (SELECT CASE WHEN s >= 2 THEN 'relational' WHEN s = 1 THEN 'hybrid' ELSE 'semantic' END AS route FROM (SELECT CASE WHEN regexp_matches(lower(text), '^\\s*(who|what|which|where|when|how|why)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\\b(between|and|with|related|linked|connected)\\b') THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\\b[A-Z][a-z]+')) >= 2 THEN 1 ELSE 0 END AS s FROM conversations)) GROUP BY route")
def question_routes(spark, d):
    """Relational, hybrid or semantic search, by how many signs of a relation a question shows."""
    return table(spark, d, "conversations").groupBy(T.search_route(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


_ASKED = "'What is the ' || p_name || ', and who makes ' || p_brand || '? Where is it; how is it packed, as well as its size?'"


@query("compound_parts", f"SELECT p_partkey AS id, p AS part FROM (SELECT p_partkey, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace({_ASKED}, ',?\\s+and (who|what|when|where|which|how|why)\\b', '|\\1', 'g'), '\\?\\s+|;\\s+|,?\\s+as well as\\s+', '|', 'g'), '|'), lambda x: trim(x, ' ?.')), lambda x: x <> '')) AS p FROM part)")
def compound_parts(spark, d):
    """Compound questions split at their joints."""
    asked = F.concat(F.lit("What is the "), "p_name", F.lit(", and who makes "), "p_brand", F.lit("? Where is it; how is it packed, as well as its size?"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(T.question_parts(asked)).alias("part"))


def _begins(stem: str):
    return lambda token: F.startswith(token, F.lit(stem))


STEMS = Q.stems("licensed copies are reserved")


@query("stem_search", f"SELECT doc_id, len(list_filter([{', '.join(repr(s) for s in STEMS)}], lambda s: len(list_filter(ts, lambda t: starts_with(t, s))) > 0)) AS hits FROM (SELECT doc_id, {TOK.format('text')} AS ts FROM documents) WHERE len(list_filter([{', '.join(repr(s) for s in STEMS)}], lambda s: len(list_filter(ts, lambda t: starts_with(t, s))) > 0)) > 0")
def stem_search(spark, d):
    """Records by words that begin with a question's stems."""
    ts = T.tokens(F.col("text"))
    hits = sum((F.exists(ts, _begins(s)).cast("long") for s in STEMS), F.lit(0).cast("long"))
    return table(spark, d, "documents").select("doc_id", hits.alias("hits")).where("hits > 0")


@query("log_chunks", "SELECT user_id AS id, count(*) AS chunks FROM events GROUP BY user_id")
def log_chunks(spark, d):
    """Logs cut at lines that begin with a time, so that an entry's further lines stay with it."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit("\n  detail "), "props")
    logs = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))  # a user's log as one file, as it is read
    return E.chunk_lines(logs, "id", "text", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}").groupBy("id").agg(F.count("*").alias("chunks"))


@query("code_chunks", "SELECT item_id AS id, 3 AS chunks, md5('def f_' || item_id || '(x):' || chr(10) || '    return 1') AS first_md5 FROM benchmark")
def code_chunks(spark, d):
    """Source files cut at functions and classes."""
    code = F.concat(F.lit("def f_"), F.col("item_id").cast("string"), F.lit("(x):\n    return 1\n\nclass B:\n    pass\n\nasync def g():\n    pass\n"))
    c = E.chunk_lines(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), code.alias("text")), "id", "text", r"(?:async )?(?:def|class|func|function) ")
    return c.groupBy("id").agg(F.count("*").cast("int").alias("chunks"), F.md5(F.rtrim(F.min_by("chunk", "ordinal"), F.lit("\n"))).alias("first_md5"))


@query("iterative_recall", rf"""{_TK}, {_bm('0', QUERY)}, one AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm0), qt1 AS (SELECT DISTINCT unnest(list_slice(ts, 1, 8)) AS term FROM tk WHERE id = (SELECT id FROM one WHERE rk = 1)), po1 AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM qt1) GROUP BY 1, 2), df1 AS (SELECT term, count(*) AS df FROM po1 GROUP BY 1),
bm1 AS (SELECT id, round(sum(greatest(0.000001, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score FROM po1 JOIN df1 USING (term), st GROUP BY 1), two AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm1),
u AS (SELECT id, 1 AS round FROM one WHERE rk <= 5 UNION ALL SELECT id, 2 FROM two WHERE rk <= 5) SELECT id, min(round) AS round FROM u GROUP BY id""")
def iterative_recall(spark, d):
    """Search, let a planner ask on from what was found, search again: what each round added. Search and planner are functions of the caller."""
    k = knowledge(spark, d)
    search = lambda q: R.top_k(R.bm25(k, q).withColumn("score", F.round("score", 9)), 5).select("query_id", "id", "rank")

    def plan(hits):
        best = hits.where("rank = 1").join(k, "id")
        return best.select("query_id", F.array_join(F.slice(T.tokens(F.col("content")), 1, 8), " ").alias("text"))

    return R.iterate(_queries(spark, QUERY), search, plan, 2).select("id", "round")
