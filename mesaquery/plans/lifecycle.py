"""Duplicates, entities, filters, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..session import knowledge, table, with_
from .registry import query

K = with_("knowledge")
TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query("exact_dups", f"{K}, h AS (SELECT id, sha256(regexp_replace(lower(trim(content)), '\\s+', ' ', 'g')) AS h FROM knowledge) SELECT id, min(id) OVER (PARTITION BY h) AS keeper FROM h")
def exact_dups(spark, d):
    """Each record's keeper under the normalised hash."""
    return D.exact_duplicates(knowledge(spark, d), "id", F.sha2(T.normalised(F.col("content")), 256))


@query("statement_repeat", rf"{K}, t AS (SELECT id, array_to_string({TOK.format('content')}, ' ') AS s FROM knowledge) SELECT id, keeper FROM (SELECT id, min(id) OVER (PARTITION BY s) AS keeper FROM t) WHERE id <> keeper")
def statement_repeat(spark, d):
    """Records that say an earlier one's token sequence again."""
    return D.exact_duplicates(knowledge(spark, d), "id", F.sha2(F.array_join(T.tokens(T.statement(F.col("content"))), " "), 256)).where("id <> keeper")


@query("jaccard_pairs", rf"""{K}, s AS (SELECT s, min(id) AS id FROM (SELECT id, list_sort(list_distinct({TOK.format('content')})) AS s FROM knowledge) WHERE len(s) > 0 GROUP BY s), x AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2, 3, 4)
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8""")
def jaccard_pairs(spark, d):
    """All pairs of distinct word sets with similarity 0.8 or more, by prefix filter."""
    k = knowledge(spark, d).select("id", T.tokens(F.col("content")).alias("items"))
    return D.jaccard_pairs(k, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("lev_match", "WITH v AS (SELECT DISTINCT p_type AS value FROM part), w(word) AS (VALUES ('economi'), ('standart'), ('smal'), ('promotion')), j AS (SELECT value, word, 1 - levenshtein(lower(value), lower(word))::DOUBLE / greatest(length(value), length(word)) AS ratio FROM v, w) SELECT value, arg_max(word, (ratio, word)) AS word, round(max(ratio), 6) AS ratio FROM j WHERE ratio >= 0.5 GROUP BY value")
def lev_match(spark, d):
    """The closest tag of a small vocabulary for each distinct value."""
    words = spark.sql("SELECT * FROM VALUES ('economi'), ('standart'), ('smal'), ('promotion') AS w(word)")
    return D.nearest_name(table(spark, d, "part"), words, "p_type", "word", 0.5).select("value", "word", F.round("ratio", 6).alias("ratio"))


@query("retention_zones", "WITH k AS (SELECT d.doc_id AS id, date_diff('day', TIMESTAMP '2024-01-01' + to_hours(d.doc_id), TIMESTAMP '2024-12-01') + d.doc_id % 200 AS age, d.doc_id % 3 AS uses, coalesce(l.quality, 0) * 0.9 AS conf FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id) SELECT id, CASE WHEN age > 365 AND uses = 0 AND conf < 0.5 THEN 'purged' WHEN age > 180 AND uses = 0 THEN 'archived' ELSE 'active' END AS zone FROM k")
def retention_zones(spark, d):
    """Zones by age, use and confidence."""
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    k = knowledge(spark, d).join(lab, F.col("id") == F.col("doc_id"), "left")
    age = F.datediff(F.to_date(F.lit("2024-12-01")), F.to_date("created_at")) + F.col("id") % 200
    return D.retention(k, age, F.col("id") % 3, F.coalesce("q", F.lit(0)) * 0.9).select("id", "zone")


@query("importance_budget", "WITH e AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS level, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE, level ORDER BY ts, event_id) AS rn FROM e) SELECT event_id, CASE WHEN rn > 2 THEN greatest(level - 1, 0) ELSE level END AS granted FROM r")
def importance_budget(spark, d):
    """At most two of a level a user and day; the rest are lowered."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("int") % 4).alias("level"), F.col("ts").cast("timestamp").alias("ts"))
    return D.daily_budget(e, "user_id", "ts", "level", "event_id", 2).select("event_id", "granted")


_RED = r"regexp_replace(regexp_replace(regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), '(?i)\b(api[_-]?key|secret|token|password)\s*[:=]\s*[^\s,;]+', '[SECRET]', 'g'), '\b[0-9]{{9,}}\b', '[NUMBER]', 'g')"


@query("redact_text", f"SELECT doc_id, md5({_RED.format('text')}) AS redacted_md5, {_RED.format('text')} <> text AS changed FROM documents")
def redact_text(spark, d):
    """Whole texts without addresses, secrets and long numbers."""
    r = table(spark, d, "documents").select("doc_id", "text", T.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


@query("line_filter", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e|copyright')), chr(10)) AS kept FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|copyright')")
def line_filter(spark, d):
    """Lines that match a filter."""
    m = "(?i)licen[sc]e|copyright"
    return table(spark, d, "documents").where(F.col("text").rlike(m)).select("doc_id", T.keep_lines(F.col("text"), m).alias("kept"))


@query("html_strip", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_strip(spark, d):
    """Text nodes of pages."""
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


@query("content_kinds", r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '^\s*[\[{]') AND regexp_matches(text, '[\]}]\s*$') THEN 'json' WHEN regexp_matches(text, '(?m)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') THEN 'log' WHEN regexp_matches(text, '(?i)\b\d+ (passed|failed)\b') THEN 'test' WHEN regexp_matches(text, '(?m)^#{1,6} ') THEN 'markdown' WHEN regexp_matches(text, '(?m)^\s*(def|class|import|function|#include)\b') THEN 'code' ELSE 'text' END AS kind FROM documents) GROUP BY kind""")
def content_kinds(spark, d):
    """Records by what their text looks like."""
    return table(spark, d, "documents").groupBy(T.content_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("latin_share", r"SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^\p{L}]', '', 'g')) END, 6) AS share FROM documents")
def latin_share(spark, d):
    """Share of Latin letters among a text's letters."""
    return table(spark, d, "documents").select("doc_id", F.round(T.latin_share(F.col("text")), 6).alias("share"))


@query("confidence_decay", "SELECT c_custkey, round(greatest(0.05::DOUBLE, c_acctbal / 10000 * CASE WHEN c_nationkey % 2 = 0 THEN 0.95::DOUBLE ELSE 1 END), 9) AS confidence FROM customer")
def confidence_decay(spark, d):
    """Stale confidence fades, never below 0.05."""
    stale = F.when(F.col("c_nationkey") % 2 == 0, 0.95).otherwise(1.0)
    return table(spark, d, "customer").select("c_custkey", F.round(F.greatest(F.lit(0.05), F.col("c_acctbal") / 10000 * stale), 9).alias("confidence"))


@query("hard_erase", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def hard_erase(spark, d):
    """A snapshot without the dependants of erased rows."""
    gone = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")
