"""Around recall: cached answers, bundles, memos, expansion, ordering of updates, upkeep runs, ingestion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import query_text as Q
from ..functions import scoring as S
from ..functions import text as T
from ..operators import dedup as D
from ..operators import evidence as E
from ..operators import retrieval as R
from ..operators.cache import ResultCache
from ..operators.shared import place
from ..session import assertions, knowledge, table, tool_calls, with_
from ..streaming import operators as stream
from .facts import _PAIR, _pairs
from .registry import query
from .retrieval import QUERY, TOK, _queries
from .tiers import _TK, _bm, _lexical

K, C = with_("knowledge"), with_("calls")
CACHE = ResultCache()


@query("recall_cached", f"{_TK}, {_bm('0', QUERY)} SELECT id, round(score, 6) AS score FROM bm0 ORDER BY score DESC, id LIMIT 20")
def recall_cached(spark, d):
    """A ranked list answered from the cache when it is asked again over the same data."""
    k = knowledge(spark, d)
    ask = lambda: R.top_k(_lexical(spark, d, QUERY), 20).select("id", F.round("score", 6).alias("score"))
    for _ in range(2):
        rows = CACHE.get(("recall", QUERY), k, ask)
    return spark.createDataFrame(rows, "id long, score double")


SECTIONS = {"view": 40, "click": 20, "purchase": 15, "signup": 15, "error": 10}


@query("context_bundle", "WITH b(section, room) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in Q.budget_split(4000, SECTIONS).items()) + "), t AS (SELECT event_type AS section, event_id, value, length(props) // 4 + 1 AS cost FROM events), r AS (SELECT *, sum(cost) OVER (PARTITION BY section ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM t) SELECT r.section, event_id FROM r JOIN b ON b.section = r.section WHERE spent <= room")
def context_bundle(spark, d):
    """A token budget split over sections, each filled with its best records."""
    room = Q.budget_split(4000, SECTIONS)
    e = table(spark, d, "events").select(F.col("event_type").alias("section"), "event_id", "value", (F.floor(F.length("props") / 4) + 1).alias("cost"))
    # a section takes a token a record at least, so it is cut to its room in records before its costs are summed
    n = F.row_number().over(W.partitionBy("section").orderBy(F.desc("value"), "event_id"))
    allowed = F.coalesce(*(F.when(F.col("section") == k, F.lit(v)) for k, v in room.items()), F.lit(0))
    few = e.withColumn("_n", n).where(F.col("_n") <= max(room.values())).withColumn("room", allowed)
    spent = F.sum("cost").over(W.partitionBy("section").orderBy(F.desc("value"), "event_id").rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("spent", spent).where("spent <= room").select("section", "event_id")


@query("path_context", "WITH h AS (SELECT doc_id, CASE WHEN contains(lower(text), 'apache') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 0.5 ELSE 0 END AS s, source FROM documents) SELECT source, round(1 - exp(-sum(s)::DOUBLE / 3), 6) AS risk, count(*) FILTER (WHERE s > 0) AS mentions FROM h GROUP BY source HAVING sum(s) > 0")
def path_context(spark, d):
    """Risk of touching a file, by what mentions it and how severely."""
    low = F.lower("text")
    s = F.when(F.contains(low, F.lit("apache")), 1.0).otherwise(0.0) + F.when(F.contains(low, F.lit("license")), 0.5).otherwise(0.0)
    g = table(spark, d, "documents").select("source", s.alias("s")).groupBy("source").agg(F.sum("s").alias("t"), F.count_if(F.col("s") > 0).alias("mentions")).where("t > 0")
    return g.select("source", F.round(1 - F.exp(-F.col("t") / 3), 6).alias("risk"), "mentions")


@query("memo_recall", rf"""WITH q AS (SELECT item_id, text, md5(text) AS h, list_distinct({TOK.format('text')}) AS t FROM benchmark), a AS (SELECT text, md5(text) AS h, list_distinct({TOK.format('text')}) AS t FROM benchmark WHERE item_id = 0), f AS (SELECT item_id, bool_or(d.doc_id IS NULL OR d.doc_id % 5 = 0) AS stale FROM q LEFT JOIN documents d ON d.doc_id = q.item_id * 3 GROUP BY 1)
SELECT q.item_id, round(CASE WHEN q.h = a.h THEN 1.0 ELSE len(list_intersect(q.t, a.t))::DOUBLE / greatest(1, len(list_distinct(list_concat(q.t, a.t)))) END, 4) AS score, stale FROM q JOIN f USING (item_id), a""")
def memo_recall(spark, d):
    """Notes on earlier explorations: an equal question matches whole, others by words; stale where a file they rest on has changed or gone."""
    q = table(spark, d, "benchmark").select("item_id", F.md5("text").alias("h"), F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    a = F.broadcast(q.where("item_id = 0").select(F.col("h").alias("ah"), F.col("t").alias("at")))  # one question
    files = q.select("item_id", (F.col("item_id") * 3).alias("doc_id"), F.lit("recorded").alias("was"))
    now = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise("recorded").alias("is"))
    stale = files.join(now, "doc_id", "left").groupBy("item_id").agg(F.bool_or(~F.col("was").eqNullSafe(F.col("is"))).alias("stale"))
    score = F.when(F.col("h") == F.col("ah"), 1.0).otherwise(T.jaccard(F.col("t"), F.col("at")))
    return q.join(a).join(stale, "item_id").select("item_id", F.round(score, 4).alias("score"), "stale")


@query("query_expansion", f"{_TK}, {_bm('0', 'license of this work')}, {_bm('1', 'copyright of this work')}, {_bm('2', 'terms of this work')}, t AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bm0 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM bm1 UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM bm2), f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS fused FROM t WHERE rk <= 30 GROUP BY id) SELECT id, round(fused, 6) AS fused FROM f ORDER BY fused DESC, id LIMIT 20")
def query_expansion(spark, d):
    """Variants of a question with other words for one of its own, all searched in one plan and fused."""
    variants = Q.expand("license of this work", {"license": ("copyright", "terms")})
    top = R.top_k(_lexical(spark, d, *variants), 30).withColumn("query_id", F.lit(0))
    f = R.rrf([(top, 1.0)]).withColumn("fused", F.round("fused", 9))
    return R.top_k(f, 20, by="fused").select("id", F.round("fused", 6).alias("fused"))


@query("entity_variants", r"WITH w AS (SELECT item_id, list_slice(regexp_extract_all(text, '[A-Za-z0-9_]+'), 1, 8) AS w FROM benchmark), g AS (SELECT item_id, list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w) SELECT item_id, list_sort(list_distinct(list_concat(g, list_concat(list_transform(g, lambda x: lower(x)), list_transform(g, lambda x: upper(x)))))) AS names FROM g")
def entity_variants(spark, d):
    """Names a question may mean: its words and pairs of words, as written, small and in capitals."""
    w = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), 1, 8)
    return table(spark, d, "benchmark").select("item_id", F.array_sort(T.name_variants(w)).alias("names"))


@query("update_order")
def update_order(spark, d):
    """A ranked window in which statements that update each other keep their places, newest first."""
    p = table(spark, d, "part")
    said = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand", F.lit(" is "), F.lower("p_type"))
    r = p.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("query_id"), said.alias("text"), F.col("p_partkey").alias("recency"), F.row_number().over(W.partitionBy("p_brand").orderBy(F.xxhash64("p_partkey"))).alias("rank"))
    return E.order_updates(r.where("rank <= 50"))


@query("fuzzy_tier")
def fuzzy_tier(spark, d):
    """Records whose opening resembles a question letter by letter, for when words find too little."""
    q = "the license of this work is Apache"
    k = knowledge(spark, d).select("id", F.substring(F.lower("content"), 1, 200).alias("a"), F.lit(q.lower()).alias("b"))
    return R.sequence_ratio(k, "a", "b", least=0.2).where("ratio > 0.2").select("id", F.round(0.6 * F.col("ratio"), 6).alias("score"))


@query("near_dup_merge")
def near_dup_merge(spark, d):
    """Records of nearly the same wording, numbers and polarity: every pair of different wordings by the ratio of matching runs of words, and each copy of a wording with its first record (1)."""
    links, of = D.alike_texts(knowledge(spark, d).select("id", "content"), 0.85)
    copies = of.where("id <> rep").select("id", F.col("rep").alias("keeper"), F.lit(1.0).alias("ratio"))
    return links.select(F.col("b").alias("id"), F.col("a").alias("keeper"), F.round("ratio", 6).alias("ratio")).unionByName(copies)


_CHUNK = r"(?s).{1,1000}\z|.{1,998}\n\n|.{1,998}[.!?]\s|.{1,1000}"


@query("semantic_chunks", rf"WITH c AS (SELECT doc_id, unnest(regexp_extract_all(trim(text), '{_CHUNK}')) AS c, generate_subscripts(regexp_extract_all(trim(text), '{_CHUNK}'), 1) - 1 AS ordinal FROM documents) SELECT doc_id, ordinal, md5(c) AS chunk_md5, length(c) // 4 AS tokens FROM c")
def semantic_chunks(spark, d):
    """Texts in chunks of up to 250 tokens that end at paragraphs, else at sentences."""
    c = E.chunk_text(table(spark, d, "documents"), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), F.md5("chunk").alias("chunk_md5"), T.token_estimate(F.col("chunk")).alias("tokens"))


@query("split_passages", r"SELECT conv_id, turn, count(*) AS lines FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l) <> '' GROUP BY 1, 2")
def split_passages(spark, d):
    """A table function over texts, as SQL calls it: a row a line that holds something."""
    spark.udtf.register("nonblank_lines", E.NonblankLines)
    table(spark, d, "conversations").createOrReplaceTempView("_turns")
    return spark.sql("SELECT conv_id, turn, count(*) AS lines FROM _turns, LATERAL nonblank_lines(text) GROUP BY conv_id, turn")


@query("ingest_pages", r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages), c AS (SELECT page_id, unnest(range(0, (length(t) + 999) // 1000)) AS ordinal, t FROM t) SELECT page_id, ordinal, md5(substr(t, ordinal * 1000 + 1, 1000)) AS chunk_md5, 'stored' AS status FROM c")
def ingest_pages(spark, d):
    """Pending pages, stripped, cut into chunks and stored."""
    t = table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t")).where("t <> ''")
    n = F.explode(F.sequence(F.lit(0), F.floor((F.length("t") + 999) / 1000).cast("int") - 1))
    c = t.select("page_id", n.alias("ordinal"), "t")
    return c.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5(F.substring("t", F.col("ordinal") * 1000 + 1, F.lit(1000))).alias("chunk_md5"), F.lit("stored").alias("status"))


@query("observation_sink", f"{C} SELECT id, tool FROM calls")
def observation_sink(spark, d):
    """Observations through the idempotent sink, with a batch replayed and one that overlaps: each is stored once."""
    path = place(spark, "observations")
    c = tool_calls(spark, d).select("id", "tool")
    write = stream.idempotent_sink(path, ["id"])
    half = c.where("id % 2 = 0")
    for batch, number in ((half, 0), (half, 0), (c, 1)):
        write(batch, number)
    return spark.read.schema("id long, tool string, batch int").parquet(path).select("id", "tool")


@query("consolidation_run", r"""WITH k AS (SELECT doc_id AS id, source, text, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS made, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS h FROM documents), m AS (SELECT *, id <> min(id) OVER (PARTITION BY source, h) AS merged, date_diff('day', made, TIMESTAMP '2024-03-01') AS age FROM k)
SELECT source AS project, count(*) FILTER (WHERE merged) AS merged, count(*) FILTER (WHERE NOT merged AND age > 40) AS decayed, count(*) FILTER (WHERE NOT merged AND age > 50) AS archived, count(*) FILTER (WHERE NOT merged AND age <= 50) AS active FROM m GROUP BY source""")
def consolidation_run(spark, d):
    """One run of upkeep: repeats merged first, then what is left decays and is archived by age; what each phase did, by project."""
    k = knowledge(spark, d)
    keep = D.exact_duplicates(k.select("id", F.concat_ws("|", "project", F.sha2(T.normalised(F.col("content")), 256)).alias("key")), "id", F.col("key"))
    m = k.select("id", "project", F.datediff(F.to_date(F.lit("2024-03-01")), F.to_date("created_at")).alias("age")).join(keep, "id")
    merged = F.col("id") != F.col("keeper")
    return m.groupBy("project").agg(F.count_if(merged).alias("merged"), F.count_if(~merged & (F.col("age") > 40)).alias("decayed"), F.count_if(~merged & (F.col("age") > 50)).alias("archived"), F.count_if(~merged & (F.col("age") <= 50)).alias("active"))


@query("session_edges", f"{C}, s AS (SELECT *, ts::DATE AS day, count(*) OVER (PARTITION BY actor, ts::DATE) AS n FROM calls), x AS (SELECT id, ok, lead(id) OVER w AS nxt, lead(ok) OVER w AS nxt_ok FROM s WHERE n BETWEEN 2 AND 50 WINDOW w AS (PARTITION BY actor, day ORDER BY ts, id)) SELECT id AS src, nxt AS dst, CASE WHEN NOT ok AND nxt_ok THEN 'fixed_by' ELSE 'followed_by' END AS relation FROM x WHERE nxt IS NOT NULL")
def session_edges(spark, d):
    """Edges along sessions of two to fifty records; from an error to the success after it they say so."""
    c = tool_calls(spark, d).withColumn("day", F.to_date("ts"))
    size = c.groupBy("actor", "day").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 50").select("actor", "day")
    w = W.partitionBy("actor", "day").orderBy("ts", "id")
    x = c.join(size, ["actor", "day"], "left_semi").select("id", "ok", F.lead("id").over(w).alias("dst"), F.lead("ok").over(w).alias("_ok")).where("dst IS NOT NULL")
    return x.select(F.col("id").alias("src"), "dst", F.when(~F.col("ok") & F.col("_ok"), "fixed_by").otherwise("followed_by").alias("relation"))


@query("session_stats", "WITH s AS (SELECT conv_id, count(*) AS turns, bool_or(role = 'assistant') AS consumed FROM conversations GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (WHERE consumed) AS consumed, count(*) FILTER (WHERE NOT consumed) AS open, round(avg(turns), 6) AS mean_turns FROM s")
def session_stats(spark, d):
    """Sessions, those answered and those left open."""
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "assistant").alias("consumed"))
    return s.agg(F.count("*").alias("total"), F.count_if("consumed").alias("consumed"), F.count_if(~F.col("consumed")).alias("open"), F.round(F.avg("turns"), 6).alias("mean_turns"))


@query("quality_gate", r"WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.4 END AS specific, least(1, length(text) / 400.0) AS durable, CASE WHEN contains(lower(text), 'license') THEN 0.9 ELSE 0.5 END AS useful FROM documents) SELECT doc_id, round(((specific + durable + useful) / 3)::DOUBLE, 6) AS score, (specific + durable + useful) / 3 >= 0.6 AND least(specific, durable, useful) >= 0.3 AS passed FROM a")
def quality_gate(spark, d):
    """Three axes, whoever scores them, against a threshold for their mean and one for the worst."""
    t = F.col("text")
    axes = (F.when(t.rlike("[0-9]"), 1.0).otherwise(0.4), F.least(F.lit(1.0), F.length(t) / 400.0), F.when(F.contains(F.lower(t), F.lit("license")), 0.9).otherwise(0.5))
    score, passed = S.gate(axes)
    return table(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"), passed.alias("passed"))


@query("episode_clusters")
def episode_clusters(spark, d):
    """Recent episodes of each project, clustered in order by the words they share with a cluster."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("project"), F.array(F.col("event_type"), F.get_json_object("props", "$.k")).alias("concepts"), F.col("ts").alias("at"))
    return E.cluster_episodes(e, "project", "at")


_ABC = "abc AS (SELECT a1, a2, lead(a1) OVER w AS b1, lead(a2) OVER w AS b2, lead(a1, 2) OVER w AS c1, lead(a2, 2) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY a1, id))"


def _allen_sql(a1: str, a2: str, b1: str, b2: str) -> str:
    return f"CASE WHEN {a2} < {b1} THEN 'before' WHEN {a2} = {b1} THEN 'meets' WHEN {b2} < {a1} THEN 'after' WHEN {b2} = {a1} THEN 'met_by' WHEN {a1} = {b1} AND {a2} = {b2} THEN 'equals' WHEN {a1} = {b1} AND {a2} < {b2} THEN 'starts' WHEN {a1} = {b1} THEN 'started_by' WHEN {a2} = {b2} AND {a1} > {b1} THEN 'finishes' WHEN {a2} = {b2} THEN 'finished_by' WHEN {a1} > {b1} AND {a2} < {b2} THEN 'during' WHEN {a1} < {b1} AND {a2} > {b2} THEN 'contains' WHEN {a1} < {b1} THEN 'overlaps' ELSE 'overlapped_by' END"


@query("allen_compose", f"WITH {_PAIR}, {_ABC}, t AS (SELECT {_allen_sql('a1', 'a2', 'b1', 'b2')} AS x, {_allen_sql('b1', 'b2', 'c1', 'c2')} AS y, {_allen_sql('a1', 'a2', 'c1', 'c2')} AS z FROM abc WHERE c1 IS NOT NULL), s AS (SELECT x, y, z FROM (VALUES " + ", ".join(f"('{x}', '{y}', '{z}')" for (x, y), z in sorted(I.COMPOSITIONS.items())) + ") v(x, y, z)) SELECT t.x, t.y, s.z, count(*) AS n, count(*) FILTER (WHERE t.z = s.z) AS agree FROM t LEFT JOIN s ON s.x = t.x AND s.y = t.y GROUP BY 1, 2, 3")
def allen_compose(spark, d):
    """For each two successive relations what they compose to, where that is one relation, held against what the intervals show."""
    w = W.partitionBy("o_custkey").orderBy("a1", "id")
    p = _pairs(spark, d, last=True).withColumn("c1", F.lead("b1").over(w)).withColumn("c2", F.lead("b2").over(w)).where("c1 IS NOT NULL")
    c = F.col
    r = p.select(I.allen(c("a1"), c("a2"), c("b1"), c("b2")).alias("x"), I.allen(c("b1"), c("b2"), c("c1"), c("c2")).alias("y"), I.allen(c("a1"), c("a2"), c("c1"), c("c2")).alias("real"))
    return r.withColumn("z", I.compose(c("x"), c("y"))).groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.count_if(c("real") == c("z")).alias("agree"))


@query("duration_text_ru", "SELECT o_orderkey AS id, CASE WHEN x = 0 THEN '0 дней' WHEN m > 0 THEN m || ' ' || CASE WHEN m % 10 = 1 AND m % 100 <> 11 THEN 'месяц' WHEN m % 10 BETWEEN 2 AND 4 AND m % 100 NOT BETWEEN 12 AND 14 THEN 'месяца' ELSE 'месяцев' END || CASE WHEN r = 0 THEN '' ELSE ' ' || r || ' ' || CASE WHEN r % 10 = 1 AND r % 100 <> 11 THEN 'день' WHEN r % 10 BETWEEN 2 AND 4 AND r % 100 NOT BETWEEN 12 AND 14 THEN 'дня' ELSE 'дней' END END ELSE x || ' ' || CASE WHEN x % 10 = 1 AND x % 100 <> 11 THEN 'день' WHEN x % 10 BETWEEN 2 AND 4 AND x % 100 NOT BETWEEN 12 AND 14 THEN 'дня' ELSE 'дней' END END AS said FROM (SELECT o_orderkey, o_orderkey % 360 AS x, (o_orderkey % 360) // 30 AS m, (o_orderkey % 360) % 30 AS r FROM orders)")
def duration_text_ru(spark, d):
    """Durations in words with Russian plural forms, two units at most."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), I.human(F.col("o_orderkey") % 360, "ru").alias("said"))


@query("tag_ranges", "WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m') WHEN 1 THEN strftime(ts, '%Y') WHEN 2 THEN 'Q' || quarter(ts) || '-' || year(ts) ELSE 'later' END AS tag, ts FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('month', ts)::DATE WHEN 1 THEN date_trunc('year', ts)::DATE WHEN 2 THEN date_trunc('quarter', ts)::DATE END AS first_day, CASE event_id % 4 WHEN 0 THEN last_day(ts) WHEN 1 THEN make_date(year(ts), 12, 31) WHEN 2 THEN last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) END AS last_day FROM t")
def tag_ranges(spark, d):
    """Tags of months, years and quarters as date ranges."""
    n = F.col("event_id") % 4
    tag = F.when(n == 0, F.date_format("ts", "yyyy-MM")).when(n == 1, F.date_format("ts", "yyyy")).when(n == 2, F.concat(F.lit("Q"), F.quarter("ts").cast("string"), F.lit("-"), F.year("ts").cast("string"))).otherwise("later")
    r = I.tag_range(tag)
    return table(spark, d, "events").select("event_id", r["first"].alias("first_day"), r["last"].alias("last_day"))


@query("drift_check", "SELECT doc_id AS id, doc_id % 5 = 0 AS drifted, CASE WHEN doc_id % 5 = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS factor FROM documents")
def drift_check(spark, d):
    """Views whose stored hash of their record isn't the record's any more lose weight (every fifth record was edited after its view was made)."""
    k = knowledge(spark, d)
    views = k.select("id", T.content_hash(F.col("content")).alias("parent_hash"))
    now = k.select("id", F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content")).alias("content"))
    j = views.join(now, "id").select("id", (F.col("parent_hash") != T.content_hash(F.col("content"))).alias("drifted"))
    return j.withColumn("factor", F.when(F.col("drifted"), 0.3).otherwise(1.0))


_MENTION = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN '  ' || p_name WHEN 2 THEN 'our ' || p_type WHEN 3 THEN 'it' ELSE 'unknown ' || p_partkey END"


@query("alias_resolve", f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN t.e WHEN 4 THEN 'unknown ' || p_partkey END AS entity, CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' WHEN 2 THEN 'alias' WHEN 3 THEN 'pronoun' ELSE 'new' END AS how FROM part JOIN (SELECT p_type AS k, min(p_name) AS e FROM part GROUP BY 1) t ON t.k = p_type")
def alias_resolve(spark, d):
    """Mentions to entities: pronouns stay open, then names, then aliases; what is left founds an entity of its own."""
    p = table(spark, d, "part")
    n, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    said = F.when(n == 0, F.concat(F.upper(name), F.lit("!"))).when(n == 1, F.concat(F.lit("  "), name)).when(n == 2, F.concat(F.lit("our "), kind)).when(n == 3, "it").otherwise(F.concat(F.lit("unknown "), F.col("p_partkey").cast("string")))
    names = p.select(name.alias("name"), name.alias("entity")).distinct()
    aliases = p.groupBy(F.concat(F.lit("our "), kind).alias("alias")).agg(F.min("p_name").alias("entity"))
    return D.resolve(p.select(F.col("p_partkey").alias("id"), said.alias("mention")), names, aliases).select("id", "entity", "how")


_NOT = "('not', 'no', 'never', 'without', 'kein', 'nicht', 'pas', 'sin')"


@query("value_guard", rf"WITH c AS (SELECT conv_id, turn, {TOK.format('text')} AS a, {TOK.format('lag(text) OVER (PARTITION BY conv_id ORDER BY turn)')} AS b FROM conversations) SELECT conv_id, turn, list_sort(list_distinct(list_filter(a, lambda x: regexp_matches(x, '[0-9]')))) = list_sort(list_distinct(list_filter(b, lambda x: regexp_matches(x, '[0-9]')))) AND len(list_filter(a, lambda x: x IN {_NOT})) % 2 = len(list_filter(b, lambda x: x IN {_NOT})) % 2 AS same FROM c WHERE b IS NOT NULL")
def value_guard(spark, d):
    """Whether a turn gives the same numbers as the one before, and as many negations, but for pairs."""
    from ..operators.temporal import neighbours

    c = neighbours(table(spark, d, "conversations"), "conv_id", ["turn"], "text").where("previous IS NOT NULL")
    return c.select("conv_id", "turn", D.same_values(F.col("text"), F.col("previous")).alias("same"))
