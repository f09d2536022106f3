"""Scans, predicates, joins, set operations and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import temporal
from ..session import knowledge, table, tool_calls, with_
from .registry import query

K, C = with_("knowledge"), with_("calls")


@query("doc_scan_scope", f"""{K} SELECT id, project, type, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '...' ELSE content END AS compact, CAST(length(content) // 4 AS BIGINT) AS token_estimate
FROM knowledge WHERE project IN ('src0', 'src1') AND type = 'en'""")
def doc_scan_scope(spark, d):
    """Scope predicate, compact projection, token estimate."""
    k = knowledge(spark, d).where(F.col("project").isin("src0", "src1") & (F.col("type") == "en"))
    return k.select("id", "project", "type", T.clip(F.col("content"), 80).alias("compact"), T.token_estimate(F.col("content")).alias("token_estimate"))


@query("tag_json_filter", f"{C} SELECT id, tool, k FROM calls WHERE k >= 50 AND NOT ok")
def tag_json_filter(spark, d):
    """JSON path predicate."""
    return tool_calls(spark, d).where((F.col("k") >= 50) & ~F.col("ok")).select("id", "tool", "k")


@query("paged_listing", f"{K} SELECT id, project FROM knowledge WHERE content ILIKE '%license%' ORDER BY id LIMIT 20 OFFSET 5")
def paged_listing(spark, d):
    """Case-insensitive LIKE and one page of the listing."""
    return knowledge(spark, d).where(F.col("content").ilike("%license%")).orderBy("id").offset(5).limit(20).select("id", "project")


@query("keyset_page", f"{K} SELECT id, type FROM knowledge WHERE id > 100 ORDER BY id LIMIT 50")
def keyset_page(spark, d):
    """Keyset pagination."""
    return knowledge(spark, d).where("id > 100").orderBy("id").limit(50).select("id", "type")


@query("prefix_range", "SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')")
def prefix_range(spark, d):
    """Prefix of a normalised name."""
    return table(spark, d, "customer").where(F.startswith(F.lower("c_name"), F.lit("customer#00000001"))).select("c_custkey", "c_name")


@query("like_escape", "SELECT doc_id FROM documents WHERE text LIKE '%!%!%%' ESCAPE '!'")
def like_escape(spark, d):
    """Texts with two literal percent signs: wildcards are escaped."""
    return table(spark, d, "documents").where("text LIKE '%!%!%%' ESCAPE '!'").select("doc_id")


@query("tag_filter", "SELECT doc_id FROM documents WHERE NOT list_has_any([source, lang], ['src3', 'de'])")
def tag_filter(spark, d):
    """Excluded tags: arrays that don't overlap."""
    return table(spark, d, "documents").where(~F.arrays_overlap(F.array("source", "lang"), F.array(F.lit("src3"), F.lit("de")))).select("doc_id")


@query("tag_search", "SELECT doc_id FROM documents WHERE len(list_filter([source, lang], lambda x: contains(lower(x), 'rc1'))) > 0")
def tag_search(spark, d):
    """Substring of any tag."""
    return table(spark, d, "documents").where(F.exists(F.array("source", "lang"), lambda x: F.contains(F.lower(x), F.lit("rc1")))).select("doc_id")


@query("null_status", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, 'active') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, 'active') = 'active'")
def null_status(spark, d):
    """Status with nulls read as active."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("toxic") == 1, "flagged"), F.lit("active")).alias("status")).where("status = 'active'")


@query("half_open_window", f"{C} SELECT tool, count(*) AS n FROM calls WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY tool")
def half_open_window(spark, d):
    """A report window: start included, end not."""
    c = tool_calls(spark, d).where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    return c.groupBy("tool").agg(F.count("*").alias("n"))


@query("title_index", f"{K} SELECT id, split_part(content, chr(10), 1) AS title FROM knowledge WHERE type = 'fr'")
def title_index(spark, d):
    """Index mode: the first line as title."""
    return knowledge(spark, d).where("type = 'fr'").select("id", F.substring_index("content", "\n", 1).alias("title"))


@query("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(spark, d):
    """Counts by key, keys without rows included."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    c = table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("pending_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def pending_anti(spark, d):
    """Rows without a finished counterpart."""
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select("l_partkey")
    p = table(spark, d, "part")
    return p.join(li, p["p_partkey"] == li["l_partkey"], "left_anti").select("p_partkey")


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_exists(spark, d):
    """Rows with a match, whatever their number of matches."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_name")


@query("semi_either_key", "SELECT DISTINCT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900)")
def semi_either_key(spark, d):
    """EXISTS with either key: two semi joins instead of an OR."""
    n = table(spark, d, "nation").select("n_nationkey")
    a = n.join(table(spark, d, "customer").where("c_acctbal > 9990"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    b = n.join(table(spark, d, "supplier").where("s_acctbal > 9900"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return a.union(b).distinct()


@query("double_semi", "WITH n AS (SELECT l_partkey AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 40), s AS (SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING count(*) >= 600) SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT k FROM n) AND l_suppkey IN (SELECT k FROM s)")
def double_semi(spark, d):
    """Edges whose ends both have enough mentions."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    often = lambda c, n: li.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(c)
    return li.distinct().join(often("l_partkey", 40), "l_partkey", "left_semi").join(often("l_suppkey", 600), "l_suppkey", "left_semi").select("l_partkey", "l_suppkey")


@query("scalar_argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS best_price FROM orders GROUP BY o_custkey")
def scalar_argmax(spark, d):
    """The strongest row of each key."""
    best = F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(best.alias("best_order"), F.max("o_totalprice").alias("best_price"))


@query("undirected_lookup", "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def undirected_lookup(spark, d):
    """Both directions of a relation."""
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    return n.unionByName(n.select(F.col("b").alias("a"), F.col("a").alias("b")))


@query("bridge_join", "SELECT r_name, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE p_type <> 'SMALL' GROUP BY r_name, p_brand")
def bridge_join(spark, d):
    """Records to entities through a bridge, one type left out."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    p = table(spark, d, "part").where("p_type <> 'SMALL'").select("p_partkey", "p_brand")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return j.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("values_join", "SELECT id, tool, w FROM (SELECT event_id AS id, event_type AS tool FROM events) JOIN (VALUES ('click', 0.5::DOUBLE), ('view', 0.25::DOUBLE)) v(t, w) ON tool = t")
def values_join(spark, d):
    """Join to an inline table."""
    v = spark.sql("SELECT * FROM VALUES ('click', 0.5D), ('view', 0.25D) AS v(tool, w)")
    return tool_calls(spark, d).select("id", "tool").join(F.broadcast(v), "tool").select("id", "tool", "w")  # two rows


@query("interval_overlap", "WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_days(CAST(10 + o_orderkey % 40 AS INTEGER)) AS b FROM orders), m AS (SELECT x AS ma, x + INTERVAL 15 DAY AS mb FROM (VALUES (TIMESTAMP '1996-02-01'), (TIMESTAMP '1998-07-10'), (TIMESTAMP '2000-11-20')) t(x)) SELECT o_orderkey, ma FROM o JOIN m ON a < mb AND ma < b")
def interval_overlap(spark, d):
    """Overlap join of two sets of ranges by day buckets."""
    days = (10 + F.col("o_orderkey") % 40).cast("int")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("a")).withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + days * 86400))
    m = spark.sql("SELECT ma, ma + INTERVAL 15 DAY AS mb FROM VALUES (TIMESTAMP '1996-02-01'), (TIMESTAMP '1998-07-10'), (TIMESTAMP '2000-11-20') AS t(ma)")
    return temporal.overlap_join(o, m, ("a", "ma"), ("b", "mb")).select("o_orderkey", F.col("ma").cast("timestamp_ntz").alias("ma"))


@query("asof_join", """WITH e AS (SELECT event_id, user_id, ts, ts - INTERVAL 8000 DAY AS t FROM events),
x AS (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM e JOIN orders ON user_id = o_custkey AND o_orderdate <= t)
SELECT e.event_id, o_orderkey AS order_key FROM e LEFT JOIN x ON x.event_id = e.event_id AND n = 1""")
def asof_join(spark, d):
    """The order that each event's user had placed last, by one union and one window."""
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("ts - INTERVAL 8000 DAY").alias("t"))
    return temporal.asof_join(e, table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ("user_id", "o_custkey"), ("t", "o_orderdate"), "o_orderkey").select("event_id", F.col("matched").alias("order_key"))


@query("set_ops", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_ops(spark, d):
    """Union, intersection and difference of keys."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    kind = lambda n, x: x.select(F.lit(n).alias("kind"), "k")
    return kind("both", c.intersect(s)).unionByName(kind("customers_only", c.subtract(s))).unionByName(kind("any", c.union(s).distinct()))


@query("merge_keep_first", "WITH u AS (SELECT o_custkey AS id, min(o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, 1000000000 + min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT id, min(p) AS place FROM u GROUP BY id")
def merge_keep_first(spark, d):
    """Order-preserving merge of two lists: the first place of each id stays."""
    o = table(spark, d, "orders")
    part = lambda s, base: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg((F.min("o_orderkey") + base).alias("p"))
    return part("F", 0).unionByName(part("P", 1_000_000_000)).groupBy("id").agg(F.min("p").alias("place"))


@query("top_n_per_group", "SELECT p_brand, p_partkey, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_partkey) AS rn FROM (SELECT p_brand, p_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE rn <= 3")
def top_n_per_group(spark, d):
    """The first rows of each group by a value, ties by id."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    w = W.partitionBy("p_brand").orderBy(F.col("n").desc(), "p_partkey")
    return n.join(p, n["l_partkey"] == p["p_partkey"]).select("p_brand", "p_partkey", "n", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("order_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_topk(spark, d):
    """The first rows by a value, ties by id, without a full sort."""
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("null_ordering", "SELECT doc_id, rn FROM (SELECT d.doc_id, row_number() OVER (ORDER BY toxic NULLS FIRST, d.doc_id) AS rn FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE rn <= 40")
def null_ordering(spark, d):
    """Ascending order puts nulls first; the first forty of it."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    top = j.orderBy(F.col("toxic").asc_nulls_first(), "doc_id").limit(40)  # forty rows reach the window
    return top.select("doc_id", F.row_number().over(W.orderBy(F.col("toxic").asc_nulls_first(), "doc_id")).cast("long").alias("rn"))


@query("session_neighbours", "SELECT conv_id, turn, lag(text) OVER w AS previous, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def session_neighbours(spark, d):
    """Each turn with the one before and after it."""
    return temporal.neighbours(table(spark, d, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "previous", "next")


@query("timeline_context", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations), h AS (SELECT conv_id, pos FROM c WHERE role = 'system') SELECT DISTINCT c.conv_id, c.turn FROM h JOIN c ON c.conv_id = h.conv_id AND c.pos BETWEEN h.pos - 2 AND h.pos + 2")
def timeline_context(spark, d):
    """Hits with two neighbours on each side: a window count, not a self join."""
    w = W.partitionBy("conv_id").orderBy("turn")
    hit = F.max(F.when(F.col("role") == "system", 1).otherwise(0)).over(w.rowsBetween(-2, 2))
    return table(spark, d, "conversations").withColumn("_h", hit).where("_h = 1").select("conv_id", "turn")


@query("session_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ago FROM conversations")
def session_ordinals(spark, d):
    """Places of turns from the front and from the back of their session."""
    w = W.partitionBy("conv_id")
    pos = F.row_number().over(w.orderBy("turn")).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", pos.alias("position"), (F.count("*").over(w) - pos).alias("ago"))


@query("token_budget", "SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations) WHERE spent <= 300")
def token_budget(spark, d):
    """Records in order until their summed tokens pass the budget."""
    from ..operators.retrieval import fill_budget

    c = table(spark, d, "conversations").withColumn("cost", T.token_estimate(F.col("text")))
    return fill_budget(c, "cost", 300, ["turn"], ["conv_id"]).select("conv_id", "turn", "spent")


@query("episode_segments", f"""{C}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS s FROM calls WINDOW w AS (PARTITION BY actor ORDER BY ts, id))
SELECT actor, episode, count(*) AS n FROM (SELECT actor, sum(s) OVER (PARTITION BY actor ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM g) GROUP BY actor, episode""")
def episode_segments(spark, d):
    """Episodes: a gap of more than an hour starts a new one."""
    return temporal.episodes(tool_calls(spark, d), "actor", "ts").groupBy("actor", "episode").agg(F.count("*").alias("n"))


@query("lead_intervals", f"{C} SELECT id, actor, epoch_us(lead(ts) OVER (PARTITION BY actor ORDER BY ts, id)) - epoch_us(ts) AS open_us FROM calls")
def lead_intervals(spark, d):
    """Phases: each ends where the next begins."""
    nxt = F.lead("ts").over(W.partitionBy("actor").orderBy("ts", "id"))
    return tool_calls(spark, d).select("id", "actor", (F.unix_micros(nxt) - F.unix_micros("ts")).alias("open_us"))


@query("max_normalised", f"{C} SELECT id, round(duration_ms / max(duration_ms) OVER (PARTITION BY tool), 6) AS share FROM calls")
def max_normalised(spark, d):
    """Scores over the best of their list; the list's maximum is aggregated, then joined, so no list is sorted in one task."""
    c = tool_calls(spark, d)
    m = c.groupBy("tool").agg(F.max("duration_ms").alias("m"))
    return c.join(F.broadcast(m) if m.limit(1001).count() <= 1000 else m, "tool").select("id", F.round(F.col("duration_ms") / F.col("m"), 6).alias("share"))


@query("update_groups_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, min(o_orderkey) AS best_place FROM orders GROUP BY o_custkey")
def update_groups_latest(spark, d):
    """Of each update group the newest record, in the group's best place."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.min("o_orderkey").alias("best_place"))


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5('s' || doc_id), doc_id LIMIT 30")
def hash_sample(spark, d):
    """A repeatable random sample (a sampling operator: its size is the feature)."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), "doc_id").limit(30)


@query("ledger_import", "SELECT DISTINCT sha256(text) AS digest FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)")
def ledger_import(spark, d):
    """Idempotent import: what isn't in the ledger yet."""
    from ..sources.records import not_imported

    new = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("digest")).distinct()
    return not_imported(new, table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("sql_functions", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(epoch(o_orderdate) AS BIGINT) AS unix, instr(o_orderpriority, '-') AS dash, greatest(o_custkey, o_orderkey) AS most, o_orderstatus IS NOT DISTINCT FROM 'F' AS is_f, hex(o_orderstatus) AS hexed, regexp_matches(o_orderpriority, '^[12]-') AS urgent FROM orders")
def sql_functions(spark, d):
    """The scalar set: dates, instr, multi-argument max, null-safe equality, hex, pattern match."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("unix"), F.instr("o_orderpriority", "-").cast("long").alias("dash"),
        F.greatest("o_custkey", "o_orderkey").alias("most"), F.col("o_orderstatus").eqNullSafe("F").alias("is_f"), F.hex("o_orderstatus").alias("hexed"), F.col("o_orderpriority").rlike("^[12]-").alias("urgent"),
    )


@query("json_render", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' AS js FROM customer")
def json_render(spark, d):
    """Rows rendered as JSON and read again."""
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("js"))
