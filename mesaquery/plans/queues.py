"""Queues and logs, imports and exports, scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T
from ..operators import lexicon as X
from ..operators import queues as Q
from ..operators.shared import place
from ..session import knowledge, table, tool_calls, with_
from ..sources import records as R
from ..streaming import operators as S
from .registry import query
from .retrieval import TOK

K, C = with_("knowledge"), with_("calls")
NOW = "2024-01-20 00:00:00"
T_ITEM = P.StructType([P.StructField("id", P.StringType()), P.StructField("name", P.StringType())])


def _now():
    return F.lit(NOW).cast("timestamp")


@query("queue_lifecycle", f"{C}, m AS (SELECT actor AS item, arg_max(tool, (ts, id)) AS last_tool, count(*) AS changes FROM calls GROUP BY 1) SELECT CASE last_tool WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'stored' WHEN 'view' THEN 'pending' ELSE 'processing' END AS status, count(*) AS items, sum(changes)::BIGINT AS changes FROM m GROUP BY 1")
def queue_lifecycle(spark, d):
    """Items by the last state of their log."""
    t = F.col("tool")
    state = F.when(t == "error", "error").when(t == "purchase", "stored").when(t == "view", "pending").otherwise("processing")
    log = tool_calls(spark, d).select(F.col("actor").alias("item"), "ts", "id", state.alias("status"))
    return Q.latest_state(log, "item", F.struct("ts", "id"), "status").groupBy("status").agg(F.count("*").alias("items"), F.sum("changes").alias("changes"))


@query("queue_claim", f"{C}, q AS (SELECT id, ts, k, CASE WHEN tool = 'view' THEN 'pending' WHEN tool = 'click' THEN 'processing' ELSE 'stored' END AS status FROM calls WHERE ts < TIMESTAMP '{NOW}') SELECT id, 'processing' AS status FROM q WHERE status = 'pending' OR (status = 'processing' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 864000000000) ORDER BY k DESC, ts, id LIMIT 100")
def queue_claim(spark, d):
    """The next hundred items by priority: pending ones and those whose lease has run out."""
    t = F.col("tool")
    q = tool_calls(spark, d).where(F.col("ts") < _now()).withColumn("status", F.when(t == "view", "pending").when(t == "click", "processing").otherwise("stored")).withColumn("leased_at", F.col("ts"))
    return Q.claim(q, _now(), 864000, 100, [F.desc("k"), "ts", "id"]).select("id", "status")


@query("enqueue_snapshots", "SELECT doc_id AS record, md5(text) AS content_md5, lang || ',' || source AS tags, length(text) > 1000 AS important FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def enqueue_snapshots(spark, d):
    """What goes to the queue for records that nothing has worked on: content and tags as they are now."""
    done = table(spark, d, "labels").select("doc_id").distinct()
    k = table(spark, d, "documents").join(done, "doc_id", "left_anti")
    return k.select(F.col("doc_id").alias("record"), F.md5("text").alias("content_md5"), F.concat_ws(",", "lang", "source").alias("tags"), (F.length("text") > 1000).alias("important"))


@query("outbox_replay", f"{C}, i AS (SELECT md5(tool || '|' || actor || '|' || k) AS h, ts, id FROM calls WHERE tool <> 'purchase'), c AS (SELECT DISTINCT md5('click' || '|' || actor || '|' || k) AS h FROM calls WHERE tool = 'purchase') SELECT h, arg_min(id, (ts, id)) AS id FROM i WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 3600000000 AND h NOT IN (SELECT h FROM c) GROUP BY h")
def outbox_replay(spark, d):
    """Intents that no commit carries: each content once, the first."""
    c = tool_calls(spark, d)
    h = lambda kind: F.md5(F.concat_ws("|", kind, F.col("actor").cast("string"), F.col("k").cast("string")))
    intents = c.where("tool <> 'purchase'").select(h(F.col("tool")).alias("h"), "ts", "id")
    committed = c.where("tool = 'purchase'").select(h(F.lit("click")).alias("h"))
    return Q.replayable(intents, committed, "h", "ts", _now(), 3600).select("h", "id")


@query("content_idempotency", "SELECT sha256(source || '|' || lang || '|' || regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS h, min(doc_id) AS first_id, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_idempotency(spark, d):
    """Writes that would repeat a committed one, by the hash of project, type and content."""
    h = F.sha2(F.concat_ws("|", "source", "lang", T.normalised(F.col("text"))), 256)
    return table(spark, d, "documents").groupBy(h.alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")).where("times > 1")


@query("log_retention", f"{C}, f AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY ts DESC, id DESC) AS rn FROM calls WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) <= 864000000000) SELECT actor, id FROM f WHERE rn <= 5")
def log_retention(spark, d):
    """An action log cut to ten days and five rows an actor."""
    return Q.retained(tool_calls(spark, d), "actor", "ts", "id", 10, 5, _now()).select("actor", "id")


@query("usage_counters", f"{C}, f AS (SELECT tool, floor(epoch_us(ts) / 3600000000) AS w, count(*) AS n FROM calls GROUP BY 1, 2) SELECT tool, sum(n)::BIGINT AS touches, count(*) AS flushes, max(n) AS busiest FROM f GROUP BY tool")
def usage_counters(spark, d):
    """Touches counted once a flush interval (here an hour) and key, and what that saves."""
    f = Q.coalesced(tool_calls(spark, d), "tool", "ts", 3_600_000)
    return f.groupBy("tool").agg(F.sum("n").alias("touches"), F.count("*").alias("flushes"), F.max("n").alias("busiest"))


@query("telemetry_flush", f"{C}, b AS (SELECT *, (row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, id) - 1) // 50 AS batch FROM calls WHERE ts >= TIMESTAMP '2024-01-05') SELECT ts::DATE AS day, batch, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1, 2")
def telemetry_flush(spark, d):
    """A log in batches of fifty a day, older days dropped whole."""
    from pyspark.sql import Window as W

    c = tool_calls(spark, d).where(F.col("ts") >= F.lit("2024-01-05").cast("timestamp")).withColumn("day", F.to_date("ts"))
    n = F.row_number().over(W.partitionBy("day").orderBy("ts", "id")) - 1
    return c.withColumn("batch", F.floor(n / 50)).groupBy("day", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("intent_dedup", f"{C}, l AS (SELECT *, lag(ts) OVER (PARTITION BY actor, tool ORDER BY ts, id) AS was FROM calls) SELECT id FROM l WHERE was IS NULL OR epoch_us(ts) - epoch_us(was) > 21600000000")
def intent_dedup(spark, d):
    """Prompts that weren't seen in the same session in the six hours before."""
    return Q.distinct_after(tool_calls(spark, d), ["actor", "tool"], "ts", "id", 21600).select("id")


@query("embedding_misses", "SELECT DISTINCT md5(text) AS h FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0)")
def embedding_misses(spark, d):
    """Texts that no cached vector answers for."""
    t = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return Q.cache_misses(t, t.where("doc_id % 3 = 0").select("h"), "h")


@query("postings_upkeep", rf"WITH n AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 1 THEN 'replaced text of this record' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2), t AS (SELECT id, unnest({TOK.format('text')}) AS term FROM n) SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT id) >= 20")
def postings_upkeep(spark, d):
    """The lexical index after changes and deletions, without reading the other documents: the same as built anew."""
    k = knowledge(spark, d)
    changed = k.where("id % 10 = 1").select("id", F.lit("replaced text of this record").alias("content"))
    index = X.patched(X.lexicon(k), changed, k.where("id % 10 = 2").select("id"))
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where("df >= 20")


@query("stream_intents", f"{C} SELECT DISTINCT actor, tool FROM calls")
def stream_intents(spark, d):
    """A stream of prompts with repeats dropped within the watermark, run to its end: the log spans less than the watermark, so each key comes once."""
    path = place(spark, "log")
    table(spark, d, "events").write.parquet(path)
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(path)
    calls = events.select(F.col("user_id").alias("actor"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"))
    target = place(spark, "intents")
    S.run_to_table(S.distinct_within(calls, ["actor", "tool"], "3650 days"), f"{target}-state", target)
    return spark.read.schema("actor long, tool string, ts timestamp").parquet(target).select("actor", "tool")


# --- exports and imports -----------------------------------------------------


@query("result_flatten", "SELECT event_type AS kind, event_id AS id, rn AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def result_flatten(spark, d):
    """A result grouped by type, five hits a type, back as a flat list."""
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    top = table(spark, d, "events").withColumn("rn", rn).where("rn <= 5")
    grouped = top.groupBy(F.col("event_type").alias("kind")).agg(F.sort_array(F.collect_list(F.struct("rn", "event_id"))).alias("hits"))  # five a type
    return grouped.select("kind", F.explode("hits").alias("h")).select("kind", F.col("h.event_id").alias("id"), F.col("h.rn").cast("long").alias("place"))


@query("full_export", f"{K} SELECT id, project, md5(content) AS content_md5, type FROM knowledge WHERE type <> 'fr'")
def full_export(spark, d):
    """Active records written as JSON lines, a folder a project, and read back."""
    path = place(spark, "export")
    R.export_json(knowledge(spark, d).where("type <> 'fr'").select("id", "project", "content", "type"), path, ["project"])
    return spark.read.schema("id long, content string, type string, project string").json(path).select("id", "project", F.md5("content").alias("content_md5"), "type")


@query("export_tables", "SELECT 'records' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'sessions', count(*) FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT doc_id FROM documents) AND l_partkey IN (SELECT doc_id FROM documents))")
def export_tables(spark, d):
    """What a full export holds: records, sessions, and relations with both ends."""
    k = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    rel = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    rel = rel.join(k.select(F.col("id").alias("a")).distinct(), "a", "left_semi").join(k.select(F.col("id").alias("b")).distinct(), "b", "left_semi")
    n = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("records", k).unionByName(n("sessions", table(spark, d, "conversations").select("conv_id").distinct())).unionByName(n("relations", rel))


_LINE = "doc_id::VARCHAR || '|' || lang || '|' || text"


@query("bundle_manifest", f"SELECT source AS file, count(*) AS records, sum(octet_length(encode({_LINE})) + 1)::BIGINT AS bytes, bit_xor(('0x' || substr(sha256({_LINE}), 1, 15))::BIGINT) AS digest FROM documents GROUP BY source")
def bundle_manifest(spark, d):
    """A portable bundle's manifest: records, bytes and a digest a file; digests of records are joined by exclusive or, so no order and no gathering is needed."""
    return R.manifest(table(spark, d, "documents"), "source", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text"))


@query("import_jsonl", "SELECT doc_id::VARCHAR AS id, source AS project, md5(text) AS content_md5 FROM documents WHERE length(text) <= 5000")
def import_jsonl(spark, d):
    """Records from JSON lines; lines over the size limit are rejected."""
    path = place(spark, "jsonl")
    k = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.length("text") <= 5000, F.col("text")).otherwise(F.repeat("text", 40)).alias("content"), F.col("source").alias("project"), F.col("lang").alias("type"))
    k.write.json(path)
    good, _ = R.read_jsonl(spark, path, longest=60_000)
    return good.where(F.length("content") <= 5000).select("id", "project", F.md5("content").alias("content_md5"))


@query("import_chat_list", "SELECT conv_id::VARCHAR AS source_id, role, md5(text) AS content_md5, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1, 2, 3")
def import_chat_list(spark, d):
    """Flat chat exports as messages."""
    path = place(spark, "chat-list")
    c = table(spark, d, "conversations")
    m = F.struct("turn", F.col("role").alias("sender"), "text", F.lit("2024-05-01T00:00:00Z").alias("created_at"))
    c.groupBy(F.col("conv_id").cast("string").alias("uuid")).agg(F.sort_array(F.collect_list(m)).alias("chat_messages")).withColumn("name", F.lit("chat")).write.json(path)
    return R.read_chat_list(spark, path, one_document=False).groupBy("source_id", "role", F.md5("content").alias("content_md5")).agg(F.count("*").alias("n"))


@query("import_chat_tree", "WITH u AS (SELECT conv_id, turn, any_value(role) AS role, any_value(text) AS text FROM conversations GROUP BY 1, 2 HAVING count(*) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM u) SELECT conv_id::VARCHAR AS source_id, n AS turn, role, md5(text) AS content_md5 FROM p WHERE trim(text) <> ''")
def import_chat_tree(spark, d):
    """Chat exports that hold a tree: the thread from the current message up to the root, abandoned branches left out."""
    from pyspark.sql import Window as W

    path = place(spark, "chat-tree")
    c = table(spark, d, "conversations")
    once = c.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n")).where("n = 1")
    w = W.partitionBy("conv_id").orderBy("turn")
    name = lambda x: F.concat(F.lit("n"), F.col(x).cast("string"))
    node = once.withColumn("parent", F.when(F.lag("turn").over(w).isNotNull(), F.concat(F.lit("n"), F.lag("turn").over(w).cast("string"))))
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.lit(1.0).alias("create_time"))
    entry = F.struct(name("turn").alias("key"), F.struct(name("turn").alias("id"), "parent", message.alias("message")).alias("value"))
    trees = node.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.max_by(name("turn"), "turn").alias("current_node"), F.collect_list(entry).alias("e"))
    aside = F.struct(F.lit("aside").alias("key"), F.struct(F.lit("aside").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>").alias("message")).alias("value"))
    trees.select("id", F.lit("t").alias("title"), "current_node", F.map_from_entries(F.concat("e", F.array(aside))).alias("mapping")).write.json(path)
    return R.read_chat_tree(spark, path, one_document=False).select("source_id", F.col("turn").cast("long").alias("turn"), "role", F.md5("content").alias("content_md5"))


@query("import_memories", "SELECT doc_id::VARCHAR AS source_id, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL")
def import_memories(spark, d):
    """Memory lists, whichever of two fields holds the text."""
    path = place(spark, "memories")
    k = table(spark, d, "documents")
    even = F.col("doc_id") % 2 == 0
    k.select(F.col("doc_id").cast("string").alias("id"), F.when(even, F.col("text")).alias("memory"), F.when(~even, F.col("text")).alias("text"), F.lit("u").alias("user_id"), F.lit("2024-05-01T00:00:00Z").alias("created_at")).write.json(path)
    return R.read_memory_export(spark, path, one_document=False).select("source_id", F.md5("content").alias("content_md5"))


@query("import_markdown", r"SELECT p_brand AS heading, count(*) AS sections, count(DISTINCT p_name) AS names FROM part GROUP BY p_brand")
def import_markdown(spark, d):
    """A tree of notes as sections with their headings: a note a file, front matter apart."""
    path = place(spark, "notes")
    p = table(spark, d, "part")
    section = F.concat(F.lit("## "), "p_brand", F.lit("\n\n"), "p_name", F.lit(" "), "p_type", F.lit("\n"))
    p.repartition(8, "p_name").select(section.alias("value")).write.text(path)
    notes = R.read_markdown(spark, path, glob="*.txt")
    return notes.groupBy("heading").agg(F.count("*").alias("sections"), F.countDistinct(F.regexp_extract("content", r"^(.*) \S+$", 1)).alias("names"))


@query("scan_source_code", "SELECT 'item_' || item_id AS name, 'def' AS kind FROM benchmark")
def scan_source_code(spark, d):
    """Functions and classes found in source files."""
    path = place(spark, "code")
    code = F.concat(F.lit("def item_"), F.col("item_id").cast("string"), F.lit("(x):\n    return "), F.length("text").cast("string"), F.lit("\n\n"))
    table(spark, d, "benchmark").select(code.alias("value")).write.text(path)
    return R.read_source_code(spark, path, glob="*.txt").select("name", "kind")


@query("file_dispatch")
def file_dispatch(spark, d):
    """Files of an inbox by what handles them: size cap first, then the extension."""
    return R.dispatch(spark, d, most_bytes=5_000_000)


@query("catalog_probe", "SELECT * FROM (VALUES ('documents', 'text', true), ('documents', 'missing', false), ('orders', 'o_orderkey', true), ('orders', 'text', false)) t(tab, col, found)")
def catalog_probe(spark, d):
    """Which columns tables have, from their schemas alone."""
    rows = [(t, c, c in table(spark, d, t).columns) for t, c in (("documents", "text"), ("documents", "missing"), ("orders", "o_orderkey"), ("orders", "text"))]
    return spark.createDataFrame(rows, "tab string, col string, found boolean")


# --- scalar functions --------------------------------------------------------


@query("glob_match", "SELECT p_partkey AS id, p_name GLOB '*[rw]i?g*' AS hit, p_brand GLOB 'Brand#1[0-4]' AS brand FROM part")
def glob_match(spark, d):
    """Shell patterns: any run, any character, a set of characters."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.glob(F.col("p_name"), "*[rw]i?g*").alias("hit"), T.glob(F.col("p_brand"), "Brand#1[0-4]").alias("brand"))


@query("ansi_strip", "SELECT doc_id, md5(text) AS plain_md5 FROM documents")
def ansi_strip(spark, d):
    """Terminal colours gone again."""
    coloured = F.concat(F.lit("\x1b[31;1m"), F.replace("text", F.lit(" the "), F.lit(" \x1b[4mthe\x1b[0m ")), F.lit("\x1b[0m"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_ansi(coloured)).alias("plain_md5"))


@query("identifier_extraction", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text || ' read_json_file some-tool PySpark', '\b(?:[a-z0-9]+(?:[_-][a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b'))) AS names FROM documents WHERE regexp_matches(text, '^[\x00-\x7F]*$')")
def identifier_extraction(spark, d):
    """snake_case, kebab-case and inner-capital names of plain texts."""
    t = table(spark, d, "documents").where(F.col("text").rlike(r"^[\x00-\x7F]*\z"))
    return t.select("doc_id", F.array_sort(T.identifiers(F.concat("text", F.lit(" read_json_file some-tool PySpark")))).alias("names"))


@query("concept_overlap", rf"WITH t AS (SELECT item_id, list_distinct({TOK.format('text')}) AS s FROM benchmark), q AS (SELECT s FROM t WHERE item_id = 0) SELECT item_id, round(CASE WHEN least(len(t.s), len(q.s)) = 0 THEN 0 ELSE len(list_intersect(t.s, q.s))::DOUBLE / least(len(t.s), len(q.s)) END, 6) AS overlap, round(len(list_intersect(t.s, q.s))::DOUBLE / greatest(1, len(list_distinct(list_concat(t.s, q.s)))), 6) AS jaccard FROM t, q")
def concept_overlap(spark, d):
    """Overlap coefficient and Jaccard similarity of each item's words with one item's."""
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("s"))
    q = F.broadcast(t.where("item_id = 0").select(F.col("s").alias("q")))  # one row
    return t.join(q).select("item_id", F.round(T.overlap(F.col("s"), F.col("q")), 6).alias("overlap"), F.round(T.jaccard(F.col("s"), F.col("q")), 6).alias("jaccard"))


@query("payload_sizes", f"{C} SELECT tool, sum(octet_length(encode(props)))::BIGINT AS bytes, max(octet_length(encode(props))) AS largest FROM calls JOIN events ON event_id = id GROUP BY tool")
def payload_sizes(spark, d):
    """Bytes of payload a tool."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.sum(F.octet_length("props")).alias("bytes"), F.max(F.octet_length("props")).cast("long").alias("largest"))


@query("verbosity_levels", r"SELECT level, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'compact' WHEN regexp_matches(trim(text), '(^|\s)[/~]\S*') OR regexp_matches(trim(text), 'https?://\S+') OR regexp_matches(trim(text), '\bline\s+\d+|\b:\d{2,}\b') OR regexp_matches(trim(text), '\w\(\)|::') OR regexp_matches(trim(text), '(?i)\band\b.+\band\b') THEN 'full' WHEN len(regexp_split_to_array(trim(text), '\s+')) >= 10 THEN 'full' WHEN len(regexp_split_to_array(trim(text), '\s+')) <= 3 THEN 'compact' ELSE 'summary' END AS level FROM documents) GROUP BY level")
def verbosity_levels(spark, d):
    """How much detail a question asks for, by its shape."""
    return table(spark, d, "documents").groupBy(T.verbosity(F.col("text")).alias("level")).agg(F.count("*").alias("n"))


@query("json_lists", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN list_value('a', 'b') WHEN 1 THEN list_value('x', 'y z') WHEN 2 THEN list_value('one') ELSE list_value() END AS tags FROM events""")
def json_lists(spark, d):
    """Tag lists as JSON arrays, comma separated text, single words or nothing, decoded alike."""
    raw = F.element_at(F.array(F.lit('["A ", "b", ""]'), F.lit("x, Y z,"), F.lit("one"), F.lit("[]")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.tag_list(raw).alias("tags"))


@query("hash_embedder", rf"WITH t AS (SELECT doc_id, unnest({TOK.format('text')}) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM t), c AS (SELECT doc_id, h % 8 AS slot, sum(CASE WHEN (h // 8) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS v FROM h GROUP BY 1, 2) SELECT doc_id, slot, v FROM c WHERE v <> 0")
def hash_embedder(spark, d):
    """A pluggable embedder's stand-in: signed hashes of words in eight slots, as the tests of vector search use."""
    t = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    h = t.select("doc_id", F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long").alias("h"))
    c = h.groupBy("doc_id", (F.col("h") % 8).alias("slot")).agg(F.sum(F.when(F.floor(F.col("h") / 8) % 2 == 0, 1).otherwise(-1)).alias("v"))
    return c.where("v <> 0")


@query("episode_summaries", "SELECT conv_id, count(*) AS turns, substr(arg_min(text, turn), 1, 80) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ')' ELSE '' END AS summary FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def episode_summaries(spark, d):
    """The summariser's fallback: the first eighty characters and how many more turns there are; any column function can take its place."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    g = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("text", "turn").alias("t"))
    more = F.when(F.col("turns") > 1, F.concat(F.lit(" (+"), (F.col("turns") - 1).cast("string"), F.lit(")"))).otherwise("")
    return g.select("conv_id", "turns", F.concat(F.substring("t", 1, 80), more).alias("summary"))


@query("import_json_array", "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def import_json_array(spark, d):
    """Records of a JSON array under a key of one document."""
    path = place(spark, "array")
    n = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))).alias("j"))
    n.agg(F.concat(F.lit('{"items": ['), F.array_join(F.collect_list("j"), ",\n"), F.lit("]}")).alias("value")).write.text(path)  # twenty-five rows
    return R.read_json_array(spark, path, T_ITEM, "items")


@query("watch_inbox", f"{C} SELECT tool, count(*) AS n, min(id) AS first_id FROM calls GROUP BY tool")
def watch_inbox(spark, d):
    """Files that arrive in a folder, taken in as a stream, so many a trigger, and appended to a raw log."""
    inbox, log = place(spark, "inbox"), place(spark, "raw-log")
    tool_calls(spark, d).select("id", "tool", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")).repartition(6).write.json(inbox)
    seen = S.watch_folder(spark, inbox, "id long, tool string, ts timestamp", files_per_trigger=2)
    S.run_to_table(seen, f"{log}-state", log)
    return spark.read.schema("id long, tool string, ts timestamp").parquet(log).groupBy("tool").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("store_copy", "SELECT 'orders' AS tab, count(*) AS n, bit_xor(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 15))::BIGINT) AS digest FROM orders UNION ALL SELECT 'customer', count(*), bit_xor(('0x' || substr(md5(c_custkey || '|' || c_name || '|' || c_nationkey), 1, 15))::BIGINT) FROM customer")
def store_copy(spark, d):
    """Tables copied to another place, and what tells that the copies are whole."""
    def copied(name: str, *columns: str):
        path = place(spark, name)
        t = table(spark, d, name)
        t.write.parquet(path)
        digest = F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 15), 16, 10).cast("long"))
        return spark.read.schema(t.schema).parquet(path).agg(F.count("*").alias("n"), digest.alias("digest")).select(F.lit(name).alias("tab"), "n", "digest")

    return copied("orders", "o_orderkey", "o_custkey", "o_orderstatus").unionByName(copied("customer", "c_custkey", "c_name", "c_nationkey"))


@query("due_jobs", f"{C}, a AS (SELECT actor, max(ts) AS last_at, max(ts) FILTER (WHERE tool = 'purchase') AS done_at FROM calls WHERE ts < TIMESTAMP '{NOW}' GROUP BY actor) SELECT actor FROM a WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_at) > 1800000000 AND (done_at IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(done_at) > 259200000000) ORDER BY last_at, actor LIMIT 20")
def due_jobs(spark, d):
    """What the upkeep loop takes up next: idle for half an hour, not served for three days, the longest idle first."""
    c = tool_calls(spark, d).where(F.col("ts") < _now())
    a = c.groupBy("actor").agg(F.max("ts").alias("last_at"), F.max(F.when(F.col("tool") == "purchase", F.col("ts"))).alias("done_at"))
    since = lambda t: F.unix_micros(_now()) - F.unix_micros(t)
    due = (since("last_at") > 1_800_000_000) & (F.col("done_at").isNull() | (since("done_at") > 259_200_000_000))
    return a.where(due).orderBy("last_at", "actor").limit(20).select("actor")
