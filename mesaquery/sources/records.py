"""Readers of record files and exports, and the idempotent import sink.

Every reader returns (source_id, role, content, created_at) or says otherwise;
schemas are declared, never inferred; rows that don't parse are kept apart. An
export that is one JSON document is read by one task; the same records as JSON
lines (``one_document=False``) are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "content", "project", "type", "created_at")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD, longest: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of line-delimited JSON; longer lines and broken ones are rejects."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull() & (F.length("value") <= longest)
    return parsed.where(good).select("r.*").drop("_bad"), parsed.where(~good).select("value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """Elements of a JSON array, or of the array under ``key`` of an object."""
    if key:
        return spark.read.schema(T.StructType([T.StructField(key, T.ArrayType(schema))])).option("multiLine", True).json(path).select(F.inline(key))
    return spark.read.schema(schema).option("multiLine", True).json(path)


_MESSAGE = "struct<author:struct<role:string>,content:struct<parts:array<string>>,create_time:double>"
_TREE = f"id string, title string, current_node string, mapping map<string,struct<id:string,parent:string,message:{_MESSAGE}>>"


def read_chat_tree(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Chat exports that hold a tree of messages: the thread from the current node up to the root, oldest first.

    The walk is a fold over one conversation's map; its length is the number of nodes.
    """
    conv = spark.read.schema(_TREE).option("multiLine", one_document).json(path)
    node = lambda i: F.try_element_at("mapping", i)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.map_keys("mapping"))))
    start = F.struct(F.coalesce("current_node", F.lit("")).alias("at"), F.array().cast("array<string>").alias("path"))
    walk = F.aggregate(steps, start, lambda a, _: F.when(node(a["at"]).isNull(), a).otherwise(F.struct(F.coalesce(node(a["at"])["parent"], F.lit("")).alias("at"), F.concat(a["path"], F.array(a["at"])).alias("path"))), lambda a: F.reverse(a["path"]))
    rows = conv.select(F.col("id").alias("source_id"), "mapping", F.posexplode(walk).alias("turn", "_n")).withColumn("_m", F.try_element_at("mapping", F.col("_n"))["message"])
    out = rows.select("source_id", "turn", F.col("_m.author.role").alias("role"), F.array_join("_m.content.parts", "\n").alias("content"), F.timestamp_seconds("_m.create_time").alias("created_at"))
    return out.where(F.length(F.trim("content")) > 0)


_FLAT = "uuid string, name string, chat_messages array<struct<sender:string,text:string,created_at:string>>"


def read_chat_list(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Chat exports that hold flat message lists."""
    conv = spark.read.schema(_FLAT).option("multiLine", one_document).json(path)
    rows = conv.select(F.col("uuid").alias("source_id"), F.posexplode("chat_messages").alias("turn", "m"))
    return rows.select("source_id", "turn", F.col("m.sender").alias("role"), F.col("m.text").alias("content"), F.to_timestamp("m.created_at").alias("created_at")).where(F.length(F.trim("content")) > 0)


def read_memory_export(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Memory lists: objects with memory (or text), user_id and created_at."""
    m = spark.read.schema("id string, memory string, text string, user_id string, created_at string").option("multiLine", one_document).json(path)
    return m.select(F.col("id").alias("source_id"), F.lit("user").alias("role"), F.coalesce("memory", "text").alias("content"), F.to_timestamp("created_at").alias("created_at")).where("content IS NOT NULL")


def read_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, front, ordinal, heading, content): notes of a folder tree, front matter apart, split at headings."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("path", F.col("_metadata.file_path"))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    parts = F.split(body, r"(?m)^(?=#{1,6} )")
    s = files.select("path", front.alias("front"), F.posexplode(parts).alias("ordinal", "section")).where(F.trim("section") != "")
    heading = F.regexp_extract("section", r"\A#{1,6} +([^\n]*)", 1)
    return s.select("path", "front", "ordinal", heading.alias("heading"), F.btrim(F.regexp_replace("section", r"\A#{1,6} +[^\n]*\n?", ""), F.lit(" \t\r\n")).alias("content"))


def read_source_code(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """(path, ordinal, kind, name, first_line, code): functions and classes at the outer level, found by indentation."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).withColumn("path", F.col("_metadata.file_path"))
    start = r"(?m)^(?=(?:async )?(?:def|class|func|function) )"
    s = files.select("path", F.posexplode(F.split("value", start)).alias("ordinal", "code"), F.split("value", start).alias("_all"))
    lines = F.size(F.split(F.array_join(F.slice("_all", F.lit(1), F.col("ordinal")), ""), "\n"))
    head = r"\A(?:async )?(def|class|func|function) +([A-Za-z_]\w*)"
    return s.select("path", "ordinal", F.regexp_extract("code", head, 1).alias("kind"), F.regexp_extract("code", head, 2).alias("name"), lines.alias("first_line"), "code").where("kind <> ''")


def not_imported(new: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the ledger doesn't hold; loading twice adds nothing."""
    return new.join(ledger.select(*keys).distinct(), keys, "left_anti")


def export_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, a folder a value of ``by``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def export_markdown(records: DataFrame, path: str) -> None:
    """Markdown files, a folder a project, a section a record."""
    text = F.concat(F.lit("## "), F.coalesce("type", F.lit("note")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    records.select("project", text.alias("value")).write.mode("overwrite").partitionBy("project").text(path)


def manifest(records: DataFrame, by: str, line: Column) -> DataFrame:
    """(file, records, bytes, digest) of an export with a file a value of ``by``: the digest joins the records' SHA-256 (60 bits each) by exclusive or, whatever their order."""
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("long")
    return records.groupBy(F.col(by).alias("file")).agg(F.count("*").alias("records"), F.sum(F.octet_length(line).cast("long") + 1).alias("bytes"), F.bit_xor(part).alias("digest"))


def dispatch(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """(name, bytes, handler) of the files of a folder, contents unread: too large ones are refused, others go by their extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.when(ext.isin("md", "txt"), "text").when(ext.isin("json", "jsonl"), "records").when(ext.isin("py", "go", "js", "ts", "rs", "java"), "code").when(ext.isin("html", "htm"), "page").when(ext.isin("csv", "parquet"), "table").otherwise("unknown")
    return files.select("name", "bytes", F.when(F.col("bytes") > most_bytes, "refused").otherwise(kind).alias("handler"))
