"""Session settings and bindings of the driver tables to the logical model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; partition counts are left to the cluster unless given."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records: id, content, project, type, created_at."""
    d = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("project"), F.col("lang").alias("type"), created.alias("created_at"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: id, ts, tool, actor, duration_ms, ok, k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.col("user_id").alias("actor"), F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped facts: id, subject, predicate, object, valid_from."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp").alias("valid_from"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part -> supplier edges: src, dst, weight (number of line items)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).agg(F.count("*").alias("weight"))


#: The same bindings as DuckDB common table expressions.
SQL = {
    "knowledge": "knowledge AS (SELECT doc_id AS id, text AS content, source AS project, lang AS type, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at FROM documents)",
    "calls": "calls AS (SELECT event_id AS id, ts, event_type AS tool, user_id AS actor, value AS duration_ms, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "facts": "facts AS (SELECT o_orderkey AS id, o_custkey AS subject, 'status' AS predicate, o_orderstatus AS object, o_orderdate AS valid_from FROM orders)",
    "edges": "edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
