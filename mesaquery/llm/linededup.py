"""Line dedup by site-relative frequency.

Lines are counted per host: the share of a host's pages that contain a line,
over the pages the host has. A line whose share exceeds a boilerplate ratio is
site furniture and goes from every page of that host. Pages of one host with equal
texts are one page: a copy doesn't make its own lines furniture. The share is
drawn in by one page above and PRIOR below the line, so that it takes more to
convict a line on a small host, and no number of pages is a switch.

Lines travel as 128-bit digests. Occurrences are pre-aggregated before the
shuffle (each page counts once for a line, as its lines are made distinct inside
the row), so a line that stands on a third of all pages costs one row a task and text.
Boilerplate lines are few: at most (mean lines a page) / ratio for a host. They
come back to the pages as one array per host where all of them together are
provably small, else by an equi-join on (host, line) whose hot keys adaptive
execution splits; either way no page's text is shuffled.

Edge cases: null text or host: a null text has no lines and stays null; pages
with a null host form one host. Blank lines are never dropped. A page that loses
every line keeps an empty text. Rows that repeat lose the same lines. A share equal
to the ratio convicts nothing. An empty table gives an empty result. Columns of the
table stay as they are whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A line is boilerplate if (its pages - 1) / (the host's pages + PRIOR) is more than this.
MAX_RATIO = 0.05
PRIOR = 20
#: Boilerplate lines, over all hosts, up to which they are broadcast (32 characters each).
BROADCAST_LINES = 100_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Digest of a line without white space at its ends; equal lines, equal keys."""
    return F.md5(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, prior: int = PRIOR) -> DataFrame:
    """(host, line, pages, ratio) of the lines that stand on too many of their host's pages."""
    page = F.md5(F.coalesce(F.col(text), F.lit("")))
    totals = pages.groupBy(F.col(host).alias("_h"), page.alias("_p")).agg(F.lit(1)).groupBy("_h").agg(F.count("*").alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(lines(F.col(text)), lambda x: ~is_blank(x)), line_key))
    at = pages.select(F.col(host).alias("host"), F.xxhash64(page).alias("_p"), F.explode(keys).alias("line")).distinct()
    counts = at.groupBy("host", "line").agg(F.count("*").alias("pages")).where("pages > 1")
    found = counts.join(totals, counts["host"].eqNullSafe(totals["_h"]), "inner").drop("_h")
    return found.withColumn("ratio", (F.col("pages") - 1) / (F.col("host_pages") + prior)).where(F.col("ratio") > max_ratio).select("host", "line", "pages", "ratio")


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", id_: str = "doc_id", broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """Two structs a page: ``d`` with the columns of ``pages``, ``l`` with n_lines, n_dropped and clean_text (its text without boilerplate lines)."""
    p = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("d"))
    text_, host_, page_id = F.col(f"d.`{text}`"), F.col(f"d.`{host}`"), F.col(f"d.`{id_}`")
    bad = materialise(boilerplate(pages, host, text, **limits), "boilerplate")
    if bad.count() <= broadcast_lines:
        per_host = bad.groupBy(F.col("host").alias("_h")).agg(F.collect_list("line").alias("_bad"))
        out = p.join(F.broadcast(per_host), host_.eqNullSafe(F.col("_h")), "left")
    else:
        # A page's boilerplate lines, found by an equi-join of its line keys; grouped under the page's id.
        keys = F.array_distinct(F.transform(F.filter(lines(text_), lambda x: ~is_blank(x)), line_key))
        at = p.select(page_id.alias("_id"), host_.alias("_host"), F.explode(keys).alias("_line"))
        hit = at.join(bad, at["_host"].eqNullSafe(bad["host"]) & (at["_line"] == bad["line"]), "inner")
        per_page = hit.groupBy("_id", "_host").agg(F.collect_set("_line").alias("_bad"))
        out = p.join(per_page, page_id.eqNullSafe(per_page["_id"]) & host_.eqNullSafe(per_page["_host"]), "left")
    bad_lines = F.coalesce("_bad", F.array().cast("array<string>"))
    kept = F.when(F.size(bad_lines) == 0, lines(text_)).otherwise(F.filter(lines(text_), lambda x: is_blank(x) | ~F.array_contains(bad_lines, line_key(x))))
    out = out.select("d", F.size(lines(text_)).cast("long").alias("_lines"), kept.alias("_kept"))
    clean = F.when(text_.isNull(), F.lit(None).cast("string")).otherwise(F.array_join("_kept", "\n"))
    return out.select("d", F.struct(F.col("_lines").alias("n_lines"), (F.col("_lines") - F.size("_kept")).alias("n_dropped"), clean.alias("clean_text")).alias("l"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_lines, n_dropped, n_chars and text after site-relative line dedup of ``documents`` (host: source)."""
    out = drop_lines(docs.select("doc_id", "source", "text"))
    return out.select("d.doc_id", "d.source", "l.n_lines", "l.n_dropped", F.length("l.clean_text").cast("long").alias("n_chars"), F.col("l.clean_text").alias("text"))


def apply_line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines gone from their texts; every document stays."""
    new = {"text": F.col("l.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("l.n_dropped") == 0, F.col("d.n_chars")).otherwise(F.length("l.clean_text").cast(docs.schema["n_chars"].dataType))
    return drop_lines(docs).select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT coalesce(text, '') AS p, source, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM (SELECT text, source, unnest(ls) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
h AS (SELECT source, count(DISTINCT coalesce(text, '')) AS n FROM d GROUP BY source),
b AS (SELECT l.source, x FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, x, n HAVING count(*) > 1 AND (count(*) - 1) / (n + {PRIOR})::DOUBLE > {MAX_RATIO}::DOUBLE),
g AS (SELECT source, list(x) AS bad FROM b GROUP BY source),
o AS (
  SELECT doc_id, d.source, text, len(ls)::BIGINT AS n_lines,
    list_filter(ls, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR bad IS NULL OR NOT list_contains(bad, trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, n_lines, (n_lines - len(kept))::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN length(array_to_string(kept, chr(10)))::BIGINT END AS n_chars,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM o
"""
