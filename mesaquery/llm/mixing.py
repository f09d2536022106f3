"""Mixing sources to target weights.

Every document gets a hash-random key; within its source documents stand in key
order; a distributed prefix sum of their word counts tells where each document
lies; the source's budget is cut there, after as many whole epochs as fit.

Keys are uniform, so equal key ranges ("buckets") are a range sort with nearly
equal parts, however large one source is: a window inside each bucket, and the
sums of the buckets are prefix-summed the same way, level by level, until few are
left. No task ever holds a whole source.

Edge cases: a null text has size 0 and takes 0. A null source is a source of its
own and stands last. A source whose documents are all empty has target 0. Keys
come from doc_id and text, so rows with a null or repeated doc_id are dealt like
others. Rows equal in doc_id, text and source are counted as one with so many
copies, in the sums and at the cut, and each comes out; which of them the cut hits
makes no difference. Ties between other rows need equal 60-bit keys; then doc_id
and size decide. An empty table gives an empty result. ``mix_documents`` returns
the columns of its input whatever their names; the others read the named ones only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPLIT, materialise, n_words, words

#: Weights, dealt in turn to the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)
#: The mix holds this multiple of all words.
TOTAL = 1.5
#: No source, and no document, is taken more than this many times.
MAX_EPOCHS = 2
SEED = "mix-1"
#: Documents that a bucket of the prefix sum should hold.
BUCKET_ROWS = 4096


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A uniform 60-bit integer of a document, the same on every run and in any SQL engine that has MD5."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(text, F.lit(""))), F.lit("/" + seed))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def ordinal_bits(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Bits of the key that pick a bucket."""
    return max(0, min(40, math.ceil(math.log2(max(1, rows) / per_bucket)))) if rows > per_bucket else 0


def prefix_sums(df: DataFrame, group: str, key: str, value: str, rows: int, order: list[str], out: str, level: int = 0) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that stand before this one by (key, *order).

    ``key`` holds uniform 60-bit integers. ``df`` should be cheap to read twice.
    """
    bits = ordinal_bits(rows)
    before = lambda w: F.coalesce(F.sum(value).over(w.orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    if not bits:
        return df.withColumn(out, before(W.partitionBy(group)))
    b, g, k, s, above, inside = (f"_{x}{level}" for x in ("b", "g", "k", "s", "above", "inside"))
    df = df.withColumn(b, F.shiftright(F.col(key), 60 - bits))
    sums = df.groupBy(F.col(group).alias(g), F.shiftleft(F.col(b), 60 - bits).alias(k)).agg(F.sum(value).alias(s))
    sums = prefix_sums(sums, g, k, s, 1 << bits, [], above, level + 1).select(g, k, above)
    df = df.withColumn(inside, before(W.partitionBy(group, b)))
    joined = df.join(sums, df[group].eqNullSafe(sums[g]) & (F.shiftleft(df[b], 60 - bits) == sums[k]), "inner")
    return joined.withColumn(out, F.col(above) + F.col(inside)).drop(b, g, k, above, inside)


def source_targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sharing by weight, stopping a source at ``cap`` times its size and resharing
    the excess until none is above is a water level: sources fill in the order
    of cap / weight, and the level is the first that the next source can hold.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_code) - 1) % len(weights)).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size"))
    rising = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    s = s.withColumn("_full", F.coalesce(F.sum("_cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(rising.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_level", (total * F.sum("source_size").over(everything) - F.col("_full")) / F.col("_rest"))
    s = s.withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(rising.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.withColumn("_water", level).select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap"))).alias("target"))


def _place(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Every document (with its ``copies``) and its place among its source's words, and the sources' targets.

    ``budget`` is what the cut leaves of one more epoch for all copies together.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("_key"))
    sized = materialise(rows.groupBy("doc_id", "source", "size", "_key").agg(F.count("*").alias("copies")).withColumn("_all", F.col("size") * F.col("copies")), "mix")
    sources = sized.groupBy("source").agg(F.sum("_all").cast("long").alias("source_size"))
    targets = source_targets(sources).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = materialise(targets, "targets")
    at = prefix_sums(sized, "source", "_key", "_all", sized.count(), ["doc_id", "size"], "_at")
    t = targets.withColumnRenamed("source", "_src")
    at = at.join(t, at["source"].eqNullSafe(t["_src"]), "left").drop("_src")
    left = F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("_at")
    return at.withColumn("budget", F.greatest(F.lit(0), F.least(F.col("_all"), left)).cast("long")), targets


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, last, taken) for every document.

    ``epochs`` is how often the whole document is taken and ``last`` how many of
    its words the cut leaves of one more copy; taken = epochs * size + last, and
    the sum of taken over a source is its target, rounded down.
    """
    at, _ = _place(docs, seed)
    one = at.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("_copy") * F.col("size"))).cast("long")
    return one.select("doc_id", "source", "size", "source_size", "target", "epochs", last.alias("last"), (F.col("epochs") * F.col("size") + last).alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, size, source_size, target, taken."""
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: Sources up to which their cuts are broadcast (some 100 bytes each).
BROADCAST_SOURCES = 50_000


def mix_documents(docs: DataFrame, seed: str = SEED, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: a row for each copy taken, with the columns of ``docs``.

    A source's cut is the place of the last document that it reaches, so a
    document learns from one row of its source how often it is taken, and no
    text is shuffled but that of the documents at a cut. In each source one copy at
    most is cut: it keeps the words that the budget still holds, single-spaced.
    Documents without words take no room and stay once.
    """
    names = docs.columns
    at, targets = _place(docs, seed)
    cuts = at.where("budget > 0").groupBy("source").agg(F.max(F.struct("_key", "doc_id", "size", "budget", "copies")).alias("_c")).withColumnRenamed("source", "_s")
    per_source = targets.select(F.col("source").alias("_src"), F.col("epochs").alias("_epochs")).join(cuts, F.col("_src").eqNullSafe(F.col("_s")), "left").drop("_s")
    per_source = materialise(per_source, "cuts")
    shared = not per_source.where("_c.copies > 1").isEmpty()  # rows that repeat at a cut
    if per_source.count() <= broadcast_sources:
        per_source = F.broadcast(per_source)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_d"), F.col("source").alias("_of"), n_words(F.col("text")).alias("_n"), random_key(F.col("doc_id"), F.col("text"), seed).alias("_key"))
    rows = rows.join(per_source, F.col("_of").eqNullSafe(F.col("_src")), "left")
    place = F.struct("_key", F.col("_d.doc_id").alias("doc_id"), F.col("_n").alias("size"))
    cut = F.struct(*(F.col(f"_c.{c}").alias(c) for c in ("_key", "doc_id", "size")))
    at_cut = F.col("_c").isNotNull() & (F.col("_n") > 0) & place.eqNullSafe(cut)
    # sizes of the copies taken: whole ones, and at the cut one of fewer words
    whole = F.when(F.col("_c").isNotNull() & (place < cut), F.col("_epochs") + 1).otherwise(F.col("_epochs"))
    last = F.when(at_cut, F.array("_c.budget")).otherwise(F.array().cast("array<bigint>"))
    takes = F.when(F.col("_n") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.array_repeat(F.col("_n"), whole.cast("int")), last))
    single = rows.where(~(at_cut & (F.col("_c.copies") > 1))) if shared else rows
    taken = single.select("_d", "_n", takes.alias("_takes"))
    if shared:
        same = rows.where(at_cut & (F.col("_c.copies") > 1)).groupBy("_d", "_of", "_n", "_epochs", F.col("_c.budget").alias("_budget")).agg(F.count("*").alias("_m"))
        before = F.coalesce(F.sum("_m").over(W.partitionBy("_of").orderBy(F.xxhash64("_d")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each variant of one document
        budget = F.greatest(F.lit(0), F.least(F.col("_m") * F.col("_n"), F.col("_budget") - before * F.col("_n")))
        same = same.withColumn("_left", budget.cast("long"))
        rest = F.col("_left") % F.col("_n")
        copies = F.concat(F.array_repeat(F.col("_n"), (F.col("_epochs") * F.col("_m") + F.expr("_left div _n")).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
        taken = taken.unionByName(same.select("_d", "_n", copies.alias("_takes")))
    d = taken.select("_d", "_n", F.explode("_takes").alias("_take"))
    full = F.col("_take") == F.col("_n")
    text = F.when(full, F.col("_d.text")).otherwise(F.array_join(F.slice(words(F.col("_d.text")), F.lit(1), F.col("_take").cast("int")), " "))
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(full, F.col("_d.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return d.select(*(new.get(c, F.col(f"_d.`{c}`")).alias(c) for c in names))


_W = ", ".join(f"{w}::DOUBLE" for w in WEIGHTS)
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, '')) || '/{SEED}'), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, {MAX_EPOCHS}::DOUBLE * source_size AS cap, ([{_W}])[1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM s),
v AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS everything FROM w),
l AS (SELECT *, ({TOTAL}::DOUBLE * everything - full_) / rest AS lev FROM v),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT min_by(lev, cap / w) FROM l WHERE lev * w <= cap) * w, cap)) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
    CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, floor(target)::BIGINT - e * source_size - pos)))::BIGINT AS taken FROM p
"""
