"""Sharding by a k-d tree over document metadata.

A node splits at the weighted median (weight: bytes) of its widest dimension;
after the levels that bring leaves to the target bytes, every leaf is a shard
with its equal share. Dimensions are doc_id, text length, and the code-point rank
of source and lang among all values; the widest is the one whose range in the
node is the largest part of its range in the whole table.

Medians are distributed: each pass makes one histogram per node (BINS bins over
the node's current range, pre-aggregated map-side), keeps the bin the median
falls into as the next range, and stops at a single value. A value that many
documents share (one source with a third of all bytes) is then split among
itself by a uniform hash of the document, in the same way. All nodes of a level
share a pass, the driver sees one row a node, and a pass reads metadata only.

Edge cases: a null text has size 1 and crc32 0; null metadata sorts first. Equal
rows may part, but rows equal in doc_id and text stand in one shard. With fewer
documents than shards some shards stay empty. Ties of a median go by the hash. An
empty table gives an empty result. Only doc_id, text, source and lang are read, so
other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise
from .mixing import prefix_sums, random_key

DEPTH = 4
#: Bins of a histogram pass; node count times this bounds what a pass shuffles.
BINS = 65536
DIMENSIONS = ("d_id", "d_len", "d_source", "d_lang")
#: 32 bits that split a tied value; the 60-bit key that orders slots.
HASH, KEY = "h", "key"
SEED = "shard-1"


#: Distinct sources or languages up to which their ranks are broadcast (some 60 bytes each).
BROADCAST_RANKS = 200_000


def _ranked(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Add the code-point rank of ``column`` among its distinct values, null first; one row a value is ranked in one task."""
    values = rows.groupBy(F.col(column).alias("_v")).agg(F.lit(1)).select("_v", (F.row_number().over(W.orderBy(F.col("_v").asc_nulls_first())) - 1).cast("long").alias(out))
    values = materialise(values, "ranks")
    side = F.broadcast(values) if values.count() <= BROADCAST_RANKS else values
    return rows.join(side, rows[column].eqNullSafe(values["_v"]), "left").drop("_v")


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row a document: the coordinates, its size and a uniform 60-bit hash of the document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("d_id"),
        F.length(text).cast("long").alias("d_len"),
        "source",
        "lang",
        random_key(F.col("doc_id"), F.col("text"), SEED).alias(KEY),
    )
    rows = materialise(rows, "kd")
    return _ranked(_ranked(rows, "source", "d_source"), "lang", "d_lang").select("doc_id", "size", "text_crc32", *DIMENSIONS, KEY, F.shiftright(F.col(KEY), 28).alias(HASH))


#: node -> (dimension, value, hash), a dictionary per level; a row stands left if (coordinate, hash) < (value, hash).
Levels = list[dict[int, tuple[str, int, int]]]


def descend(levels: Levels, leaf) -> Column:
    """``leaf(node)`` of the node a row falls into, as nested conditions: a row evaluates one comparison a level."""

    def at(node: int, level: int) -> Column:
        if level == len(levels) or node not in levels[level]:
            return leaf(node << (len(levels) - level))
        d, v, h = levels[level][node]
        right = (F.col(d) > v) | ((F.col(d) == v) & (F.col(HASH) >= h))
        return F.when(right, at(2 * node + 1, level + 1)).otherwise(at(2 * node, level + 1))

    return at(0, 0)


def assign(levels: Levels) -> Column:
    """The node of a row under the splits found so far, numbered left to right."""
    return descend(levels, lambda n: F.lit(n).cast("int"))


def _of(n: Column, values: dict[int, int]) -> Column:
    """A number per node (at most 2 ** DEPTH of them)."""
    out = F.lit(None).cast("bigint")
    for k, v in values.items():
        out = F.when(n == k, F.lit(v).cast("bigint")).otherwise(out)
    return out


def _medians(rows: DataFrame, levels: Levels, coordinate, ranges: dict[int, tuple[int, int]], below: dict[int, int], half: dict[int, int]) -> dict[int, int]:
    """For every node the least value v of its coordinate at which the weight up to v, added to ``below``, passes ``half``.

    ``below`` becomes the weight under v. Ranges narrow by BINS a pass, so that a
    64-bit coordinate takes four passes at most.
    """
    found = {n: lo for n, (lo, hi) in ranges.items() if lo == hi}
    while open_ := {n: r for n, r in ranges.items() if n not in found}:
        width = {n: max(1, -(-(hi - lo + 1) // BINS)) for n, (lo, hi) in open_.items()}
        value = lambda f: descend(levels, lambda n: f(n) if n in open_ else F.lit(None).cast("bigint"))
        number = lambda v: F.lit(v).cast("bigint")
        inside = rows.select("size", assign(levels).alias("n"), value(coordinate).alias("c"), value(lambda n: number(open_[n][0])).alias("lo"), value(lambda n: number(open_[n][1])).alias("hi"), value(lambda n: number(width[n])).alias("w"))
        bins = inside.where(F.col("c").between(F.col("lo"), F.col("hi"))).groupBy("n", F.expr("(c - lo) div w").alias("b")).agg(F.sum("size").alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        upto = F.sum("s").over(W.partitionBy("n").orderBy("b")) + _of(F.col("n"), below)
        crossing = bins.withColumn("upto", upto).where(F.col("upto") > _of(F.col("n"), half))
        crossed = crossing.groupBy("n").agg(F.min_by(F.struct("s", "upto", "lo", "hi"), "b").alias("x")).collect()  # a row a node
        if {r.n for r in crossed} != set(open_):
            raise AssertionError("a median lies outside its range")
        for r in crossed:
            ranges[r.n] = (r.x.lo, r.x.hi)  # the values that the bin does hold
            below[r.n] = int(r.x.upto - r.x.s)
            if ranges[r.n][0] == ranges[r.n][1]:
                found[r.n] = r.x.lo
    return found


def build(meta: DataFrame, depth: int = DEPTH) -> Levels:
    """The splits of every level."""
    levels: Levels = []
    whole: dict[str, int] = {}
    for level in range(depth):
        stats = meta.groupBy(assign(levels).alias("n")).agg(F.sum("size").alias("s"), *(f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("min", F.min), ("max", F.max)))).collect()  # a row a node
        if level == 0 and stats:
            whole = {d: max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) for d in DIMENSIONS}
        pick = {r.n: max(DIMENSIONS, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / whole[d], -DIMENSIONS.index(d))) for r in stats}
        below, half = dict.fromkeys(pick, 0), {r.n: r.s // 2 for r in stats}
        value = _medians(meta, levels, lambda n: F.col(pick[n]), {r.n: (r[f"min_{pick[r.n]}"], r[f"max_{pick[r.n]}"]) for r in stats}, below, half)
        tied = meta.where(descend(levels, lambda n: F.col(pick[n]) == value[n] if n in value else F.lit(False))) if value else meta
        cut = _medians(tied, levels, lambda n: F.col(HASH), {n: (0, (1 << 32) - 1) for n in value}, below, half)
        levels.append({n: (pick[n], value[n], cut[n]) for n in value})
    return levels


def levels_for(meta: DataFrame, target_bytes: int) -> int:
    """Levels after which a leaf's share is ``target_bytes`` at most."""
    total = meta.agg(F.sum("size")).first()[0] or 0
    return max(0, math.ceil(math.log2(total / target_bytes))) if total > target_bytes else 0


def shard(docs: DataFrame, depth: int = DEPTH, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots run from 0 in each shard without gaps.

    ``target_bytes`` decides the depth of the tree, else ``depth`` does. The
    splits become one nested condition a row, so a run makes at most some
    thousand shards; more are made by sharding each shard again.
    """
    meta = materialise(metadata(docs), "kd")
    levels = build(meta, depth if target_bytes is None else levels_for(meta, target_bytes))
    placed = meta.select("doc_id", "size", "text_crc32", KEY, assign(levels).cast("int").alias("shard")).withColumn("_one", F.lit(1).cast("long"))
    slots = prefix_sums(placed, "shard", KEY, "_one", placed.count(), ["doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
