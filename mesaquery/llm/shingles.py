"""Near copies by exact Jaccard similarity of shingle sets.

Two texts are linked if their sets of word shingles have a similarity of at
least the threshold; components of links are groups. Every such pair is found
and none is made up:

* Copies. Texts with equal sets collapse to one row by a digest of the set.
* Fingerprints. The SimHash of a set is searched as in ``simhash``: vantage points
  route it to a shard and, as a query, to the neighbour shards, a tree searches
  each shard, and components of fingerprints within its MAX_BITS are the first
  candidate groups. These alone find the pairs that lie so near.
* Sketches find what the radius leaves out: pairs across those groups, whose
  fingerprints differ by more. A set of up to SKETCH items is its own sketch. Of larger ones the
  items whose hash is in the lowest 2 ** -level part make the sketch, some SKETCH / 2
  to SKETCH of them, however long the text; sets that may be similar meet on a
  level, as each takes part on its own and, near its edge, on the next one. A set
  shares at least the threshold of its items with a similar one, so a sketch
  that shares fewer items with all other groups together is out. For sampled sketches
  the bound is that of a binomial tail: a pair right at the threshold is missed with a
  probability of TAIL at most, more similar ones with far less.
* Prefix filter. What two sketches must share, they share already among each one's
  rarest items but for so many; only these link.
* Candidates. Groups whose sets share such an item are joined to the smallest of
  them, never pairwise; components of these stars are candidate groups, and no
  similar pair lies across two of them. Whole sets are made again for these alone.
* Exact check, by vantage points. Jaccard distance is a metric. In a task, a set
  is a vantage point: its exact distances to all others come from an inverted
  index; what lies within the radius is linked, and where nothing lies between
  one and two radii, the linked sets need no distances of their own (triangle
  bound). A group of more than GROUP_ITEMS items is parted around its smallest set
  into rings one radius wide: links lead to the same or the next ring only, so
  each ring is searched by its own sets and by those of the next one; the
  innermost ring is linked already. Rings are dealt into blocks of GROUP_ITEMS.

Edge cases: a null, empty or blank text has an empty set with fingerprint zero; all
of these are copies of each other. A text of fewer words than a shingle is one shingle. Rows
that repeat have one set. Ties don't arise: the smallest digest leads. An empty
table has no groups. Columns other than doc_id, text and h aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialise

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Items of a sketch at most, on the average.
SKETCH = 64
TAIL = 1e-7
#: Times that sets which share too little go; what goes can only leave others with too little.
ROUNDS = 2
#: Items, over all its sets, that one verifying task or block holds (a single set may have more): some 50 MB of memory.
GROUP_ITEMS = 500_000
#: Sets in candidate groups up to which their keys are broadcast (40 bytes each).
BROADCAST_KEYS = 300_000


def items(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: as in simhash.fingerprint
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)] if w else []
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(g, SEED) for g in grams), np.uint64).view(np.int64))


@lru_cache(maxsize=4096)
def least(m: int, similarity: float, sampled: bool) -> int:
    """How many of the m items of its sketch a set shares with a similar set at least."""
    if not sampled:
        return max(1, math.ceil(similarity * m - 1e-9))
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * similarity**k * (1 - similarity) ** (m - k)
        if below > TAIL:
            return max(1, k)
    return max(1, m)


def sketches(s: np.ndarray, similarity: float) -> list[tuple[int, np.ndarray]]:
    """(least, items) of a set on each level that it takes part in; the lowest six bits of an item name the level."""
    level = lambda n: max(0, math.ceil(math.log2(n / SKETCH))) if n else 0
    out = []
    for at in sorted({level(len(s)), level(len(s) / similarity)}):
        low = s if at == 0 else s[s.view(np.uint64) >> np.uint64(64 - at) == 0]
        if len(low):
            out.append((least(len(low), similarity, at > 0), np.unique(low & ~np.int64(63) | np.int64(at))))
    return out


def signatures(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h, key (a digest of the set), n (its items), fp (its fingerprint) and sketches of every row of ``docs`` (doc_id, text, h)."""
    from .simhash import set_fingerprint

    kind = pa.list_(pa.struct([("least", pa.int32()), ("xs", pa.list_(pa.int64()))]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [items(t.as_py(), shingle) for t in b.column(1)]
            found = [[{"least": n, "xs": x} for n, x in sketches(s, similarity)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array(found, kind)], names=["doc_id", "h", "key", "n", "fp", "sketches"])

    return map_arrow(docs.select("doc_id", "text", "h"), emit, "doc_id long, h long, key long, n long, fp long, sketches array<struct<least:int,xs:array<bigint>>>")


def digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of items."""
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def _verify(similarity: float):
    """A verifying task: rows (key, items, asks) -> links (u, v), u > v, that connect all similar rows of which one asks."""

    from .simhash import _union

    def links(t: pa.Table) -> pa.Table:
        key, first = np.unique(t.column("key").to_numpy(), return_index=True)
        lists = t.column("items").combine_chunks().take(pa.array(first))
        sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        asks = np.zeros(len(key), bool)
        np.logical_or.at(asks, np.searchsorted(key, t.column("key").to_numpy()), t.column("asks").to_numpy(zero_copy_only=False).astype(bool))
        values, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        by = np.argsort(code, kind="stable")
        holders, starts = np.repeat(np.arange(len(key)), sizes)[by], np.searchsorted(code[by], np.arange(len(values) + 1))
        ends = np.cumsum(sizes)
        parent = np.arange(len(key))
        for i in range(len(key)):
            if not asks[i]:
                continue
            mine = code[ends[i] - sizes[i] : ends[i]]
            mine = mine[starts[mine + 1] - starts[mine] > 1]
            if not len(mine):
                continue
            who, shared = np.unique(np.concatenate([holders[starts[x] : starts[x + 1]] for x in mine]), return_counts=True)
            alike = shared / (sizes[i] + sizes[who] - shared)
            close = alike >= similarity - 1e-9
            near = who[close]
            _union(parent, near, np.full(len(near), i))
            if not (~close & (alike >= 2 * similarity - 1 - 1e-9)).any():
                asks[near] = False  # all that is within the radius of these is linked to i
        child = np.flatnonzero(parent != np.arange(len(key)))
        a, b = key[child], key[parent[child]]
        return pa.table({"u": pa.array(np.maximum(a, b), pa.int64()), "v": pa.array(np.minimum(a, b), pa.int64())})

    return links


def near(sets: DataFrame) -> DataFrame:
    """(key, c) of every key: its fingerprint's component, named by the smallest fingerprint within reach."""
    from .simhash import fingerprint_components

    fps = materialise(sets.select("key", "fp").distinct(), "simhash")
    found = fingerprint_components(materialise(fps.select("fp").distinct(), "distinct"))
    return materialise(fps.join(found, "fp").select("key", F.col("component").alias("c")), "near")


def candidates(sets: DataFrame) -> DataFrame:
    """(node, component) of the keys that may have similar ones, a group named by its smallest; ``sets`` is what ``signatures`` gives."""
    from .simhash import components

    def shared(rows: DataFrame) -> DataFrame:
        """The rows (x, key, c) whose item a set of another component has as well, with the smallest such component and how many rows have it."""
        hubs = rows.groupBy("x").agg(F.min("c").alias("hub"), F.max("c").alias("_top"), F.count("*").alias("n")).where("hub <> _top").select("x", "hub", "n")
        return materialise(rows.join(hubs, "x"), "shared")

    by_fp = near(sets)
    level = F.col("x").bitwiseAND(63).alias("level")
    need = sets.select("key", F.explode("sketches").alias("s")).where("size(s.xs) > 0").select("key", F.get("s.xs", F.lit(0)).alias("x"), F.col("s.least").alias("least")).select("key", level, "least").distinct()
    one = sets.groupBy("key").agg(F.first("sketches").alias("sketches")).join(by_fp, "key")  # copies collapse before they are sent
    rows = shared(one.select("key", "c", F.explode("sketches.xs").alias("xs")).select("key", "c", F.explode("xs").alias("x")))
    for _ in range(ROUNDS):
        live = rows.groupBy("key", level).agg(F.count("*").alias("s")).join(need, ["key", "level"]).where("s >= least").select("key", "level")
        before, rows = rows, shared(rows.select("x", "key", "c").withColumn("level", level).join(live, ["key", "level"]).select("x", "key", "c"))
        discard(before)
    # the rarest first: of the s items shared, s - least + 1 must do
    order = W.partitionBy("key", "level").orderBy("n", "x")
    ranked = rows.withColumn("level", level).withColumn("r", F.row_number().over(order)).withColumn("s", F.count("*").over(W.partitionBy("key", "level")))
    few = ranked.join(need, ["key", "level"]).where("r <= s - least + 1").select("x", "key", "c")
    stars = components(shared(few).where("c <> hub").select(F.col("c").alias("u"), F.col("hub").alias("v")).distinct())
    grouped = materialise(by_fp.join(stars, by_fp["c"] == stars["node"], "left").select("key", F.coalesce("component", "c").alias("g")), "grouped")
    names = grouped.groupBy("g").agg(F.min("key").alias("component"), F.max("key").alias("_top")).where("component <> _top").select("g", "component")
    return grouped.join(names, "g").select(F.col("key").alias("node"), "component")


def links(docs: DataFrame, sets: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Edges (u, v), u > v, of keys that connect all sets of at least that similarity."""
    groups = materialise(candidates(sets), "candidates")
    # one row of ``docs`` stands for all that have its set
    one = sets.groupBy("key").agg(F.min("h").alias("_h"), F.first("n").alias("n")).join(groups, F.col("key") == F.col("node"))
    one = materialise(one.select("_h", "key", "component", "n"), "sets")
    size = one.groupBy(F.col("component").alias("_c")).agg(F.sum("n").alias("_s"))
    one = materialise(one.join(size, one["component"] == size["_c"]).select("_h", "key", "component", "n", (F.col("_s") > group_items).alias("large")), "chosen")
    total, items_ = one.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    picked = docs.join(F.broadcast(one) if total <= BROADCAST_KEYS else one, docs["h"] == one["_h"]).select("text", "key", "component", "large")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [items(t.as_py(), shingle) for t in b.column(0)]
            right = [i for i, (s, k) in enumerate(zip(sets, b.column(1).to_pylist(), strict=True)) if digest(s) == k]  # another row may have the same row hash
            at = pa.array(right, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in (1, 2, 3)), pa.array([sets[i] for i in right], pa.list_(pa.int64()))], names=["key", "component", "large", "items"])

    members = map_arrow(picked, emit, "key long, component long, large boolean, items array<long>").groupBy("key", "component", "large").agg(F.first("items").alias("items"))
    members = materialise(members, "members")
    bins = max(1, -(-items_ // group_items))
    small = members.where("not large").select("key", "items", F.lit(True).alias("asks"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"))
    found = small.groupBy("bin").applyInArrow(_verify(similarity), "u long, v long")
    large = members.where("large").drop("large")
    if not large.isEmpty():
        found = found.unionByName(_rings(large, similarity, group_items))
    return found.distinct()


def _rings(members: DataFrame, similarity: float, group_items: int) -> DataFrame:
    """Links within groups of more than ``group_items`` items, by rings around each group's smallest set."""
    vantage = members.where("key = component").select(F.col("component").alias("_v"), F.col("items").alias("_vitems"))
    shared = F.size(F.array_intersect("items", "_vitems"))
    distance = 1 - shared / (F.size("items") + F.size("_vitems") - shared)
    radius = 1 - similarity
    # the small allowance keeps a set on a ring's edge within reach of both sides
    rings = members.join(vantage, members["component"] == vantage["_v"]).select("key", "component", "items", F.greatest(F.lit(0), F.ceil((distance - 1e-9) / (radius + 2e-9)) - 1).cast("int").alias("ring"))
    rings = materialise(rings, "rings")
    inner = rings.where("ring = 0 AND key <> component").select(F.greatest("key", "component").alias("u"), F.least("key", "component").alias("v"))
    sizes = rings.groupBy("component", "ring").agg(F.sum(F.size("items")).alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / group_items)).cast("int")
    # ring r is asked by r (unless it is 0) and by r + 1
    own = sizes.select("component", F.col("ring").alias("_r"), blocks(F.col("n")).alias("_blocks"))
    asking = sizes.withColumn("_r", F.explode(F.when(F.col("ring") > 0, F.array("ring", F.col("ring") - 1)).otherwise(F.array().cast("array<int>")))).select("component", "ring", "_r", blocks(F.col("n")).alias("_qblocks"))
    plan = materialise(asking.join(own, ["component", "_r"]), "plan")  # a row for each pair of neighbouring rings
    pick = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = rings.join(plan, ["component", "ring"]).select("key", "items", "component", "_r", "ring", span(F.col("_blocks")).alias("b"), pick(F.col("_qblocks")).alias("q"), F.lit(True).alias("asks"))
    held = rings.withColumnRenamed("ring", "_r").join(plan, ["component", "_r"]).select("key", "items", "component", "_r", "ring", pick(F.col("_blocks")).alias("b"), span(F.col("_qblocks")).alias("q"), F.lit(False).alias("asks"))
    return inner.unionByName(asks.unionByName(held).groupBy("component", "_r", "ring", "b", "q").applyInArrow(_verify(similarity), "u long, v long"))


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, h and component of every row of ``docs`` (doc_id, text, h)."""
    from .simhash import components

    sets = materialise(signatures(docs, shingle, similarity), "shingles")
    found = components(links(docs, sets, shingle, similarity, group_items))
    return sets.select("doc_id", "h", "key").join(found, F.col("key") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "key").alias("component"))
