"""SimHash near-dedup with vantage-point trees.

Fingerprints are taken per text in Arrow batches. Distinct fingerprints are
then searched for pairs at Hamming distance
MAX_BITS or less:

* Routing. A vantage point, chosen of a sample for the spread of its distances,
  measures the Hamming distance on one block of bits;
  distances to the points of all levels name a fingerprint's cell (shard). By
  the triangle inequality two fingerprints at distance d lie at cells whose
  coordinates differ by d at most, and as the blocks of the levels are disjoint
  the differences add up over the levels. So a fingerprint is also sent, as a
  query, to each neighbour cell within MAX_BITS; of two cells the smaller asks.
* Search. Inside a cell a vantage-point tree over disjoint 8-bit blocks is an
  array sorted by its ring numbers; queries descend it level by level and drop
  every branch whose summed ring difference exceeds MAX_BITS. What remains is
  compared exactly. The method is exact: no pair is missed, none is made up.
* Components. A cell returns a spanning forest of its links, never all pairs;
  large-star / small-star rounds join the forests across cells.

More levels are used until the fullest cell holds CELL_ROWS fingerprints or all
levels are in use; the members and the queries of a cell still fuller are dealt
into blocks, and each two are a task. So no task holds more than CELL_ROWS of
either. Other cells stay whole.

Edge cases: a null, empty or blank text has fingerprint zero, and links like any
other. Equal texts share a fingerprint and cost one row in the search, however
many there are. A null doc_id links like any other but never names a component;
such a row takes its group's smallest doc_id, or null. Ties (a bit set in exactly
half the hashes) leave the bit zero. Only doc_id and text are read, so no other
column can clash; ``apply_near_dedup`` returns all columns of its input as they
are. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, map_arrow, materialise

MAX_BITS = 2
SHINGLE = 3
#: The pipeline's stage takes five words, the same search and an exact check of similarity 0.8 (shingles.py); op2's contract fixes three words and two bits.
SEED = 42
#: Members of a cell that one task searches at most.
CELL_ROWS = 40_000
#: Level counts that routing may use: with r levels a block has 64 / r bits.
ROUTES = (1, 2, 3, 4, 6, 8)
#: Over-full cells up to which their block counts are broadcast (16 bytes each).
FULL_CELLS = 100_000
#: Shingles hashed at a time, for texts of any length.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    ones, n = np.zeros(64, np.int64), 0
    while block := b"".join(map(xxhash.xxh64_digest, islice(grams, BLOCK), repeat(SEED))):
        h = np.frombuffer(block, np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def set_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of 64-bit hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[start : start + BLOCK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [_signed(fingerprint(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer."""
    d = docs.select(F.col("doc_id").cast("long"), "text")
    return map_arrow(d, _fingerprints, "doc_id long, fp long")


#: Fingerprints of which vantage points are chosen.
VANTAGE_ROWS = 512


def _levels(count: int, seed: int, sample: np.ndarray) -> list[tuple[int, int]]:
    """(vantage point, mask) per level: disjoint masks over all 64 bits; of 16 members of ``sample`` the one whose distances spread most is the point."""
    rnd = random.Random(seed)
    bits = list(range(64))
    rnd.shuffle(bits)
    masks = [sum(1 << b for b in bits[i::count]) for i in range(count)]
    some = sample[: VANTAGE_ROWS]
    if not len(some):
        return [(0, m) for m in masks]
    few = some[:: max(1, len(some) // 16)][:16]
    return [(int(max(few.tolist(), key=lambda v: np.bitwise_count((some ^ np.uint64(v)) & np.uint64(m)).var())), m) for m in masks]


def _distance(fp: Column, vantage: int, mask: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(vantage)).cast("long")).bitwiseAND(F.lit(_signed(mask)).cast("long")))


def _cells(fp: Column, levels: list[tuple[int, int]], offsets: list[tuple[int, ...]]) -> Column:
    """The cells at ``offsets`` from a fingerprint's own, as packed integers; cells off the scale hold nothing and are met by no member."""
    at = [_distance(fp, v, m) + MAX_BITS for v, m in levels]
    pack = lambda o: sum(((a + x).cast("long") * (1 << (7 * i)) for i, (a, x) in enumerate(zip(at, o, strict=True))), F.lit(0).cast("long"))
    return F.array(*(pack(o) for o in offsets))


def _offsets(count: int) -> list[tuple[int, ...]]:
    """Own cell first, then the half of the neighbours within MAX_BITS that stand above it."""
    zero = (0,) * count
    near = lambda k, left: [(x, *rest) for x in range(-left, left + 1) for rest in near(k - 1, left - abs(x))] if k else [()]
    return [zero, *(o for o in near(count, MAX_BITS) if o > zero)]


# --- inside a cell -----------------------------------------------------------

_DEPTH = 8
_LEAF = 48


def _rings(x: np.ndarray, tree: list[tuple[int, int]]) -> np.ndarray:
    """Distances to the vantage points of all levels, a row a level."""
    return np.stack([np.bitwise_count((x ^ np.uint64(v)) & np.uint64(m)).astype(np.int64) for v, m in tree])


def _search(members: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query index, member index) within MAX_BITS, found by descending the tree of ``members``."""
    tree = _levels(_DEPTH, 2, members[:: max(1, len(members) // VANTAGE_ROWS)])
    keys = np.zeros(len(members), np.int64)
    for ring in _rings(members, tree):
        keys = keys * 9 + ring
    order = np.argsort(keys, kind="stable")
    keys, sorted_members = keys[order], members[order]
    for start in range(0, len(queries), 4096):
        q = queries[start : start + 4096]
        rings = _rings(q, tree)
        who, prefix, left = np.arange(len(q)), np.zeros(len(q), np.int64), np.full(len(q), MAX_BITS)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(members), np.int64)
        for level in range(_DEPTH + 1):
            leaf = (hi - lo <= _LEAF) | (level == _DEPTH)
            if leaf.any():
                yield from _compare(q, who[leaf], lo[leaf], hi[leaf], sorted_members, order, start)
            who, prefix, left = who[~leaf], prefix[~leaf], left[~leaf]
            if not len(who):
                break
            span = 9 ** (_DEPTH - 1 - level)
            parts = []
            for step in range(-MAX_BITS, MAX_BITS + 1):
                ring = rings[level][who] + step
                ok = (np.abs(step) <= left) & (ring >= 0) & (ring <= 8)  # the triangle bound, summed over the levels above
                child = prefix[ok] * 9 + ring[ok]
                a, b = np.searchsorted(keys, child * span), np.searchsorted(keys, (child + 1) * span)
                some = b > a
                parts.append((who[ok][some], child[some], left[ok][some] - abs(step), a[some], b[some]))
            who, prefix, left, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))


def _compare(q: np.ndarray, who: np.ndarray, lo: np.ndarray, hi: np.ndarray, members: np.ndarray, order: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact distances of queries to leaf ranges, a bounded number of pairs at a time."""
    sizes = hi - lo
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1 << 18, int(sizes.sum()), 1 << 18))
    for w, a, n in zip(*(np.split(x, np.unique(cuts)) for x in (who, lo, sizes)), strict=True):
        total = int(n.sum())
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
        one = np.repeat(w, n)
        near = np.bitwise_count(q[one] ^ members[at]) <= MAX_BITS
        yield one[near] + start, order[at[near]]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook components together along edges; ``parent`` stays flat."""
    while len(a):
        a, b = parent[a], parent[b]
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(flat := parent[parent], parent):
                parent[:] = flat


def _forest(t: pa.Table) -> pa.Table:
    """One cell -> edges (rep, root) of a spanning forest of its links."""
    fp = t.column("fp").to_numpy().view(np.uint64)
    rep, own, asks = t.column("rep").to_numpy(), *(t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("own", "asks"))
    by = np.lexsort((~own, rep))  # smaller names first: roots are the smallest
    fp, rep, own, asks = fp[by], rep[by], own[by], asks[by]
    at, ask = np.flatnonzero(own), np.flatnonzero(asks)
    parent = np.arange(len(fp))
    if len(at) and len(ask):
        for a, b in _search(fp[at], fp[ask]):
            _union(parent, ask[a], at[b])
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.table({"u": pa.array(rep[child], pa.int64()), "v": pa.array(rep[parent[child]], pa.int64())})


# --- across cells ------------------------------------------------------------


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect all fingerprints within MAX_BITS; ``distinct`` has one row (fp, rep) a fingerprint."""
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(VANTAGE_ROWS).toArrow().column("fp").to_numpy().view(np.uint64) if n > CELL_ROWS else np.empty(0, np.uint64)
    for count in ROUTES:
        levels = _levels(count, 1, sample)
        own = _cells(F.col("fp"), levels, [(0,) * count])[0]
        fullest = distinct.groupBy(own.alias("cell")).count().agg(F.max("count")).first()[0] or 0 if n > CELL_ROWS else n
        if fullest <= CELL_ROWS:
            break
    routed = distinct.select("fp", "rep", F.posexplode(_cells(F.col("fp"), levels, _offsets(count))).alias("o", "cell")).select("fp", "rep", "cell", (F.col("o") == 0).alias("own"))
    whole = routed.select("fp", "rep", "own", F.lit(True).alias("asks"), "cell", F.lit(0).alias("b"), F.lit(0).alias("q"))
    if fullest > CELL_ROWS:
        # a region with too many fingerprints: its members in blocks, its queries in blocks, a task for each two; other cells stay whole
        routed = materialise(routed, "routed")
        blocks = lambda c: F.ceil(c / CELL_ROWS).cast("int")
        sizes = routed.groupBy("cell").agg(F.count_if("own").alias("m"), F.count("*").alias("c")).where(F.col("m") > CELL_ROWS)
        full = materialise(sizes.select(F.col("cell").alias("_cell"), blocks(F.col("m")).alias("_m"), blocks(F.col("c")).alias("_q")), "full")
        small = full.count() <= FULL_CELLS
        at = routed.join(F.broadcast(full) if small else full, routed["cell"] == full["_cell"], "left")
        split = at.where("_cell IS NOT NULL")
        block = lambda salt, k: F.pmod(F.xxhash64("fp", F.lit(salt)), k).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        members = split.where("own").select("fp", "rep", "own", F.lit(False).alias("asks"), "cell", block(1, F.col("_m")).alias("b"), every("_q").alias("q"))
        queries = split.select("fp", "rep", F.lit(False).alias("own"), F.lit(True).alias("asks"), "cell", every("_m").alias("b"), block(2, F.col("_q")).alias("q"))
        rest = at.where("_cell IS NULL").select("fp", "rep", "own", F.lit(True).alias("asks"), "cell", F.lit(0).alias("b"), F.lit(0).alias("q"))
        whole = rest.unionByName(members).unionByName(queries)
    return whole.groupBy("cell", "b", "q").applyInArrow(_forest, "u long, v long").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star until the edges stay the same: the
    rounds grow with the logarithm of the longest chain, not with a hub's degree.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = edges.count()
    while count:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = materialise(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        n = now.count()
        same = n == count and now.join(edges, ["u", "v"], "left_anti").isEmpty()
        discard(large, edges)
        edges, count = now, n
        if same:
            break
    labels = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(labels, "u", "left_anti").select("u", F.col("u").alias("component"))
    return labels.unionByName(roots).withColumnRenamed("u", "node")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(fp, component) of every row of ``distinct`` (fp, ...): the smallest fingerprint within reach, as a signed integer."""
    found = components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(distinct["fp"], F.coalesce("component", distinct["fp"]).alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    fps = materialise(fingerprints(docs), "simhash")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    of = fingerprint_components(distinct).join(distinct, "fp")
    names = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    mapped = of.join(names, "component").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(mapped, fps["fp"] == mapped["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with _h, a hash of all columns: never null, and equal for rows equal in all columns only."""
    return docs.withColumn("_h", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``groups`` (doc_id, h, component; a row for each of ``docs``).

    The smallest doc_id stays, a null one only where all are null, and of rows
    that share it the first by hash. Rows equal in all columns are one document.
    """
    rows = groups.groupBy("component", "doc_id", "h").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("k")
    keep = materialise(rows.groupBy("component").agg(first).select(F.col("k.doc_id").alias("_keep"), F.col("k.h").alias("_kh"), F.col("k.n").alias("_n")), "keep")
    hashed = row_hash(docs)
    kept = hashed.join(keep, (hashed["_h"] == keep["_kh"]) & hashed["doc_id"].cast("long").eqNullSafe(keep["_keep"]))
    return kept.where("_n = 1").select(*docs.columns).unionByName(kept.where("_n > 1").select(*docs.columns).distinct())


def apply_near_dedup(docs: DataFrame, shingle: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, judged by the texts: see ``keep_one``.

    Fingerprints of the shingle sets are searched as above; what lies within
    MAX_BITS is checked exactly. Pairs of similarity 0.8 differ by 10 bits in the
    mean and by 16 at times, too wide a radius for any search, so ``shingles``
    finds those across the fingerprints' components by sketches and checks them
    in the same way: no link of that similarity is lost.
    """
    d = row_hash(docs).select(F.col("doc_id").cast("long"), "text", F.col("_h").alias("h"))
    return keep_one(docs, shingles.groups(d, shingle, similarity))
