"""Duplicates, entity resolution, retention."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_accents, levenshtein_ratio, number_tokens, tokens
from .shared import batched, cut, discard


def exact_duplicates(docs: DataFrame, id_: str, key: Column) -> DataFrame:
    """(id, keeper): the smallest id of those with an equal key; an equi-join against one row a key, so no group is gathered."""
    k = docs.select(F.col(id_).alias("id"), key.alias("_k"))
    return k.join(k.groupBy("_k").agg(F.min("id").alias("keeper")), "_k").select("id", "keeper")


#: Items, the most frequent ones, whose order by frequency is given to every task (12 bytes each); others are rarer and stand before them by hash.
RANKED_ITEMS = 500_000


def _packed(ranks: np.ndarray, rare: np.ndarray) -> bytes:
    """A set's ranks and rare hashes, both ascending, as few bytes."""
    steps = np.diff(ranks, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(rare).to_bytes(4, "little") + rare.astype("<i8").tobytes() + zlib.compress(steps, 1)


def _unpacked(body: bytes) -> np.ndarray:
    """Rare hashes and ranks as one array of unlike 64-bit numbers."""
    cut_at = 4 + 8 * int.from_bytes(body[:4], "little")
    steps = np.frombuffer(zlib.decompress(body[cut_at:]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.concatenate([np.frombuffer(body[4:cut_at], "<i8"), np.cumsum(steps, dtype=np.int64)])


def jaccard_pairs(sets: DataFrame, threshold: float, id_: str = "id", items: str = "items", block: str | None = None, strict: bool = False, ranked: int = RANKED_ITEMS) -> DataFrame:
    """(a, b, similarity), a < b: pairs of distinct sets with Jaccard similarity of at least the threshold (above it if ``strict``).

    Items travel as 64-bit hashes. Prefix filter: they are ordered from rare to
    frequent (``ranked`` of them by count, those before by hash: any one order is right), and
    two sets that are similar enough share an item among their first
    n - ceil(t * n) + 1. A pair comes from an item only if its sizes are near enough and
    enough items are left after the place where the prefixes meet; the first item
    that they share always is such a one. Sets travel packed, by rank, and are
    compared exactly. Equal sets count once (by their smallest id), so copies cost
    nothing; ``block`` (a column) keeps pairs within groups.
    """
    group = F.col(block) if block else F.lit(0)
    s = sets.select(F.col(id_).alias("id"), group.alias("g"), F.array_distinct(F.transform(items, lambda x: F.xxhash64(x))).alias("s")).where(F.size("s") > 0)
    freq = s.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    top = freq.orderBy(F.desc("f"), "x").limit(ranked).toArrow()
    known = top.column("x").to_numpy()
    by = np.argsort(known)
    hashes, rank_of = known[by], by.astype(np.int64)
    whole = len(known) < ranked  # what has no rank then stands in one set alone, and meets nothing

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "k": [], "xs": [], "body": []}
            values, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(hashes, values), max(0, len(hashes) - 1))
            has = hashes[at] == values if len(hashes) else np.zeros(len(values), bool)
            for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                v, h = values[lo:hi], has[lo:hi]
                ranks, rare = np.sort(rank_of[at[lo:hi][h]]), np.sort(v[~h])
                n = hi - lo
                keep = int(n - np.ceil(threshold * n - 1e-9) + 1)
                first = np.concatenate([rare, ranks[::-1]])[:keep]
                body = _packed(ranks, rare)
                out["n"].append(int(n))
                out["k"].append(sha256(body).digest()[:16])
                out["xs"].append([(int(x), p) for p, x in enumerate(first.tolist()) if not (whole and p < len(rare))])
                out["body"].append(body)
            kinds = {"n": pa.int32(), "k": pa.binary(), "xs": pa.list_(pa.struct([("x", pa.int64()), ("p", pa.int32())])), "body": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[c], kinds[c]) for c in kinds)], names=["id", "g", *kinds])

    kind = dict(s.dtypes)
    packed = batched(s).mapInArrow(pack, f"id {kind['id']}, g {kind['g']}, n int, k binary, xs array<struct<x:bigint,p:int>>, body binary")
    d = packed.groupBy("g", "k").agg(F.min(F.struct("id", "n", "xs", "body")).alias("r"))
    d = cut(d.select("g", "r.*"), "sets")
    prefix = d.select("id", "g", "n", F.explode("xs").alias("e")).select("id", "g", "n", F.col("e.p").alias("p"), F.col("e.x").alias("x"))
    a, b = (prefix.select(F.col("id").alias(k), "g", F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}"), "x") for k in "ab")
    need = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    cand = cut(a.join(b, ["g", "x"]).where((F.col("a") < F.col("b")) & (room >= need)).select("a", "b").distinct(), "candidates")
    left, right = (d.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("body").alias(f"s{k}")) for k in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            alike = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                if sb != last:
                    last, mine = sb, _unpacked(sb)
                shared = len(np.intersect1d(_unpacked(sa), mine, assume_unique=True))
                alike.append(shared / (na + nb - shared))
            out = pa.table({"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(alike, pa.float64())})
            yield from out.to_batches()

    out = batched(cand.join(left, "a").join(right, "b")).mapInArrow(compare, f"a {kind['id']}, b {kind['id']}, similarity double")
    return out.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def similar_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((a, b) of similar word sets within a ``block``, (id, rep)): a set goes by its smallest id, and every record by its set.

    Copies have the neighbours of their set, so nothing is lost by not pairing them.
    """
    s = sets.select("id", "block", F.array_sort(F.array_distinct(F.transform("items", lambda x: F.xxhash64(x)))).alias("s"))
    rep = s.groupBy("block", "s").agg(F.min("id").alias("rep"))
    return jaccard_pairs(sets, threshold, block="block", strict=True).select("a", "b"), s.join(rep, ["block", "s"]).select("id", "rep")


def consolidate(records: DataFrame, threshold: float) -> DataFrame:
    """(id, keeper, members, status) of records (id, block, items, n) in greedy groups: the longest (by ``n``, then the first) is kept."""
    from .grouping import greedy_groups

    links, of = similar_sets(records, threshold)
    lead = greedy_groups(links).withColumnRenamed("id", "rep")
    g = of.join(lead, "rep", "left").select("id", F.coalesce("leader", "rep").alias("leader")).join(records.select("id", "n"), "id")
    keep = g.groupBy("leader").agg(F.max_by("id", F.struct(F.col("n"), -F.col("id"))).alias("keeper"), F.count("*").alias("members")).where("members > 1")
    return g.join(keep, "leader").select("id", "keeper", "members", F.when(F.col("id") == F.col("keeper"), "active").otherwise("consolidated").alias("status"))


def _values(x: Column) -> tuple[Column, Column]:
    """The numbers of a statement and the parity of its negations."""
    return number_tokens(x), F.size(F.filter(tokens(x), lambda w: w.isin("not", "no", "never", "without", "kein", "nicht", "pas", "sin"))) % 2


def same_values(a: Column, b: Column) -> Column:
    """True if two statements give the same numbers and the same parity of negations: only then may they merge."""
    (m, p), (n, q) = _values(a), _values(b)
    return (m == n) & (p == q)


def value_pairs(pairs: DataFrame, texts: DataFrame, id_: str = "id", text: str = "content") -> DataFrame:
    """(a, b, ta, tb) of the pairs (a, b) whose texts give the same values.

    A digest of each text's values settles most pairs before any text is sent, and
    only texts of pairs that are left are; what remains is compared by the values.
    """
    from .retrieval import small

    v = texts.select(F.col(id_).alias("id"), F.xxhash64(*_values(F.col(text))).alias("v"))
    of = lambda c: v.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    left = cut(pairs.join(of("a"), "a").join(of("b"), "b").where("va = vb").select("a", "b"), "pairs")
    named = small(left.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    t = texts.select(F.col(id_).alias("_id"), F.col(text).alias("_t")).join(named, "_id", "left_semi")
    held = lambda c: t.select(F.col("_id").alias(c), F.col("_t").alias(f"t{c}"))
    return left.join(held("a"), "a").join(held("b"), "b").where(same_values(F.col("ta"), F.col("tb")))


#: Share of the words needed that must meet within the rarest ones, beyond the first that meets: more sort out more pairs early, fewer send fewer words.
SPARE = 0.02
#: Places where two texts have the same word that are held at once (8 bytes each, several times over).
CELLS = 4_000_000
#: Makes one number of two neighbours; odd and without pattern, so that unlike neighbours give unlike numbers.
NEIGHBOUR = np.int64(0x5851F42D4C957F2D)


#: Different words that a task remembers at once.
WORDS_HELD = 500_000


def _word_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word, the same in every process."""
    return np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words), "<i8")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, f): hashes of words and in how many texts they stand, summed over what a task remembers."""
    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_word_hashes(list(held))), pa.array(list(held.values()), pa.int64())], names=["x", "f"])

    held: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            held.update(set((t or "").split()))
            if len(held) > WORDS_HELD:
                yield told()
                held = Counter()
    yield told()


#: A negation of ``_values`` as a whole token; the first letter is looked at before its surroundings.
NEGATION = r"(?=[nwkps])(?<![\p{L}\p{N}_])(?:not|no|never|without|kein|nicht|pas|sin)(?![\p{L}\p{N}_])"


def value_digest(text: Column) -> Column:
    """128 bits of ``_values``, without tokens where a text has no digit."""
    numbers = F.when(text.rlike("[0-9]"), F.array_join(number_tokens(text), " ")).otherwise("")
    return F.unhex(F.md5(F.concat_ws(" ", numbers, F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(NEGATION)) % 2)))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(i, j, words): the longest run that two sequences share, the first in ``a``, then in ``b``; diagonal by diagonal, so nothing large is held."""
    best = (0, 0, 0)
    for d in range(len(a) - 1, -len(b), -1):  # i - j
        lo = max(0, d)
        hi = min(len(a), len(b) + d)
        if hi - lo < best[2]:
            continue
        edge = np.diff(np.concatenate([[0], (a[lo:hi] == b[lo - d : hi - d]).view(np.int8), [0]]))
        at = np.flatnonzero(edge == 1)
        if len(at):
            long = np.flatnonzero(edge == -1) - at
            k = int(np.argmax(long))
            i, n = lo + int(at[k]), int(long[k])
            if n > best[2] or n == best[2] and (i, i - d) < best[:2]:
                best = (i, i - d, n)
    return best


def _cells(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``b`` of its items in order, first of them for each item of ``a``, how many): all places where two sequences are equal."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    lo = np.searchsorted(ordered, a)
    there = np.flatnonzero(ordered[np.minimum(lo, len(b) - 1)] == a)
    each = np.zeros(len(a), np.int64)
    each[there] = np.searchsorted(ordered, a[there], "right") - lo[there]
    return order, lo, each


def _runs(order: np.ndarray, lo: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, items) of the runs that ``_cells`` make along diagonals, by i and j."""
    i = np.repeat(np.arange(len(each)), each)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(each) - each - lo, each)]
    wide = len(each) + 1  # a run never goes on in the next diagonal
    key = np.sort((i - j + len(order)) * wide + i)
    first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 1]))
    d, i = np.divmod(key[first], wide)
    j, n = i - d + len(order), np.diff(np.append(first, len(key)))
    by = np.lexsort((j, i))
    return i[by], j[by], n[by]


def matching_words(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> int:
    """Words in the blocks that Python's SequenceMatcher (``autojunk=False``) finds in two sequences of numbers; 0 once they are sure to be under ``least`` of all.

    It takes the longest run of equal words, the first in ``a`` and then in ``b``, and
    goes on to its left and right. Where all runs longer than some length follow one
    another in both texts, none of them cuts another, so it comes to take them all: they
    are taken at once, and what lies between goes on. Runs of two words and more are found by
    pairs of neighbours, which are rarer than words. Where runs would be too many (texts of few
    different words) the longest alone is searched.
    """
    need = least / 2 * (len(a) + len(b)) - 1e-9
    may, found, parts = min(len(a), len(b)), 0, [(a, b)]
    while parts and may >= need:
        a, b = parts.pop()
        may -= min(len(a), len(b))
        if len(a) * len(b) <= 256:
            x, y = a.tolist(), b.tolist()
            if not set(x).isdisjoint(y):
                n = sum(k.size for k in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
                found, may = found + n, may + n
            continue
        two = [x[:-1] * NEIGHBOUR + x[1:] for x in (a, b)] if min(len(a), len(b)) > 1 else None
        at, length = (_cells(*two), 1) if two else (None, 0)
        if at is None or not at[2].any():
            at, length = _cells(a, b), 0
        cells = int(at[2].sum())
        if not cells:
            continue
        if cells > CELLS:
            blocks = [_longest(a, b)]
        else:
            i, j, n = _runs(*at)
            n = n + length
            si, sj, sn = i, j, n
            while len(si) > 1 and (cross := (si[:-1] + sn[:-1] > si[1:]) | (sj[:-1] + sn[:-1] > sj[1:])).any():
                on = sn > np.minimum(sn[:-1], sn[1:])[cross].max()
                si, sj, sn = si[on], sj[on], sn[on]
            if not len(si):
                k = int(n.argmax())  # the first of the longest
                si, sj, sn = i[k : k + 1], j[k : k + 1], n[k : k + 1]
            blocks = zip(si.tolist(), sj.tolist(), sn.tolist(), strict=True)
        pi = pj = 0
        for i, j, n in [*blocks, (len(a), len(b), 0)]:
            if pi < i and pj < j and (i - pi > 1 or j - pj > 1):  # one word against one: were they equal, a run would have gone on
                parts.append((a[pi:i], b[pj:j]))
                may += min(i - pi, j - pj)
            found, may = found + n, may + n
            pi, pj = i + n, j + n
    return found if may >= need else 0


def _sequence(codes: np.ndarray, rare: np.ndarray) -> bytes:
    """A text's words in order, as few bytes: ranks, or after all ranks the places of hashes in a list."""
    return len(rare).to_bytes(4, "little") + rare.astype("<i8").tobytes() + zlib.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _in_order(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, hashes) of ``_sequence``."""
    cut_at = 4 + 8 * int.from_bytes(body[:4], "little")
    return np.frombuffer(zlib.decompress(body[cut_at:]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64), np.frombuffer(body[4:cut_at], "<i8")


def alike_texts(texts: DataFrame, least: float, id_: str = "id", text: str = "content", ranked: int = RANKED_ITEMS) -> tuple[DataFrame, DataFrame]:
    """((a, b, ratio), a < b, of texts of the same values whose ratio of matching runs of words is at least ``least``; (id, rep) of texts with words).

    Texts of the same words in the same order are one (``rep``, the smallest id): they
    have the same links, and a ratio of 1 among themselves. The others are linked
    without a loss. M matching words of ``a`` and ``b`` are least / 2 * (na + nb) or
    more, and lie in blocks in the same order, so:

    * with words from rare to frequent, one that matches stands where M words less
      those that matched before it are left in either text. Only so many of a text's
      rarest words are sent, and the pairs that they make must have some in common (``SPARE``);
    * a word that stands once in either text matches only where the words before and
      after it differ in number by (1 - least) * (na + nb) at most;
    * texts of other values never meet, as the values are part of what is joined.

    What is left is compared in order. Words travel as ranks by frequency, rarer ones by hash.
    """
    from .retrieval import small

    shared = least / (2 - least)  # of a text's words with the shortest text it may be linked to
    s = texts.select(F.col(id_).alias("id"), value_digest(F.col(text)).alias("v"), F.col(text).alias("t"))
    freq = batched(s.select("t")).mapInArrow(_word_counts, "x bigint, f bigint").groupBy("x").agg(F.sum("f").alias("f")).where("f > 1")
    top = freq.orderBy(F.desc("f"), "x").limit(ranked).toArrow()
    known = top.column("x").to_numpy()
    by = np.argsort(known)
    hashes, ranks = known[by], len(known)
    whole = ranks < ranked  # what has no rank then stands in one text alone, and meets nothing

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}  # codes of words: ranks, and for those without one their places in ``rare``
        rare = np.zeros(0, np.int64)
        for batch in batches:
            texts = [(t or "").split() for t in batch.column(2).to_pylist()]
            if len(held) > WORDS_HELD:
                held, rare = {}, rare[:0]
            if new := list({w for t in texts for w in t if w not in held}):
                h = _word_hashes(new)
                at = np.minimum(np.searchsorted(hashes, h), max(0, ranks - 1))
                has = hashes[at] == h if ranks else np.zeros(len(h), bool)
                code = ranks + len(rare) + np.cumsum(~has) - 1
                code[has] = by[at[has]]
                rare = np.concatenate([rare, h[~has]])
                held.update(zip(new, code.tolist(), strict=True))
            on, keys, bodies = np.array([bool(t) for t in texts], bool), [], []
            for t in texts:
                if t:
                    c = np.array([held[w] for w in t], np.int64)
                    r = c >= ranks
                    own, place = np.unique(rare[c[r] - ranks], return_inverse=True)
                    c[r] = ranks + place
                    bodies.append(_sequence(c, own))
                    keys.append(sha256(bodies[-1]).digest()[:16])
            ids, values = (batch.column(k).filter(pa.array(on)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, values, pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], names=["id", "v", "k", "body"])

    kind = dict(s.dtypes)["id"]
    packed = cut(batched(s).mapInArrow(pack, f"id {kind}, v binary, k binary, body binary"), "packed")
    of = cut(packed.select("id", "k").join(packed.groupBy("k").agg(F.min("id").alias("rep")), "k").select("id", "rep"), "copies")
    d = cut(packed.join(small(of.where("id <> rep").select("id")), "id", "left_anti").select("id", "v", "body"), "texts")
    discard(packed)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for v, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                codes, rare = _in_order(body)
                u, pos, c = np.unique(codes, return_index=True, return_counts=True)
                # rare words by hash (their codes are in its order), then ranks from the last to the first
                u, pos, c = (np.concatenate([y[ranks <= u], y[u < ranks][::-1]]) for y in (u, pos, c))
                p = np.cumsum(c) - c
                on = len(codes) - p >= (1 - SPARE) * shared * len(codes) - 1e-6
                if whole:
                    on &= u < ranks
                u, pos, c, p = u[on], pos[on], c[on], p[on]
                x = u.astype(np.uint64)
                x[u >= ranks] = rare[u[u >= ranks] - ranks].view(np.uint64)
                x = (x ^ np.frombuffer(v[:8], "<u8")) * np.uint64(0x9E3779B97F4A7C15)  # of unlike words or values, a pair more to compare at worst
                out.append(((x >> np.uint64(24)).view(np.int64), np.full(len(u), len(codes)), p, c, np.where(c == 1, pos, -1)))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(out)), [len(o[0]) for o in out])))
            cols = [np.concatenate(y) for y in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            table = pa.table([ids, *(pa.array(y, pa.int64() if k == 0 else pa.int32()) for k, y in enumerate(cols))], names=["id", "x", "n", "p", "c", "pos"])
            yield from table.to_batches(max_chunksize=1 << 17)

    prefix = batched(d).mapInArrow(rarest, f"id {kind}, x bigint, n int, p int, c int, pos int")
    a, b = (prefix.select("x", *(F.col(c).alias(f"{c}{k}") for c in ("id", "n", "p", "c", "pos"))) for k in "ab")
    both = F.col("na") + F.col("nb")
    need = F.lit(least / 2) * both
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need - F.floor(SPARE * need) - 1e-6
    shift = F.col("posa") - F.col("posb")
    near = (F.col("posa") < 0) | (F.col("posb") < 0) | (F.abs(shift) + F.abs(F.col("na") - F.col("nb") - shift) <= (1 - least) * both + 1e-6)
    met = a.join(b, "x").where((F.col("ida") < F.col("idb")) & room & near).groupBy(F.col("ida").alias("a"), F.col("idb").alias("b"))
    cand = met.agg(F.sum(F.least("ca", "cb")).alias("m"), F.first(F.floor(SPARE * need) + 1).alias("least"))
    cand = cut(cand.where("m >= least").select("a", "b"), "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(256)  # texts of one group come again and again
        def words(body: bytes) -> np.ndarray:
            codes, rare = _in_order(body)
            codes[codes >= ranks] = rare[codes[codes >= ranks] - ranks]
            return codes

        for batch in batches:
            ratio = []
            for p, q in zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True):
                x, y = words(p), words(q)
                ratio.append(2.0 * matching_words(x, y, least) / (len(x) + len(y)))
            yield from pa.table({"a": batch.column("a"), "b": batch.column("b"), "ratio": pa.array(ratio, pa.float64())}).to_batches()

    linked = small(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    d = cut(d.join(linked, "id", "left_semi"), "linked")
    left, right = (d.select(F.col("id").alias(k), F.col("v").alias(f"v{k}"), F.col("body").alias(f"b{k}")) for k in "ab")
    out = batched(cand.join(left, "a").join(right, "b").where("va = vb").select("a", "b", "ba", "bb")).mapInArrow(compare, f"a {kind}, b {kind}, ratio double")
    return out.where(F.col("ratio") >= least), of


PRONOUNS = tuple("he she it they him her them this that these those i we you".split())


def resolve(mentions: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``mentions`` with entity and how: pronouns stay open, then exact names, then aliases, else the mention itself founds an entity.

    Keys are folded: case, marks and punctuation don't count.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(fold_accents(c), r"[^\p{L}\p{N}]+", " ")))
    m = mentions.withColumn("_k", key(F.col("mention")))
    n = names.select(key(F.col("name")).alias("_k"), F.col("entity").alias("_e1")).groupBy("_k").agg(F.min("_e1").alias("_e1"))
    a = aliases.select(key(F.col("alias")).alias("_k"), F.col("entity").alias("_e2")).groupBy("_k").agg(F.min("_e2").alias("_e2"))
    j = m.join(n, "_k", "left").join(a, "_k", "left")
    pronoun = F.col("_k").isin(*PRONOUNS)
    how = F.when(pronoun, "pronoun").when(F.col("_e1").isNotNull(), "exact").when(F.col("_e2").isNotNull(), "alias").otherwise("new")
    return j.withColumn("entity", F.when(~pronoun, F.coalesce("_e1", "_e2", F.trim("mention")))).withColumn("how", how).drop("_k", "_e1", "_e2")


def nearest_name(values: DataFrame, vocabulary: DataFrame, value: str, word: str, least: float) -> DataFrame:
    """(value, word, ratio): for each distinct value the closest word of a small vocabulary by edit distance."""
    from .retrieval import small

    v = values.select(F.col(value).alias("value")).distinct()
    j = v.join(small(vocabulary.select(F.col(word).alias("word"))), F.lit(True)).withColumn("ratio", levenshtein_ratio(F.lower("value"), F.lower("word")))
    best = j.where(F.col("ratio") >= least).groupBy("value").agg(F.max(F.struct("ratio", F.col("word"))).alias("b"))
    return best.select("value", F.col("b.word").alias("word"), F.col("b.ratio").alias("ratio"))


def retention(records: DataFrame, age_days: Column, uses: Column, confidence: Column, archive_after: int = 180, purge_after: int = 365) -> DataFrame:
    """Add zone: purged when old, unused and doubtful; archived when old and unused; else active."""
    zone = F.when((age_days > purge_after) & (uses == 0) & (confidence < 0.5), "purged").when((age_days > archive_after) & (uses == 0), "archived").otherwise("active")
    return records.withColumn("zone", zone)


def daily_budget(records: DataFrame, group: str, at: str, level: str, ties: str, budget: int) -> DataFrame:
    """Add granted: the level asked for, one lower beyond the group's budget of the day."""
    w = W.partitionBy(group, F.to_date(at), level).orderBy(at, ties)
    return records.withColumn("granted", F.when(F.row_number().over(w) > budget, F.greatest(F.col(level) - 1, F.lit(0))).otherwise(F.col(level)))
