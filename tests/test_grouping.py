"""Greedy groups, bands of vectors and chains against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesaquery.functions import text as T
from mesaquery.operators import dedup, evidence, grouping, lexicon, retrieval, stats, temporal, vectors


def test_greedy_groups_equal_one_pass(spark):
    r = random.Random(4)
    for n, p in ((40, 0.05), (40, 0.3), (120, 0.02)):
        links = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]
        near = {(a, b) for a, b in links}
        want, used = {}, set()
        for i in range(n):
            if i in used:
                continue
            for j in range(i + 1, n):
                if j not in used and (i, j) in near:
                    want[j] = i
                    used.add(j)
            want[i] = i
        got = {x.id: x.leader for x in grouping.greedy_groups(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: want[i] for i in got} and all(i in got for a, b in links for i in (a, b))


def test_consolidation(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        s = words[: 20 + i % 7] if i % 3 else r.sample(words, 20)
        rows.append((i, i % 2, s + ["x"] * (i % 4), len(s) * 3 + i % 4))
    got = {x.id: x.keeper for x in dedup.consolidate(spark.createDataFrame(rows, "id long, block long, items array<string>, n long"), 0.75).collect()}
    want = {}
    for block in (0, 1):
        mine = [x for x in rows if x[1] == block]
        used = set()
        for i, x in enumerate(mine):
            if x[0] in used:
                continue
            group = [x]
            for y in mine[i + 1 :]:
                a, b = set(x[2]), set(y[2])
                if y[0] not in used and len(a & b) / len(a | b) > 0.75:
                    group.append(y)
                    used.add(y[0])
            if len(group) > 1:
                keeper = max(group, key=lambda g: g[3])[0]
                want |= {g[0]: keeper for g in group}
    assert got == want and want


def test_band_pairs_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    v = np.vstack([base[i % 12] + rng.normal(size=8) * 0.3 for i in range(150)] + [np.zeros(8)])
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v[:-1] / np.linalg.norm(v[:-1], axis=1, keepdims=True)
    sims = u @ u.T
    for lo, hi in ((0.9, 1.0), (0.3, 0.95)):
        want = {(i, j) for i in range(150) for j in range(i + 1, 150) if lo <= sims[i, j] <= hi}
        for block in (16, 512):
            assert {(x.a, x.b) for x in vectors.band_pairs(df, lo, hi, block=block).collect()} == want


def test_window_dedup(spark):
    rows = [(1, "g", "a", [1.0, 0.0]), (2, "g", "a", [0.0, 1.0]), (3, "g", "b", [1.0, 0.01]), (4, "g", "a", [1.0, 0.02]), (5, "h", "a", [1.0, 0.0]), (6, "g", "a", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, g string, s string, embedding array<double>")
    merged = lambda **k: {(x.id, x.keeper) for x in vectors.window_dedup(df, "g", "vec_id", **k).collect()}
    assert merged() == {(3, 4), (1, 4)} and merged(same="s") == {(1, 4)} and merged(window=3) == {(3, 4)}


def test_chains(spark):
    p = [(i, i + 1 if i % 10 != 9 else None) for i in range(40)] + [(100, None), (200, 201), (201, 200)]
    got = {x.id: (x.origin, x.latest, x.depth) for x in temporal.chains(spark.createDataFrame(p, "id long, next long")).collect()}
    assert all(got[i] == (i // 10 * 10, i // 10 * 10 + 9, i % 10) for i in range(40)) and got[100] == (100, 100, 0) and len(got) == 43


def test_percentiles(spark):
    r = random.Random(2)
    rows = [(g, float(r.choice([r.random() * 100, 5.0, 7.25]))) for g in "ab" for _ in range(501)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for x in stats.percentiles(df, "g", "v", {"p50": 0.5, "p95": 0.95}).collect():
        s = sorted(v for g, v in rows if g == x.g and v is not None)
        assert (x.n, x.p50, x.p95) == (len(s), s[-(-len(s) * 50 // 100) - 1], s[-(-len(s) * 95 // 100) - 1])
    n = df.where("v IS NOT NULL").groupBy("g").agg(F.count("*").alias("_n"))
    got = {x.g: x.value for x in stats.interpolated(df, n, "g", "v", (F.col("_n") - 1) * 0.9).collect()}
    assert got == pytest.approx({g: float(np.quantile([v for h, v in rows if h == g], 0.9)) for g in "abc"})


def test_binomial(spark):
    from math import comb

    for n, k, p in ((10, 3, 0.5), (7, 0, 0.3), (400, 230, 0.5), (1, 1, 0.5), (0, 0, 0.5)):
        pm = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        want = min(1.0, sum(x for x in pm if x <= pm[k] * (1 + 1e-7))) if n else 1.0
        assert spark.range(1).select(stats.binomial_p(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0] == pytest.approx(want, abs=1e-9)


def test_value_updates(spark):
    cases = [
        ("The capital of X is Rome", "the capital of x is Oslo", True), ("the capital of X is Rome", "the capital of X is Rome", False), ("a b", "a c", False),
        ("we meet at 9:30 on Mondays", "we meet at 10:15 on Mondays", True), ("the maker of Foo is GM now", "the maker of Bar is GM now", False), ("she likes red colour", "she likes blue colour", True), ("", "x", False), (None, "x y z", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i long, a string, b string")
    got = {x.i: x.u for x in df.select("i", T.updates_value(T.statement_tokens(F.col("a")), T.statement_tokens(F.col("b"))).alias("u")).collect()}
    assert [bool(got[i]) for i in range(len(cases))] == [w for *_, w in cases]


def test_lexicon_patch_equals_rebuild(spark):
    docs = [(1, "a b c"), (2, "b b d"), (3, ""), (4, "e")]
    index = lexicon.build(spark.createDataFrame(docs, "id long, content string"))
    changed, removed = spark.createDataFrame([(2, "b x"), (5, "a a")], "id long, content string"), spark.createDataFrame([(4, "")], "id long, content string")
    got = lexicon.patched(index, changed, removed)
    want = lexicon.build(spark.createDataFrame([(1, "a b c"), (2, "b x"), (3, ""), (5, "a a")], "id long, content string"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(got.postings) == rows(want.postings) and rows(got.terms) == rows(want.terms)
    assert got.mean_length == pytest.approx(7 / 4) == want.mean_length + 0 and (got.docs, want.docs) == (4, 4)


def test_novelty_and_rerank(spark):
    r = spark.createDataFrame([(0, 1, 1, ["a", "b"]), (0, 2, 2, ["a", "b"]), (0, 3, 3, ["c"])], "query_id long, id long, rank long, s array<string>")
    assert {x.id: x.weight for x in evidence.novelty(r).collect()} == {1: 1.0, 2: 0.25, 3: round(1 / 3, 6)}
    s = r.withColumn("m", F.col("id"))
    assert [x.id for x in retrieval.rerank(s, "m").orderBy("place").collect()] == [3, 2, 1]


def test_many_queries_meet_every_row(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda **k: sorted((x.query_id, x.id, round(x.score, 9)) for x in retrieval.cosine_scores(v, q, **k).collect())
    assert rows() == rows(broadcast_rows=7, block_rows=4) and len(rows()) == 900


def test_ratio_by_words(spark):
    d = spark.createDataFrame([("a b c d", "a b x d"), (None, ""), ("p", "q")], "a string, b string")
    assert [x.ratio for x in retrieval.sequence_ratio(d, "a", "b", words=True).collect()] == [0.75, 1.0, 0.0]
    assert [x.ratio for x in retrieval.sequence_ratio(d, "a", "b", least=0.9).collect()] == [0.0, 1.0, 0.0]


def test_statements_fold_dressed_characters(spark):
    d = spark.createDataFrame([("\uff21\uff22 x\u00b2 \u0451\u043b\u043a\u0430",), (None,)], "t string")
    assert [r.s for r in d.select(T.statement(F.col("t")).alias("s")).collect()] == ["ab x2 \u0435\u043b\u043a\u0430", None]


def test_a_cleared_index_is_built_again(spark, sf_dir):
    from mesaquery.operators.shared import discard
    from mesaquery.session import knowledge

    k = knowledge(spark, sf_dir)
    first = lexicon.lexicon(k)
    assert lexicon.lexicon(knowledge(spark, sf_dir)) is first
    discard(first.postings)
    again = lexicon.lexicon(k)
    assert again is not first and again.postings.count() == again.terms.agg(F.sum("df")).first()[0]
