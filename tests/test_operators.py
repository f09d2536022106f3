"""Operators on hand-made inputs."""

import json
import math
import re
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mesaquery.functions import intervals as I
from mesaquery.functions import scoring as S
from mesaquery.functions import text as T
from mesaquery.operators import dedup, graph, retrieval, temporal
from mesaquery.sources import records
from mesaquery.streaming import operators as stream


def test_rrf_ranks_from_one(spark):
    one = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "query_id long, id long, rank int")
    two = spark.createDataFrame([(0, 3, 1), (0, 1, 2)], "query_id long, id long, rank int")
    got = {r.id: r.fused for r in retrieval.rrf([(one, 1.0), (two, 1.2)]).collect()}
    assert got == pytest.approx({1: 1 / 61 + 1.2 / 62, 2: 1 / 62, 3: 1 / 63 + 1.2 / 61})


@pytest.mark.parametrize("a,b,want", [((0, 1), (2, 3), "before"), ((0, 2), (2, 3), "meets"), ((0, 2), (1, 3), "overlaps"), ((0, 1), (0, 3), "starts"), ((1, 2), (0, 3), "during"), ((2, 3), (0, 3), "finishes"), ((0, 3), (0, 3), "equals")])
def test_allen_and_inverse(spark, a, b, want):
    lit = lambda p: (F.lit(p[0]), F.lit(p[1]))
    r = spark.range(1).select(I.allen(*lit(a), *lit(b)).alias("x"), I.inverse(I.allen(*lit(b), *lit(a))).alias("y")).first()
    assert (r.x, r.y) == (want, want)


@pytest.mark.parametrize("a,b,months", [("2024-01-31", "2024-02-29", 1), ("2024-01-31", "2024-02-28", 0), ("2020-02-29", "2021-02-28", 12), ("2024-03-15", "2024-03-15", 0)])
def test_whole_months(spark, a, b, months):
    d = lambda x: F.lit(x).cast("timestamp")
    assert spark.range(1).select(I.whole_months(d(a), d(b))).first()[0] == months


def test_validity_takes_late_inserts(spark):
    f = spark.createDataFrame([(1, "s", "p", "a", datetime(2024, 1, 1)), (2, "s", "p", "c", datetime(2024, 3, 1)), (3, "s", "p", "b", datetime(2024, 2, 1))], "id long, subject string, predicate string, object string, valid_from timestamp")
    got = {r.object: r.valid_to for r in temporal.with_validity(f).collect()}
    assert got == {"a": datetime(2024, 2, 1), "b": datetime(2024, 3, 1), "c": None}
    assert [r.object for r in temporal.as_of(temporal.with_validity(f), "2024-02-15").collect()] == ["b"]


def test_episode_gap(spark):
    e = spark.createDataFrame([(1, 1, datetime(2024, 1, 1, 0, 0)), (2, 1, datetime(2024, 1, 1, 0, 10)), (3, 1, datetime(2024, 1, 1, 1, 20))], "id long, actor long, ts timestamp")
    assert {r.id: r.episode for r in temporal.episodes(e, "actor", "ts").collect()} == {1: 1, 2: 1, 3: 2}


@pytest.fixture
def two_triangles(spark):
    return spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1)], "src string, dst string, weight long")


def test_components(two_triangles):
    assert {(r.node, r.component) for r in graph.components(two_triangles).collect()} == {(n, "a") for n in "abc"} | {(n, "x") for n in "xyz"}


def test_pagerank_is_even_on_a_ring(two_triangles):
    assert {round(r["rank"], 6) for r in graph.pagerank(two_triangles).collect()} == {round(1 / 6, 6)}


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "src string, dst string, weight long")).count() == 0


def test_jaccard_pairs_against_brute_force(spark):
    sets = [(i, [f"t{(i * 7 + j * j) % 23}" for j in range(3 + i % 9)]) for i in range(80)] + [(100, []), (101, ["q"]), (102, ["q"])]
    got = {(r.a, r.b) for r in dedup.jaccard_pairs(spark.createDataFrame(sets, "id long, items array<string>"), 0.6).collect()}
    first: dict = {}
    for i, s in sets:
        first.setdefault(frozenset(s), i)
    d = {i: s for s, i in first.items() if s}
    assert got == {(a, b) for a in d for b in d if a < b and len(d[a] & d[b]) / len(d[a] | d[b]) >= 0.6}


def test_jaccard_pairs_by_hash_and_by_rank(spark):
    """Any order of items is right: with no ranks, some, and all; blocks part pairs, and strict leaves out the threshold itself."""
    sets = [(i, i % 2, [f"t{(i * 5 + j * j) % 19}" for j in range(4 + i % 7)] + [f"own{i}"] * (i % 3 == 0)) for i in range(60)] + [(100, 0, []), (101, 1, ["q"]), (102, 1, ["q"])]
    df = spark.createDataFrame(sets, "id long, half long, items array<string>").repartition(3)
    first: dict = {}
    for i, h, s in sets:
        first.setdefault((h, frozenset(s)), i)
    d = {i: (h, s) for (h, s), i in first.items() if s}
    like = {(a, b): len(d[a][1] & d[b][1]) / len(d[a][1] | d[b][1]) for a in d for b in d if a < b and d[a][0] == d[b][0]}
    assert any(x == 0.5 for x in like.values())
    for ranked in (1, 8, 1000):
        got = {(r.a, r.b): r.similarity for r in dedup.jaccard_pairs(df, 0.5, block="half", ranked=ranked).collect()}
        assert got == {k: x for k, x in like.items() if x >= 0.5}
    assert {(r.a, r.b) for r in dedup.jaccard_pairs(df, 0.5, block="half", strict=True).collect()} == {k for k, x in like.items() if x > 0.5}


def test_jaccard_pairs_sends_whole_sets_once(spark):
    """Only packed sets and prefixes are shuffled: no item of a set is sent to be ordered."""
    df = spark.createDataFrame([(i, [f"t{j}" for j in range(i, i + 40)]) for i in range(30)], "id long, items array<string>")
    plan = dedup.jaccard_pairs(df, 0.8)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_intersect" not in plan


def test_value_guard(spark):
    same = lambda a, b: spark.range(1).select(dedup.same_values(F.lit(a), F.lit(b))).first()[0]
    assert not same("100 rpm", "500 rpm")
    assert not same("it is safe", "it is not safe")
    assert same("it runs at 100 rpm", "runs at 100 rpm")


def test_passages_keep_every_character(spark):
    text = "One. Two two! " + "x" * 1000 + ". End\nlast"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, content string")
    rows = sorted((r.ordinal, r.passage) for r in retrieval.passages(d, 40).collect())
    assert "".join(p for _, p in rows) == text and all(len(p) <= 40 for _, p in rows)


def test_passages_by_speaker(spark):
    text = "user: one. Two two! three\nassistant: " + "word. " * 30 + "\nuser: end"
    d = spark.createDataFrame([(1, text)], "id long, content string")
    rows = [tuple(r) for r in retrieval.passages(d, 60).orderBy("ordinal").select("ordinal", "speaker", "passage").collect()]
    want, start = [], 0
    marks = [m.start() for m in re.finditer(r"(?m)^(?:user|assistant):", text)] + [len(text)]
    for a, b in zip(marks, marks[1:]):
        start = a
        while start < b:
            end = min(start + 60, b)
            if end < b:
                cut = max(text.rfind("\n", start, end), text.rfind(". ", start, end))
                end = cut + 1 if cut > start else end
            want.append((len(want), text[a:b].split(":")[0], text[start:end]))
            start = end
    assert rows == [w for w in want if w[2].strip()]


def test_excerpts_and_packing(spark):
    from mesaquery.operators import evidence

    text = "Head of it. " + "filler words here. " * 60 + "The treasure is buried. " + "more filler. " * 60
    cut = evidence.excerpt(text, "where is the treasure", 500)
    assert "treasure" in cut and len(cut) <= 500 and evidence.excerpt("short", "q", 10) == "short"
    assert evidence.excerpt("a" * 100, "q", 25).startswith("aaa") and len(evidence.excerpt("a" * 100, "q", 25)) == 25
    assert evidence.shares([10, 1000, 1000], [1.0, 1.0, 0.5], 610) == [10, 400, 200] and evidence.shares([5], [1.0], 100) == [5]
    assert evidence.annotated("we met yesterday, not yesterday [x]", date(2024, 3, 1)) == "we met yesterday [Thu 29 February 2024], not yesterday [x]"
    assert evidence.annotated(None, date(2024, 3, 1)) is None


def test_text_functions_on_nulls(spark):
    r = spark.range(1).select(T.tokens(F.lit(None).cast("string")).alias("t"), T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), T.levenshtein_ratio(F.lit(""), F.lit("")).alias("l"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert (r.t, r.j, r.l, r.c) == ([], 0.0, 1.0, 0.0)


def test_asof_join_equals_scan(spark):
    p = [(i, i % 3, (i * 37) % 50) for i in range(40)]
    b = [(i % 3, (i * 11) % 50, i) for i in range(30)]
    got = {r.id: r.matched for r in temporal.asof_join(spark.createDataFrame(p, "id long, k long, t long"), spark.createDataFrame(b, "k long, u long, v long"), ("k", "k"), ("t", "u"), "v").collect()}
    for i, k, t in p:
        c = [(u, v) for kk, u, v in b if kk == k and u <= t]
        assert got[i] == (max(c)[1] if c else None)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "content": "x"}\nnot json\n\n')
    good, bad = records.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert [r.id for r in good.collect()] == ["1"] and bad.count() == 1
    tree = [{"id": "c", "title": "t", "current_node": "n3", "mapping": {n: {"id": n, "parent": p, "message": {"author": {"role": r}, "content": {"parts": [n]}, "create_time": 1.0}} for n, p, r in (("n1", None, "user"), ("n2", "n1", "assistant"), ("n3", "n2", "user"), ("side", "n1", "user"))}}]
    (tmp_path / "t.json").write_text(json.dumps(tree))
    assert [(r.turn, r.content) for r in records.read_chat_tree(spark, str(tmp_path / "t.json")).orderBy("turn").collect()] == [(0, "n1"), (1, "n2"), (2, "n3")]
    (tmp_path / "md").mkdir()
    (tmp_path / "md/a.md").write_text("---\ntags: x\n---\nintro\n# One\nbody\n## Two\nmore\n")
    assert {(r.heading, r.content) for r in records.read_markdown(spark, str(tmp_path / "md")).collect()} == {("", "intro"), ("One", "body"), ("Two", "more")}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import x\n\ndef f():\n    pass\n\nclass B:\n    pass\n")
    assert {(r.kind, r.name, r.first_line) for r in records.read_source_code(spark, str(tmp_path / "src")).collect()} == {("def", "f", 3), ("class", "B", 6)}


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rows = [{"actor": i % 3, "tool": "t", "ok": i % 2 == 0, "ts": f"2024-01-0{1 + i // 10}T0{i % 10}:00:00Z"} for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "actor long, tool string, ok boolean, ts timestamp"
    live = stream.watch_folder(spark, str(tmp_path / "in"), schema)
    stream.run_to_table(stream.activity(live), str(tmp_path / "cp"), str(tmp_path / "out"))
    batch = {tuple(r) for r in stream.activity(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert done and done <= batch


def test_idempotent_sink(spark, tmp_path):
    write = stream.idempotent_sink(str(tmp_path / "t"), ["h"])
    a = spark.createDataFrame([("x", 1), ("y", 2)], "h string, v long")
    for batch, i in ((a, 0), (a, 0), (a.unionByName(spark.createDataFrame([("z", 3)], a.schema)), 1)):
        write(batch, i)
    assert sorted(r.h for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["x", "y", "z"]


def test_boolean_expressions(spark):
    from mesaquery.functions.query_text import boolean_filter

    d = spark.createDataFrame([(1, "red fox jumps"), (2, "red dog"), (3, "blue fox and red hen"), (4, None)], "id long, t string")
    hits = lambda q: sorted(r.id for r in d.where(boolean_filter(q, F.col("t"))).collect())
    assert hits("red") == [1, 2, 3] and hits("red fox") == [1, 3] and hits('"red fox"') == [1]
    assert hits("dog OR jumps") == [1, 2] and hits("red NOT fox") == [2] and hits("fo*") == [1, 3]
    assert hits("(dog OR hen) AND red") == [2, 3] and hits("red AND (") == [3]  # unparsable: all words, "and" too


def test_query_text():
    from mesaquery.functions import query_text as Q

    day = date(2024, 3, 13)
    assert Q.date_ranges("yesterday", day) == [(date(2024, 3, 12),) * 2]
    assert Q.date_ranges("last month", day) == [(date(2024, 2, 12), day)]
    assert Q.date_ranges("three weeks ago", day) == [(date(2024, 2, 18), date(2024, 2, 24))]
    assert Q.date_ranges("since about a couple of days ago", day) == [(date(2024, 3, 10), day)]
    assert Q.date_ranges("past two weeks", day) == [(date(2024, 2, 28), day)] and Q.date_ranges("this week", day) == [(date(2024, 3, 11), day)]
    assert Q.date_ranges("on 8 May, 2023 or may 9th 2023", day) == [(date(2023, 5, 8),) * 2, (date(2023, 5, 9),) * 2]
    assert Q.date_ranges("in May 2023", day) == [(date(2023, 5, 1), date(2023, 5, 31))] and Q.date_ranges("in 2021", day) == [(date(2021, 1, 1), date(2021, 12, 31))]
    assert Q.date_ranges("recently", day) == [(date(2024, 1, 13), day)] and Q.date_ranges("on 2024-02-31", day) == []
    assert Q.relative_day("last Thursday", day) == "Thu 7 March 2024" and Q.relative_day("two weeks ago", day) == "about 2 weeks before Wed 13 March 2024"
    assert Q.relative_day("next month", date(2024, 12, 5)) == "January 2025" and Q.relative_day("some day", day) is None
    assert Q.date_ranges("winter 2023", day) == [(date(2023, 12, 1), date(2024, 2, 28))]
    assert Q.date_ranges("last wednesday", day) == [(date(2024, 3, 6),) * 2]
    assert Q.terms("What is the API of src/main.py in the API") == ["api", "src/main.py"]
    assert Q.intent("why does it crash?") == "debug" and Q.parts("who is A, and what is B?") == ["who is A", "what is B"]
    assert sum(Q.budget_split(1003).values()) == 1003


def test_changes_and_evidence(spark):
    from mesaquery.operators import changes, evidence

    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    log = spark.createDataFrame([(1, "x", 1, "upsert"), (1, "y", 2, "upsert"), (2, "b", 3, "delete"), (4, "d", 4, "upsert"), (4, "d", 5, "delete"), (5, "e", 6, "upsert")], "k long, v string, seq long, op string")
    assert {tuple(r) for r in changes.apply_changes(base, log, "k", "seq", "op").collect()} == {(1, "y"), (3, "c"), (5, "e")}
    assert [r[0] for r in spark.range(4).select(changes.backoff(F.col("id") * 3)).collect()] == [30, 240, 1920, 3600]
    scored = spark.createDataFrame([(0, 1, o, s) for o, s in ((0, 9.0), (1, 8.0), (2, 7.0), (5, 6.0))] + [(0, 2, 1, 5.0)], "query_id long, id long, ordinal long, score double")
    assert [(r.id, r.ordinal) for r in evidence.select_evidence(scored, 3).orderBy("place").collect()] == [(1, 0), (1, 2), (1, 5)]
    docs = spark.createDataFrame([(1, "The Big Red fox, the big red fox"), (2, ""), (3, None)], "id long, t string")
    names = spark.createDataFrame([("Big red FOX",), ("fox",), ("!!",)], "name string")
    assert {tuple(r) for r in evidence.concept_links(docs, names, "id", "t", "name").collect()} == {(1, "Big red FOX", 2), (1, "fox", 2)}


def plain_bm25(rows, queries):
    """(query, row number) -> score to nine places, over all rows (tokens)."""
    mean = sum(map(len, rows)) / len(rows)
    df = Counter(t for r in rows for t in set(r))
    idf = lambda t: max(1e-6, math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5)))
    part = lambda t, r: idf(t) * r.count(t) * 2.2 / (r.count(t) + 1.2 * (0.25 + 0.75 * len(r) / mean))
    return {(q, i): round(sum(part(t, r) for t in set(ts) if t in r), 9) for q, ts in queries.items() for i, r in enumerate(rows) if set(ts) & set(r)}


def corpus():
    texts = [[f"w{(i * j + j * j) % (7 + i % 11)}" for j in range(2 + i % 13)] for i in range(120)] + [["same", "w1"]] * 30 + [[], ["alone"]]
    return texts, {1: ["w1", "w3", "same", "w1"], 2: ["alone", "w2"], 3: ["nowhere"], 4: ["w5", "w6", "w0"]}


def test_best_by_bm25_against_brute_force(spark):
    texts, asked = corpus()
    ids = [i % 40 for i in range(len(texts))]  # ids that stand several times go by their best row
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "id long, content string").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "query_id long, text string")
    best: dict = {}
    for (q, i), s in plain_bm25(texts, asked).items():
        best[q, ids[i]] = max(s, best.get((q, ids[i]), 0.0))
    want = {(q, i, n + 1) for q in asked for n, (i, _) in enumerate(sorted(((i, s) for (p, i), s in best.items() if p == q), key=lambda x: (-x[1], x[0]))[:5])}
    for limit in (1000, 3):  # one block of queries, and several
        got = {(r.query_id, r.id, r["rank"]) for r in retrieval.bm25_best(docs, queries, 5, ["id"], "content", limit).collect()}
        assert got == want


def test_own_rank_against_brute_force(spark):
    texts, _ = corpus()
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, content string").repartition(3)
    asked = {i: t[:4] for i, t in enumerate(texts) if i % 3 == 0}
    scores = plain_bm25(texts, asked)
    places = {q: 1 + sum(1 for (p, i), s in scores.items() if p == q and (-s, i) < (-scores[q, q], q)) for q in asked if asked[q]}
    own = docs.where("id % 3 = 0").withColumn("asked", F.slice(F.split("content", " "), 1, 4)).where("content <> ''")
    for limit in (1000, 20):
        got = {r.query_id: r["rank"] for r in retrieval.bm25_own_rank(docs, own, 10, limit=limit).collect()}
        assert got == {q: n for q, n in places.items() if n <= 10}
    again = docs.unionByName(docs.where("id = 3"))  # a repeated id: one document
    assert retrieval.bm25_own_rank(again, own, 10).where("query_id = 3").count() <= 1


@pytest.mark.parametrize("name", ["evidence_selection", "passage_ranking", "fact_tier", "self_retrieval"])
def test_batches_of_queries_write_no_postings(spark, sf_dir, name, monkeypatch):
    """Queries against every row keep their best in the scan: neither an index nor (query, row) pairs are stored."""
    from mesaquery.plans import catalogue

    def never(*_, **__):
        raise AssertionError("a stored index")

    monkeypatch.setattr(retrieval, "lexicon", never)
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_value_pairs(spark):
    """Pairs of the same numbers and polarity, with their texts; others go before texts are sent."""
    texts = spark.createDataFrame([(1, "100 rpm"), (2, "runs at 100 rpm"), (3, "500 rpm"), (4, "not 100 rpm"), (5, "no 100 rpm"), (6, "alone")], "id long, content string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5), (2, 3)], "a long, b long")
    assert sorted(tuple(r) for r in dedup.value_pairs(pairs, texts).select("a", "b", "ta", "tb").collect()) == [(1, 2, "100 rpm", "runs at 100 rpm"), (4, 5, "not 100 rpm", "no 100 rpm")]


def test_alike_texts_loses_no_link(spark):
    """Every pair of like texts is found: of equal word sets in another order, of few different words, of words that aren't tokens; copies come with their first record."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    base = [[f"w{r.choice('abcdefgh')}{r.choice('xyz')}" for _ in range(r.randint(1, 40))] for _ in range(12)]
    texts = ["one two three four five six seven eight", "two three four five six seven eight one", "go " * 17 + "alpha beta gamma", "go " * 17 + "delta epsilon zeta", "+ - * / = + - * / =", "+ - * / = + - * / !", "", " \n"]
    for b in base:
        for _ in range(6):
            w = [x if r.random() > 0.07 else "not" if r.random() < 0.1 else f"v{r.randint(0, 9)}" if r.random() < 0.1 else "new" for x in b if r.random() > 0.03]
            texts += [" ".join(w), " \t" + "\n".join(w)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    value = {x.id: x.v for x in df.select("id", F.xxhash64(*dedup._values(F.col("content"))).alias("v")).collect()}
    first: dict = {}
    rep = {i: first.setdefault(tuple(t.split()), i) for i, t in enumerate(texts) if t.split()}
    want = {(a, b): SequenceMatcher(None, s, t, autojunk=False).ratio() for s, a in first.items() for t, b in first.items() if a < b and value[a] == value[b]}
    want = {k: x for k, x in want.items() if x >= 0.85}
    assert {(0, 1), (2, 3), (4, 5)} <= set(want) and len(want) > 30
    for ranked in (1, 20, 100_000):
        links, of = dedup.alike_texts(df, 0.85, ranked=ranked)
        assert {(x.a, x.b): x.ratio for x in links.collect()} == want
        assert {x.id: x.rep for x in of.collect()} == rep


def test_matching_words_is_sequence_matcher(monkeypatch):
    """The same blocks as Python's, with runs held or searched one by one; 0 only under the least ratio."""
    import random
    from difflib import SequenceMatcher

    import numpy as np

    r = random.Random(2)
    for cells in (dedup.CELLS, 0, 30):
        monkeypatch.setattr(dedup, "CELLS", cells)
        for _ in range(400):
            v = r.choice([1, 2, 3, 6, 30])
            a = [r.randrange(v) for _ in range(r.randint(0, 60))]
            b = [x if r.random() > 0.1 else r.randrange(v + 1) for x in a if r.random() > 0.05]
            b = b[7:] + b[:7] if r.random() < 0.3 else b
            m = sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            assert dedup.matching_words(x, y) == m
            assert dedup.matching_words(x, y, 0.85) in ((m,) if 2 * m >= 0.85 * (len(a) + len(b)) else (0, m))


def test_value_digest_is_that_of_values(spark, sf_dir):
    """Digests part texts as numbers and negations do, over a table and at the edges of words."""
    from mesaquery.session import knowledge

    odd = ["not", "nothing", "not_", "a not", "no-no", "not not", "Never 5", "5 NEVER", "", None, "x9 3", "3 X9 3", "\u0436not", "not\u0661", "\u0661", "pas\nsin kein", "\u0130 no"]
    t = knowledge(spark, sf_dir).select("content").union(spark.createDataFrame([(x,) for x in odd], "content string"))
    v = F.to_json(F.struct(*dedup._values(F.coalesce("content", F.lit("")))))
    rows = t.select(v.alias("v"), F.hex(dedup.value_digest(F.col("content"))).alias("d")).collect()
    assert len({r.v for r in rows}) == len({r.d for r in rows}) == len({(r.v, r.d) for r in rows}) > 5
