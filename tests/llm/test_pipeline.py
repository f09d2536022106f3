"""The pipeline's stages against plain Python, on the smallest tables and on odd ones."""

import re
from collections import Counter

import pytest
import sentencepiece
from test_digests import reach, shingle_set, word

import corpus_pipeline
from mesaquery.llm import linededup, mixing, pieces, quality
from mesaquery.llm.common import materialise
from mesaquery.llm.queries import DOCS

WHITE = " \t\r\x0b\x0c"


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))


def plain_line_dedup(rows):
    """(source, text) -> the text without its host's boilerplate lines."""
    pages, count = {}, Counter()
    for s, t in {(s, t or "") for s, t in rows}:
        pages.setdefault(s, set()).add(t)
    for s, ts in pages.items():
        for t in ts:
            count.update((s, k) for k in {x.strip(WHITE) for x in t.split("\n") if x.strip(WHITE + "\n")})
    bad = {k for k, n in count.items() if (n - 1) / (len(pages[k[0]]) + linededup.PRIOR) > linededup.MAX_RATIO}
    return {(s, t): None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(WHITE)) not in bad) for s, t in rows}


def check_stages(spark, docs, sf_dir):
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)
    names = docs.columns
    at = {c: i for i, c in enumerate(names)}
    rows = lambda df: [tuple(r) for r in df.collect()]

    want = Counter(tuple(r.q.clean if c == "text" else len(r.q.clean) if c == "n_chars" else r.d[c] for c in names) for r in quality.judge(docs).collect() if r.q.kept)
    docs = materialise(one(spark, docs, sf_dir), "t1")
    assert docs.columns == names and Counter(rows(docs)) == want

    before = rows(docs)
    clean = plain_line_dedup([(r[at["source"]], r[at["text"]]) for r in before])
    docs = materialise(two(spark, docs, sf_dir), "t2")
    new = lambda r: clean[r[at["source"]], r[at["text"]]]
    assert docs.columns == names
    assert Counter(rows(docs)) == Counter(tuple(new(r) if c == "text" else (len(new(r)) if new(r) != r[at["text"]] else r[at[c]]) if c == "n_chars" else r[at[c]] for c in names) for r in before)

    before = sorted(set(rows(docs)), key=lambda r: (r[at["doc_id"]] is None, r[at["doc_id"]] or 0, repr(r)))
    sets = [shingle_set(r[at["text"]]) for r in before]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for v in holders.values() for a in v for b in v if a < b)
    similar = {(a, b) for (a, b), n in shared.items() if 10 * n >= 8 * len(sets[a] | sets[b])}
    group = reach_by(len(before), similar | {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if not sets[a] and not sets[b]})
    docs = materialise(three(spark, docs, sf_dir), "t3")
    kept = rows(docs)
    assert docs.columns == names and len(kept) == len(set(kept)) == len(set(group))
    where = {r: i for i, r in enumerate(before)}
    assert len({group[where[r]] for r in kept}) == len(kept)  # one of each group
    assert all(r[at["doc_id"]] == before[group[where[r]]][at["doc_id"]] for r in kept)  # that with the smallest doc_id

    before = docs
    targets = {r.source: int(r.target) for r in mixing.mix(before).collect()}
    docs = materialise(four(spark, docs, sf_dir), "t4")
    mixed = docs.collect()
    total = Counter()
    for r in mixed:
        total[r.source] += n_words(r.text)
    assert docs.columns == names and {s: n for s, n in total.items() if n} == {s: n for s, n in targets.items() if n}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in before.collect()}

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = five(spark, docs, sf_dir).collect()
    ids = lambda t: tuple(lib.encode(t or "", add_bos=True, add_eos=True))
    assert Counter((r.doc_id, r.source, tuple(r.ids), r.n_tokens, r.decoded) for r in out) == Counter((r.doc_id, r.source, ids(r.text), len(ids(r.text)), lib.decode(list(ids(r.text)))) for r in mixed)
    return out


def reach_by(n, links):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_stages_one_by_one(spark, sf_dir):
    out = check_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOCS.split()), sf_dir)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(out)


@pytest.fixture(scope="module")
def odd():
    import random

    r = random.Random(21)
    prose = lambda n: " ".join(word(r) + word(r) for _ in range(n)) + "."
    base = [prose(70) for _ in range(8)]
    edited = [t.replace(" ", " q", 1) + " tail" for t in base[:4]]
    texts = [None, "", " \n\t", "too short"] + base + base + edited + [f"Furniture of this host.\n{prose(60)}\nRead more | Home | About | Help" for _ in range(30)] + [prose(3000)]
    rows = [(r.choice([i, i, None, 3]), t, r.choice(["en", None]), r.choice(["s", "s", "t", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[5:9] + rows[5:6] * 5


def test_stages_on_odd_documents(spark, odd, tmp_path):
    """Null and repeated ids, null texts and sources, equal rows, several texts under one id, a clashing column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*x, "mine", "own") for x in odd], schema + ", kept string, key string").repartition(4)
    out = check_stages(spark, materialise(docs, "odd"), None)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r.doc_id, r.decoded) for r in out)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert reach([0, 1], lambda a, b: True) == {0: 0, 1: 0}
