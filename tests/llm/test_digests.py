"""The operators against brute force, on odd documents: nulls, empties, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from mesaquery.llm import chat, htmltree, kdtree, linededup, media, mixing, pieces, quality, queries, shingles, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, key string, h string"


def word(r):
    return "".join(r.choice("abcdeéöñ漢") for _ in range(r.randint(1, 7)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    prose = lambda n: " ".join(word(r) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "two words", "a b c a b c a b c", "x\x0by\x0cz", "\x85odd\xa0spaces here", "| a | b | c |\nGood line here.\n"]
    base = [prose(n) for n in (60, 120, 300, 2000)]
    texts += base + base + [base[2].upper(), base[2] + " tail", base[3].replace(" ", "\n", 7)]
    texts += [f"Shared line of this host.\n{prose(70)}.\nAll rights reserved." for _ in range(30)]
    texts += [prose(80) + " " + base[0] for _ in range(20)] + ["same same copy of a text " * 20] * 40
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", None, "é"]), len(t or ""), "k", "s", "y", "z") for i, t in enumerate(texts)]
    return out + [out[10], out[10], (None, "text without an id", "en", "s2", 4, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def test_empty_tables(spark, empty):
    for f in (quality.quality_rules, simhash.near_duplicates, mixing.mix_report, pieces.encode_report, media.media_report, linededup.line_dedup_report, kdtree.shard, mixing.mix_documents, quality.apply_quality_rules, linededup.apply_line_dedup, simhash.apply_near_dedup):
        assert f(empty).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert htmltree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_mix_sources", "op7_line_dedup"])
def test_sql_on_odd_documents(spark, docs, rows, tmp_path, name):
    pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    got = queries.queries()[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    at = [want.columns.index(x) for x in got.columns]
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(map(near, r)) for r in got.collect()) == Counter(tuple(near(r[i]) for i in at) for r in want.fetchall())


def test_quality_repeats_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t, *_ in rows[:-1]:
        w = split(t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {p for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(inside), sum(map(len, w)))


def brute_fingerprint(t):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    g = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, linked):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b) and root(a) != root(b):
                at[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_brute_force(docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows[:-1]}
    want = reach(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {i: (got[i].fingerprint, got[i].component_id) for i in fp} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert len({want[i] for i in fp}) < len(fp)


@pytest.mark.parametrize("cell_rows", [40_000, 60, 8])
def test_links_chain_across_cells(spark, monkeypatch, cell_rows):
    """Chains of one- and two-bit steps wander through many cells; small limits force more levels and blocks."""
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    r = random.Random(3)
    fps = []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 25)):
            fps.append(x)
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    ids = list(range(len(fps)))
    r.shuffle(ids)
    f = spark.createDataFrame([(simhash._signed(x), i) for x, i in zip(fps, ids)], "fp long, rep long")
    got = {x.node: x.component for x in simhash.components(simhash.links(f)).collect()}
    of = dict(zip(ids, fps))
    want = reach(sorted(ids), lambda a, b: (of[a] ^ of[b]).bit_count() <= 2)
    assert {i: got.get(i, i) for i in ids} == want


def test_one_of_each_group_stays(docs):
    groups = simhash.near_duplicates(docs).where("doc_id IS NOT NULL")
    kept = [r.doc_id for r in simhash.apply_near_dedup(docs.where("doc_id IS NOT NULL")).collect()]
    assert len(kept) == len(set(kept)) == groups.select("component_id").distinct().count()


def test_rows_with_null_or_repeated_ids_are_judged_by_text(spark):
    a, b, c, d = (" ".join(word(random.Random(k * 1000 + i)) for i in range(80)) for k in range(4))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (1, c, "x"), (1, d, "x"), (1, d, "y"), (2, c, "x"), (None, c, "x")]
    kept = [tuple(r) for r in simhash.apply_near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted((i is None, i, t) if i else (True, 0, t) for i, t, _ in kept) == sorted([(True, 0, a), (True, 0, b), (False, 1, c), (False, 1, d)])


def shingle_set(t):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("group_items, sketch", [(500_000, 64), (900, 64), (150, 10**6)])
def test_near_copies_brute_force(spark, monkeypatch, group_items, sketch):
    """Edited copies around similarity 0.8, chains of them, a common passage; few rows to a task force rings and blocks."""
    monkeypatch.setattr(shingles.groups, "__defaults__", (5, 0.8, group_items))
    monkeypatch.setattr(shingles, "SKETCH", sketch)
    r = random.Random(11)
    passage, texts = [word(r) for _ in range(15)], [None, "", " \n", "one", "One", "two words here", "a b c d e", "a b c d e f"]
    for n in (30, 60, 60, 200, 600):
        w = [word(r) for _ in range(n)] + passage
        for _ in range(14):
            texts.append(" ".join(w))
            if r.random() < 0.5:
                w = list(w)
            for p in r.sample(range(n), max(1, n // r.choice([20, 40, 60]))):
                w[p] = word(r) + "q"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    same = lambda a, b: sets[a] == sets[b] or bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])
    want = reach(range(len(texts)), same)
    got = sorted(x.doc_id for x in simhash.apply_near_dedup(docs).collect())
    assert got == sorted(set(want.values()))
    assert 10 < len(got) < len(texts) - 20


def test_fingerprints_find_what_lies_near(spark, monkeypatch):
    """The stage searches SimHash fingerprints: these alone find the pairs within two bits, and no sketch finds those again."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        w = [word(r) + word(r) for _ in range(300)]
        texts.append(" ".join(w))
        for edits in (1, 1, 8):
            for p in r.sample(range(300), edits):
                w[p] = word(r) + "q"
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    hashes = [[xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s] for s in sets]
    fps = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) for h in hashes]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    similar = lambda a, b: len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = lambda: sorted(x.doc_id for x in simhash.apply_near_dedup(docs).collect())
    whole = sorted(set(reach(range(len(texts)), similar).values()))
    assert kept() == whole
    monkeypatch.setattr(shingles, "sketches", lambda s, similarity: [])
    by_fingerprint = sorted(set(reach(range(len(texts)), lambda a, b: near(a, b) and similar(a, b)).values()))
    assert kept() == by_fingerprint
    assert len(whole) < len(by_fingerprint) < len(texts)
    monkeypatch.undo()
    monkeypatch.setattr(simhash, "links", lambda distinct: distinct.crossJoin(distinct.agg(F.min("fp").alias("v"))).select(F.col("fp").alias("u"), "v").where("u <> v"))
    assert kept() == whole  # all fingerprints in one component: no sketch links across, and the exact check parts them


def test_null_ids_link_others(spark, monkeypatch):
    of = {"a": 0b11, "b": 0b1111, "c": 0b111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.create_map(*(F.lit(x).cast("string") if isinstance(x, str) else F.lit(x).cast("long") for p in of.items() for x in p))[F.col("text")].alias("fp")))
    got = simhash.near_duplicates(spark.createDataFrame([(7, "a"), (None, "b"), (5, "c")], "doc_id long, text string")).collect()
    assert [r.component_id for r in got] == [5, 5, 5]


def test_mix_cuts_exactly_among_repeated_rows(spark):
    nine = [(1, " ".join(["w"] * 31), "s", "en", "c")] * 9
    other = [(None, "x y z", None, "en", "c")] * 4 + [(None, "x y z", None, "de", "c")] * 3
    for rows in (nine, other, nine + other):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string")
        targets = {r.source: r.target for r in mixing.mix(d).collect()}
        taken = Counter()
        for r in mixing.mix(d).collect():
            taken[r.source] += r.taken
        words = Counter()
        out = mixing.mix_documents(d)
        for r in out.collect():
            words[r.source] += len(split(r.text))
        assert words == taken == {s: int(t) for s, t in targets.items()} and out.columns == d.columns


def test_prefix_sums_by_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing.ordinal_bits, "__defaults__", (4,))
    r = random.Random(1)
    rows = [(r.choice(["a", "a", None]), r.getrandbits(60), r.randint(0, 9)) for _ in range(500)]
    got = mixing.prefix_sums(spark.createDataFrame(rows, "g string, k long, v long"), "g", "k", "v", 500, [], "o").collect()
    assert sorted((x.k, x.o) for x in got) == sorted((k, sum(v2 for g2, k2, v2 in rows if g2 == g and k2 < k)) for g, k, _ in rows)


def test_mix_totals_and_documents(docs):
    m = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in m:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for rs in by.values():
        assert sum(r.taken for r in rs) == int(rs[0].target)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in m))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(split(r.text))
    assert {s: n for s, n in words.items() if n} == {s: int(rs[0].target) for s, rs in by.items() if int(rs[0].target)}
    again = mixing.mix_documents(docs, broadcast_sources=0)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in again.collect())


def test_line_dedup_joins_agree(docs):
    wide = {(r.doc_id, r.text) for r in linededup.drop_lines(docs.where("doc_id IS NOT NULL")).select("d.doc_id", F.col("l.clean_text").alias("text")).collect()}
    long = {(r.doc_id, r.text) for r in linededup.drop_lines(docs.where("doc_id IS NOT NULL"), broadcast_lines=0).select("d.doc_id", F.col("l.clean_text").alias("text")).collect()}
    assert wide == long and any(t and "Shared line" not in t and "rights" not in t for _, t in wide)


def test_pieces_equal_the_library(docs, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = {r.doc_id: r for r in pieces.encode_report(docs).collect()}
    for i, t, *_ in rows[:-1]:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(lib.decode(ids).encode()))


def test_pieces_on_random_strings():
    lib, c, r = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.coder(pieces.model_path()), random.Random(9)
    for n in [*range(1500), 20_000]:
        t = "".join(r.choice("ab eé漢\U0001f600\n\tthing▁'<0xA>14 \x00‍") for _ in range(n if n > 1500 else n % 50))
        ids = c.encode(t)
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True) and c.decode(ids) == lib.decode(ids.tolist())
    assert c.decode(__import__("numpy").array([1, 3 + 0xE9, 3 + 0x41, 2], "<u4")) == lib.decode([1, 3 + 0xE9, 3 + 0x41, 2])


def test_pieces_keep_words_without_what_follows_them():
    lib, c = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.PieceCoder(pieces.model_path())
    words = [a + b for a in ("verbe", "cher", "tion", "edwh") for b in ("keit", "aux", "ing", "le")]
    t = " ".join(f"{v}{mark}\n{w}" for v in words for w in words for mark in ".,;")
    assert c.encode(t).tolist() == lib.encode(t, add_bos=True, add_eos=True)
    kept = {k for table in vars(c).values() if isinstance(table, dict) for k, v in table.items() if isinstance(v, bytes)}
    assert len(kept) < 60  # a word at a space, one after a line break, some marks; not their 768 sequences


def test_pieces_across_stretches(monkeypatch):
    lib, c, r = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.PieceCoder(pieces.model_path()), random.Random(4)
    texts = ["".join(r.choice(" ab eé漢\U0001f600\n\tthing▁'.-=14\x00‍ßüœ") for _ in range(r.randrange(40))) for _ in range(400)]
    for stretch in (1, 2, 7):
        monkeypatch.setattr(pieces, "STRETCH", stretch)
        for t in [*texts, "a" * 100, " " * 50, "thing" * 20, "." * 33]:
            ids = c.encode(t)
            assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True) and c.decode(ids) == lib.decode(ids.tolist())


def test_pieces_with_full_tables(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    monkeypatch.setattr(pieces, "PAIRS", 7)
    lib, c, r = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.PieceCoder(pieces.model_path()), random.Random(5)
    for _ in range(50):
        t = " ".join(r.choice(("the", "Thing,", "cher", "œuvre", "漢字", "(14)", "un", "able.\nNo")) + r.choice(("", "keit", "!")) for _ in range(30))
        assert c.encode(t).tolist() == lib.encode(t, add_bos=True, add_eos=True)
        assert len(c.segments) <= 5 and len(c.older) <= 5 and len(c.pairs) <= 7


def test_media_round_trip(docs, rows):
    got = {r.doc_id: r for r in media.media_report(docs).collect()}
    for i, t, *_ in rows[:-1]:
        b = (t or "").encode()
        b += b"\xff" * ((-len(b)) % 576 or (0 if b else 576))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]))
        assert got[i].media_bytes == len(b) + 44
        wave = b"RIFF" + struct.pack("<I", 36 + len(b)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(b)) + b
        mean = sum(b) / len(b)
        spread = math.sqrt(sum((x - mean) ** 2 for x in b) / len(b))
        assert got[i].media_sha256 == hashlib.sha256(wave).hexdigest()
        assert got[i].feature == f"audio/wav;false=0;carved=0;mean={mean:.4f};deviation={spread:.4f};levels={len(set(b))}"


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_carves_and_corrects(spark):
    wav, p = media.store(b"abc BM %PDF- RIFF"), png()
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + struct.pack("<IIIIIIHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab\x12\xff\0\x34\xff\xd9"
    for kind, m in (("audio/wav", wav), ("image/png", p), ("image/gif", gif), ("image/bmp", bmp), ("image/jpeg", jpg)):
        found, _ = media.sniff(m)
        assert [(f.media_type, f.offset, f.length) for f in found] == [(kind, 0, len(m))]
        assert media.sniff(m[:-1])[0] == []
    df = spark.createDataFrame([(1, bytearray(b"junk" + p + b"mid" + wav), "text/plain"), (2, bytearray(p), "image/gif"), (3, None, None), (4, bytearray(b"GIF89a no"), "image/gif")], "id long, b binary, d string")
    got = {r.id: r for r in media.sniff_column(df, "id", "b", "d").collect()}
    assert got[1].media_type == "text/plain" and [bytes(c.content) for c in got[1].carved] == [p, wav]
    assert (got[2].media_type, got[2].carved) == ("image/png", [])
    assert got[3].media_type == got[4].media_type == media.UNKNOWN and got[4].false_signatures == 1


def test_sniffing_is_linear():
    """Long runs of signatures without an end, or with one end for all; a walk doesn't go again where one failed."""
    gif = b"GIF89a\x01\0\x01\0\0\0\0"
    blobs = [b"PK\x03\x04" * 200_000, b"%PDF-" * 200_000 + b"%%EOF", (gif + b"!\xfe" + b"\x0d") * 30_000, b"RIFF" * 200_000, b"BM" * 300_000, b"\xff\xd8\xff\xe0\0\x04" * 100_000]
    for b in blobs:
        began = time.process_time()
        found, false = media.sniff(b)
        assert not found and false > 1000 and time.process_time() - began < 10
    pdf = b"%PDF-1.4 x startxref 1 %%EOF"
    archive = b"PK\x03\x04data" + b"PK\x01\x02dir" + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 7, 8, 2) + b"hi"
    found, _ = media.sniff(b"%PDF- " + b"x" * 9 + archive + pdf + archive)
    assert [(f.media_type, f.length) for f in found][:1] == [("application/pdf", 6 + 9 + len(archive) + len(pdf))]
    assert [(f.media_type, f.offset, f.length) for f in media.sniff(b"ab" + archive + b"cd" + pdf)[0]] == [("application/zip", 2, len(archive)), ("application/pdf", 4 + len(archive), len(pdf))]


def test_shards(docs, rows):
    got = kdtree.shard(docs).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert all((r["size"], r.text_crc32) == sizes[r.doc_id] for r in got)


def plain_tree(rows, depth):
    """Shards of (doc_id, text, source, lang) by the definition, from sorted lists."""
    ranks = [{v: i for i, v in enumerate(sorted({r[c] for r in rows}, key=lambda v: (v is not None, (v or "").encode())))} for c in (2, 3)]
    key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}/{hashlib.md5((r[1] or '').encode()).hexdigest()}/{kdtree.SEED}".encode()).hexdigest()[:15], 16) >> 28
    at = [((-1 if r[0] is None else r[0], len(r[1] or ""), ranks[0][r[2]], ranks[1][r[3]]), key(r), len((r[1] or "").encode()) + 1, i) for i, r in enumerate(rows)]
    whole = [max(1, max(x[0][d] for x in at) - min(x[0][d] for x in at)) for d in range(4)]
    nodes = {0: at}
    for _ in range(depth):
        below = {}
        for n, xs in nodes.items():
            width = lambda d: (max(x[0][d] for x in xs) - min(x[0][d] for x in xs)) / whole[d]
            d = max(range(4), key=lambda d: (width(d), -d))
            xs.sort(key=lambda x: (x[0][d], x[1]))
            half, run, cut = sum(x[2] for x in xs) // 2, 0, None
            for x in xs:
                run += x[2]
                if run > half:
                    cut = (x[0][d], x[1])
                    break
            for x in xs:
                below.setdefault(2 * n + ((x[0][d], x[1]) >= cut), []).append(x)
        nodes = below
    return {x[3]: n for n, xs in nodes.items() for x in xs}


def test_shards_brute_force(spark, rows):
    r = random.Random(3)
    some = [x[:2] + (x[3], x[2]) for x in rows]
    some += [(r.randrange(10**6), " ".join(word(r) for _ in range(r.choice([1, 5, 50]))), "https://site-" + r.choice("abcdefgh"), r.choice(["en", None])) for _ in range(300)]
    d = spark.createDataFrame([(*x, i) for i, x in enumerate(some)], "doc_id long, text string, source string, lang string, shard long").repartition(3)
    for depth in (1, 4):
        want = plain_tree(some, depth)
        got = Counter((x.doc_id, x.text_crc32, x.shard) for x in kdtree.shard(d, depth).collect())
        assert got == Counter((x[0], zlib.crc32((x[1] or "").encode()), want[i]) for i, x in enumerate(some))
    total = sum(len((x[1] or "").encode()) + 1 for x in some)
    assert {x.shard for x in kdtree.shard(d, target_bytes=total // 3).collect()} == {0, 1, 2, 3}


def test_shards_are_even_with_ties(spark):
    d = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    b = [r.s for r in kdtree.shard(d).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(b) == 16 and max(b) < 1.02 * min(b)


def test_toxicity_learns_and_tolerates(spark):
    r = random.Random(2)
    insults = ["idiot", "moron", "clown", "scum"]
    vocabulary = [word(r) + word(r) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        w = [r.choice(vocabulary) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(insults)
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 5 == 0)))
    docs += [(1000, "you i.d.i.o.t of " + vocabulary[0], "x"), (1001, "an i d i o t here", "x"), (1002, None, "x"), (1003, "", "x"), (1004, vocabulary[1], "x")]
    got = {x.doc_id: x for x in toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i, _ in labels)
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) > 0.95 * len(held)
    assert got[1000].predicted == got[1001].predicted == 1
    assert got[1002].score == got[1003].score < 0.5 and got[1004].predicted == 0


def plain_kernel(a, b):
    """The kernel by its definition: common letter triples, decayed by letters spanned and gap characters inside."""

    def feature(w):
        c = [(1, 0)]
        gaps = 0
        for x in w:
            if toxicity._code(x):
                c.append((toxicity._code(x), gaps))
            else:
                gaps += 1
        c.append((2, gaps))
        f = Counter()
        for i in range(len(c)):
            for j in range(i + 1, min(len(c), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    f[c[i][0], c[j][0], c[k][0]] += toxicity.DECAY ** (k - i + 1) * toxicity.GAP ** (c[k][1] - c[i][1])
        norm = math.sqrt(sum(v * v for v in f.values()))
        return {x: v / norm for x, v in f.items()} if norm else f

    fa, fb = feature(a), feature(b)
    return sum(v * fb.get(x, 0) for x, v in fa.items())


def test_kernel_brute_force():
    r = random.Random(4)
    some = ["idiot", "i*d-i.o.t", "i d i o t", "a", "aa", "漢字", "x9-9", "banana"] + ["".join(r.choice("abci d*ot9é") for _ in range(r.randint(1, 18))) for _ in range(40)]
    got = toxicity._kernel(some, some)
    assert all(abs(got[i, j] - plain_kernel(a, b)) < 1e-5 for i, a in enumerate(some) for j, b in enumerate(some))
    assert plain_kernel("idiot", "i*d-i.o.t") > 0.9 > 0.5 > plain_kernel("idiot", "riotous")


def test_sentences_and_wrong_labels(spark):
    assert toxicity.sentences("One. Two 3.5 of? No!\nLast e.g. this") == ["One.", "Two 3.5 of?", "No!", "Last e.g.", "this"]
    assert toxicity.sentences(None) == toxicity.sentences(" \n ") == []
    r = random.Random(6)
    prose = lambda: [word(r) + word(r) for _ in range(30)]
    docs = []
    for i in range(500):
        w = prose()
        if i % 4 == 0 or i in (3, 7, 11):  # three insults under a clean label
            w[5] = r.choice(["zqworth", "zqmoron"])
        docs.append((i, ". ".join(" ".join(w[k : k + 6]) for k in range(0, 30, 6)), int(i % 4 == 0)))
    docs += [(900, docs[0][1] + " of 900", 0)] * 3 + [(None, "no id", 1)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity(d, spark.createDataFrame([(x[0], x[2]) for x in docs], "doc_id long, toxic int")).collect()}
    held = [x for x in docs if x[0] is not None and x[0] < 500 and got[x[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.97 * len(held)


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class='cookie-notice'>We use</div>{}<div id=comments><p>First!</p></div><form>Send</form><footer>&copy; f</footer></body></html>"


def test_html_articles(spark):
    pages = [
        (1, "http://a.b/1", PAGE.format("<article><h1>T &amp; x</h1><p>One <b>two<br><p>thr\n ee &eacute;<aside>side</aside></article>")),
        (2, "http://a.b/2", PAGE.format("<div><p>No article</p>loose</div>")),
        (3, None, None), (4, "x", ""), (5, "http://a.b/3", "<article><p>cut off he"), (6, "http://a.b/4", "<nav>x</nav>"),
    ]
    pages += [(100 + i, "http://c.d/", f"<body><div class=top>Always the same</div><div class=body><p>Text {i} is its own {i * i}</p></div><div class=end>Ever</div></body>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (0, 1000):
        got = {r.page_id: r for r in htmltree.extract(df, broadcast_nodes=limit).collect()}
        assert [got[i].text for i in range(1, 7)] == ["T & x\n\nOne two\n\nthr ee é", "No article\n\nloose", "", "", "cut off he", ""]
        assert all(got[100 + i].text == f"Text {i} is its own {i * i}" and got[100 + i].n_chars == len(got[100 + i].text) for i in range(30))


def plain_importance(pages):
    """(node -> importance) of a host's pages by the textbook formulas, from lists."""
    shown, texts, seen = defaultdict(list), defaultdict(list), set()
    for page in pages:
        kept, nodes = htmltree.candidates(page, "h")
        main = tuple(t for _, _, t in kept)
        if main in seen:
            continue
        seen.add(main)
        for n, f in nodes:
            shown[n].append(f)
        for n, t in {(n, t) for n, _, t in kept}:
            texts[n].append(t)
    out = {}
    for n, fs in shown.items():
        m = len(fs)
        presentation = -sum(c / m * math.log(c / m) for c in Counter(fs).values()) / math.log(m) if m > 1 else 1
        content = 1 - sum(c * math.log(c) / math.log(m) for c in Counter(texts[n]).values()) / len(texts[n]) if m > 1 and texts[n] else 1
        prior = htmltree.PRIOR + (m if n % 2 else 0)
        out[n] = (m * ((1 - htmltree.GAMMA) * presentation + htmltree.GAMMA * content) + prior) / (m + prior)
    return out


def test_style_tree_brute_force(spark):
    """Importance of nodes in articles too, against plain formulas; what repeats is cut, what HTML says is followed."""
    r = random.Random(8)
    part = lambda: " ".join(word(r) for _ in range(6))
    pages = []
    for i in range(60):
        own = "".join(f"<p>{part()}</p>" for _ in range(r.randint(1, 3)))
        html = f"<body><main><div class=box>Read our other stories</div><div class='related-work'>{part()}</div><div id='reply-theory'><span>{part()}</span></div>{own}<p>Set in {r.choice('AB')}.</p><div class='cookie-notice'>{part()}</div></main><div class=x>{part()}</div></body>"
        pages.append((i, "http://h/" + str(i), html if i % 10 else pages[-1][2] if pages else html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parsed = htmltree.parse(df)
    want = plain_importance([p[2] for p in pages])
    # the host is part of a node's key
    assert sorted(round(v, 9) for v in want.values()) == sorted(round(x.importance, 9) for x in htmltree.importance(parsed).collect())
    got = {x.page_id: x.text for x in htmltree.extract(df).collect()}
    for i, _, html in pages:
        want_text = [t for t in re.findall(r"(?:<p>|related-work'>|<span>)([^<]+)<", html)]
        assert got[i].split("\n\n") == want_text, i


def test_html_odd_markup():
    texts = lambda h: [t for _, w, t in htmltree.candidates(h, "")[0] if w >= htmltree.THRESHOLD]
    assert texts("<article><p>one</p><svg><p>two</p></article>") == ["one", "two"]
    assert texts("<article><p>a <svg><g><text>icon</text></g></svg> b</p><select><option>x</select><p>c<script>var p='<p>'") == ["a b", "c"]
    assert texts("<article><svg>x<p>one</p><p>two <svg>y</svg>three</p>") == ["one", "two three"]
    assert texts("<article><object><div>deep</div></article>tail") == ["deep"]
    assert texts("<article><noscript>no<p>no</noscript><p>yes</p><noscript>open") == ["yes", "open"]
    assert texts("<article><p>yes</p><script>var open = 1; <p>no</p>") == ["yes"]


def plain_links(rows):
    """(conv, turn) -> parent, by comparing every quote with every message."""
    fold = lambda ls: " ".join(" ".join(ls).casefold().split())
    said, quoted = defaultdict(set), defaultdict(dict)
    for c, t, _, text in rows:
        paragraphs, run, level = [], [], 0
        lines = (text or "").split("\n")
        kinds = []
        for i, x in enumerate(lines):
            m = re.match(r"^[ \t]*((?:>[ \t]?)+)", x)
            n = m[1].count(">") if m else 0
            if m is None and i + 1 < len(lines) and re.match(r"^[ \t]*>", lines[i + 1]) and chat.ATTRIBUTION.match(x):
                continue
            kinds.append((n, x[m.end() :] if m else x))
        for n, x in [*kinds, (-1, "")]:
            if n != level or not x.strip():
                if run:
                    paragraphs.append((level, run))
                run = []
            level = n
            if x.strip():
                run.append(x)
        for n, run in paragraphs:
            folded = fold(run)
            for u in {folded, *map(fold, ([x] for x in run)), *re.split(r"(?<=[.!?])\s+", folded)} - {""}:
                if n == 0:
                    said[u].add((c, t))
                else:
                    quoted[c, t][u] = min(n, quoted[c, t].get(u, n))
    out = {}
    for (c, t), us in quoted.items():
        votes = defaultdict(lambda: [0, 0])
        for u, n in us.items():
            own = [x for x in said[u] if x[0] == c and x[1] < t]
            others = [x for x in said[u] if x[0] != c]
            p = min(own) if own else min(others) if others and len(u.split()) >= 3 else None
            if p:
                votes[p][0] += 1
                votes[p][1] += n == 1
        if votes:
            out[c, t] = max(votes, key=lambda p: (votes[p][1] > 0, p[0] == c, votes[p][1], votes[p][0], p[1], p[0]))
    return out


def test_quotes_brute_force(spark):
    """Random threads with rewrapped, nested, short and foreign quotes, repeated lines and repeated turns."""
    r = random.Random(12)
    sentence = lambda: " ".join(word(r) for _ in range(r.choice([1, 2, 5, 9]))).capitalize() + r.choice([".", "?", "!", ""])
    rows = []
    for c in range(25):
        mine = []
        for t in range(r.randint(1, 9)):
            body = "\n".join(" ".join(sentence() for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3)))
            if mine and r.random() < 0.7:
                pool = mine if r.random() < 0.7 or not rows else [x[3] for x in rows]
                words = r.choice(pool).split()
                if r.random() < 0.5:
                    words = r.choice(pool).split("\n")[0].split()
                quote = [" ".join(words[k : k + 4]) for k in range(0, len(words), 4)] if r.random() < 0.6 else [" ".join(words)]
                body = "\n".join([*(["Ann wrote:"] if r.random() < 0.3 else []), *(r.choice(["> ", ">", ">> ", "> > "] if k == 0 else ["> "]) + q for k, q in enumerate(quote)), body])
            mine.append(body)
            rows.append((c, t, "user", body if r.random() < 0.95 else None))
    rows += [rows[5], rows[6]]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = plain_links(rows)
    assert len(got) == len(rows) and len(want) > 20
    parent = {(x.conv_id, x.turn): (x.parent_conv_id, x.parent_turn) for x in got if x.parent_conv_id is not None}
    assert parent == want
    up = {k: p for k, p in parent.items() if p[0] <= k[0]}
    for x in got:
        path = [(x.conv_id, x.turn)]
        while path[0] in up:
            path.insert(0, up[path[0]])
        assert [tuple(p) for p in x.reply_path] == path and (x.thread_conv_id, x.root_turn, x.reply_depth) == (*path[0], len(path) - 1)
    read = [(x.thread_conv_id, tuple(map(tuple, x.reply_path))) for x in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert read == sorted(read)


def test_quotes_link_replies(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt is long and slow."),
        (1, 1, "assistant", "On Monday Ann wrote:\n> How do I sort a list?\nUse sorted() on the list."),
        (1, 2, "user", "A new topic about cats here."),
        (1, 3, "user", "> Use sorted() on the list.\n>> How do I sort a list?\nThank you very much."),
        (1, 4, "user", "> nobody ever said these words\nok"),
        (2, 0, "user", ">  a NEW   topic about cats here.\nI like those cats too."),
        (3, 0, "user", None), (3, 1, "user", ""), (3, 1, "user", "again the same turn"),
        (4, 0, "user", "Yes, please"), (4, 1, "user", "> Yes, please\nDone."), (5, 0, "user", "> Yes, please\nWhat?"),
        (6, 0, "user", "> Use sorted()\n> on the list.\nWrapped anew."), (6, 1, "user", "Use sorted() on the list."), (None, 0, "user", "> Yes, please"), (4, None, "user", "x"),
    ]
    rows += [(9, i, "user", "We all say the same words.") for i in range(300)] + [(9, 300, "user", "> We all say the same words.\nYes we do say.")]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    where = lambda k: (at[k].parent_conv_id, at[k].parent_turn)
    assert where((1, 1)) == (1, 0) and where((1, 3)) == (1, 1) and where((1, 2)) == where((1, 4)) == (None, None)
    assert where((2, 0)) == (1, 2) and where((9, 300)) == (9, 0)
    assert where((4, 1)) == (4, 0) and where((5, 0)) == where((None, 0)) == (None, None) and where((6, 0)) == (1, 1)
    assert (at[1, 3].root_turn, at[1, 3].reply_depth, at[1, 3].quote_depth, at[6, 0].thread_conv_id, at[6, 0].root_turn) == (0, 2, 2, 1, 0)
    assert at[1, 1].text == "Use sorted() on the list." and at[3, 0].text == "" and at[4, 1].formatted == "### user\nDone.\n"
    order = [(r.conv_id, r.turn) for r in sorted((r for r in got if r.thread_conv_id == 1), key=lambda r: r.reply_path)]
    assert order == [(1, 0), (1, 1), (1, 3), (6, 0), (1, 2), (2, 0), (1, 4)]
