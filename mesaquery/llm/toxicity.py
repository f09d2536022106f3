"""Toxicity by a string-kernel support vector machine.

The kernel counts subsequences of three letters with gaps: each occurrence
weighs DECAY to the power of the letters it spans, and GAP to the power of the
other characters, which are nothing but gaps: "i*d-ioot" and "i d i o t" still
share most of what "idiot" has. A sentence enters by its windows (words, and runs
of single letters): in the kernel of a whole sentence, one insult would drown
among twenty words. Windows carry end marks, kernels are normalised.

The machine is trained on labelled sentences, each labelled as its document is.
Landmarks are windows of toxic sentences and of clean ones; they give Nyström
features, in which a linear machine with squared hinge loss is trained. A clean
sentence speaks against all its windows. A toxic document speaks by its most
suspicious sentence, and by its others that come out as toxic; such a sentence
speaks for its most suspicious window only; both are picked anew each round.
Windows are judged by the odds of toxic to clean documents, so a few wrong
labels don't undo an insult. A sentence's margin is that of its worst window, a
text's margin that of its worst sentence, and a logistic curve makes it a score,
0.5 where documents left out of training are told apart with fewest errors.

The machine is linear in subsequence counts, so it collapses into one table of
weights, a few hundred kB, whatever it was trained on: scoring a window is a table
lookup for each of its subsequences. Windows are scored once a worker.

Labels are learned only from rows with crc32(doc_id) mod 5 other than 0. Of
those, at most MAX_TOXIC + MAX_CLEAN documents are taken, by a hash of doc_id, one
row of each, and of each SENTENCES sentences at most, by a hash of the sentence:
this bounds what the driver holds. Texts are scored whole; the score sees nothing
but the text.

Edge cases: null, empty and word-free texts get the score of a text without any
suspicious word. Equal texts get equal scores, rows that repeat are scored each.
Without labels of both kinds to learn from, every score is the share of toxic
labels, or 0. A document labelled both ways counts as toxic; null labels and ids
are left out of training. An empty table gives an empty result. Only the columns
named are read, so others can't clash.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The bounded sample of labelled documents, and the sentences taken of each.
MAX_TOXIC, MAX_CLEAN = 1000, 1500
SENTENCES = 120
#: A window is suspicious if the share of toxic documents that have it is this many times that of clean ones.
ODDS = 8
FOLDS = 5
DECAY, GAP = 0.7, 0.9
#: Subsequences span this many characters at most; words are read in windows of WINDOW.
SPAN, WINDOW = 6, 24
LANDMARKS = 256
ROUNDS = 3
COST = 2.0
#: Characters are told apart in so many classes: gaps, two end marks, a-z, 0-9, and other letters by code.
CLASSES = 48
KEPT_WORDS = 400_000
#: Letters standing alone, four or more in a row, spell a word; the spaces are its gaps.
SPELT = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){3,}")
SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?](?!\s)[^\n.!?]*)*[.!?]*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normalise(window: str) -> str:
    """Case, accents and outer punctuation gone; what stands between the letters stays, as a gap of the kernel."""
    w = _EDGE.sub("", window)
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c))
    return w.lower()


def windows_of(text: str | None) -> set[str]:
    """The distinct raw windows of a text or sentence."""
    t = (text or "").lower()
    found = set(t.split())
    found.update(m[0] for m in SPELT.finditer(t))
    return found


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: they end at a line's end or a full stop, question or exclamation mark before white space."""
    return [x for m in SENTENCE.finditer(text or "") if (x := m[0].strip())]


def _code(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 94  # 3..28
    if "0" <= c <= "9":
        return ord(c) - 19  # 29..38
    return 39 + ord(c) % (CLASSES - 39) if c.isalnum() else 0


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index triples within SPAN of an n-character string, and their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = (np.array(x, np.int64) for x in zip(*at, strict=True))
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float64)


_TRIPLES: dict[int, tuple] = {}


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in ``words``, codes, weights) by word length: a row a window, normalised to length one.

    Repeated subsequences stand apart in a row; the norm is taken over their sums.
    Gap characters make no subsequences of their own.
    """
    by_size: dict[int, list[tuple[int, list[int], list[int]]]] = {}
    for at, w in enumerate(words):
        c, gaps = [1, *map(_code, w), 2], []
        if 0 in c:
            gaps = [sum(x == 0 for x in c[:p]) for p, x in enumerate(c) if x] if len(c) < 256 else np.cumsum([x == 0 for x in c])[[x != 0 for x in c]].tolist()
            c = [x for x in c if x]
        for s in range(0, max(1, len(c) - WINDOW // 2), WINDOW // 2):
            part = c[s : s + WINDOW]
            if len(part) >= 3:
                by_size.setdefault(len(part), []).append((at, part, gaps[s : s + WINDOW]))
    for n, rows in by_size.items():
        if n not in _TRIPLES:
            _TRIPLES[n] = _triples(n)
        i, j, k, weight = _TRIPLES[n]
        for start in range(0, len(rows), 1024):
            at = np.array([r[0] for r in rows[start : start + 1024]])
            c = np.array([r[1] for r in rows[start : start + 1024]], np.int64)
            codes = (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k]
            order = np.argsort(codes, axis=1)
            codes, w = np.take_along_axis(codes, order, 1), weight[order]
            if any(r[2] for r in rows[start : start + 1024]):
                g = np.array([r[2] or [0] * n for r in rows[start : start + 1024]])
                w = w * np.take_along_axis(GAP ** (g[:, k] - g[:, i]), order, 1)
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            flat = np.flatnonzero(first.ravel())
            sums = np.add.reduceat(w.ravel(), flat)
            norms = np.sqrt(np.bincount(flat // codes.shape[1], sums**2, minlength=len(codes)))
            yield at, codes, w / np.maximum(norms, 1e-12)[:, None]


@dataclass
class Model:
    """Weights of all subsequences, and the logistic curve of a text's margin."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Margins of normalised words; a long word counts by its worst window."""
        out = np.full(len(words), -np.inf)
        for at, codes, w in subsequences(words):
            np.maximum.at(out, at, (self.table[codes] * w).sum(axis=1) + self.bias)
        return np.where(np.isfinite(out), out, self.bias)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, words by landmarks."""
    dense = np.zeros((len(landmarks), CLASSES**3), np.float32)
    for at, codes, w in subsequences(landmarks):
        for r, row in enumerate(at):
            np.add.at(dense[row], codes[r], w[r])
    table = np.ascontiguousarray(dense.T)
    out = np.full((len(words), len(landmarks)), 0.0)
    for at, codes, w in subsequences(words):
        for s in range(0, len(at), 64):
            np.maximum.at(out, at[s : s + 64], np.einsum("rt,rtl->rl", w[s : s + 64], table[codes[s : s + 64]]))
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x1.shape[1])
    ridge = np.eye(len(v))
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x1 @ v)
        on = slack > 0
        c = COST * weight[on]
        step = np.linalg.solve(ridge + (x1[on].T * c) @ x1[on], ridge @ v - x1[on].T @ (c * y[on] * slack[on]))
        v -= step
        if np.abs(step).max() < 1e-6:
            break
    return v[:-1], float(v[-1])


#: A document: its sentences, each as its distinct normalised windows.
Doc = list[list[str]]


def fit(toxic: list[Doc], clean: list[Doc]) -> Model:
    """Train on the sentences of labelled documents.

    The logistic curve is fitted to margins of documents that a machine wasn't
    trained on (in more parts where there are few, to leave it enough), so one that
    knows its own examples too well isn't trusted.
    """
    share = len(toxic) / max(1, len(toxic) + len(clean))
    if len(toxic) < 2 or len(clean) < 2:
        return Model(np.zeros(CLASSES**3), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0))
    margins, labels = [], []
    parts = max(2, min(8, 1600 // len(toxic)))
    for k in range(parts):
        most = [[d for i, d in enumerate(docs) if i % parts != k] for docs in (toxic, clean)]
        machine = _train(*most) if all(most) else None
        for y, docs in ((1.0, toxic[k::parts]), (0.0, clean[k::parts])):
            margins += _worst(machine, docs) if machine else []
            labels += [y] * len(docs) if machine else []
    model = _train(toxic, clean)
    x, y = np.array(margins), np.array(labels)
    model.slope = _logistic(x, y)[0]
    model.shift = -model.slope * _cut(x, y)
    return model


def _cut(x: np.ndarray, y: np.ndarray) -> float:
    """The margin that tells the two kinds apart with fewest errors; of equals the one in the widest gap."""
    by = np.argsort(x, kind="stable")
    x, y = x[by], y[by]
    errors = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]  # with the cut before each place
    places = np.flatnonzero(errors[1:-1] == errors[1:-1].min()) + 1 if len(x) > 1 else np.array([0])
    at = max(places, key=lambda p: (x[p] - x[p - 1], p))
    return float((x[at - 1] + x[at]) / 2)


def _worst(model: Model, docs: list[Doc]) -> list[float]:
    seen = sorted({w for d in docs for s in d for w in s})
    margin = dict(zip(seen, model.margins(seen).tolist(), strict=True))
    return [max((margin[w] for s in d for w in s), default=model.bias) for d in docs]


def _train(toxic: list[Doc], clean: list[Doc]) -> Model:
    t, c = (Counter(w for d in docs for w in {w for s in d for w in s}) for docs in (toxic, clean))
    odds = {w: ((n + 0.5) / (len(toxic) + 1)) / ((c[w] + 0.5) / (len(clean) + 1)) for w, n in t.items()}
    suspicious = lambda w: odds[w] >= ODDS and c[w] <= t[w]
    rnd = np.random.default_rng(7)
    clean_words = sorted(c, key=lambda w: (-c[w], w))
    negatives = dict.fromkeys([*clean_words[:800], *(clean_words[i] for i in rnd.permutation(len(clean_words))[:2500])])
    # first guess: windows that several toxic documents have, and clean ones hardly ever; the most frequent are landmarks
    often = max(2, len(toxic) // 100)  # rarer ones stand in toxic documents by chance as well
    only = sorted((w for w in t if t[w] >= often and suspicious(w)), key=lambda w: (-t[w], w))[: 3 * LANDMARKS]
    only = only or sorted(t, key=lambda w: (-odds[w], w))[:LANDMARKS]
    positives = only
    marks = list(dict.fromkeys([*only[: LANDMARKS * 3 // 4], *clean_words[: LANDMARKS // 4]]))
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    dense = np.zeros((len(marks), CLASSES**3), np.float32)
    for at, codes, w in subsequences(marks):
        for r, row in enumerate(at):
            np.add.at(dense[row], codes[r], w[r])
    for step in range(ROUNDS):
        neg = [w for w in negatives if w not in set(positives)]
        y = np.r_[np.ones(len(positives)), -np.ones(len(neg))]
        weight = np.r_[[np.log(t[w]) + 0.1 for w in positives], [np.log1p(c[w]) for w in neg]]
        weight[: len(positives)] *= weight[len(positives) :].sum() / weight[: len(positives)].sum() / 4
        v, bias = _machine(_kernel([*positives, *neg], marks) @ whiten, y, weight)
        model = Model(((whiten @ v) @ dense).astype(np.float64), bias, 1.0, 0.0)
        if step + 1 < ROUNDS:
            names = list(c)
            margin = dict(zip(names, model.margins(names).tolist(), strict=True))
            negatives.update(dict.fromkeys(sorted(names, key=lambda w: (-margin[w], w))[:1000]))
            mine = [w for w in t if suspicious(w)]
            margin = dict(zip(mine, model.margins(mine).tolist(), strict=True))
            spoken: Counter[str] = Counter()
            for d in toxic:
                # the most suspicious window of each sentence; the worst sentence speaks, and those that come out as toxic
                worst = sorted((max((margin[w], w) for w in s if w in margin) for s in d if any(w in margin for w in s)), reverse=True)
                spoken.update({w for i, (x, w) in enumerate(worst) if x > 0 or i == 0 and x > -0.5})
            positives = list(dict.fromkeys([*(w for w in spoken if t[w] > 1), *(w for w in only if margin[w] > 0)])) or positives
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by damped Newton steps, with targets drawn in from 0 and 1."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x1 = np.stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)) @ x1.T + 1e-6 * np.eye(2), x1 @ (p - target))
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs = []
        for t in b.column(2):
            some = sorted(set(sentences(t.as_py())), key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x))[:SENTENCES]
            docs.append([sorted({n for w in windows_of(x) if (n := normalise(w))}) for x in some])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(docs, pa.list_(pa.list_(pa.string())))], names=["doc_id", "toxic", "sentences"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; each side is chosen by a hash of doc_id, before any text is read."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    sides = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    chosen = sides[0].unionByName(sides[1])  # at most MAX_TOXIC + MAX_CLEAN rows
    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), _windows, "doc_id long, toxic int, sentences array<array<string>>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("toxic", "sentences")).alias("d")).select("d.toxic", "d.sentences").toArrow()  # one row an id
    rows = sorted(zip(found["toxic"].to_pylist(), found["sentences"].to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
    return fit([w for y, w in rows if y], [w for y, w in rows if not y])


class _Scorer:
    """Scores texts with one model; margins of raw words are remembered in a bounded table."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def texts(self, texts: list[str | None]) -> list[float]:
        out = []
        for start in range(0, len(texts), 64):
            sets = [windows_of(t) for t in texts[start : start + 64]]
            new = [w for w in set().union(*sets) if w not in self.known]
            if len(self.known) + len(new) > KEPT_WORDS:
                self.known.clear()
                new = list(set().union(*sets))
            bare = [normalise(w) for w in new]
            margins = self.model.margins(bare)
            self.known.update((w, float(m) if b else -np.inf) for w, b, m in zip(new, bare, margins, strict=True))
            out += [self.model.score(max(max((self.known[w] for w in s), default=-np.inf), self.model.bias)) for s in sets]
        return out


_SCORERS: dict[str, _Scorer] = {}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    spark = docs.sparkSession
    name = uuid.uuid4().hex
    model = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = _Scorer(model.value)
        for b in batches:
            scores = _SCORERS[name].texts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")
