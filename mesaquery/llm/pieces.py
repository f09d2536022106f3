"""SentencePiece encoding and decoding, exact for merge-type (BPE) models.

A sequence of pieces is the BPE encoding of a text if and only if each two
neighbours are the encoding of their joint text. So instead of merging, a text is
walked from the left: at each place the longest piece that an Aho-Corasick pass
found there, and that agrees with the piece before it, is taken; where none
agrees the place is marked in a field of failed positions, never to be tried
again, and the walk steps back. Whether two pieces agree is settled by merging
their joint text once and remembered.

Two characters that stand side by side in no piece can't be joined, so a text is
cut between them before it is walked. That cuts off punctuation and unknown
characters, and parts texts at spaces, as pieces never hold the space mark after
another character (checked on loading). The ids of short segments are remembered
in a bounded table. Characters without a piece fall back to their UTF-8 bytes.

Edge cases: null and empty texts encode to the begin and end ids alone. Texts
are whole, of any length; a segment without cuts costs time linear in its length.
Equal texts give equal rows, and rows that repeat each come out; ties of merge
scores go to the left. An empty table gives an empty result; only the columns named
are read, so others can't clash. A model with normalisation, unused pieces or user
pieces, or one that isn't BPE, is refused on loading.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"
#: Entries of the table of segments: full, it becomes the older generation, from which what is met again comes back.
#: With both generations some 80 MB a worker. Then of pairs, which are emptied when full: 30 MB.
TABLE = 280_000
PAIRS = 240_000
#: Longer segments are encoded each time they come.
LONGEST_KEPT = 32
#: Characters that are looked through for cuts at once.
STRETCH = 1 << 16
#: Texts on which a model is compared with the installed library before it is used.
PROBES = ("", " ", "a", "  two  spaces ", "tab\tand\nline", "éè 漢字 \U0001f600‍", SPACE + "x", "ﬁ Ａ <s></s>", "aaaaaaaaaaaaaaaaa" * 3)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        special = [i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)]
        self.bytes_ = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.byte_ids = [self.bytes_[f"<0x{b:02X}>"] for b in range(256)] if len(self.bytes_) == 256 else []
        plain = [i for i in range(n) if not (lib.is_byte(i) or i in special)]
        if any(" " in lib.id_to_piece(i) or SPACE in lib.id_to_piece(i).lstrip(SPACE) for i in plain):
            raise ValueError(f"{path}: not a model with pieces that begin words")
        # from here on a space stands for the space mark
        self.ids = {lib.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.first, self.last = (struct.pack("<I", i) for i in (self.begin, self.end))
        if not self.byte_ids or any(lib.is_unused(i) for i in range(n)) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError(f"{path}: not a BPE model with byte fallback and a piece for each character of its pieces")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, i))
        self.automaton.make_automaton()
        self.piece = {i: p for p, i in self.ids.items()}
        self.size, self.shorter, self.n = [0] * n, [-1] * n, n
        for p, i in self.ids.items():
            self.size[i] = len(p)
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        # a number for each character that stands in a longer piece (others: 0), and which two stand side by side in one
        inner = {c: k for k, c in enumerate(sorted({c for p in self.ids if len(p) > 1 for c in p}), 1)}
        self.row = np.zeros(0x110000, np.intp)
        self.row[[ord(c) for c in inner]] = list(inner.values())
        self.apart = np.ones((len(inner) + 1, len(inner) + 1), bool)
        for p in self.ids:
            for left, right in zip(p, p[1:], strict=False):
                self.apart[inner[left], inner[right]] = False
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # what an id decodes to by itself; bytes from 128 up depend on their neighbours and are left to decode()
        self.text = [""] * n
        for p, i in self.ids.items():
            self.text[i] = p
        for b in range(128):
            self.text[self.byte_ids[b]] = chr(b)
        self.high = np.zeros(n, bool)
        self.high[self.byte_ids[128:]] = True
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        for probe in PROBES:
            ids = self.encode(probe)
            if ids.tolist() != lib.encode(probe, add_bos=True, add_eos=True) or self.decode(ids) != lib.decode(ids.tolist()):
                raise ValueError(f"{path}: a model of another kind (normalisation, prefix or merge order)")

    def merge(self, text: str) -> list[str]:
        """Encoding by merging: the best-scored joinable neighbours first, the leftmost of equals."""
        parts, score, never = list(text), self.score, -np.inf
        scores = [score.get(two, never) for two in map(add, parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == never:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at], never)
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1], never)
        return parts

    def agrees(self, left: int, right: int) -> bool:
        """Whether a piece can follow another (-1: stand alone) in an encoding."""
        key = left * self.n + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            want = [self.piece[right]] if left < 0 else [self.piece[left], self.piece[right]]
            known = self.pairs[key] = self.merge("".join(want)) == want
        return known

    def walk(self, text: str) -> list[int]:
        """The ids of a text of known characters, by backtracking."""
        n = len(text)
        longest = [self.ids[c] for c in text]
        for last, (back, i) in self.automaton.iter(text):
            longest[last - back] = i  # for one place the ends come in rising order
        failed = bytearray(n + 1)
        ids: list[int] = []
        agrees, pairs, size, shorter, base = self.agrees, self.pairs, self.size, self.shorter, self.n
        at, before, i = 0, -1, longest[0]
        while at < n:
            row = before * base
            while i >= 0:
                if not failed[at + size[i]]:
                    known = pairs.get(row + i)
                    if known or known is None and agrees(before, i):
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                at += size[i]
                before, i = i, longest[at] if at < n else -1
            else:
                failed[at] = 1
                i = ids.pop()
                at -= size[i]
                before, i = ids[-1] if ids else -1, shorter[i]
        return ids

    def segment(self, text: str) -> bytes:
        """Packed ids, little-endian 32-bit integers, of a stretch without a cut; an unknown character stands alone and gives its bytes."""
        packed = self.older.get(text)
        if packed is None:
            if len(text) == 1 and text not in self.ids:
                ids = [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]
            else:
                ids = self.walk(text)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST_KEPT:
            if len(self.segments) >= TABLE:
                self.older, self.segments = self.segments, {}
            self.segments[text] = packed
        return packed

    def cut(self, text: str) -> list[str]:
        """The segments of a text: it is cut where two characters stand side by side in no piece."""
        out, start = [], 0
        for base in range(0, len(text), STRETCH):
            rows = self.row[np.frombuffer(text[base : base + STRETCH + 1].encode("utf-32-le", "surrogatepass"), "<u4")]
            cuts = (np.flatnonzero(self.apart.take(rows[:-1] * len(self.apart) + rows[1:])) + base + 1).tolist()
            if cuts:
                out += [text[i:j] for i, j in zip([start, *cuts], cuts, strict=False)]
                start = cuts[-1]
        out.append(text[start:])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, begin and end included."""
        out = [self.segments.get(k) or self.segment(k) for k in self.cut(" " + text.replace(SPACE, " "))] if text else []
        return np.frombuffer(b"".join([self.first, *out, self.last]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte runs read as UTF-8, the mark before the first piece dropped."""
        high = self.high[ids]
        table = self.text
        listed = ids.tolist()
        if not high.any():
            text = "".join(map(table.__getitem__, listed))
        else:
            edges = np.flatnonzero(np.diff(high)) + 1
            text = ""
            parts = []
            start = 0
            for stop in [*edges.tolist(), len(listed)]:
                run = listed[start:stop]
                parts.append(_utf8(bytes(self.byte_of[i] for i in run)) if high[start] else "".join(map(table.__getitem__, run)))
                start = stop
            text = "".join(parts)
        first = next((i for i in listed if i not in (self.begin, self.end)), None)
        return text[1:] if first is not None and table[first].startswith(" ") else text


def _utf8(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that isn't part of a valid character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode("utf-8"))
                    i += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    """One coder a worker process and model; its tables serve all tasks of the worker."""
    return PieceCoder(path)


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path(name))
        for b in batches:
            rows = []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path(name))
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                coded = [c.encode(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in coded], pa.int64()), pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array([c.decode(x) for x in coded], pa.string())],
                    names=["doc_id", "source", "n_tokens", "ids", "decoded"],
                )

    return run


def encode_report(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, source, n_tokens, ids and decoded text of every document."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "source", "text"), _ids(model), "doc_id long, source string, n_tokens long, ids array<int>, decoded string")
