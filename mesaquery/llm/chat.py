"""Chat formatting by quotation linking.

Quoted lines (">" marks, any nesting) are parsed level by level. Lines of one
level that run together are a passage; a passage, its lines and its sentences,
white space folded and case aside, are hashed, so a quote that was wrapped anew
or cut short still matches. Messages' own paragraphs are hashed the same way. The
hashes are joined, so a reply finds the message it answers, and conversations
come out in reply order, with roles and without quotes.

Links are equi-joins against one original per (conversation, hash): the first
message that says it. A passage that thousands of messages say or quote thus joins
to one row, and no pair of its repeaters is ever made. What has no original in its
own conversation is tried against the first message of any other conversation;
passages under MIN_WORDS words are looked up in their own conversation only.

A message's parent is, of the messages found, one quoted at level one before one
quoted deeper (which was said before the answered message), one of the own
conversation before others, then that with most matches, the latest of equals.
Reply order: a message that answers another follows it and what answered it
before. A reply to a message of another conversation joins that conversation's
thread if its conv_id is the smaller one; so threads have no cycles.

Edge cases: null or empty texts give an empty text and no links. A message never
answers itself or a later turn of its conversation. Rows that repeat (conv_id,
turn) each come out, linked alike; what such rows quote counts together. Rows
with a null conv_id or turn have no links and stand by themselves. Threads are
resolved by pointer doubling, so a chain of n replies takes log n rounds; a
message carries the path from its root. Very long texts are parsed whole, in time
linear in their length. An empty table gives an empty result; other columns of the
table aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialise

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: "On 3 May, Ann wrote:" before a quote belongs to the quote.
ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\b.{0,40}:\s*$", re.I)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Shorter passages, in words, are too common to point at a message of another conversation.
MIN_WORDS = 3


def key(words: list[str]) -> int:
    x = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def units(passages: list[list[str]]) -> dict[int, bool]:
    """Hash -> too short to be looked up elsewhere, of the passages (lists of lines), their lines and their sentences."""
    out: dict[int, bool] = {}
    for lines in passages:
        whole = " ".join(lines).casefold()
        for text in (whole, *(x.casefold() for x in lines), *SENTENCE.split(whole)):
            if w := text.split():
                out[key(w)] = len(w) < MIN_WORDS
    return out


def parse(text: str | None) -> tuple[str, int, dict[int, bool], dict[int, tuple[int, bool]], int]:
    """(own text, deepest level, units of the own paragraphs, units of the quotes with the least level they are quoted at, quoted passages)."""
    own: list[str] = []
    passages: dict[int, list[list[str]]] = {}
    runs, deepest, last = [[]], 0, 0  # own paragraphs
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level = m[1].count(">") if m else 0
        if m is None:
            own.append(line)
            if line.strip() and last == 0:
                runs[-1].append(line)
            else:
                runs.append([line] if line.strip() else [])
        else:
            deepest = max(deepest, level)
            if own and ATTRIBUTION.match(own[-1]) and last == 0:
                own.pop()
                runs[-1] = runs[-1][:-1]
            rest = line[m.end() :]
            if last != level or not rest.strip():
                passages.setdefault(level, []).append([])
            if rest.strip():
                passages[level][-1].append(rest)
        last = level
    said = "\n".join(own)
    quoted: dict[int, tuple[int, bool]] = {}
    for level in sorted(passages, reverse=True):
        quoted.update((h, (level, short)) for h, short in units(passages[level]).items())
    return said.strip() if deepest else said, deepest, units(runs), quoted, sum(bool(p) for ps in passages.values() for p in ps)


_SAID = pa.list_(pa.int64())
_QUOTED = pa.list_(pa.struct([("h", pa.int64()), ("level", pa.int32()), ("short", pa.bool_())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [parse(t.as_py()) for t in b.column(3)]
        columns = [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([list(r[2]) for r in rows], _SAID),
            pa.array([[{"h": h, "level": x, "short": s} for h, (x, s) in r[3].items()] for r in rows], _QUOTED),
            pa.array([r[4] for r in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *columns], names=["conv_id", "turn", "role", "text", "quote_depth", "own", "quoted", "n_quoted"])


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, quote_depth, n_quoted, n_linked, parent_conv_id, parent_turn, thread_conv_id, root_turn, reply_depth, reply_path, formatted.

    Ordered by (thread_conv_id, reply_path), ``formatted`` reads as the thread.
    """
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")
    m = materialise(map_arrow(m, _parsed, "conv_id long, turn long, role string, text string, quote_depth int, own array<long>, quoted array<struct<h:bigint,level:int,short:boolean>>, n_quoted long"), "chat")
    known = m.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = known.where("size(quoted) > 0").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*").groupBy("conv_id", "turn", "h", "short").agg(F.min("level").alias("level"))
    said = known.select("conv_id", "turn", F.explode("own").alias("h")).join(quotes.select("h").distinct(), "h", "left_semi").groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    here = said.select("h", "conv_id", F.col("turn").alias("_t"))
    inside = quotes.join(here, ["h", "conv_id"], "left").withColumn("_t", F.when(F.col("_t") < F.col("turn"), F.col("_t")))
    # of the first two conversations that say it, one is another than the own
    first = said.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("conv_id"))).where("r <= 2").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turn"))).alias("_f"))
    found = inside.join(first, "h", "left")
    other = F.get(F.filter("_f", lambda f: f["conv_id"] != F.col("conv_id")), F.lit(0))
    target = F.when(F.col("_t").isNotNull(), F.struct("conv_id", F.col("_t").alias("turn"))).when(~F.col("short"), other)
    direct = F.col("level") == 1
    votes = found.withColumn("p", target).where("p IS NOT NULL").groupBy("conv_id", "turn", "p").agg(F.count("*").alias("n"), F.count_if(direct).alias("n1"))
    best = F.max(F.struct((F.col("n1") > 0).alias("direct"), (F.col("p.conv_id") == F.col("conv_id")).alias("same"), "n1", "n", F.col("p.turn").alias("turn"), F.col("p.conv_id").alias("conv")))
    parents = votes.groupBy("conv_id", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked")).select("conv_id", "turn", F.col("b.conv").alias("parent_conv_id"), F.col("b.turn").alias("parent_turn"), "n_linked")
    parents = materialise(parents, "parents")
    paths = _paths(parents.where("parent_conv_id <= conv_id").select("conv_id", "turn", F.struct(F.col("parent_conv_id").alias("conv_id"), F.col("parent_turn").alias("turn")).alias("up")))
    p = parents.join(paths, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_u"), "parent_conv_id", "parent_turn", "n_linked", "path")
    out = m.join(p, (m["conv_id"] == p["_c"]) & (m["turn"] == p["_u"]), "left")
    path = F.coalesce("path", F.array(F.struct("conv_id", "turn")))
    root = F.get(path, F.lit(0))
    return out.select(
        "conv_id", "turn", "role", "text", "quote_depth", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv_id", "parent_turn",
        root["conv_id"].alias("thread_conv_id"), root["turn"].alias("root_turn"), (F.size(path) - 1).cast("long").alias("reply_depth"), path.alias("reply_path"),
        F.concat(F.lit("### "), F.coalesce("role", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n")).alias("formatted"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The rows of ``link`` in reply order, sorted over all partitions: written out, each thread reads from top to bottom."""
    return link(messages).orderBy("thread_conv_id", "reply_path")


def _paths(up: DataFrame) -> DataFrame:
    """(conv_id, turn, path from the root): each round doubles the steps taken, until no step has a parent of its own."""
    up = up.withColumn("path", F.array(F.struct("conv_id", "turn")))
    while True:
        up = materialise(up, "paths")
        nxt = up.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        step = up.join(nxt, (up["up.conv_id"] == nxt["_c"]) & (up["up.turn"] == nxt["_t"]), "left")
        if step.where("_up IS NOT NULL").isEmpty():
            return up.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("path"))
        longer = F.when(F.col("_up").isNull(), F.col("path")).otherwise(F.concat("_path", "path"))
        up = step.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), longer.alias("path"))
