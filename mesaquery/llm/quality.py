"""Quality rules, line first.

Every line is held against a punctuation, a navigation and a boilerplate rule;
failing lines are removed; a document that loses too large a share of its text,
or that fails the document-level base rules, is rejected. All of it is column
expressions over one row: no shuffle, no Python, no exploded rows.

Edge cases: a null text counts as an empty one (zero words, base_failed, not
kept). Rows that repeat are judged one by one. A share equal to its limit passes.
Repeated three-word windows are found by sorting 64-bit hashes of the windows with
their positions, so cost per text is n log n in its words, at any length. An empty
table gives an empty result; columns of the table stay as they are whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPLIT, let, words

#: Symbols that running prose seldom has.
SYMBOLS = "#*$%&|<>"
#: A line fails the punctuation rule if symbols take more than this share of its characters ...
MAX_SYMBOL_SHARE = 0.10
#: ... or if more than this share of its words end in two or more exclamation or question marks.
MAX_SHOUT_SHARE = 0.30
#: A line with this many separators between short entries is a menu.
NAV_SEPARATORS = 3
NAV = r"[|\x{2022}\x{00BB}\x{203A}\x{00B7}]"
#: Phrases of site furniture, at the head of a short line.
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie (policy|settings|consent)|we use cookies|accept (all )?cookies|privacy policy|terms of (use|service)"
    r"|enable javascript|skip to (main )?content|sign up for our newsletter|subscribe to our newsletter|click here to|share (this|on) |lorem ipsum|copyright \(c\)|^(licensed|released) under )"
)
#: Boilerplate is looked for in lines of at most this many characters; longer lines are prose that mentions it.
BOILERPLATE_LINE = 200
#: The largest share of a document's non-blank characters that the lines removed may take.
MAX_LOSS = 0.40
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bare_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPLIT, ""))


def n_symbols(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{SYMBOLS}]"))


def line_fails(line: Column, chars: Column, symbols: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rule removes; a blank line never fails."""
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}([\x20\x09-\x0D]|$)"))
    # the cheap test stands first: most lines never come to the costly one
    punctuation = (symbols > MAX_SYMBOL_SHARE * chars) | ((shouts > 0) & (shouts > MAX_SHOUT_SHARE * F.size(F.split(line, SPLIT))))
    navigation = F.regexp_count(line, F.lit(NAV)) >= NAV_SEPARATORS
    boilerplate = (F.length(line) <= BOILERPLATE_LINE) & line.rlike(BOILERPLATE)
    return (chars > 0) & (punctuation | navigation | boilerplate)


def repeat_words(w: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more in the array ``w``.

    Windows are sorted as primitive longs: hash above, position below. Equal
    windows are then neighbours; that they are equal is confirmed on the words.
    """

    def covered(starts: Column) -> Column:  # sorted starts of repeated windows; each covers three words, overlaps count once
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    def with_bits(bits: Column) -> Column:
        high = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)

        def window(x: Column, i: Column) -> Column:
            return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))

        def at(key: Column) -> Column:
            return key.bitwiseAND(F.bitwise_not(high)).cast("int")

        def same(a: Column, b: Column) -> Column:
            words_equal = F.lit(True)
            for k in range(3):
                words_equal = words_equal & (F.get(w, at(a) + k) == F.get(w, at(b) + k))
            return F.when(a.bitwiseXOR(b).bitwiseAND(high) == 0, words_equal).otherwise(F.lit(False))

        def repeated(s: Column) -> Column:
            # the second neighbour as well: a window of equal hash and other words may stand between two equal ones
            hits = F.filter(s, lambda e, k: same(e, F.get(s, k + 1)) | same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 2)) | same(e, F.get(s, k - 2)))
            return covered(F.sort_array(F.transform(hits, lambda e: e.bitwiseAND(F.bitwise_not(high)))))

        return let(F.sort_array(F.slice(F.transform(w, window), F.lit(1), F.size(w) - 2)), repeated)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(F.size(w))).cast("int"), with_bits))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs a row: ``d`` with the columns of ``docs``, ``q`` with the base counts, characters lost to line rules and the cleaned text.

    Each intermediate array is let-bound, so that it is computed once a row, and
    the document's characters and symbols are sums over its lines.
    """
    counts = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    line = lambda x: let(F.struct(_bare_length(x).alias("c"), n_symbols(x).alias("s")), lambda m: F.struct(x.alias("x"), m["c"].alias("c"), m["s"].alias("s"), line_fails(x, m["c"], m["s"]).alias("fails")))
    total = lambda ls, f: F.aggregate(ls, F.lit(0).cast("long"), lambda a, e: a + f(e))
    by_line = let(
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line),
        lambda ls: F.struct(
            total(ls, lambda e: e["c"]).alias("word_chars"),
            total(ls, lambda e: e["s"]).alias("n_symbols"),
            let(F.transform(F.filter(ls, lambda e: e["c"] > 0), lambda e: e["x"]), lambda f: (F.size(f) - F.size(F.array_distinct(f))).cast("long")).alias("n_dup_lines"),
            total(ls, lambda e: F.when(e["fails"], e["c"]).otherwise(F.lit(0))).alias("lost_chars"),
            F.when(F.exists(ls, lambda e: e["fails"]), F.array_join(F.transform(F.filter(ls, lambda e: ~e["fails"]), lambda e: e["x"]), "\n")).otherwise(F.coalesce(F.col(text), F.lit(""))).alias("clean"),
        ),
    )
    both = F.struct(counts.alias("c"), by_line.alias("l"))
    names = {"n_words": "c", "n_repeat_words": "c", "word_chars": "l", "n_symbols": "l", "n_dup_lines": "l", "lost_chars": "l", "clean": "l"}
    # explode() of one element, not an alias: a later filter on the verdict would otherwise compute all this once more
    q = F.explode(F.transform(F.array(both), lambda q: F.struct(*(q[part][name].alias(name) for name, part in names.items()))))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), q.alias("q"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Two structs a row: ``d`` with the columns of ``docs``, ``q`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, clean, base_failed and kept."""
    failed = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))
    kept = ~failed & (F.col("q.lost_chars") <= MAX_LOSS * F.col("q.word_chars"))
    return measure(docs, text).select("d", F.struct("q.*", failed.alias("base_failed"), kept.alias("kept")).alias("q"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, base counts, verdicts and the characters that the line rules removed."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judge(docs.select("doc_id", "text")).select("d.doc_id", *(f"q.{c}" for c in counts))


def apply_quality_rules(docs: DataFrame) -> DataFrame:
    """Documents kept, with failing lines gone from their text; same columns as ``docs``."""
    new = {"text": F.col("q.clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("q.clean").cast(docs.schema["n_chars"].dataType)
    return judge(docs).where("q.kept").select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM d),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
win AS (SELECT rid, p, [w[p], w[p + 1], w[p + 2]] AS g FROM tri),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY 1),
ln AS (
  SELECT rid, x, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c
  FROM (SELECT rid, unnest(ls) AS x FROM w)),
lost AS (
  SELECT rid, sum(c) FILTER (WHERE
      length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > {MAX_SYMBOL_SHARE}::DOUBLE * c
      OR len(regexp_extract_all(x, '[!?]{{2,}}([\x20\x09-\x0D]|$)')) > {MAX_SHOUT_SHARE}::DOUBLE * len(regexp_split_to_array(x, '[\x20\x09-\x0D]+'))
      OR len(regexp_extract_all(x, '{NAV}')) >= {NAV_SEPARATORS}
      OR (length(x) <= {BOILERPLATE_LINE} AND regexp_matches(x, '{BOILERPLATE}'))) AS n,
    count(*) - count(DISTINCT x) AS dup
  FROM ln WHERE c > 0 GROUP BY 1),
o AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lost.dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN cov ON cov.rid = w.rid LEFT JOIN lost ON lost.rid = w.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost_chars <= {MAX_LOSS}::DOUBLE * word_chars AS kept,
  lost_chars
FROM o
"""
