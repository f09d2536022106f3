"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; ``\\w`` alone is ASCII in Spark.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens; null and empty texts give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _base(c: str) -> str:
    """The letter that an accented one is made of, or the character itself."""
    d = unicodedata.normalize("NFD", c)
    return d[0] if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) else c


#: Latin, Greek and Cyrillic letters with marks, and what they are without, by the Unicode decomposition.
_MARKED = "".join(chr(i) for i in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)] if _base(chr(i)) != chr(i))
_PLAIN = "".join(map(_base, _MARKED))


def fold_accents(text: Column) -> Column:
    """Letters without their marks; marks that stand by themselves go."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"[\u0300-\u036f]", "")


def _compatible(c: str) -> str:
    """The character that a wide, circled, raised or otherwise dressed one stands for, or itself."""
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 else c


#: Characters that compatibility folding changes to one other, by the Unicode tables; those that become several stay.
_DRESSED = "".join(chr(i) for i in [*range(0xA0, 0x100), *range(0x2000, 0x2500), *range(0x3000, 0x3400), *range(0xFB00, 0xFB50), *range(0xFF00, 0xFFF0)] if _compatible(chr(i)) != chr(i))
_UNDRESSED = "".join(map(_compatible, _DRESSED))


def statement(text: Column) -> Column:
    """A text with compatible characters folded and \u0451 as \u0435, for comparing statements word by word."""
    return F.replace(F.lower(F.translate(text, _DRESSED, _UNDRESSED)), F.lit("\u0451"), F.lit("\u0435"))


def normalised(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def clip(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis if something is cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def latin_share(text: Column) -> Column:
    """Latin letters over all letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", "")) / letters)


def redact(text: Column) -> Column:
    """Mail addresses, long digit groups and key-like assignments replaced by placeholders."""
    t = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    t = F.regexp_replace(t, r"(?i)\b(api[_-]?key|secret|token|password)\s*[:=]\s*[^\s,;]+", "[SECRET]")
    return F.regexp_replace(t, r"\b[0-9]{9,}\b", "[NUMBER]")


PRIVATE = r"(?s)<private>.*?</private>"


def strip_private(text: Column, placeholder: str = "") -> Column:
    """Without sections between <private> and </private>."""
    return F.regexp_replace(text, PRIVATE, placeholder)


def count_private(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PRIVATE))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def keep_lines(text: Column, pattern: str, head: int | None = None) -> Column:
    """Lines that match, the first ``head`` of them if given."""
    kept = F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern))
    return F.array_join(F.slice(kept, 1, head) if head else kept, "\n")


def drop_lines(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def identifiers(text: Column) -> Column:
    """snake_case, kebab-case and inner-capital names, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:[a-z0-9]+(?:[_-][a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(0)))


def tag_list(raw: Column) -> Column:
    """A JSON array of strings, or comma separated text; trimmed, lower case."""
    split = F.coalesce(F.from_json(raw, "array<string>"), F.split(raw, ","))
    return F.filter(F.transform(split, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def number_tokens(text: Column) -> Column:
    """Sorted distinct tokens with a digit: the values a statement gives."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda x: x.rlike("[0-9]"))))


def strip_html(html: Column) -> Column:
    """Text nodes of a page: scripts, styles and tags go, white space folds."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))


def content_kind(text: Column) -> Column:
    """json, log, test, markdown, code or text, by how the text looks."""
    return (
        F.when(text.rlike(r"^\s*[\[{]") & text.rlike(r"[\]}]\s*$"), "json")
        .when(text.rlike(r"(?m)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "log")
        .when(text.rlike(r"(?i)\b\d+ (passed|failed)\b"), "test")
        .when(text.rlike(r"(?m)^#{1,6} "), "markdown")
        .when(text.rlike(r"(?m)^\s*(def|class|import|function|#include)\b"), "code")
        .otherwise("text")
    )


#: Prepositions that open a modifier after a value ("at 9:30 on Mondays"): fixed values.
MODIFIERS = tuple("on in at for from since until till every each during after before per with without via within near starting".split())


def statement_tokens(text: Column) -> Column:
    """Words of a statement, compounds such as 9:30 or a/b whole, case folded."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+(?:[./:-][\p{L}\p{N}_]+)*"), F.lit(0))


def updates_value(new: Column, old: Column) -> Column:
    """Whether one statement (as tokens) gives another value for what the other states.

    They open with the same two words at least, differ in one run of up to eight
    words without a common one, and end alike in a word at most, or in up to six
    that a preposition opens; what they share is half of the longer one at least.
    """
    n, m = F.size(new), F.size(old)
    least = F.least(n, m)
    # the first place where they differ, from the front and from the back
    def run(a: Column, b: Column, most: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), most))
        return F.when(most < 1, 0).otherwise(F.coalesce(F.get(F.filter(places, lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1))), F.lit(0)) - 1, most))

    prefix = run(new, old, least)
    suffix = run(F.reverse(new), F.reverse(old), least - prefix)
    value = lambda t, k: F.slice(t, prefix + 1, F.greatest(F.lit(0), k - suffix - prefix))
    a, b = value(new, n), value(old, m)
    tail = (suffix <= 1) | ((suffix <= 6) & F.get(new, n - suffix).isin(*MODIFIERS))
    short = F.size(a).between(1, 8) & F.size(b).between(1, 8)
    return (prefix >= 2) & tail & short & ~F.arrays_overlap(a, b) & (2 * (prefix + suffix) >= F.greatest(n, m))


def name_variants(words: Column, most: int = 64) -> Column:
    """Words and pairs of neighbours as written, small and in capitals, without repeats."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1)), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    names = F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(names, F.transform(names, F.lower), F.transform(names, F.upper))), 1, most)


#: Words that show what a question asks for: fixed values.
CUES = {
    "ordering": r"\b(first|before|after|earlier|later|order of|sequence)\b",
    "historical": r"\b(used to|previously|formerly|originally|old value|was before)\b",
    "debug": r"\b(error|exception|fails?|crash|bug|traceback)\b",
    "relational": r"\b(related|depends|between|connected|linked)\b",
    "advice": r"\b(should|recommend|best way|advice|how do i)\b",
}


def has_cue(question: Column, kind: str) -> Column:
    return F.lower(question).rlike(CUES[kind])


def search_route(question: Column) -> Column:
    """relational, hybrid or semantic: signs of a relation are a question word, a joining word and two names."""
    low = F.lower(question)
    signs = (low.rlike(r"^\s*(who|what|which|where|when|how|why)\b"), low.rlike(r"\b(between|and|with|related|linked|connected)\b"), F.regexp_count(question, F.lit(r"\b[A-Z][a-z]+")) >= 2)
    n = sum((s.cast("int") for s in signs), F.lit(0))
    return F.when(n >= 2, "relational").when(n == 1, "hybrid").otherwise("semantic")


def question_parts(question: Column) -> Column:
    """A compound question split at its joints; a plain one is one part."""
    joints = r"\?\s+|;\s+|,?\s+and (?=(?:who|what|when|where|which|how|why)\b)|,?\s+as well as\s+"
    return F.filter(F.transform(F.split(question, joints), lambda x: F.btrim(x, F.lit(" ?."))), lambda x: x != "")


def glob(text: Column, pattern: str) -> Column:
    """A shell pattern over the whole text: * any run, ? one character, [a-z] and [^a-z] sets; case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" if inner[0] in "^!" else "") + re.sub(r"([\\\[&])", r"\\\1", inner.lstrip("^!")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return text.rlike(rf"(?s)\A{out}\z")


def verbosity(question: Column) -> Column:
    """compact, summary or full: paths, addresses, line numbers, code and many clauses ask for everything, few words for little."""
    q = F.trim(question)
    n = F.size(F.split(q, r"\s+"))
    whole = q.rlike(r"(^|\s)[/~]\S*") | q.rlike(r"https?://\S+") | q.rlike(r"\bline\s+\d+|\b:\d{2,}\b") | q.rlike(r"\w\(\)|::") | q.rlike(r"(?i)\band\b.+\band\b")
    return F.when(F.coalesce(q, F.lit("")) == "", "compact").when(whole | (n >= 10), "full").when(n <= 3, "compact").otherwise("summary")
