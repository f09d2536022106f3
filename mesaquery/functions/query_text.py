"""What is read from a query's own text, on the driver: a query is one short string."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

STOP = frozenset("a an and are as at be but by did do does for from had has have how in is it of on or that the this to was were what when where which who why will with".split())
_TERM = re.compile(r"\w+(?:[./:-]\w+)*")


def terms(query: str, most: int = 32) -> list[str]:
    """Lexical terms: case folded, stop words gone, in order, without repeats."""
    found = (t for t in _TERM.findall(query.casefold()) if t not in STOP)
    return list(dict.fromkeys(found))[:most]


_PART = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"|([^\s()"]+))')


def boolean_filter(query: str, text: Column) -> Column:
    """A search expression as a predicate: OR binds least, then AND, NOT, then juxtaposition as AND.

    "quoted words" must follow each other; word* is a prefix. An expression that
    doesn't parse is read as all its words joined by AND.
    """
    parts = [(m[1] or m[2] or "", m[3], m[4]) for m in _PART.finditer(query) if m[0].strip()]
    toks = tokens(text)
    at = 0

    def word(w: str) -> Column:
        w = w.lower()
        return F.exists(toks, lambda x: F.startswith(x, F.lit(w[:-1]))) if w.endswith("*") else F.array_contains(toks, w)

    def phrase(p: str) -> Column:
        return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(" " + " ".join(re.findall(r"\w+", p.lower())) + " "))

    def peek() -> str | None:
        if at >= len(parts):
            return None
        sign, quoted, w = parts[at]
        return sign or ("" if quoted is not None else w)

    def unit() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError("an operand is missing")
        sign, quoted, w = parts[at]
        at += 1
        if sign == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("a bracket stays open")
            at += 1
            return inner
        if sign or w in ("AND", "OR", "NOT"):
            raise ValueError("an operand is missing")
        return phrase(quoted) if quoted is not None else word(w)

    def near() -> Column:
        out = unit()
        while peek() is not None and peek() not in (")", "AND", "OR", "NOT"):
            out = out & unit()
        return out

    def chain(sign: str, below, join) -> Column:
        nonlocal at
        out = below()
        while peek() == sign:
            at += 1
            out = join(out, below())
        return out

    negative = lambda: chain("NOT", near, lambda a, b: a & ~b)
    both = lambda: chain("AND", negative, lambda a, b: a & b)
    either = lambda: chain("OR", both, lambda a, b: a | b)
    try:
        out = either()
        if at < len(parts):
            raise ValueError("something follows the expression")
        return out
    except ValueError:
        out = F.lit(True)
        for w in re.findall(r"\w+", query):
            out = out & word(w)
        return out


#: Days of a unit, and how far off "N units ago" may be; days that "recently" covers: fixed values.
_UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
_SLACK = {"day": 1, "week": 3, "month": 7, "year": 30}
RECENT = 60
_NUMBERS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"a": 1, "an": 1, "couple": 2, "few": 3, "several": 3}
_NUMBER = r"(?:\d{1,3}|" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_MONTHS = "january february march april may june july august september october november december".split()
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 2)}


def _month(year: int, month: int) -> tuple[date, date]:
    following = date(year + month // 12, month % 12 + 1, 1)
    return date(year, month, 1), following - timedelta(days=1)


def _named_month(name: str) -> int | None:
    """The number of a month by its name or first letters (three at least)."""
    return next((i for i, m in enumerate(_MONTHS, 1) if len(name) >= 3 and m.startswith(name)), None)


def _count(word: str | None) -> int:
    return 1 if not word else int(word) if word.isdigit() else _NUMBERS[word]


def date_ranges(query: str, today: date) -> list[tuple[date, date]]:
    """Date ranges that a query names, both ends included; relative ones are counted back from ``today``.

    "N units ago" is that day, give or take the unit's slack, or from there to
    today after "since"; "last month" and "past two weeks" are the days up to
    today, "this week" begins at its first day.
    """
    q, out = query.lower(), []

    def add(lo, hi=None) -> None:
        try:
            a = lo() if callable(lo) else lo
            out.append((a, (hi() if callable(hi) else hi) or a))
        except ValueError:
            pass  # no such day

    back = lambda n, unit: today - timedelta(days=n * _UNITS[unit])
    for since, n, unit in re.findall(rf"\b(?:(since)\b[^.?!]{{0,40}}?)?\b({_NUMBER})(?: of)? (day|week|month|year)s? ago\b", q):
        mid, slack = back(_count(n), unit), timedelta(days=_SLACK[unit])
        add(mid - slack, today if since else mid + slack)
    for which, n, unit in re.findall(rf"\b(last|past|previous|this) (?:({_NUMBER})(?: of)? )?(day|week|month|year)s?\b", q):
        if which == "this":
            add({"day": today, "week": today - timedelta(days=today.weekday()), "month": today.replace(day=1), "year": today.replace(month=1, day=1)}[unit], today)
        else:
            add(back(_count(n), unit), today)
    for word, days in (("yesterday", (1, 1)), ("today", (0, 0)), ("the other day", (7, 0)), ("recently", (RECENT, 0)), ("lately", (RECENT, 0))):
        if re.search(rf"\b{word}\b", q):
            add(today - timedelta(days=days[0]), today - timedelta(days=days[1]))
    for name in re.findall(rf"\blast ({'|'.join(_DAYS)})\b", q):
        add(today - timedelta(days=(today.weekday() - _DAYS.index(name) - 1) % 7 + 1))
    for y, m, d in re.findall(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", q):
        add(lambda y=y, m=m, d=d: date(int(y), int(m), int(d)))
    named: list[str] = []
    for d, name, y in re.findall(r"\b(\d{1,2})(?:st|nd|rd|th)? (?:of )?([a-z]{3,9}),? (\d{4})\b", q):
        if (m := _named_month(name)) and not named.append(f"{name}{y}"):
            add(lambda y=y, m=m, d=d: date(int(y), m, int(d)))
    for name, d, y in re.findall(r"\b([a-z]{3,9}) (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})\b", q):
        if (m := _named_month(name)) and not named.append(f"{name}{y}"):
            add(lambda y=y, m=m, d=d: date(int(y), m, int(d)))
    for name, y in re.findall(r"\b([a-z]{3,9}),? (\d{4})\b", q):
        if (m := _named_month(name)) and f"{name}{y}" not in named:
            add(*_month(int(y), m))
    for name, y in re.findall(rf"\b({'|'.join(_SEASONS)}),? (\d{{4}})\b", q):
        a, b = _SEASONS[name]
        add(date(int(y), a, 1), date(int(y) + (b < a), b, 28))
    if not out:
        for y in re.findall(r"(?<![\d-])((?:19|20)\d{2})(?![\d-])", q):
            add(date(int(y), 1, 1), date(int(y), 12, 31))
    return out


def relative_day(phrase: str, said: date) -> str | None:
    """What a relative phrase denotes, said on a day: a day, a week relative to it, a month or a year; None for other phrases."""
    p = " ".join(phrase.lower().split())
    name = lambda d: f"{d:%a} {d.day} {d:%B %Y}"
    days = {"today": 0, "tonight": 0, "yesterday": -1, "last night": -1, "tomorrow": 1, "the day before yesterday": -2}
    if p in days:
        return name(said + timedelta(days=days[p]))
    if m := re.fullmatch(r"(last|next) (week|month|year)", p):
        step = 1 if m[1] == "next" else -1
        if m[2] == "week":
            return f"the week {'after' if step > 0 else 'before'} {name(said)}"
        n = said.year * 12 + said.month - 1 + step
        return f"{date(n // 12, n % 12 + 1, 1):%B %Y}" if m[2] == "month" else str(said.year + step)
    if m := re.fullmatch(rf"(last|next) ({'|'.join(_DAYS)})", p):
        there = _DAYS.index(m[2])
        if m[1] == "last":
            return name(said - timedelta(days=(said.weekday() - there - 1) % 7 + 1))
        return name(said + timedelta(days=(there - said.weekday() - 1) % 7 + 1))
    if m := re.fullmatch(rf"({_NUMBER}) (day|week|month|year)s? ago", p):
        n = _count(m[1])
        if m[2] == "day":
            return name(said - timedelta(days=n))
        if m[2] == "week":
            return f"the week before {name(said)}" if n == 1 else f"about {n} weeks before {name(said)}"
        k = said.year * 12 + said.month - 1 - n
        return f"around {date(k // 12, k % 12 + 1, 1):%B %Y}" if m[2] == "month" else f"around {said.year - n}"
    return None


def intent(query: str) -> str:
    """ordering, historical, debug, relational, factual or search, by the query's shape."""
    q = query.lower()
    if re.search(r"\b(first|before|after|earlier|later|order of|sequence)\b", q):
        return "ordering"
    if re.search(r"\b(used to|previously|formerly|originally|old value|was before)\b", q):
        return "historical"
    if re.search(r"\b(error|exception|fails?|crash|bug|traceback)\b", q):
        return "debug"
    if re.search(r"\b(related|depends|between|connected|linked)\b", q):
        return "relational"
    return "factual" if re.match(r"\s*(who|what|when|where|which)\b", q) else "search"


#: Endings that a search by stems leaves off, the longest first (English and Russian): fixed values.
_ENDINGS = sorted("ing ings ed es s ies er ers ation ations ly ами ями ого его ому ему ыми ими ая яя ое ее ые ие ый ий ой ов ев ам ям ах ях ом ем а я о е ы и у ю ь".split(), key=lambda e: (-len(e), e))


def stem(word: str, least: int = 3) -> str:
    """A word without its ending, if ``least`` letters stay: a prefix to look for, not a dictionary form."""
    w = word.casefold()
    return next((w[: -len(e)] for e in _ENDINGS if w.endswith(e) and len(w) - len(e) >= least), w)


def stems(query: str) -> list[str]:
    return list(dict.fromkeys(stem(t) for t in terms(query)))


def expand(query: str, other: dict[str, tuple[str, ...]]) -> list[str]:
    """A question and its variants with one word replaced by another of the same meaning."""
    words = query.split()
    return [query] + [" ".join([*words[:i], o, *words[i + 1 :]]) for i, w in enumerate(words) for o in other.get(w.lower(), ())]


def parts(query: str) -> list[str]:
    """A compound question split at its joints; a query without any is one part."""
    found = [p.strip(" ?.") for p in re.split(r"\?\s+|;\s+|,?\s+and (?=(?:who|what|when|where|which|how|why)\b)|,?\s+as well as\s+", query)]
    return [p for p in found if p] or [query.strip()]


def budget_split(total: int, weights: dict[str, int] | None = None) -> dict[str, int]:
    """A token budget over the sections of a context bundle; what rounding leaves goes to the first."""
    w = weights or {"records": 40, "graph": 20, "episodes": 15, "rules": 15, "errors": 10}
    out = {k: total * v // sum(w.values()) for k, v in w.items()}
    out[next(iter(w))] += total - sum(out.values())
    return out
