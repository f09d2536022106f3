"""Interval relations and calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("before", "meets", "overlaps", "starts", "during", "finishes", "equals", "after", "met_by", "overlapped_by", "started_by", "contains", "finished_by")


def allen(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """The one of thirteen relations that two half-open intervals stand in."""
    return (
        F.when(a2 < b1, "before").when(a2 == b1, "meets").when(b2 < a1, "after").when(b2 == a1, "met_by")
        .when((a1 == b1) & (a2 == b2), "equals")
        .when(a1 == b1, F.when(a2 < b2, "starts").otherwise("started_by"))
        .when(a2 == b2, F.when(a1 > b1, "finishes").otherwise("finished_by"))
        .when((a1 > b1) & (a2 < b2), "during").when((a1 < b1) & (a2 > b2), "contains")
        .when(a1 < b1, "overlaps").otherwise("overlapped_by")
    )


def _relation(a: tuple[int, int], b: tuple[int, int]) -> str:
    """The relation of two intervals given as numbers."""
    (a1, a2), (b1, b2) = a, b
    if a2 <= b1:
        return "before" if a2 < b1 else "meets"
    if b2 <= a1:
        return "after" if b2 < a1 else "met_by"
    if a1 == b1:
        return "equals" if a2 == b2 else "starts" if a2 < b2 else "started_by"
    if a2 == b2:
        return "finishes" if a1 > b1 else "finished_by"
    if a1 > b1:
        return "during" if a2 < b2 else "overlapped_by"
    return "contains" if a2 > b2 else "overlaps"


def _compositions() -> dict[tuple[str, str], str]:
    """(r1, r2) -> r3 wherever a r1 b and b r2 c leave one relation of a to c.

    Six ends of three intervals take six places at most, so trying all intervals
    on six places shows every case that there is.
    """
    spans = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    seen: dict[tuple[str, str], set[str]] = {}
    for a in spans:
        for b in spans:
            for c in spans:
                seen.setdefault((_relation(a, b), _relation(b, c)), set()).add(_relation(a, c))
    return {k: next(iter(v)) for k, v in seen.items() if len(v) == 1}


COMPOSITIONS = _compositions()


def compose(first: Column, second: Column) -> Column:
    """The relation that two compose to, where there is only one; else null."""
    table = F.create_map(*(F.lit(v) for (x, y), z in sorted(COMPOSITIONS.items()) for v in (f"{x} {y}", z)))
    return F.try_element_at(table, F.concat_ws(" ", first, second))


def inverse(relation: Column) -> Column:
    """The relation read from the other side."""
    pairs = {"before": "after", "meets": "met_by", "overlaps": "overlapped_by", "starts": "started_by", "during": "contains", "finishes": "finished_by"}
    out = relation
    for x, y in pairs.items():
        out = F.when(relation == x, y).when(relation == y, x).otherwise(out)
    return out


def whole_months(a: Column, b: Column) -> Column:
    """Anniversaries passed between two dates; the day is clamped to the month's end, so 31 January to 29 February 2024 is one."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    n = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    return F.when(F.add_months(lo, n) > F.to_date(hi), n - 1).otherwise(n)


def whole_years(a: Column, b: Column) -> Column:
    return F.floor(whole_months(a, b) / 12).cast("int")


def whole_days(a: Column, b: Column) -> Column:
    return F.floor(F.abs(F.unix_timestamp(b) - F.unix_timestamp(a)) / 86400).cast("long")


def _plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form of a counted noun."""
    return F.when((n % 10 == 1) & (n % 100 != 11), one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def human(days: Column, lang: str = "en") -> Column:
    """A number of days in words: years of 365, months of 30 and days, the two greatest that aren't zero."""
    y, rest = F.floor(days / 365), days % 365
    m, d = F.floor(rest / 30), rest % 30
    if lang == "ru":
        names = (_plural(y, "год", "года", "лет"), _plural(m, "месяц", "месяца", "месяцев"), _plural(d, "день", "дня", "дней"))
    else:
        names = tuple(F.when(n == 1, w).otherwise(w + "s") for n, w in ((y, "year"), (m, "month"), (d, "day")))
    parts = F.filter(F.array(*(F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), w)) for n, w in zip((y, m, d), names, strict=True))), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, "0 дней" if lang == "ru" else "0 days").otherwise(F.array_join(F.slice(parts, 1, 2), " "))


def range_distance(day: Column, lo: Column, hi: Column) -> Column:
    """Days from a day to a range; 0 inside."""
    return F.greatest(F.lit(0), F.datediff(lo, day), F.datediff(day, hi))


def proximity(distance: Column, reach: float = 180.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / reach)


def tag_period(tag: Column) -> Column:
    """First day of YYYY, YYYY-MM or Qn-YYYY; null for other tags."""
    quarter = F.regexp_extract(tag, r"^Q([1-4])-(\d{4})$", 1)
    return (
        F.when(tag.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(tag, F.lit("-01"))))
        .when(tag.rlike(r"^\d{4}$"), F.to_date(F.concat(tag, F.lit("-01-01"))))
        .when(quarter != "", F.make_date(F.regexp_extract(tag, r"-(\d{4})$", 1).try_cast("int"), quarter.try_cast("int") * 3 - 2, F.lit(1)))
    )


def event_time(said: Column, observed: Column) -> Column:
    """first, last and precision of a time expression said on a day; nulls and "unknown" for what isn't one."""
    text = F.lower(F.trim(said))
    monday = F.to_date(F.date_trunc("week", observed))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text == "today", observed).when(text == "yesterday", F.date_sub(observed, 1)).when(text == "tomorrow", F.date_add(observed, 1))
    month = F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(text, F.lit("-01"))))
    year = F.when(text.rlike(r"^\d{4}$"), F.to_date(F.concat(text, F.lit("-01-01")))).when(text == "last year", F.make_date(F.year(observed) - 1, F.lit(1), F.lit(1)))
    week = F.when(text == "this week", monday).when(text == "last week", F.date_sub(monday, 7))
    precision = F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year").when(week.isNotNull(), "week").otherwise("unknown")
    last = F.coalesce(day, F.last_day(month), F.make_date(F.year(year), F.lit(12), F.lit(31)), F.date_add(week, 6))
    return F.struct(F.coalesce(day, month, year, week).alias("first"), last.alias("last"), precision.alias("precision"))


def tag_range(tag: Column) -> Column:
    """first and last day of YYYY, YYYY-MM or Qn-YYYY; null for other tags."""
    first = tag_period(tag)
    last = F.when(tag.rlike(r"^\d{4}$"), F.make_date(F.year(first), F.lit(12), F.lit(31))).when(tag.startswith("Q"), F.last_day(F.add_months(first, 2))).otherwise(F.last_day(first))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), last.alias("last")))


def best_range(content: Column, tags: Column) -> Column:
    """first, last and source of the dates of a record: the stamp it opens with, else the span of ISO dates it names, else that of its tags."""
    stamp = F.try_to_date(F.regexp_extract(content, r"^\s*\[(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    named = F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0)), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda x: x.isNotNull())
    ranges = F.filter(F.transform(tags, tag_range), lambda x: x.isNotNull())
    of = lambda a, b, source: F.struct(a.alias("first"), b.alias("last"), F.lit(source).alias("source"))
    return (
        F.when(stamp.isNotNull(), of(stamp, stamp, "entry")).when(F.size(named) > 0, of(F.array_min(named), F.array_max(named), "content"))
        .when(F.size(ranges) > 0, of(F.array_min(F.transform(ranges, lambda r: r["first"])), F.array_max(F.transform(ranges, lambda r: r["last"])), "tag"))
    )


def interval(start: Column, end: Column, closed_start: Column, closed_end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), closed_start.alias("closed_start"), closed_end.alias("closed_end"))


def interval_kind(i: Column) -> Column:
    """interval, instant (no length, both ends closed) or invalid."""
    both = i["closed_start"] & i["closed_end"]
    return F.when((i["end"] < i["start"]) | ((i["end"] == i["start"]) & ~both), "invalid").when(i["end"] == i["start"], "instant").otherwise("interval")


def holds(i: Column, point: Column) -> Column:
    """Whether a point lies in an interval."""
    return ((point > i["start"]) | ((point == i["start"]) & i["closed_start"])) & ((point < i["end"]) | ((point == i["end"]) & i["closed_end"]))


def canonical_time(raw: Column) -> Column:
    """ISO timestamps with a blank or T, with Z, an offset or neither (then UTC), as a timestamp; null for other texts."""
    return F.try_to_timestamp(F.replace(F.trim(raw), F.lit(" "), F.lit("T")))
