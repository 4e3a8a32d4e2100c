"""Dates and times as they stand in expected and extracted events, made comparable.

Null, empty and other texts without a date or time give null.  A text that only a browser's own date
parser could read is not a date here.  Functions of dates take a column of what :func:`normalize_judge_text`
gives, in a projection of its own (it has a UDF, which may not stand below a lambda); those of times take any text.

Each pattern is looked for once: a match becomes an array of its groups, which :func:`let` holds while they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from datebook.functions import patterns as P
from datebook.functions.patterns import B, S, W
from datebook.functions.text import let, trim

_DASHES = r"[‐-―]"
_NAME, _DAY, _TIME, _ZONE = f"({P.MONTH_NAME})", f"({P.DAY_NUMBER})(?:st|nd|rd|th)?", f"({P.CLOCK})", P.ZONE_WORD
#: Between the groups of a match.
_MARK = "\x01"


def _spaced(x: Column) -> Column:
    """One kind of dash and of space, none at the ends."""
    return trim(F.regexp_replace(F.regexp_replace(x, _DASHES, "-"), f"{S}+", " "))


def _matched(x: Column, pattern: str, groups: int, body: Callable[..., Column], other: Column | None = None) -> Column:
    """``body`` of the groups of the first match, whatever their case; ``other`` without a match."""
    whole = F.regexp_replace(x, rf"(?is)^.*?{pattern}.*\z", "".join(f"{_MARK}${k}" for k in range(1, groups + 1)))
    held = let(whole, lambda w: F.when(w != x, F.split(w, _MARK, -1)))
    return let(held, lambda g: F.when(g.isNotNull(), body(*(F.get(g, k) for k in range(1, groups + 1)))).otherwise(other))


def _month(name: Column) -> Column:
    """The month's two digits, by the first three letters of its name."""
    numbers = F.create_map(*[F.lit(v) for k, name in enumerate(P.MONTH_NAMES, 1) for v in (name[:3], f"{k:02}")])
    return F.try_element_at(numbers, F.substring(F.lower(name), 1, 3))


def _two(day: Column) -> Column:
    return F.lpad(day, 2, "0")


def _real(year: Column, month: Column, day: Column) -> Column:
    """The date as ``yyyy-MM-dd`` if the calendar has it."""
    return let(F.concat(year, F.lit("-"), month, F.lit("-"), day), lambda key: F.when(F.try_to_date(key, "yyyy-MM-dd").isNotNull(), key))


def _day_of(month: Column, day: Column) -> Column:
    return F.when(day.cast("int").between(1, 31), F.concat(month, F.lit("-"), day))


def has_explicit_year(x: Column) -> Column:
    """Whether four digits stand alone."""
    return F.coalesce(x.rlike(f"{B}[0-9]{{4}}{B}"), F.lit(False))


def month_day(t: Column) -> Column:
    """``MM-dd`` of the first month name beside a day from 1 to 31, with or without a year."""
    day_first = _matched(t, rf"{W}{_DAY}{S}+{_NAME}\.?{B}", 2, lambda d, m: _day_of(_month(m), _two(d)))
    return _matched(t, rf"{W}{_NAME}\.?{S}+{_DAY}{B}", 2, lambda m, d: _day_of(_month(m), _two(d)), day_first)


def date_key(t: Column) -> Column:
    """``yyyy-MM-dd`` of the first ISO date, else of a date with a month's name, else of a numeric one.

    A numeric date is month first unless that can't be.  An ISO date that the calendar hasn't is none at all.
    """
    def numbers(one: Column, two: Column, year: Column) -> Column:
        swapped = (one.cast("int") > 12) & (two.cast("int") <= 12)
        return F.when(swapped, _real(year, _two(two), _two(one))).otherwise(_real(year, _two(one), _two(two)))

    day_first = _matched(t, rf"{W}{_DAY}{S}+{_NAME}\.?{S}+([0-9]{{4}}){B}", 3, lambda d, m, y: _real(y, _month(m), _two(d)))
    named = _matched(t, rf"{W}{_NAME}\.?{S}+{_DAY},?{S}+([0-9]{{4}}){B}", 3, lambda m, d, y: _real(y, _month(m), _two(d)), day_first)
    numeric = _matched(t, f"{W}([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]([0-9]{{4}}){B}", 3, numbers)
    return _matched(t, f"{W}([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){B}", 3, _real, F.coalesce(named, numeric))


def _minutes(x: Column) -> Column:
    """Minutes since midnight of a clock time, null where hour or minute can't be."""

    def clock(hour: Column, minute: Column, half: Column) -> Column:
        h, m = hour.cast("int"), F.when(minute == "", 0).otherwise(minute.cast("int"))
        of_day = F.when(half == "", F.when(h <= 23, h)).when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
        return F.when(m <= 59, of_day * 60 + m)

    return _matched(trim(x), rf"(?<![\s\S])([0-9]{{1,2}})(?:[:.]([0-9]{{2}}))?{S}*([ap])?\.?m?\.?(?![\s\S])", 3, clock)


def single_time(x: Column) -> Column:
    """Minutes since midnight of a text that is one time, with or without a zone."""
    return _matched(trim(x), rf"(?<![\s\S]){_TIME}{_ZONE}(?![\s\S])", 1, _minutes)


def time_range(x: Column) -> Column:
    """Struct of ``start`` and ``end`` in minutes since midnight, null without both.

    A start without AM or PM takes the end's, if a space or the like parts that from the hour.
    """
    half = lambda t: F.regexp_extract(t, rf"(?i){W}([ap])\.?m\.?{B}", 1)

    def both(first: Column, last: Column) -> Column:
        start = _minutes(F.when((half(last) != "") & (half(first) == ""), F.concat_ws(" ", first, half(last))).otherwise(first))
        return _pair(start, _minutes(last))

    return _matched(_spaced(x), rf"{W}{_TIME}{_ZONE}{S}*(?:-|to|until){S}*{_TIME}{_ZONE}{B}", 2, both)


def looks_like_time_range(x: Column) -> Column:
    """Whether two times stand beside a dash, "to" or "until"; the first may be without minutes."""
    return F.coalesce(_spaced(x).rlike(rf"(?i){W}[0-9]{{1,2}}(?::[0-9]{{2}})?{S}*(?:[ap]\.?m\.?)?(?:{S}*[a-z]{{2,5}})?{S}*(?:-|to|until){S}*[0-9]{{1,2}}"), F.lit(False))


def _pair(start: Column, end: Column) -> Column:
    """Struct of both, null unless both are there."""
    return let(F.struct(start.alias("start"), end.alias("end")), lambda r: F.when(r["start"].isNotNull() & r["end"].isNotNull(), r))


def _span(year: Column, *ends: tuple[Column, Column]) -> Column:
    """From a month and a day for each end: with a year dates that the calendar has, else months and days."""
    dated, plain = ([f(m, d) for m, d in ends] for f in (lambda m, d: _real(year, _month(m), _two(d)), lambda m, d: _day_of(_month(m), _two(d))))
    return F.when(year != "", _pair(*dated)).otherwise(_pair(*plain))


def date_range(t: Column) -> Column:
    """Struct of ``start`` and ``end``, each ``yyyy-MM-dd``, or ``MM-dd`` where no year is told; null without both.

    Short forms first (``Jun 5-7``, ``Jun 5 - Jul 7``, ``Fri 5 - Sun 7 June``), then any two dates with a
    dash, "to" or "until" between spaces.  An end without a year takes the other's, if the calendar has that date.
    """
    tail = rf"(?:,?{S}+([0-9]{{4}}))?{B}"
    weekday = rf"(?:[a-z]{{2,9}}{S}+)?"
    short = F.coalesce(
        _matched(t, rf"{W}{_NAME}\.?{S}+{_DAY}{S}*-{S}*{_DAY}{tail}", 4, lambda m, a, b, y: _span(y, (m, a), (m, b))),
        _matched(t, rf"{W}{_NAME}\.?{S}+{_DAY}{S}*-{S}*{_NAME}\.?{S}+{_DAY}{tail}", 5, lambda m, a, n, b, y: _span(y, (m, a), (n, b))),
        _matched(t, rf"{W}{weekday}{_DAY}{S}*-{S}*{weekday}{_DAY}{S}+{_NAME}\.?{tail}", 4, lambda a, b, m, y: _span(y, (m, a), (m, b))),
    )

    def told(p: Column) -> Column:
        part = lambda x: let(x, lambda v: F.coalesce(date_key(v), month_day(v)))
        return F.when(F.size(p) > 1, let(_pair(part(F.get(p, 0)), part(F.array_join(F.slice(p, 2, 1 << 30), " "))), lambda r: F.when(r.isNotNull(), _pair(dated(r["start"], r["end"]), dated(r["end"], r["start"])))))

    def dated(own: Column, other: Column) -> Column:
        lacks = (F.length(own) == 5) & (F.length(other) == 10)
        return F.when(lacks, F.coalesce(_real(F.substring(other, 1, 4), F.substring(own, 1, 2), F.substring(own, 4, 2)), own)).otherwise(own)

    parts = F.filter(F.transform(F.split(t, rf"{S}+(?:-|to|until){S}+", -1), trim), lambda p: p != "")
    return F.coalesce(short, let(parts, told))


def looks_like_date_range(t: Column) -> Column:
    """Whether a text, its ISO dates aside, has two ends: "to", "until", a dash between spaces, or one between days."""
    months = rf"{W}{_NAME}\.?{S}+{_DAY}{S}*-{S}*(?:{_NAME}|[0-9]{{1,2}})"
    days = rf"{W}{_DAY}{S}*-{S}*(?:[a-z]{{2,9}}{S}+)?{_DAY}{S}+{_NAME}{B}"
    return F.regexp_replace(t, f"{W}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{B}", "").rlike(rf"{W}(?:to|until){B}|{S}+-{S}+|{months}|{days}")
