"""How much a text speaks of events: matches, scores and kinds of blocks, as column expressions.

Each function takes the text of a block, or a whole text, and none needs Python.  ``F.regexp_count``
counts matches the way repeated matching does; empty matches cannot occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datebook.functions import patterns as P
from datebook.functions.text import line_fingerprint, normalize_model_text, strip_markdown_links, trim

S = P.S


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def points(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def has_date(x: Column) -> Column:
    return x.rlike(P.DATE)


def has_time(x: Column) -> Column:
    return x.rlike(P.TIME)


def has_place_detail(x: Column) -> Column:
    return x.rlike(P.PLACE_DETAILS)


def links(x: Column) -> Column:
    return matches(x, r"\]\(")


def score_block(x: Column) -> Column:
    """Ten for each date and time, five for event and place words, less for chrome and lists of links."""
    return (
        matches(x, P.DATE) * 10
        + matches(x, P.TIME) * 10
        + points(x.rlike(P.EVENT_WORDS), 5)
        + points(x.rlike(P.PLACE_WORDS), 5)
        + points(x.rlike(rf"^#{{1,6}}{S}"), 2)
        + points(x.rlike(rf"^{S}*[-*]{S}+"), 1)
        - points((links(x) > 3) & (F.length(x) < 200), 5)
        - points(x.rlike(P.CHROME_WORDS), 8)
        - points(F.length(trim(x)) < 4, 3)
    )


def is_noise(x: Column, score: Column) -> Column:
    return (score < P.SIGNAL_SCORE) & (x.rlike(P.NOISE_WORDS) | ((links(x) > 2) & (F.length(x) < 220)))


def is_month(x: Column) -> Column:
    return trim(x).rlike(P.STANDALONE_MONTH)


def is_day(x: Column) -> Column:
    return trim(x).rlike(P.STANDALONE_DAY)


def word_list(x: Column) -> Column:
    return F.filter(F.split(x, rf"{S}+"), lambda w: w != "")


def _is_compact(t: Column, longest: int, ending: bool = False, noise: bool = False) -> Column:
    """``t`` is trimmed: one short line that is no date, link or chrome."""
    fits = (t != "") & (F.length(t) <= longest) & ~F.contains(t, F.lit("\n")) & ~has_date(t) & ~t.rlike(P.STANDALONE_MONTH) & ~t.rlike(P.STANDALONE_DAY) & ~t.rlike(r"(?i)[\]\[]\(|https?://")
    if not ending:
        fits = fits & ~t.rlike(r"[.!?]\z")
    return fits if noise else fits & ~t.rlike(P.COMPACT_NOISE)


def is_compact(x: Column, longest: int, ending: bool = False, noise: bool = False) -> Column:
    return _is_compact(trim(F.coalesce(x, F.lit(""))), longest, ending, noise)


def is_title(x: Column) -> Column:
    """A line that may name the event below it."""
    t = trim(F.coalesce(x, F.lit("")))
    words = word_list(t)
    count = F.size(words)
    chrome = (
        t.rlike(P.CONTEXT_LABEL)
        | t.rlike(P.TITLE_CHROME)
        | t.rlike(r"(?i)^(?:cookie|cookies|subscribe)\z")
        | t.rlike(P.any_of(rf"manage{S}+cookies?"))
        | t.rlike(P.any_of(rf"cookies?{S}+(?:settings|preferences|notice|policy|banner|consent|center|centre)"))
        | (t.rlike(P.any_of("cookies?")) & ~t.rlike(P.TITLE_EVENTS))
    )
    offer = (
        t.rlike(P.any_of(rf"subscribe{S}+(?:for|to our|for our|now|today)"))
        | t.rlike(P.any_of(rf"subscribe{S}+(?:to{S}+)?(?:updates?|newsletter|alerts?|emails?)"))
        | t.rlike(rf"(?i)^subscribe{S}+to{S}+.*{P.B}(?:calendar|events?|mailing lists?|list|updates?|newsletter|alerts?|emails?|ical|ics|outlook|apple|google|yahoo|rss|feed){P.B}")
        | (t.rlike(rf"(?i)^subscribe{P.B}") & ~t.rlike(rf"^[Ss]ubscribe{S}+to{S}+[A-Z][A-Za-z0-9'.-]*(?:{S}+[A-Z][A-Za-z0-9'.-]*){{0,5}}\z"))
    )
    cased = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9'.-]*\.?\z")))
    sentence = ~t.rlike(r"\.\z") | (count <= 4) | ((count <= 12) & (cased >= F.ceil(count * 0.6)))
    return _is_compact(t, 220, ending=True, noise=True) & ~chrome & ~offer & count.between(1, 28) & t.rlike("[A-Za-z]") & sentence


def is_bridge(x: Column) -> Column:
    """A few words that may stand between a title and its event."""
    t = trim(F.coalesce(x, F.lit("")))
    return _is_compact(t, 80) & F.size(word_list(t)).between(1, 6) & t.rlike("[A-Za-z]")


def is_link_heavy(html: Column, rendered_length: Column) -> Column:
    return (links(html) >= 20) & (F.length(html) > F.greatest(F.lit(1200), rendered_length * 3))


def has_delimited_lead_date(x: Column) -> Column:
    """A date in a piped line among the first eight lines of the first 700 characters; ``x`` is normalised."""
    lines = F.slice(F.split(F.substring(x, 1, 700), "\n", -1), 1, 8)
    return F.exists(lines, lambda line: F.contains(line, F.lit("|")) & has_date(line))


def detail_lines(html: Column, rendered: Column) -> Column:
    """Plain lines of ``html`` that speak of an event and whose letters aren't in ``rendered``."""
    lines = F.transform(F.split(html, "\n", -1), trim)
    lines = F.filter(lines, lambda line: F.length(line).between(4, 240) & (links(line) == 0) & ~F.contains(line, F.lit("|")))
    plain = F.filter(F.transform(lines, strip_markdown_links), lambda line: score_block(line) >= 5)
    return F.filter(plain, lambda line: (F.length(line_fingerprint(line)) >= 4) & ~F.contains(rendered, line_fingerprint(line)))
