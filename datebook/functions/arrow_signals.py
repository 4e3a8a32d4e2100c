"""What a block says, for whole Arrow arrays of texts.

Arrow's expressions take time in proportion to a text, however many words an alternation has.  They are put
over texts with A-Z lower-cased, because their own ``(?i)`` folds letters beyond ASCII too.  Their word boundary is
the ASCII one that ``patterns.B`` spells out.  Null texts are taken as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from datebook.functions import patterns as P

S = P.S
#: The white space of ``patterns.S`` as characters.
SPACE_CHARS = re.sub(r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), P.SPACES.encode().decode("unicode_escape"))
#: The patterns for Python's own search; only ASCII letters are folded.
DATE, TIME, DETAIL = (re.compile(x, re.ASCII) for x in (P.DATE, P.TIME, P.DETAIL_WORDS))
_LINK = re.compile(r"\[([^\]]+)\]\([^)]+\)")
_LEAD = re.compile(rf"^(?:[#>*-]|{S})+")


def linear(pattern: str) -> str:
    """A pattern of :mod:`patterns` for Arrow; one that ignores case is lower-cased."""
    x = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern.replace(P.B, r"\b").replace(P.W, r"\b"))
    return x[4:].lower() if x.startswith("(?i)") else x


def strip(x: str) -> str:
    return x.strip(SPACE_CHARS)


def stripped(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, characters=SPACE_CHARS)


def normalized(x: pa.Array) -> pa.Array:
    """As ``text.normalize_model_text``."""
    x = pc.fill_null(x, "")
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\f", " "), ("\x0b", " ")):
        x = pc.replace_substring(x, pattern=a, replacement=b)
    x = pc.replace_substring_regex(x, pattern=" {2,}", replacement=" ")
    for a in ("\n ", " \n"):
        x = pc.replace_substring(x, pattern=a, replacement="\n")
    return stripped(pc.replace_substring_regex(x, pattern="\n{4,}", replacement="\n\n\n"))


def slices(batch: pa.RecordBatch, rows: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most so many rows, and so many bytes of strings where one row hasn't more."""
    ends = sum((np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)), np.zeros(batch.num_rows, np.int64))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """An array of texts, and its lower-cased one for patterns that ignore case."""

    def __init__(self, x: pa.Array):
        self.x = pc.fill_null(x, "")
        self.low = pc.ascii_lower(self.x)
        self.chars = pc.utf8_length(self.x).to_numpy(zero_copy_only=False)

    def _side(self, pattern: str) -> pa.Array:
        return self.low if pattern.startswith("(?i)") else self.x

    def has(self, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(self._side(pattern), pattern=linear(pattern)).to_numpy(zero_copy_only=False)

    def count(self, pattern: str) -> np.ndarray:
        """Matches one after another; a pattern must begin and end at boundaries of words, or at none."""
        return pc.count_substring_regex(self._side(pattern), pattern=linear(pattern)).to_numpy(zero_copy_only=False)

    def contains(self, part: str) -> np.ndarray:
        return pc.match_substring(self.x, pattern=part).to_numpy(zero_copy_only=False)

    def stripped(self) -> Texts:
        return Texts(stripped(self.x))

    def where(self, some: np.ndarray) -> Texts:
        return Texts(self.x.filter(pa.array(some)))


def scores(t: Texts) -> np.ndarray:
    """Ten for each date and time, five for event and place words, less for chrome and lists of links."""
    return (
        10 * t.count(P.DATE) + 10 * t.count(P.TIME) + 5 * t.has(P.EVENT_WORDS) + 5 * t.has(P.PLACE_WORDS)
        + 2 * t.has(rf"^#{{1,6}}{S}") + 1 * t.has(rf"^{S}*[-*]{S}+")
        - 5 * ((t.count(r"\]\(") > 3) & (t.chars < 200)) - 8 * t.has(P.CHROME_WORDS) - 3 * (t.stripped().chars < 4)
    ).astype(np.int32)


def noise(t: Texts, score: np.ndarray) -> np.ndarray:
    return (score < P.SIGNAL_SCORE) & (t.has(P.NOISE_WORDS) | ((t.count(r"\]\(") > 2) & (t.chars < 220)))


def months(t: Texts) -> np.ndarray:
    return t.stripped().has(P.STANDALONE_MONTH)


def days(t: Texts) -> np.ndarray:
    return t.stripped().has(P.STANDALONE_DAY)


def _compact(t: Texts, longest: int) -> np.ndarray:
    """One short line that is no date or link; ``t`` is trimmed."""
    fits = (t.chars > 0) & (t.chars <= longest) & ~t.contains("\n")
    some = t.where(fits)
    fits[fits] = ~some.has(P.DATE) & ~some.has(P.STANDALONE_MONTH) & ~some.has(P.STANDALONE_DAY) & ~some.has(r"(?i)[\]\[]\(|https?://")
    return fits


def _cased(x: str) -> bool:
    words = [w for w in re.split(f"{S}+", x) if w]
    return 10 * sum(bool(re.match(r"[A-Z][A-Za-z0-9'.-]*\.?\Z", w)) for w in words) >= 6 * len(words)


def titles(t: Texts) -> np.ndarray:
    """Lines that may name the event below them."""
    t = t.stripped()
    out = _compact(t, 220)
    t = t.where(out)
    chrome = (
        t.has(P.CONTEXT_LABEL) | t.has(P.TITLE_CHROME) | t.has(r"(?i)^(?:cookie|cookies|subscribe)\z") | t.has(P.any_of(rf"manage{S}+cookies?"))
        | t.has(P.any_of(rf"cookies?{S}+(?:settings|preferences|notice|policy|banner|consent|center|centre)")) | (t.has(P.any_of("cookies?")) & ~t.has(P.TITLE_EVENTS))
    )
    offer = (
        t.has(P.any_of(rf"subscribe{S}+(?:for|to our|for our|now|today)")) | t.has(P.any_of(rf"subscribe{S}+(?:to{S}+)?(?:updates?|newsletter|alerts?|emails?)"))
        | t.has(rf"(?i)^subscribe{S}+to{S}+[^\n\r\u0085\u2028\u2029]*{P.B}(?:calendar|events?|mailing lists?|list|updates?|newsletter|alerts?|emails?|ical|ics|outlook|apple|google|yahoo|rss|feed){P.B}")
        | (t.has(rf"(?i)^subscribe{P.B}") & ~t.has(rf"^[Ss]ubscribe{S}+to{S}+[A-Z][A-Za-z0-9'.-]*(?:{S}+[A-Z][A-Za-z0-9'.-]*){{0,5}}\z"))
    )
    words = t.count(f"[^{P.SPACES}]+")
    sentence = ~t.has(r"\.\z") | (words <= 4)
    open_ = ~sentence & (words <= 12)
    sentence[open_] = [_cased(x) for x in t.x.filter(pa.array(open_)).to_pylist()]
    out[out] = ~chrome & ~offer & (words >= 1) & (words <= 28) & t.has("[A-Za-z]") & sentence
    return out


def bridges(t: Texts) -> np.ndarray:
    """A few words that may stand between a title and its event."""
    t = t.stripped()
    out = _compact(t, 80)
    t = t.where(out)
    words = t.count(f"[^{P.SPACES}]+")
    out[out] = ~t.has(r"[.!?]\z") & ~t.has(P.COMPACT_NOISE) & (words >= 1) & (words <= 6) & t.has("[A-Za-z]")
    return out


def signal_offsets(x: str) -> list[int]:
    """Where dates, times and detail words start, in that order, each kind up to its cap and each place once."""
    found: dict[int, None] = {}
    for pattern, cap in ((DATE, P.SIGNAL_CAPS["date"]), (TIME, P.SIGNAL_CAPS["time"]), (DETAIL, P.SIGNAL_CAPS["detail"])):
        for n, m in enumerate(pattern.finditer(x)):
            if n == cap:
                break
            found[m.start()] = None
    return list(found)


def signal_counts(t: Texts) -> np.ndarray:
    """How many places :func:`signal_offsets` finds; only texts with signals of several kinds are searched for the places."""
    kinds = np.stack([np.minimum(t.count(p), P.SIGNAL_CAPS[k]) for p, k in ((P.DATE, "date"), (P.TIME, "time"), (P.DETAIL_WORDS, "detail"))])
    out, several = kinds.sum(0), (kinds > 0).sum(0) > 1
    out[several] = [len(signal_offsets(x)) for x in t.x.filter(pa.array(several)).to_pylist()]
    return out


def quality(t: Texts) -> np.ndarray:
    """Up to 12 for length, 40 for signals and 30 for the score of the first 12000 characters; texts are normalised."""
    block = np.clip(scores(Texts(pc.utf8_slice_codeunits(t.x, 0, 12000))), 0, 30)
    return np.where(t.chars == 0, 0, np.minimum(12, t.chars // 1200) + np.minimum(40, 3 * signal_counts(t)) + block).astype(np.int32)


def fingerprint(x: str) -> str:
    """Letters and digits of a line, for finding it in another text; as ``text.line_fingerprint``."""
    return re.sub("[^a-z0-9]+", " ", _LEAD.sub("", _LINK.sub(r"\1", x).lower())).strip(" ")


def detail_lines(html: pa.Array, rendered: pa.Array) -> list[list[str] | None]:
    """Plain lines of ``html`` that speak of an event and whose letters aren't in ``rendered``; null for null."""
    texts, others = html.to_pylist(), rendered.to_pylist()
    lines = [[strip(x) for x in (h or "").split("\n")] for h in texts]
    lines = [[_LINK.sub(r"\1", x) for x in ls if 4 <= len(x) <= 240 and "](" not in x and "|" not in x] for ls in lines]
    kept = iter((scores(Texts(pa.array([x for ls in lines for x in ls], pa.string()))) >= 5).tolist())
    out: list[list[str] | None] = []
    for h, r, ls in zip(texts, others, lines):
        plain = [x for x in ls if next(kept)]
        whole = fingerprint(r or "") if plain else ""
        out.append(None if h is None else [x for x in plain if len(f := fingerprint(x)) >= 4 and f not in whole])
    return out
