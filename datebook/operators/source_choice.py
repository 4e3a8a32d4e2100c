"""Which of a page's two texts goes to the model, and the whole of its input within the budget.

A page's texts, their blocks and their windows are made, read and dropped in slices of a batch, so a worker's memory
grows with a slice, and no table of texts is written on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from datebook.functions import arrow_signals
from datebook.functions import patterns as P
from datebook.functions.arrow_signals import Texts, normalized, quality, slices, stripped
from datebook.operators.blocks import condense, condensed, text_blocks
from datebook.operators.html import PAGE, page_structs

#: Most pages of a slice.  Small ones go by the thousand, because an expression is compiled for each slice.
SLICE = 1000


def cluster_counts(blocks: list[list[str]]) -> list[int]:
    """Windows of six blocks with a date, a place and a time or kind of event; after a hit three blocks are passed over.

    All windows are searched at once; only the steps over the hits are taken text by text.
    """
    window = Texts(pa.array(["\n".join(b[i : i + 6]) for b in blocks for i in range(len(b))], pa.string()))
    hits = iter((window.has(P.DATE) & window.has(P.PLACE_DETAILS) & (window.has(P.TIME) | window.has(P.TITLE_EVENTS))).tolist())
    out = []
    for b in blocks:
        n = wait = 0
        for _ in b:
            hit = next(hits)
            n, wait = (n, wait - 1) if wait else (n + 1, 3) if hit else (n, 0)
        out.append(n)
    return out


def any_has(lines: list[list[str]], pattern: str) -> np.ndarray:
    """Whether any of each list's lines matches."""
    counts = np.array([len(x) for x in lines], int)
    hits = Texts(pa.array([x for own in lines for x in own], pa.string())).has(pattern)
    return np.bincount(np.repeat(np.arange(len(lines)), counts)[hits], minlength=len(lines)) > 0


def delimited_lead_dates(x: pa.Array) -> np.ndarray:
    """As ``signals.has_delimited_lead_date``."""
    return any_has([[line for line in lead.split("\n")[:8] if "|" in line] for lead in pc.utf8_slice_codeunits(x, 0, 700).to_pylist()], P.DATE)


@dataclass
class SourceSignals:
    """What the choice between a rendered text and a page's markdown is made by, for arrays of both.

    ``t`` is of the text and ``h`` of the page: their score ``s``, that of their lead ``l``, their length ``n`` and the events they tell ``c``.
    """

    ts: np.ndarray
    hs: np.ndarray
    tl: np.ndarray
    hl: np.ndarray
    tn: np.ndarray
    hn: np.ndarray
    tc: np.ndarray
    hc: np.ndarray
    limit: np.ndarray
    lines: np.ndarray
    place: np.ndarray
    chrome: np.ndarray
    collapsible: np.ndarray
    dated: np.ndarray
    reduced: np.ndarray


def source_signals(t: pa.Array, h: pa.Array, most: np.ndarray) -> SourceSignals:
    """The signals of normalised texts.  Events are counted where the text must be reduced and the page needn't, in the text as reduced."""
    limit = np.where(most > 0, most, P.MAX_CHARS)
    text, page = Texts(t), Texts(h)
    tn, hn, ts, hs = text.chars, page.chars, quality(text), quality(page)
    lead = lambda x: quality(Texts(stripped(pc.utf8_slice_codeunits(x, 0, 2200))))
    both = (tn > 0) & (hn > 0)
    link_heavy = (page.count(r"\]\(") >= 20) & (hn > np.maximum(1200, tn * 3))
    longer = pa.array(both & (hn > tn * 1.1) & ~link_heavy)
    details = [x or [] for x in arrow_signals.detail_lines(pc.if_else(longer, h, None), pc.if_else(longer, t, None))]
    reduced = both & (tn > limit) & (hn <= limit) & (hs >= P.HTML_SCORE)
    tc, hc, some = np.zeros(len(t), int), np.zeros(len(t), int), pa.array(reduced)
    short = condensed(t.filter(some).to_pylist(), limit[reduced].tolist())
    for counts, own in ((tc, normalized(pa.array(short, pa.string()))), (hc, h.filter(some))):
        counts[reduced] = cluster_counts([text_blocks(x) for x in own.to_pylist()])
    return SourceSignals(
        ts=ts, hs=hs, tl=lead(t), hl=lead(h), tn=tn, hn=hn, tc=tc, hc=hc, limit=limit,
        lines=np.array([len(x) for x in details], int), place=any_has(details, P.PLACE_DETAILS), chrome=text.count(P.DETAIL_CHROME),
        collapsible=text.has(P.COLLAPSED), dated=delimited_lead_dates(t) & ~delimited_lead_dates(h), reduced=reduced,
    )


def text_wins(s: SourceSignals) -> np.ndarray:
    """Whether the rendered text goes to the model."""
    ts, hs, tl, hl, tn, hn, limit = s.ts, s.hs, s.tl, s.hl, s.tn, s.hn, s.limit
    m = P.SOURCE_CHOICE
    looks_like_chrome = ((s.chrome >= m["chrome_many"]) & (hn >= tn * m["chrome_share"]) & (hs >= P.HTML_SCORE)) | ((s.chrome >= m["chrome_some"]) & (hn > tn * m["chrome_growth"]) & (hs >= ts + m["chrome_lead"]))
    adds_details = s.place & ((hs >= m["details_score"]) | (s.lines >= m["details_lines"]))
    accordion = (tn <= m["accordion_chars"]) & (hn > tn * m["accordion_growth"]) & s.collapsible & (hs >= ts - m["accordion_less"])
    opened = ~(looks_like_chrome | adds_details | accordion)
    reduced = s.reduced & ~((s.tc >= m["clusters"]) & (s.tc > s.hc))
    fits = opened & (tn <= limit) & (ts >= np.maximum(m["fit_score"], hs - m["fit_less"]))
    better_lead = opened & (tn <= hn) & (tl >= m["lead_score"]) & (tl >= hl + m["lead_more"])
    dated = (tn <= hn) & s.dated
    near_budget = opened & (tn <= limit * m["near_limit"]) & (hn >= tn * m["near_share"]) & (ts >= m["near_score"]) & (tl >= m["near_lead"])
    sparse = (hn < m["sparse_chars"]) & (tn > hn * m["sparse_growth"]) & (ts >= hs)
    richer = (tn > hn * m["richer_growth"]) & (ts >= hs + m["richer_more"])
    broader = (tn > hn * m["broader_growth"]) & (ts >= np.maximum(m["broader_score"], hs - m["broader_less"]))
    bulky = (hn > limit) & (hn > tn * m["bulky_growth"]) & (ts >= m["bulky_score"])
    return ~reduced & (fits | better_lead | dated | near_budget | sparse | richer | broader | bulky)


def chosen(text: pa.Array, markdown: pa.Array, most: np.ndarray) -> pa.Array:
    """The rendered text or the page's markdown, normalised; null texts are empty."""
    t, h = normalized(text), normalized(markdown)
    wins = text_wins(source_signals(t, h, most))
    is_empty = lambda x: pc.equal(pc.binary_length(x), 0)
    return pc.if_else(is_empty(h), t, pc.if_else(is_empty(t), h, pc.if_else(pa.array(wins), t, h)))


def model_inputs(text: pa.Array, markdown: pa.Array, most: np.ndarray) -> pa.Array:
    """The chosen source, condensed to ``most`` characters."""
    return pa.array(condensed(chosen(text, markdown, most).to_pylist(), most.tolist()), pa.string())


def fit_table(x: str, room: int) -> str:
    """A snippet within ``room`` characters, cut to whole lines, two at least, or nothing of it."""
    if len(x) <= room:
        return x
    lines, used = [], 0
    for line in x.split("\n"):
        size = len(line) + (1 if lines else 0)
        if used + size > room:
            break
        lines.append(line)
        used += size
    return "\n".join(lines) if len(lines) > 1 else ""


def fit_tables(tables: list[str], most: int = P.CSV_MAX_CHARS) -> list[str]:
    """Snippets in order within ``most`` characters."""
    kept, room = [], most
    for x in tables:
        if room > 0 and (fitted := fit_table(x, room)):
            kept.append(fitted)
            room -= len(fitted)
    return kept


def csv_chars(tables: Column) -> Column:
    return F.aggregate(tables, F.lit(0), lambda n, x: n + F.length(x))


def preprocess_pages(pages: DataFrame, text_col: str | None = "text", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages``, or the columns of them to ``keep``, with ``page``, ``csv_snippets`` and ``model_input``.  The text defaults to the page's own.

    A page is parsed once; what the snippets take of the budget the model's input hasn't.
    """
    made = [StructField("page", PAGE), StructField("csv_snippets", ArrayType(StringType())), StructField("model_input", StringType())]
    own = [f for f in pages.schema if f.name not in {m.name for m in made} and (keep is None or f.name in keep)]
    kept = [f.name for f in own]
    read = list(dict.fromkeys([*kept, html_col, *([text_col] if text_col else [])]))

    def inputs(part: pa.RecordBatch) -> list[pa.Array]:
        page = page_structs(part.column(html_col))
        tables = [fit_tables(x) for x in page.field("tables").to_pylist()]
        room = np.array([max(0, P.MAX_CHARS - sum(map(len, x)) - len(x)) for x in tables], int)
        return [page, pa.array(tables, pa.list_(pa.string())), model_inputs(part.column(text_col) if text_col else page.field("text"), page.field("markdown"), room)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *inputs(part)], [*kept, *(m.name for m in made)])
            # Not held while the next batch is read.
            batch = part = None

    return pages.select(*read).mapInArrow(run, StructType([*own, *made]))


def preprocess_selection(df: DataFrame, text_col: str) -> DataFrame:
    """Selected text alone: no page and no tables."""
    return condense(df.filter(F.coalesce(F.trim(text_col), F.lit("")) != ""), text_col, P.MAX_CHARS, "model_input").withColumn("csv_snippets", F.array().cast("array<string>"))
