"""From a text to its blocks, and from blocks to a selection within a budget of characters.

A text's blocks stay in its row as arrays, so scoring neighbours, ranking and selecting need no
shuffle; the steps are Arrow UDFs that take the blocks of all rows of a batch at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from datebook.functions import arrow_signals
from datebook.functions import patterns as P
from datebook.functions.arrow_signals import Texts, signal_counts, signal_offsets, slices, strip
from datebook.functions.text import normalize_model_text

_SENTENCE = re.compile(rf"[.!?]{P.S}+(?=[A-Z0-9#*])")
_GAP = re.compile(rf"\n{P.S}*\n")
MARK = "\n...\n"


def chunks(x: str) -> list[str]:
    """Pieces of about 1400 characters, cut after a sentence, else at a space, else hard."""
    out, at = [], 0
    while len(x) - at > P.CHUNK_CHARS:
        low, high = at + int(P.CHUNK_CHARS * 0.65), at + P.CHUNK_CHARS
        ends = [m.end() for m in _SENTENCE.finditer(x, low, high)]
        space = x.rfind(" ", 0, high + 1)
        cut = ends[-1] if ends else space + 1 if space > low else high
        out, at = [*out, strip(x[at:cut])], cut
    return [c for c in [*out, strip(x[at:])] if c]


def clip(x: str) -> str:
    """At most 4000 characters around up to five signals, or the head and tail of a text without any."""
    most = P.MAX_BLOCK_CHARS
    if len(x) <= most:
        return x
    offsets = signal_offsets(x) if signal_counts(Texts(pa.array([x])))[0] else []
    if not offsets:
        room = most - len(MARK)
        head = int(room * 0.55)
        return strip(x[:head]) + MARK + strip(x[head - room :])
    if len(offsets) > 5:
        # Half-way picks go to the later offset.
        offsets = list(dict.fromkeys(offsets[int(k * (len(offsets) - 1) / 4 + 0.5)] for k in range(5)))
    spans = [(0, 220), (len(x) - 180, len(x))] + [(max(0, o - P.PRE_CONTEXT_CHARS), min(len(x), o + P.POST_CONTEXT_CHARS)) for o in offsets]
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1] + 20:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    parts, used = [], 0
    for a, b in joined:
        gap = len(MARK) if parts else 0
        room = most - used - gap
        if room > 80:
            b = min(b, a + room)
            parts.append(x[a:b])
            used += gap + b - a
    return MARK.join(p for p in map(strip, parts) if p)


@F.arrow_udf(IntegerType())
def _signal_count(x: pa.Array) -> pa.Array:
    return pa.array(signal_counts(Texts(x)), pa.int32())


def signal_count(x: Column) -> Column:
    """Distinct places of dates, times and detail words, each kind up to its cap."""
    return _signal_count(x)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of so many of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def list_counts(x: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)


def paragraph_blocks(p: str) -> list[str]:
    """A paragraph as one block, as its lines if these are many or short, or cut where it is long and full of signals."""
    if len(p) > P.MAX_BLOCK_CHARS and signal_counts(Texts(pa.array([p])))[0] >= P.CHUNK_MIN_SIGNALS and len(cut := chunks(p)) > 1:
        return cut
    lines = [x for x in map(strip, p.split("\n")) if x]
    return lines if len(lines) > 4 or len(lines) > 1 and all(len(x) <= 180 for x in lines) else [p]


def text_blocks(x: str) -> list[str]:
    """The blocks of a normalised text."""
    return [b for p in map(strip, _GAP.split(x)) if p for b in paragraph_blocks(p)]


@F.arrow_udf(ArrayType(StringType()))
def _blocks(text: pa.Array) -> pa.Array:
    return pa.array([text_blocks(x or "") for x in text.to_pylist()], pa.list_(pa.string()))


def with_blocks(df: DataFrame, text: Column, out: str = "blocks") -> DataFrame:
    """``df`` with ``out``, the text's blocks as an array of strings; a text without any has an empty array."""
    return df.withColumn(out, _blocks(normalize_model_text(text)))


@F.arrow_udf(StructType([StructField("score", IntegerType()), StructField("noise", BooleanType())]))
def _block_signals(content: pa.Array) -> pa.Array:
    t = Texts(content)
    score = arrow_signals.scores(t)
    return pa.StructArray.from_arrays([pa.array(score), pa.array(arrow_signals.noise(t, score))], ["score", "noise"])


def block_signals(content: Column) -> Column:
    """Struct of a block's ``score`` and whether it is ``noise``."""
    return _block_signals(content)


def block_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, idx, content, score, noise`` of each block."""
    # An outer explode: for an inner one Spark infers a filter that would compute all blocks once more.
    rows = with_blocks(df.select(id_col, text_col), F.col(text_col)).select(id_col, F.posexplode_outer("blocks").alias("idx", "content")).filter("idx IS NOT NULL")
    return rows.withColumn("_s", block_signals(F.col("content"))).select(id_col, "idx", "content", "_s.score", "_s.noise")


#: What a block of a high score adds to its neighbours, by their distance.
NEIGHBOURS = {-3: 3, -2: 4, -1: 8, 0: 20, 1: 8, 2: 4}
#: Less than any score: nothing proposes the block.
_NONE = -(10**9)


def priorities(score: np.ndarray, clipped: Texts, counts: np.ndarray) -> np.ndarray:
    """The priority of each block of lists of so many blocks, ``_NONE`` where nothing proposes it.

    Noise is barred unless it is a title; where nothing of a list is proposed, its first blocks that aren't noise are.
    """
    size = len(score)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.arange(size) - first
    count = np.repeat(counts, counts)

    def near(values: np.ndarray, k: int, otherwise) -> np.ndarray:
        """What the block ``k`` places on has, in the same list."""
        there = (at + k >= 0) & (at + k < count)
        return np.where(there, values[np.where(there, np.arange(size) + k, 0)], otherwise) if size else values

    only = lambda some, value: np.where(some, value, _NONE)
    noise, title, bridge, month, day = arrow_signals.noise(clipped, score), arrow_signals.titles(clipped), arrow_signals.bridges(clipped), arrow_signals.months(clipped), arrow_signals.days(clipped)
    high = only(score >= P.SIGNAL_SCORE, score)
    above = lambda k, bonus: (lambda h: only(h > _NONE, h + bonus))(near(high, k, _NONE))
    dated = month & near(day, 1, False)
    pair = dated | (day & near(month, 1, False))
    beside = P.SIGNAL_SCORE + 8
    plain = [above(-d, bonus) for d, bonus in NEIGHBOURS.items()]
    plain.append(only((score > 0) & (score < P.SIGNAL_SCORE), score))
    # A day that follows this month, and a signal one or two blocks behind it.
    plain += [only(dated, above(k, 6)) for k in (2, 3)]
    plain += [only(near(pair, -k, False), beside - less) for k, less in ((0, 0), (1, 0), (2, 1), (3, 2), (4, 3))]
    lead = (score > 0) | ((at < P.PRIORITY_LEADS) & (score <= 0) & (clipped.chars <= P.SCORELESS_LEAD_CHARS))
    plain.append(only(at < P.LEADS, np.where(lead, P.SIGNAL_SCORE + 36, 4)))
    bridged = title & near(bridge, 1, False)
    named = [only(title, above(1, 9)), only(bridged, above(2, 9)), only(title & near(pair, 1, False), beside + 1), only(bridged & near(pair, 2, False), beside + 1)]
    out = np.maximum(only(~noise, np.maximum.reduce(plain)), np.maximum.reduce(named))
    idle = np.bincount(row[out > _NONE], minlength=len(counts))[row] == 0
    fit = np.cumsum(~noise)
    rank = fit - np.where(first > 0, fit[first - 1], 0) if size else fit
    return np.where(idle & ~noise & (rank <= P.LEADS), 1, out)


def candidates(blocks: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Scores, clipped texts and priorities of all blocks of the lists, and how many a list has."""
    counts, flat = list_counts(blocks), Texts(blocks.flatten())
    clipped = flat.x.to_pylist()
    for k in np.flatnonzero(flat.chars > P.MAX_BLOCK_CHARS):
        clipped[k] = clip(clipped[k])
    score = arrow_signals.scores(flat)
    return score, clipped, priorities(score, Texts(pa.array(clipped, pa.string())), counts), counts


@F.arrow_udf(StructType([StructField("scores", ArrayType(IntegerType())), StructField("priority", ArrayType(IntegerType()))]))
def _candidates(blocks: pa.Array) -> pa.Array:
    score, _, priority, counts = candidates(blocks)
    return pa.StructArray.from_arrays([lists(pa.array(score), counts), lists(pa.array(priority.astype(np.int32), mask=priority == _NONE), counts)], ["scores", "priority"])


def with_candidates(df: DataFrame, blocks: str = "blocks") -> DataFrame:
    """``df`` with ``scores`` and ``priority``, arrays beside ``blocks``; a block that nothing proposes has priority null."""
    return df.withColumn("_c", _candidates(F.col(blocks))).select(*df.columns, "_c.scores", "_c.priority")


def selection(priority: list[int], sizes: list[int], budget: int) -> list[int]:
    """Indexes of the blocks that fit ``budget``: by priority, skipping what is too long, until it is full."""
    used, taken = 0, []
    for i in sorted((i for i, p in enumerate(priority) if p != _NONE), key=lambda i: -priority[i]):
        size = sizes[i] + (2 if taken else 0)
        if not taken or used + size <= budget:
            used += size
            taken.append(i)
        if used >= budget:
            break
    return sorted(taken) or [0]


def picked(blocks: list[list[str]], budget: list[int]) -> list[str]:
    """Of each list the blocks that fit its budget, clipped and in their order."""
    _, clipped, priority, counts = candidates(pa.array(blocks, pa.list_(pa.string())))
    out, at, priority = [], 0, priority.tolist()
    for n, most in zip(counts.tolist(), budget):
        own = clipped[at : at + n]
        out.append("\n\n".join(own[i] for i in selection(priority[at : at + n], list(map(len, own)), most)) if n else "")
        at += n
    return out


def trim_to(x: str, most: int) -> str:
    """At most ``most`` characters, cut at the last blank line if that is in the last quarter."""
    head = x[: max(0, most)]
    gap = head.rfind("\n\n")
    return x if len(x) <= most else strip(head[:gap] if gap >= 0 and gap > most * 0.75 else head)


def with_notice(x: str, most: int) -> str:
    """``x`` within ``most`` characters under a notice that it is shortened."""
    notice = P.TRUNCATION_NOTICE
    body = trim_to(x, max(most - len(notice) - 2, 0))
    return strip(notice[: max(0, most)]) if most <= len(notice) else f"{notice}\n\n{body}" if body else notice


def condensed(texts: list[str], most: list[int]) -> list[str]:
    """Normalised texts within so many characters each, the blocks that matter most first."""
    out = list(texts)
    blocks = {k: text_blocks(x) for k, x in enumerate(texts) if len(x) > most[k]}
    for k, own in blocks.items():
        out[k] = "\n\n".join(own)
    over = [k for k in blocks if len(out[k]) > most[k]]
    if not over:
        return out
    room = [most[k] - len(P.TRUNCATION_NOTICE) - 2 for k in over]
    for k, left, body in zip(over, room, picked([blocks[k] for k in over], [max(n, 0) for n in room])):
        out[k] = with_notice(body if left > 0 else "", most[k])
    return out


@F.arrow_udf(StringType())
def _condensed(text: pa.Array, most: pa.Array) -> pa.Array:
    """In slices, because a batch's blocks, their clipped and their lower-cased texts are several times its size."""
    batch = pa.RecordBatch.from_arrays([pc.fill_null(text, ""), pc.fill_null(most, 0)], ["text", "most"])
    parts = [pa.array(condensed(*(c.to_pylist() for c in part.columns)), pa.string()) for part in slices(batch, 1000)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def condense(df: DataFrame, text_col: str, most: Column | int = P.MAX_CHARS, out: str = "condensed") -> DataFrame:
    """``df`` with ``out``: the text within ``most`` characters, the blocks that matter most first.

    A null text is empty.  Texts within the budget pass through their first projection only.
    """
    most = F.lit(most) if isinstance(most, int) else most
    own = [c for c in df.columns if c != out]
    df = df.select(*own, normalize_model_text(F.col(text_col)).alias("_norm"), most.cast("int").alias("_most"))
    long = F.length("_norm") > F.col("_most")
    return df.select(*own, F.when(~long, F.col("_norm")).otherwise(_condensed(F.when(long, F.col("_norm")), F.col("_most"))).alias(out))
