"""Benchmark decontamination with an FM-index for each block of a training shard.

The words of a block become symbols of the benchmark's alphabet; a word that the benchmark doesn't
have can't be part of a phrase and becomes a break, and so does the end of a text.  The block's suffix
array gives its Burrows-Wheeler transform, kept in a wavelet matrix.  Phrases are searched backward
by rank, all of them at a time; what is found is located through sampled suffix positions, and the
spans of each document are merged.

The benchmark is the stated query set.  It is read in parts of at most ``PART_CHARS`` characters; the
documents pass by each part in the same job and keep what the parts before have found, so nothing is
shuffled and the driver never holds more than a part.

Edge cases: null, empty and wordless texts have no words and no hits; an item without words has no
window; items of fewer words than a window are one window; equal items all count; an item whose id is
null hits words and isn't listed; repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import _ALNUM, _parts, alnum_words, checkpointed, map_rows, table
from datebook.llm.wavelet import Bits, WaveletMatrix

WINDOW = 10
#: Characters of benchmark text that a job holds in each worker.
PART_CHARS = 16_000_000
#: Distance between the text positions whose suffixes are sampled.
SAMPLE = 8
_WORD = re.compile(rb"[^ ]+")


class Phrases:
    """The distinct windows of a part of the benchmark, by length, with the items that hold them."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.alphabet: dict[bytes, int] = {}
        holders: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            words = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in alnum_words(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                holders[tuple(words[i : i + window])].add(item)
        self.shortest = min(map(len, holders), default=0)
        by_length = defaultdict(list)
        for phrase in holders:
            by_length[len(phrase)].append(phrase)
        #: A matrix of symbols for each length, and for each of its rows the items.
        self.groups = [(np.array(p, np.int64), [sorted(x for x in holders[q] if x is not None) for q in p]) for p in by_length.values()]
        self.levels = max(1, len(self.alphabet).bit_length())


class FmIndex:
    """Suffix order, transform and sampled positions of symbols in which 0 is a break.

    Breaks sort first and by their place, so a comparison never runs past one, and a suffix that
    follows a break is always sampled, so a walk never crosses one.
    """

    def __init__(self, text: np.ndarray, levels: int):
        n = len(text)
        breaks = int((text == 0).sum())
        rank = np.where(text == 0, np.cumsum(text == 0) - 1, text + breaks - 1).astype(np.int64)
        reach = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (n + len(text) + (1 << levels) + 2) + after
            order = np.argsort(key, kind="stable")
            step = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = step
            if n < 2 or step[-1] == n - 1:
                break
            reach *= 2
        self.size = n
        before = text[order - 1]
        self.bwt = WaveletMatrix.of(before, levels)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=(1 << levels) + 1)))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.positions = Bits.of(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``phrases`` that occur, and their ranges of suffixes."""
        row = np.arange(len(phrases))
        symbol = phrases[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for column in range(phrases.shape[1] - 2, -1, -1):
            some = low < high
            row, low, high = row[some], low[some], high[some]
            if not len(row):
                break
            symbol = phrases[row, column]
            low, high = self.first[symbol] + self.bwt.rank(symbol, low), self.first[symbol] + self.bwt.rank(symbol, high)
        some = low < high
        return row[some], low[some], high[some]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, steps, open_ = np.zeros(len(at), np.int64), 0, np.arange(len(at))
        while len(open_):
            hit = self.sampled[at]
            out[open_[hit]] = self.positions[self.sampled.rank(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.bwt.access(at)
            at = self.first[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out


def find(texts: list[str | None], phrases: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
    """For each text its number of words, the merged spans of hit words and the items found."""
    counts = np.zeros(len(texts), np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    pieces = []
    known = phrases.alphabet.get
    for i, text in enumerate(texts):
        words = alnum_words(text)
        counts[i] = len(words)
        pieces.append(np.fromiter((known(w, 0) for w in words), np.int32, len(words)))
        pieces.append(np.zeros(1, np.int32))
    if not phrases.groups or not pieces:
        return counts, spans, items
    symbols = np.concatenate(pieces)
    # Runs between breaks that are shorter than the shortest phrase hold none.
    stops = np.flatnonzero(symbols == 0)
    lengths = np.diff(np.append(-1, stops)) - 1
    kept = np.repeat(lengths >= phrases.shortest, lengths + 1)
    where = np.flatnonzero(kept)
    if not len(where):
        return counts, spans, items
    index = FmIndex(symbols[where], phrases.levels)
    starts = np.cumsum(counts + 1) - counts - 1
    found = []
    for matrix, holders in phrases.groups:
        row, low, high = index.search(matrix)
        if len(row):
            many = high - low
            suffix = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            place = where[index.locate(suffix)]
            doc = np.searchsorted(starts, place, "right") - 1
            found.append((doc, place - starts[doc], np.full(len(doc), matrix.shape[1])))
            row = np.repeat(row, many)
            pair = np.unique(doc * len(matrix) + row)
            for d, r in zip((pair // len(matrix)).tolist(), (pair % len(matrix)).tolist()):
                items[d].update(holders[r])
    if found:
        doc, start, length = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((start, doc))
        for d, a, n in zip(doc[order].tolist(), start[order].tolist(), length[order].tolist()):
            _extend(spans[d], a, a + n)
    return counts, spans, items


def _extend(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span that starts no earlier than the last."""
    if spans and start <= spans[-1][1]:
        spans[-1] = (spans[-1][0], max(spans[-1][1], end))
    else:
        spans.append((start, end))


def merged(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(x for spans in lists for x in spans):
        _extend(out, start, end)
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span of words."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_ALNUM))]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def parts(benchmark: DataFrame, most: int = PART_CHARS):
    """The benchmark as :class:`Phrases`, of about ``most`` characters each."""
    rows = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    number = -(-chars // most)
    for k in range(number):
        yield Phrases([(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PART_CHARS) -> DataFrame:
    """``id_col, n_words long, spans array<struct<start, end>>, items array<long>`` of every row.

    Spans are half-open ranges of words, merged where they touch; items are in ascending order.
    """
    schema = f"{id_col} long, text string, n_words long, spans array<struct<start: int, end: int>>, items array<long>"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("text")).selectExpr("*", "0L AS n_words", "CAST(array() AS array<struct<start: int, end: int>>) AS spans", "CAST(array() AS array<long>) AS items")
    all_parts = parts(benchmark, most)
    part = next(all_parts, None) or Phrases([])
    while part:
        after = next(all_parts, None)

        def work(slices, part=part, last=after is None):
            for ids, texts, _, spans, items in slices:
                counts, new, found = find(texts, part)
                spans = [merged([(s["start"], s["end"]) for s in a], b) for a, b in zip(spans, new)]
                items = [sorted({*a, *b}) for a, b in zip(items, found)]
                yield [ids, pa.nulls(len(ids), pa.string()) if last else texts, pa.array(counts), [[{"start": a, "end": b} for a, b in s] for s in spans], items]

        rows = map_rows(rows, work, schema, 20_000, 6_000_000)
        part = after
    return rows.drop("text")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", most: int = PART_CHARS) -> DataFrame:
    """Rows of ``docs`` with every benchmark occurrence cut out of the text and ``length_col`` set anew.

    A round finds the occurrences of all parts of the benchmark in a text and cuts them at once.  A cut can
    bring words together that form a phrase, so what was cut is searched again until none is left; the
    parts' size doesn't change the result.  A document that had nothing but benchmark words goes; all
    others stay as they are.
    """
    at, columns, marks = docs.columns.index(text_col), docs.columns, "marks"
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    while marks in columns:
        marks += "_"

    def work(old: list[str | None], marked: list[list[int]], part: Phrases, only: bool, last: bool) -> tuple[list, list, list]:
        """Texts, their marks and whether they go.  Marks are spans, and after the last part whether there was a cut."""
        texts, gone, todo = list(old), [False] * len(old), range(len(old))
        while todo:
            counts, spans, _ = find([texts[i] for i in todo], part)
            again = []
            for i, n, new in zip(todo, counts.tolist(), spans):
                new = merged(list(zip(marked[i][::2], marked[i][1::2])), new)
                if not last:
                    marked[i] = [x for span in new for x in span]
                    continue
                if new:
                    texts[i], gone[i] = without_spans(texts[i], new), sum(b - a for a, b in new) == n
                    again.append(i)
                marked[i] = []
            if not only:
                marked = [[1, 1] if i in set(again) else m for i, m in enumerate(marked)] if last else marked
                break
            todo = again
        return texts, marked, gone

    def run_with(part: Phrases, only: bool, last: bool):
        def run(batches):
            for whole in batches:
                for batch in _parts(whole, 20_000, 6_000_000):
                    fields, old = batch.schema, batch.column(at).to_pylist()
                    texts, marked, gone = work(old, batch.column(batch.num_columns - 1).to_pylist(), part, only, last)
                    new = list(batch.columns)
                    new[at], new[-1] = pa.array(texts, fields.field(at).type), pa.array(marked, fields.field(len(new) - 1).type)
                    if length_at is not None:
                        lengths = [n if t is o else len(t) for n, o, t in zip(batch.column(length_at).to_pylist(), old, texts)]
                        new[length_at] = pa.array(lengths, fields.field(length_at).type)
                    yield pa.RecordBatch.from_arrays(new, schema=fields).filter(pa.array([not g for g in gone], pa.bool_()))

        return run

    def round_of(rows: DataFrame) -> tuple[DataFrame, bool]:
        """``rows`` cut once by all parts, with marks on what was cut; by a single part until none is left."""
        rows, number = rows.select(*columns, F.expr("CAST(array() AS array<int>)").alias(marks)), 0
        found = parts(benchmark, most)
        part = next(found, None)
        while part:
            after = next(found, None)
            rows, number, part = rows.mapInArrow(run_with(part, number == 0 and after is None, after is None), rows.schema), number + 1, after
        return rows, number > 1

    rows, more = round_of(docs)
    if more:
        rows = checkpointed(rows)
        ready, todo = rows.filter(F.size(marks) == 0), rows.filter(F.size(marks) > 0)
        while not todo.isEmpty():
            rows = checkpointed(round_of(todo)[0])
            ready, todo = ready.union(rows.filter(F.size(marks) == 0)), rows.filter(F.size(marks) > 0)
        rows = ready
    return rows.select(columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, w[i:i + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, range(0, 10) AS o(k) WHERE k < n GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
