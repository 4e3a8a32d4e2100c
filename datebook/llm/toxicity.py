"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

*Examples.*  At most ``most`` labelled rows, half of them toxic or as many as there are, taken by the hash
of their id, are the examples; that bound is the only sample.  Everything counted about words covers all documents.

*Passages.*  Examples and documents are cut into as few passages of equal length as hold at most ``PASSAGE`` words each, so a few words
weigh as much in a long text as in a short one.  No word is left out; a text of at most ``PASSAGE`` words is one passage.

*Vector space.*  The terms are all words of the examples and their stems of 4 to 7 bytes.  A passage's weights are
``(1 + ln tf) * idf`` with document frequencies over all whole documents, scaled to unit length.

*Search.*  The examples' passages stand in blocks of 256, alike ones together, behind an inverted index which has
the greatest weight of each term in each block.  A query bounds each block's cosine by those and leaves out
blocks whose bound is below what its commonest terms alone give the k-th best passage, so the
neighbours are exact.

*Score.*  Neighbours vote with their cosine, shrunk to the prior, and a document has the highest vote of its passages; a rising curve
fitted to leave-one-out votes of the examples, none of whose own passages vote, turns a vote into a probability.  Of the numbers of
neighbours in ``KS`` the one is taken whose leave-one-out fit is the likeliest.

Edge cases: null and empty texts and texts without a term have no neighbours and get the score of an
empty vote; without labels of both classes every score is the prior; a label of null isn't used, a
repeated label row once; of document rows that repeat an id the least text is the example; other columns
are left out.  Memory of the index grows with the examples' distinct terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, fields
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import _ALNUM, _parts, alnum_words, crc_fold, map_rows, release_memory, table

BLOCK = 256
#: Most words of a passage.
PASSAGE = 300
#: Numbers of neighbours to choose from.
KS = (5, 15, 60, 120)
REJECT = 0.7


#: Lengths in bytes of the stems that stand for a word beside itself.
STEMS = (4, 5, 6, 7)


def terms(words: list[bytes]) -> Counter:
    """How often each word and each stem stands in a text."""
    count: Counter = Counter()
    for w, n in Counter(words).items():
        count[w] += n
        for k in STEMS:
            if len(w) > k:
                count[b"%d~%s" % (k, w[:k])] += n
    return count


def _places(word: bytes, place: Callable[[bytes, int], int]) -> list[int]:
    """Places of the word's known terms.

    The vocabulary has all stems of a word that it has, and all shorter stems of a stem, so the first that is missing ends the search.
    """
    found = []
    for k in STEMS:
        if len(word) <= k:
            break
        i = place(b"%d~%s" % (k, word[:k]), -1)
        if i < 0:
            return found
        found.append(i)
    i = place(word, -1)
    if i >= 0:
        found.append(i)
    return found


#: Most words whose terms a task keeps beside the vocabulary.
KEPT = 200_000


def passages(words: list[bytes]) -> list[list[bytes]]:
    """The words cut as :func:`known_terms` cuts them; no words are one passage."""
    parts = max(1, -(-len(words) // PASSAGE))
    ends = [-(-i * len(words) // parts) for i in range(parts + 1)]
    return [words[a:b] for a, b in zip(ends, ends[1:])]


def known_terms(texts: list[str | None], vocabulary: dict[bytes, int], kept: dict[bytes, list[int]] | None = None, cut: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in the vocabulary and frequency of each known term of each text, in this order, then the number of passages of each text.

    With ``cut``, passages stand in place of texts, numbered through all texts; without, a text is one passage.
    The words of all texts are coded together, so a word's terms are looked up once.  The vocabulary is that of :func:`terms` of some texts;
    ``kept`` has terms of words from slice to slice.
    """
    spaced = pa.array([text.encode().translate(_ALNUM) if text else b"" for text in texts], pa.string())
    lists = pc.split_pattern(spaced, " ")
    coded, place = lists.flatten().dictionary_encode(), vocabulary.get
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    kept = {b"": []} if kept is None else kept
    if len(kept) > KEPT:
        kept.clear()
    found = [kept.get(w) if w in kept else kept.setdefault(w, _places(w, place) if w else []) for w in words]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1]) if len(ends) else 0)
    owner, code = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), coded.indices.to_numpy()
    parts = np.ones(len(texts), np.int64)
    if cut:
        full = np.fromiter(map(len, words), np.int64, len(words))[code] > 0
        owner, code = owner[full], code[full]
        size = np.bincount(owner, minlength=len(texts))
        parts = np.maximum(1, -(-size // PASSAGE))
        place_in = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
        owner = (np.cumsum(parts) - parts)[owner] + place_in * parts[owner] // size[owner]
    pair, n = np.unique(owner * max(1, len(words)) + code, return_counts=True)
    word = pair % max(1, len(words))
    at, by = _ranges((ends - np.diff(ends, prepend=0))[word], ends[word])
    pair, back = np.unique((pair // max(1, len(words)))[by] * max(1, len(vocabulary)) + flat[at], return_inverse=True)
    return pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), np.bincount(back, n[by], len(pair)), parts


@dataclass
class NearestExamples:
    """Block-max index over passages of examples: for each term the blocks that hold it, with the greatest weight there.

    ``example_ids`` and ``toxic`` have a row a passage.  ``offsets`` has where a term's postings start; ``examples`` (places of passages) and
    ``weights`` are the postings.  Those of a term that over a sixteenth of the passages hold stand as one row of weights a block instead.
    """

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    example_ids: np.ndarray
    toxic: np.ndarray
    offsets: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    prior: float
    k: int = 15
    shrink: float = 0.5
    #: Votes in ascending order and the probability at each.
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def __post_init__(self):
        self.kept: dict[bytes, list[int]] = {}
        size = np.diff(self.offsets)
        self.blocks = -(-len(self.toxic) // BLOCK)
        term, self.heavy = np.repeat(np.arange(len(size)), size), np.where(size * 16 > len(self.toxic), 0, -1)
        self.heavy[self.heavy == 0] = np.arange((self.heavy == 0).sum())
        thick = self.heavy[term] >= 0
        self.rows = np.zeros((self.heavy.max(initial=-1) + 1, self.blocks * BLOCK), np.float32)
        self.rows[self.heavy[term[thick]], self.examples[thick]] = self.weights[thick]
        term, self.thin, self.thin_weights = term[~thick], self.examples[~thick].astype(np.intp), self.weights[~thick].astype(float)
        block = self.thin // BLOCK
        first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(block) != 0))[: len(term)])
        #: A row for each other term and block that holds it: the block, the greatest weight, the postings' start.
        self.pairs = (block[first], np.maximum.reduceat(self.thin_weights, first) if len(first) else self.thin_weights, np.append(first, len(term)))
        self.pair_offsets = np.searchsorted(term[first], np.arange(len(size) + 1))

    def __reduce__(self):
        # What __post_init__ derives is made again and doesn't travel.
        return NearestExamples, tuple(getattr(self, f.name) for f in fields(self))

    def vectors(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Each passage's terms and their weights, and the number of passages of each text."""
        passage, term, n, parts = known_terms(texts, self.vocabulary, self.kept, cut=True)
        total = int(parts.sum())
        weight = (1 + np.log(n)) * self.idf[term]
        weight /= np.maximum(np.sqrt(np.bincount(passage, weight**2, total)), 1e-12)[passage]
        ends = np.searchsorted(passage, np.arange(1, total + 1))
        return [(term[a:b], weight[a:b]) for a, b in zip(np.append(0, ends), ends)], parts

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector, cosines and places of the k passages of the highest positive cosine, best first; ``without`` has the id of an example for each vector whose passages are left out."""
        out = []
        for at in range(0, len(vectors), 256):
            some = vectors[at : at + 256]
            queries = np.zeros((len(some), len(self.rows)), np.float32)
            for query, (terms_, weight) in zip(queries, some):
                row = self.heavy[terms_]
                query[row[row >= 0]] = weight[row >= 0]
            for i, (part, (terms_, weight)) in enumerate(zip(queries @ self.rows, some)):
                thin = self.heavy[terms_] < 0
                out.append(self._nearest(part, terms_[thin], weight[thin], without[at + i] if without else None))
        return out

    def _nearest(self, part: np.ndarray, at: np.ndarray, weight: np.ndarray, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours, from the ``part`` of each cosine that the rows give and the other terms."""
        if without is not None:
            part = np.where(self.others(without), part, 0)
        block_of, most, postings = self.pairs
        start, end = self.pair_offsets[at], self.pair_offsets[at + 1]
        pair, by = _ranges(start, end)
        block = block_of[pair]
        bounds = np.bincount(block, weight[by] * most[pair], self.blocks) + part.reshape(self.blocks, BLOCK).max(1, initial=0)
        # No weight is negative, so the k-th best cosine is at least the k-th best part.
        least = float(np.partition(part, -self.k)[-self.k]) - 1e-5 if self.k <= len(part) else 0.0
        chosen = bounds > max(0.0, least)
        mine = chosen[block]
        if 2 * np.count_nonzero(mine) > len(mine):
            # A term's postings stand together; the other blocks' cosines are then right too.
            posting, by = _ranges(postings[start], postings[end])
        else:
            part = np.where(np.repeat(chosen, BLOCK), part, 0)
            posting, among = _ranges(postings[pair[mine]], postings[pair[mine] + 1])
            by = by[mine][among]
        sums = part + np.bincount(self.thin[posting], weight[by] * self.thin_weights[posting], len(part))
        if without is not None:
            sums[~self.others(without)] = 0
        found = np.flatnonzero(sums > 0)
        cosine = sums[found]
        if len(cosine) > self.k:
            best = np.argpartition(-cosine, self.k)[: self.k]
            cosine, found = cosine[best], found[best]
        best = np.lexsort((found, -cosine))
        return cosine[best], found[best]

    def others(self, example: int) -> np.ndarray:
        """Which places of the blocks hold no passage of the example."""
        return np.append(self.example_ids != example, np.ones(self.blocks * BLOCK - len(self.example_ids), bool))

    def vote(self, cosine: np.ndarray, found: np.ndarray) -> float:
        return (float(cosine[self.toxic[found]].sum()) + self.shrink * self.prior) / (float(cosine.sum()) + self.shrink)

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.curve))

    def of(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Each text's score and the neighbours of its passage of the highest vote, the first of equal ones."""
        vectors, parts = self.vectors(texts)
        found = [(self.vote(*near), near) for near in self.neighbours(vectors)]
        best = (max(found[a:b], key=lambda x: x[0]) for a, b in zip(np.cumsum(parts) - parts, np.cumsum(parts)))
        return [(self.score(vote), *near) for vote, near in best]

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Choose k and fit the curve by leave-one-out votes, the classes weighted as they are in the labels."""
        self.k = max(KS)
        near = self.neighbours(vectors, self.example_ids.tolist())
        _, first, example = np.unique(self.example_ids, return_index=True, return_inverse=True)
        y = self.toxic[first].astype(float)
        share = np.where(y == 1, self.prior / max(y.sum(), 1), (1 - self.prior) / max((1 - y).sum(), 1)) * len(y)
        best = None
        for k in KS:
            votes = np.zeros(len(first))
            np.maximum.at(votes, example, [self.vote(c[:k], f[:k]) for c, f in near])
            curve = _rising(votes, y, share, self.prior)
            p = np.interp(votes, *curve)
            likely = float((share * np.log(np.where(y == 1, p, 1 - p))).sum())
            if best is None or likely > best[0]:
                best = (likely, k, curve)
        _, self.k, self.curve = best


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the range of each."""
    size = end - start
    by = np.repeat(np.arange(len(size)), size)
    return np.arange(len(by)) + (start - np.cumsum(size) + size)[by], by


def _rising(x: np.ndarray, y: np.ndarray, share: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to ``y`` over ``x``, by pooling adjacent violators: places and values.

    A pool has its mean from its least place to its greatest; only between pools does the curve rise.  A pool's mean counts one more
    case at the prior, so no value is 0 or 1.
    """
    pools: list[list[float]] = []  # weight, weight of y, least x, greatest x
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([share[i], share[i] * y[i], x[i], x[i]])
        while len(pools) > 1 and (pools[-2][3] == pools[-1][2] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    weight, ones, least, greatest = np.array(pools).T
    return np.column_stack([least, greatest]).ravel(), np.repeat(np.maximum.accumulate((ones + prior) / (weight + 1)), 2)


def _examples(labels: DataFrame, most: int) -> tuple[DataFrame, float]:
    """Up to ``most`` ids, half of them toxic or as many as there are, and the share of toxic labels."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(crc_fold("doc_id") != 1).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = min(count.get(True, 0), max(most // 2, most - count.get(False, 0)))
    some = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((True, toxic), (False, most - toxic))]
    return some[0].union(some[1]), count.get(True, 0) / max(1, sum(count.values()))


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000) -> NearestExamples:
    """The index, learned from rows outside the held-out fold (crc32 of the id as text, modulo 3, is 1)."""
    ids, prior = _examples(labels, most)

    def spelled(slices):
        for doc_ids, toxic, texts in slices:
            cut = [(d, y, terms(part) or {b"": 0}) for d, y, x in zip(doc_ids, toxic, texts) for part in passages(alnum_words(x))]
            yield [[d for d, _, _ in cut], [y for _, y, _ in cut], [list(c) for _, _, c in cut], [list(c.values()) for _, _, c in cut]]

    # At most ``most`` ids, so the broadcast is bounded, and so is what the driver takes of them.
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = map_rows(chosen, spelled, "doc_id long, toxic boolean, terms array<binary>, tf array<int>", 100).toArrow()
    rows = rows.take(np.argsort(rows["doc_id"].to_numpy(), kind="stable")).combine_chunks()
    # A passage without a term has the row of an empty one, which no text holds.
    ids, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(bool)
    example = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(rows["terms"]).to_numpy())
    keys = pc.list_flatten(rows["terms"]).combine_chunks().dictionary_encode()
    vocabulary = {t: i for i, t in enumerate(keys.dictionary.to_pylist())}
    term, tf = keys.indices.to_numpy().copy(), pc.list_flatten(rows["tf"]).to_numpy().copy()
    del rows, keys
    release_memory()
    total, frequency = document_frequency(docs, vocabulary)
    idf = np.log((total + 1) / (frequency + 0.5)) * (frequency > 0)
    weight = (idf[term] * (1 + np.log(np.maximum(tf, 1)))).astype(np.float32)
    weight /= np.maximum(np.sqrt(np.bincount(example, weight**2, len(ids))), 1e-12)[example]
    order = _alike(example, term, weight, len(ids), len(idf))
    ids, toxic, place = ids[order], toxic[order], np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    example = place[example]
    order = np.lexsort((example, term))
    index = NearestExamples(vocabulary, idf, ids, toxic, np.searchsorted(term[order], np.arange(len(idf) + 1)), example[order], weight[order].astype(np.float32), prior)
    if toxic.any() and not toxic.all():
        by_example = np.argsort(example, kind="stable")
        ends = np.cumsum(np.bincount(example, minlength=len(ids)))
        index.calibrate([(term[o], weight[o]) for o in np.split(by_example, ends[:-1])])
    else:
        index.curve = (np.zeros(1), np.full(1, prior))
    return index


def _alike(example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, n_terms: int) -> np.ndarray:
    """The examples in an order that has those of one language together: by their part in the second of the
    leading directions of all vectors (the first is what they share)."""
    held, first = np.cos(np.arange(examples) * 0.7) + 1.5, None
    for round_ in range(2):
        for _ in range(15):
            if first is not None:
                held = held - first * (first @ held)
            held = np.bincount(example, weight * np.bincount(term, weight * held[example], n_terms)[term], examples)
            held = held / max(float(np.sqrt((held**2).sum())), 1e-12)
        if round_ == 0:
            first, held = held, np.sin(np.arange(examples) * 1.3)
    return np.argsort(held, kind="stable")


def document_frequency(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """The number of all documents, and of those that hold each term."""

    def work(slices):
        count, seen, kept = np.zeros(len(vocabulary), np.int64), 0, {}
        for (texts,) in slices:
            seen += len(texts)
            count += np.bincount(known_terms(texts, vocabulary, kept)[1], minlength=len(vocabulary))
        some = np.flatnonzero(count)
        yield [np.append(-1, some), np.append(seen, count[some])]

    counted = map_rows(docs.select("text"), work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the examples
    at, n = counted["i"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(len(vocabulary), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def toxicity_scores(docs: DataFrame, index: NearestExamples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score double, evidence array<struct<doc_id, cosine, toxic>>`` of every whole text."""

    def work(slices):
        for ids, texts in slices:
            found = index.of(texts)
            evidence = [[{"doc_id": int(index.example_ids[i]), "cosine": float(c), "toxic": bool(index.toxic[i])} for c, i in zip(cosine, near)] for _, cosine, near in found]
            yield [ids, [score for score, _, _ in found], evidence]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: boolean>>")


def toxic_scores(docs: DataFrame, index: NearestExamples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score double`` of every whole text."""

    def work(slices):
        for ids, texts in slices:
            yield [ids, [score for score, _, _ in index.of(texts)]]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, score double")


def without_toxic(docs: DataFrame, index: NearestExamples, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Rows of ``docs`` that score below ``reject``, with the same columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in _parts(whole, 250, 2_000_000):
                yield batch.filter(pa.array([score < reject for score, _, _ in index.of(batch.column(at).to_pylist())], pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit(docs, table(spark, sf_dir, "labels"))
    return toxic_scores(docs, index).select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
