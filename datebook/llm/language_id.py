"""Language of each word in code-switched text, by a linear-chain conditional random field.

A text is the sequence of its words (runs of letters).  A word's features are its affixes of one to four
letters, its bigrams and trigrams with the word's ends, the word itself, and the lexicon: the languages whose training words hold
it, by how strongly.  Affixes, n-grams and words are hashed into ``2**BITS`` buckets of weights for each language.
Transitions between the languages of neighbouring words are learned too.  Forward-backward gives each word the probability of each language
given the whole text; a text's language is the one with the largest sum over its words, its score the mean.

Training: of each language up to ``examples`` texts, the least by the hash of the text, so copies count once; of
each up to ``WINDOWS`` windows of ``SPAN`` words, spread evenly over the whole text.  The windows, each labelled by its document's language, are put in a
fixed random order and joined to sequences of ``LENGTH`` words, so that there are switches to learn from; the likelihood's gradient
is followed in full by Adam.  What reaches the driver is bounded by ``examples``, ``WINDOWS``, ``SPAN`` and ``LONGEST``, the letters kept of a training word.

Scoring: the texts of a slice are one stream of words, in which the first word of each text starts anew.
It is cut in chunks; the chunks' transfer matrices are multiplied up side by side, messages pass from
chunk to chunk, and all chunks are then run through at once.  That is exact, and a text may be as long as memory holds.
Word types are featurised once in a task, up to ``KNOWN`` of them at a time.

Edge cases: null text, empty text and text without a letter give ``und`` and 0; so does every text if nothing
is labelled; a single learned language takes all other texts; repeated rows each give a row and repeated
texts count once in training; of ties the first language in order wins; null languages teach nothing; empty tables give
no rows; other columns are not read, and names do not clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datebook.llm.common import checkpointed, crc_fold, map_rows, table

BITS = 17
#: Training texts of a language, windows of a text, words of a window and of a sequence, letters kept of a word.
EXAMPLES, WINDOWS, SPAN, LENGTH, LONGEST = 400, 6, 12, 36, 64
#: Word types that a task keeps, words of a chunk.
KNOWN, CHUNK = 400_000, 64
#: Parts of the hashes, keys that are broadcast (3 MB).
PARTS, FEW = 64, 100_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; marks and numerals that count as word characters need a letter beside them."""
    return [w for w in _WORD.findall(text) if w.isalpha() or any(map(str.isalpha, w))] if text else []


@dataclass
class Model:
    """Weights of a bucket by language, of a transition (from, to), of a first word; the lexicon's log shares."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexicon_weight: np.ndarray


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all features, in the order of the words, and where each word's begin."""
    joined = "".join(f"\x02{w.lower()}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens, closes = np.flatnonzero(codes == 2), np.flatnonzero(codes == 3)
    owner = np.repeat(np.arange(len(words)), closes - opens + 1)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)

    def grams(n):
        out = np.zeros(len(mixed) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ mixed[k : len(mixed) - n + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(31)
        return out

    kinds, owners = [], []
    # With the word's ends among the letters the n-grams at an end are prefixes and suffixes.
    for n in (2, 3, 4, 5):
        if len(mixed) < n:
            continue
        all_n = grams(n)
        at = np.flatnonzero(owner[: len(all_n)] == owner[n - 1 :])
        if n > 3:
            at = at[(codes[at] == 2) | (codes[at + n - 1] == 3)]
        kinds.append(all_n[at] + np.uint64(n))
        owners.append(owner[at])
    with np.errstate(over="ignore"):
        place = (np.arange(len(mixed)) - opens[owner]).astype(np.uint64)
        whole = np.add.reduceat(mixed * (place * np.uint64(2) + np.uint64(1)) * np.uint64(0x94D049BB133111EB), opens)
    kinds.append(whole ^ whole >> np.uint64(33))
    owners.append(np.arange(len(words)))
    flat, of = np.concatenate(kinds), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    flat = (flat[order] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
    return flat.astype(np.int64), np.searchsorted(of[order], np.arange(len(words)))


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """The words' scores for each language."""
    buckets, starts = features(words)
    out = np.add.reduceat(model.weights[buckets], starts, axis=0)
    none = np.zeros(len(model.langs))
    return out + np.array([model.lexicon.get(w.lower(), none) for w in words]) * model.lexicon_weight


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probabilities of each language for each word of a stream; ``starts`` marks first words of texts.

    ``scores``, ``moves`` and ``first`` are logarithms.  Exact but for rounding: what a chunk does to a message is a matrix.
    """
    n, labels = scores.shape
    chunks = -(-n // CHUNK)
    pad = chunks * CHUNK - n
    local = np.exp(scores - scores.max(1, keepdims=True))
    local = np.concatenate([local, np.ones((pad, labels))]).reshape(chunks, CHUNK, labels)
    # What follows the last word starts anew and so tells nothing about it.
    fresh = np.concatenate([starts, np.ones(pad, bool)]).reshape(chunks, CHUNK)
    fresh[0, 0] = True
    step, begin = np.exp(moves - moves.max()), np.exp(first - first.max())

    transfer = np.broadcast_to(np.eye(labels), (chunks, labels, labels)).copy()
    for t in range(CHUNK):
        moved = (transfer.reshape(-1, labels) @ step).reshape(transfer.shape)
        transfer = np.where(fresh[:, t, None, None], transfer.sum(2, keepdims=True) * begin, moved) * local[:, t, None, :]
        transfer /= transfer.sum((1, 2), keepdims=True)

    into, back = np.empty((chunks, labels)), np.empty((chunks, labels))
    into[0] = 1 / labels
    for c in range(chunks - 1):
        v = into[c] @ transfer[c]
        into[c + 1] = v / v.sum()
    back[-1] = 1 / labels
    for c in range(chunks - 1, 0, -1):
        v = transfer[c] @ back[c]
        back[c - 1] = v / v.sum()

    ahead, v = np.empty((chunks, CHUNK, labels)), into
    for t in range(CHUNK):
        v = np.where(fresh[:, t, None], v.sum(1, keepdims=True) * begin, v @ step) * local[:, t]
        v = v / v.sum(1, keepdims=True)
        ahead[:, t] = v
    v = back
    for t in range(CHUNK - 1, -1, -1):
        ahead[:, t] *= v
        v = local[:, t] * v
        v = np.where(fresh[:, t, None], (v * begin).sum(1, keepdims=True), v @ step.T)
        v = v / v.sum(1, keepdims=True)
    both = ahead.reshape(-1, labels)[:n]
    return both / both.sum(1, keepdims=True)


def _sample(docs: DataFrame, examples: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``lang, h, words``: windows of the chosen texts, one row a text."""
    rows = docs.filter(f"`{text_col}` IS NOT NULL AND `{lang_col}` IS NOT NULL").select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # First among the texts of a part of the hashes, so that no task gets more of a frequent language than PARTS * examples.
    part, rank = F.pmod("h", F.lit(PARTS)), F.row_number()
    first = rows.select("lang", "h").distinct().withColumn("r", rank.over(Window.partitionBy("lang", part).orderBy("h"))).filter(F.col("r") <= examples).drop("r")
    ids = checkpointed(first.withColumn("r", rank.over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= examples).drop("r"))
    # With few languages the keys are few; with very many Spark joins them by a shuffle.
    chosen = rows.join(F.broadcast(ids) if ids.count() <= FEW else ids, ["lang", "h"], "left_semi")

    def work(slices):
        for langs, hashes, texts in slices:
            kept = []
            for text in texts:
                words = [w[:LONGEST] for w in words_of(text)]
                n = min(WINDOWS, -(-len(words) // SPAN))
                at = [len(words) * k // n for k in range(n)]
                kept.append([words[a : a + SPAN] for a in at])
            yield [langs, hashes, kept]

    return map_rows(chosen, work, "lang string, h long, windows array<array<string>>", 100).groupBy("lang", "h").agg(F.min("windows").alias("windows"))


def fit(docs: DataFrame, examples: int = EXAMPLES, rounds: int = 60, rate: float = 0.05, decay: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of ``docs``, at most ``examples`` texts of each; None without labelled words."""
    rows = sorted(_sample(docs, examples, id_col, text_col, lang_col).collect(), key=lambda r: (r.lang, r.h))
    langs = sorted({r.lang for r in rows if r.windows})
    windows = [(langs.index(r.lang), w) for r in rows for w in r.windows if w]
    if not windows:
        return None
    order = np.random.default_rng(42).permutation(len(windows))
    words = [w for k in order for w in windows[k][1]]
    labels = np.array([windows[k][0] for k in order for _ in windows[k][1]])
    length = min(LENGTH, len(words))
    count = len(words) // length
    words, labels = words[: count * length], labels[: count * length]

    kinds = sorted(set(words))
    at = {w: i for i, w in enumerate(kinds)}
    typed = np.fromiter((at[w] for w in words), np.int64, len(words))
    size = len(langs)
    # A word's share of places in each language, against an even share, without its own place: what a lexicon tells of a word not used in training.
    folded = {}
    lower = np.array([folded.setdefault(w.lower(), len(folded)) for w in kinds])[typed]
    held = np.zeros((len(folded), size))
    np.add.at(held, (lower, labels), 1)
    smooth = lambda c: np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * size) * size)
    own = held[lower]
    own[np.arange(len(labels)), labels] -= 1
    lexical = smooth(own)

    buckets, starts = features(kinds)
    of = np.repeat(np.arange(len(kinds)), np.diff(np.append(starts, len(buckets))))
    fresh = np.zeros(len(words), bool)
    fresh[::length] = True
    one = np.eye(size)[labels]
    went = np.zeros((size, size))
    np.add.at(went, (labels[:-1][~fresh[1:]], labels[1:][~fresh[1:]]), 1)

    params = [np.zeros((1 << BITS, size)), np.zeros((size, size)), np.zeros(size), np.zeros(size)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        weights, moves, first, lex = params
        scores = np.add.reduceat(weights[buckets], starts, axis=0)[typed] + lexical * lex
        p, pairs = _expected(scores.reshape(count, length, size), moves, first)
        p = p.reshape(-1, size)
        by_type = np.zeros((len(kinds), size))
        np.add.at(by_type, typed, p - one)
        slopes = [np.stack([np.bincount(buckets, by_type[of, j], 1 << BITS) for j in range(size)], 1), pairs - went, (p - one)[fresh].sum(0), ((p - one) * lexical).sum(0)]
        for k, slope in enumerate(slopes):
            slope = slope / len(words) + decay * params[k] / (1 << BITS if k == 0 else 1)
            means[k] = 0.9 * means[k] + 0.1 * slope
            squares[k] = 0.99 * squares[k] + 0.01 * slope * slope
            params[k] = params[k] - rate * (means[k] / (1 - 0.9**turn)) / (np.sqrt(squares[k] / (1 - 0.99**turn)) + 1e-8)
    return Model(langs, params[0], params[1], params[2], dict(zip(folded, smooth(held))), params[3])


def _expected(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of equal length: each word's probabilities, and the expected number of each transition."""
    count, length, size = scores.shape
    local = np.exp(scores - scores.max(2, keepdims=True))
    step, begin = np.exp(moves - moves.max()), np.exp(first - first.max())
    ahead, behind = np.empty_like(local), np.empty_like(local)
    v = begin * local[:, 0]
    ahead[:, 0] = v / v.sum(1, keepdims=True)
    for t in range(1, length):
        v = (ahead[:, t - 1] @ step) * local[:, t]
        ahead[:, t] = v / v.sum(1, keepdims=True)
    behind[:, -1] = 1
    pairs = np.zeros((size, size))
    for t in range(length - 1, 0, -1):
        v = local[:, t] * behind[:, t]
        joint = ahead[:, t - 1, :, None] * step * v[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        v = v @ step.T
        behind[:, t - 1] = v / v.sum(1, keepdims=True)
    p = ahead * behind
    return p / p.sum(2, keepdims=True), pairs


class Scorer:
    """Scores of word types, kept between slices."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.langs)))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) > KNOWN:
            self.at, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            scores = np.concatenate([word_scores(self.model, new[k : k + 20_000]) for k in range(0, len(new), 20_000)])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.rows = np.concatenate([self.rows, scores])
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def _texts(scorer: Scorer, texts: list) -> list[tuple[list[str], np.ndarray]]:
    """Words and their languages' probabilities, for each text."""
    found = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in found])
    ends = np.cumsum(sizes)
    flat = [w for words in found for w in words]
    if not flat:
        return [(w, np.zeros((0, len(scorer.model.langs)))) for w in found]
    starts = np.zeros(len(flat), bool)
    starts[(ends - sizes)[sizes > 0]] = True
    p = marginals(scorer(flat), starts, scorer.model.moves, scorer.model.first)
    return [(w, p[e - n : e]) for w, n, e in zip(found, sizes, ends)]


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", out: str = "lang_pred") -> DataFrame:
    """``id_col``, ``out`` and ``score`` for each row, with ``n_words`` and ``n_switches``, neighbours of different likeliest languages."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{out}` string, score double, n_words long, n_switches long"

    def work(slices):
        scorer = Scorer(model) if model else None
        for ids, texts in slices:
            rows = []
            for words, p in _texts(scorer, texts) if scorer else [((), ())] * len(texts):
                if len(words):
                    mean, best = p.mean(0), p.argmax(1)
                    k = int(mean.argmax())
                    rows.append((model.langs[k], min(1.0, float(mean[k])), len(words), int((best[1:] != best[:-1]).sum())))
                else:
                    rows.append((UNKNOWN, 0.0, 0, 0))
            yield [ids, *map(list, zip(*rows))]

    return map_rows(docs.select(id_col, text_col), work, schema, 400, 4_000_000)


def language_runs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, runs``: of each text the runs of words of one likeliest language, as (first word, words, language, mean probability)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, runs array<struct<first:long,words:long,lang:string,score:double>>"

    def work(slices):
        scorer = Scorer(model)
        for ids, texts in slices:
            out = []
            for words, p in _texts(scorer, texts):
                best = p.argmax(1)
                cuts = np.flatnonzero(np.diff(best, prepend=-1, append=-1)).tolist() if len(words) else []
                out.append([{"first": a, "words": b - a, "lang": model.langs[best[a]], "score": float(p[a:b, best[a]].mean())} for a, b in zip(cuts, cuts[1:])])
            yield [ids, out]

    return map_rows(docs.select(id_col, text_col), work, schema, 400, 4_000_000)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # An id that is null is in no fold: such rows teach nothing, and aren't held out.
    model = fit(docs.filter(crc_fold("doc_id") != 1))
    return languages(docs, model).select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
