"""A quality classifier from weak labels.

Nine heuristics vote good, bad or nothing on each document.  The votes of all documents are counted
by pattern, of which there are at most ``3 ** 9``, and expectation-maximisation over these counts
estimates each heuristic's accuracy and each pattern's probability of being good.  With those
probabilities as labels a linear scorer over hashed words and word shapes is fitted to at most
``TRAINING`` documents, taken by the hash of their id; then it scores every whole text.

Edge cases: null and empty texts are scored as texts without words, for which all features are zero and
the weak label decides; an empty table gives no rows; repeated rows each give a row; other columns are
left out.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm.common import map_rows, table, written

#: Documents that the linear scorer is fitted to, at most.
TRAINING = 4000
#: Hashed features, a power of two.
FEATURES = 1 << 15
KEEP = 0.5

_SYMBOLS = bytes(b"#*$%&|<>")
_PLAIN = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or chr(b).isspace())
_SHAPE = bytes(ord("9") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
GOOD, BAD, NONE = 1, 0, 2


def _between(value: float, good, bad) -> int:
    return GOOD if good(value) else BAD if bad(value) else NONE


def votes(text: str | None) -> list[int]:
    """The heuristics' votes, in a fixed order."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    again = sum(map(eq, words, words[1:])) / n
    distinct = len(set(words))
    length = sum(map(len, words)) / n
    return [
        _between(symbols / n, lambda x: x < 0.02, lambda x: x > 0.2),
        _between(again, lambda x: x < 0.02, lambda x: x > 0.2),
        _between(len(words), lambda x: x >= 50, lambda x: x < 8),
        _between((len(lines) - len(set(lines))) / max(1, len(lines)), lambda x: x < 0.1, lambda x: x > 0.4),
        _between(length, lambda x: 3 <= x <= 9, lambda x: x < 2 or x > 14),
        # Distinct words grow about as the square root of a text, so the bounds do too.
        _between(distinct / n**0.5, lambda x: x > min(4.0, 0.5 * n**0.5), lambda x: x < min(2.0, 0.3 * n**0.5)),
        _between(sum(w[-1:] in b".!?" for w in words) / n, lambda x: 0.02 <= x <= 0.3, lambda x: x < 0.002 or x > 0.6),
        _between(sum(w[-1:] in _SYMBOLS for w in words) / n, lambda x: x < 0.02, lambda x: x > 0.2),
        _between(len(data.translate(None, _PLAIN)) / max(1, len(data)), lambda x: x < 0.05, lambda x: x > 0.12),
    ]


def vote_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_col`` and ``pattern``, the votes as digits; written, so that a text is voted on once."""

    def work(slices):
        for ids, texts in slices:
            yield [ids, texts, ["".join(map(str, votes(t))) for t in texts]]

    return written(map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, {text_col} string, pattern string"), "vote-patterns")


def label_model(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], float, np.ndarray]:
    """Probability of good by pattern, the share of good documents, and ``P(vote | class)``.

    ``counts``: documents by pattern.  Votes are independent given the class; the start takes a
    bad vote as rare for a good document, and Dirichlet counts of one keep estimates inside (0, 1).
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, 0.5, np.zeros((0, 2, 3))
    seen = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array([counts[p] for p in patterns], float)
    m = seen.shape[1]
    chance = np.tile(np.array([[0.4, 0.3, 0.3], [0.03, 0.67, 0.3]]), (m, 1, 1))  # class bad, good by vote bad, good, none
    good = 0.8
    for _ in range(rounds):
        log_odds = np.log(good / (1 - good)) + sum(np.log(chance[j, 1, seen[:, j]] / chance[j, 0, seen[:, j]]) for j in range(m))
        p = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))
        good = float(((p * weight).sum() + 1) / (weight.sum() + 2))
        for j in range(m):
            for y, share in ((0, 1 - p), (1, p)):
                by_vote = np.bincount(seen[:, j], share * weight, minlength=3) + 1
                chance[j, y] = by_vote / by_vote.sum()
    return dict(zip(patterns, p.tolist())), good, chance


class Features:
    """Hashed words, word shapes and repeats of a text; a word's features are found once."""

    def __init__(self, size: int = FEATURES, cached: int = 300_000):
        self.size, self.cached, self.known = size, cached, {}

    def _of(self, word: bytes) -> tuple[int, int]:
        from zlib import crc32

        shape = _RUNS.sub(rb"\1\1", word.translate(_SHAPE))
        return crc32(b"w" + word.lower()) % self.size, crc32(b"s" + shape) % self.size

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features and their weights, of unit length together."""
        if len(self.known) > self.cached:
            self.known = {}
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = self._of(w)
        places = np.array([known[w] for w in words]).ravel()
        count = np.bincount(places, minlength=self.size)
        again = sum(map(eq, words, words[1:]))
        count[0] = 0
        at = np.flatnonzero(count)
        value = np.log1p(count[at])
        value = value / np.sqrt((value**2).sum())
        return np.append(0, at), np.append(again / len(words), value)  # place 0 is the share of repeats


class LinearScorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, size: int = FEATURES, epochs: int = 15, rate: float = 0.5) -> LinearScorer:
        """Logistic loss against soft targets by AdaGrad, in the order given."""
        w, squares, bias, bias_squares = np.zeros(size), np.full(size, 1e-2), 0.0, 1e-2
        for _ in range(epochs):
            for (at, x), y in zip(rows, targets.tolist()):
                g = 1 / (1 + np.exp(-(w[at] @ x + bias))) - y
                step = g * x + 1e-4 * w[at]
                squares[at] += step**2
                w[at] -= rate * step / np.sqrt(squares[at])
                bias_squares += g * g
                bias -= rate * g / bias_squares**0.5
        return cls(w, float(bias))

    def __call__(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -50, 50))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: int = TRAINING) -> tuple[DataFrame, dict[str, float], LinearScorer]:
    """The texts and patterns of all documents, the label model's probabilities, and the scorer."""
    patterns = vote_patterns(docs, id_col, text_col)
    labels, _, _ = label_model({r.pattern: r.n for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()})  # at most 3 ** 9 rows
    chosen = patterns.filter(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(training)
    # At most ``training`` ids, so the broadcast is bounded; and one text of each, the least, so is what the driver takes.
    texts = patterns.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min(text_col).alias(text_col))

    def work(slices):
        features = Features()
        for _, found in slices:
            pairs = [features(t) for t in found]
            yield [["".join(map(str, votes(t))) for t in found], [a.tolist() for a, _ in pairs], [x.tolist() for _, x in pairs]]

    rows = map_rows(texts, work, "pattern string, at array<int>, x array<double>", 200).collect()
    rows = sorted(rows, key=lambda r: (r.pattern[::-1], len(r.at), r.at[:20], r.x[:20]))
    order = np.random.default_rng(0).permutation(len(rows))
    pairs = [(np.array(rows[i].at, np.int64), np.array(rows[i].x, float)) for i in order]
    return patterns, labels, LinearScorer.fit(pairs, np.array([labels[rows[i].pattern] for i in order]))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: int = TRAINING) -> DataFrame:
    """``id_col, weak double, score double, kept boolean``: the label model's and the scorer's probability of good.

    A document stays if the mean of both is at least ``KEEP``; one without words by its weak label.
    """
    patterns, labels, scorer = fit(docs, id_col, text_col, training)

    def work(slices):
        features = Features()
        for ids, texts, given in slices:
            weak = [labels[p] for p in given]
            score = [scorer(*f) if len(f[0]) else w for f, w in zip(map(features, texts), weak)]
            yield [ids, weak, score, [(w + s) / 2 >= KEEP for w, s in zip(weak, score)]]

    return map_rows(patterns.select(id_col, text_col, "pattern"), work, f"{id_col} long, weak double, score double, kept boolean")


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
