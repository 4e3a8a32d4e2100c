import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datebook.llm import language_id as l
from datebook.llm.common import crc_fold

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("chunk", [3, 64])
def test_marginals_by_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(l, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    sizes = [1, 4, 7, 2, 1, 6]
    scores, moves, first = rng.normal(size=(sum(sizes), 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.zeros(len(scores), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    got, at = l.marginals(scores, starts, moves, first), 0
    for n in sizes:
        expected = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.exp(first[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for i, y in enumerate(path):
                expected[i, y] += weight
        assert np.allclose(got[at : at + n], expected / expected.sum(1, keepdims=True))
        at += n


def test_expected_counts_by_enumeration():
    rng = np.random.default_rng(2)
    scores, moves, first = rng.normal(size=(3, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, pairs = l._expected(scores, moves, first)
    ones, twos = np.zeros((3, 5, 2)), np.zeros((2, 2))
    for s in range(3):
        paths = list(itertools.product(range(2), repeat=5))
        weights = np.exp([first[y[0]] + sum(scores[s, i, c] for i, c in enumerate(y)) + sum(moves[a, b] for a, b in itertools.pairwise(y)) for y in paths])
        for y, w in zip(paths, weights / weights.sum()):
            for i, c in enumerate(y):
                ones[s, i, c] += w
            for a, b in itertools.pairwise(y):
                twos[a, b] += w
    assert np.allclose(p, ones) and np.allclose(pairs, twos)


def test_features_do_not_depend_on_the_neighbours():
    words = ["a", "Ab", "straße", "𝒳y", "x" * 500, "ab", "été"]
    buckets, starts = l.features(words)
    ends = [*starts[1:], len(buckets)]
    for i, w in enumerate(words):
        alone, _ = l.features([w])
        assert alone.tolist() == buckets[starts[i] : ends[i]].tolist()
    assert len(l.features(["a"])[0]) == 4  # two bigrams and the trigram with the ends, and the word


@pytest.fixture(scope="module")
def model(spark):
    return l.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(crc_fold("doc_id") != 1), examples=60)


def test_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = l.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 300")
    texts = {r.lang: " ".join(l.words_of(r.text)[:30]) for r in docs.groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    order = ["en", "de", "fr"]
    mixed = " ".join(texts[x] for x in order)
    (row,) = l.language_runs(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).collect()
    words = [x.lang for x in row.runs for _ in range(x.words)]
    assert len(words) == 90 and sum(w == order[i // 30] for i, w in enumerate(words)) >= 80
    assert [x["first"] for x in row.runs] == [0, *np.cumsum([x.words for x in row.runs])[:-1].tolist()]


def test_edges(spark, model):
    texts = [None, "", "12 ² ½ _ ́ --", "é", "the and of " * 60_000, "the and of", "the and of"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    rows = {r.doc_id: r for r in l.languages(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and [rows[i].score for i in range(3)] == [0.0] * 3
    assert rows[3].lang_pred in model.langs and rows[4].lang_pred == rows[6].lang_pred == rows[None].lang_pred == "en" and rows[4].n_words == 180_000
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert l.fit(nothing) is None and {r.lang_pred for r in l.languages(docs, None).collect()} == {"und"}
    assert l.languages(docs.limit(0), model).count() == 0
    only = l.fit(docs.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in l.languages(docs.filter("text > 'a'"), only).collect()} == {"xx"}


def test_training_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(7, "word " * 20 + str(i % 3), "en", i) for i in range(300)] + [(i, f"mot été {i}", "fr", i) for i in range(50)], "doc_id long, text string, lang string, h long")
    rows = l._sample(docs, 5, "doc_id", "text", "lang").collect()
    assert len(rows) == 3 + 5
    a, b = (l.fit(docs.repartition(n), 5) for n in (1, 5))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves) and a.lexicon.keys() == b.lexicon.keys()
