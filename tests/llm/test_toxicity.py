import random
import zlib
from collections import Counter

import numpy as np

from datebook.llm.common import alnum_words
from datebook.llm.toxicity import PASSAGE, STEMS, NearestExamples, _rising, fit, known_terms, passages, terms, toxicity_scores, without_toxic


def index_of(vectors, toxic, n_terms, k):
    term = np.concatenate([v[0] for v in vectors])
    example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    weight = np.concatenate([v[1] for v in vectors])
    order = np.lexsort((example, term))
    return NearestExamples({}, np.ones(n_terms), np.arange(len(vectors)), np.array(toxic), np.searchsorted(term[order], np.arange(n_terms + 1)), example[order], weight[order].astype(np.float32), 0.1, k=k)


def test_neighbours_are_exact():
    rng = np.random.default_rng(4)
    def vector():
        at = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(at))
        return at, w / np.linalg.norm(w)
    vectors = [vector() for _ in range(400)]
    index = index_of(vectors, rng.random(400) < 0.3, 40, 7)
    for q in [vector() for _ in range(60)]:
        dense = np.zeros(40)
        dense[q[0]] = q[1]
        cosines = [float(dense[a] @ w) for a, w in vectors]
        got = index.neighbours([q])[0]
        want = sorted((c for c in cosines if c > 0), reverse=True)[:7]
        assert np.allclose(got[0], want, atol=1e-5)
        assert all(abs(cosines[i] - c) < 1e-5 for c, i in zip(*got))
    assert len(index.neighbours([(np.zeros(0, np.int64), np.zeros(0))])[0][0]) == 0


def corpus(n=900):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(40)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["vilest", "foulish", "grubby" + word()])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "vilest foulish " * 20_000, "x"), (None, "plain", "x")]
    return docs, labels + labels[:3] + [(n, 1, None), (None, 1, 1)]


def test_held_out_accuracy_and_filter(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    index = fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity_scores(d, index).collect()}
    truth = {i: y for i, _, y in labels if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 and y is not None}
    right = sum((rows[i].score >= 0.7) == (y == 1) for i, y in truth.items())
    assert right / len(truth) > 0.97
    assert rows[902].score > 0.7 and rows[900].score == rows[901].score < 0.3 and rows[902].evidence[0].toxic
    kept = without_toxic(d, index)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.score < 0.7}


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.evidence for r in toxicity_scores(docs, fit(docs, none)).collect()] == [[], []]
    assert toxicity_scores(docs.limit(0), fit(docs.limit(0), none)).count() == 0


def test_fit_by_brute_force(spark):
    docs, labels = corpus(300)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = fit(d, lab)
    learn = {i: y for i, _, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    assert dict(zip(index.example_ids.tolist(), index.toxic.tolist())) == {i: bool(y) for i, y in learn.items()}

    def count(text):
        words = (text or "").encode().split()
        return Counter(words) + Counter(b"%d~%s" % (k, w[:k]) for w in words for k in STEMS if len(w) > k)

    held = [count(t) for _, t, _ in docs]
    df = Counter(t for c in held for t in c)

    def unit(c, known):
        v = {t: (1 + np.log(n)) * np.log((len(docs) + 1) / (df[t] + 0.5)) for t, n in c.items() if t in known}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    of = {i: c for (i, _, _), c in zip(docs, held)}
    known = {t for i in learn for t in of[i]}
    examples = {i: unit(of[i], known) for i in learn}
    rows = {r.doc_id: r for r in toxicity_scores(d, index).collect() if r.doc_id is not None}
    assert set(index.vocabulary) - {b""} == known
    for i in range(0, 300, 7):
        q = unit(of[i], known)
        cosines = sorted((sum(x * e.get(t, 0) for t, x in q.items()) for e in examples.values()), reverse=True)
        assert np.allclose([e.cosine for e in rows[i].evidence], [c for c in cosines if c > 0][: index.k], atol=1e-5)
        total = sum(e.cosine for e in rows[i].evidence)
        vote = (sum(e.cosine for e in rows[i].evidence if e.toxic) + index.shrink * index.prior) / (total + index.shrink)
        assert abs(rows[i].score - np.interp(vote, *index.curve)) < 1e-6


def test_repeated_rows_and_bound(spark):
    rows = [(i, f"word{i} plain", "x") for i in range(40)] + [(1, "another text", "x"), (1, "word1 plain", "x")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(40)] * 2
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, tf string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    indexes = [fit(x, lab, most=10) for x in (d, d.orderBy("text"))]
    assert [len(i.toxic) for i in indexes] == [10, 10] and indexes[0].toxic.sum() == 5
    assert indexes[0].vocabulary.keys() == indexes[1].vocabulary.keys()
    assert toxicity_scores(d, indexes[0]).count() == 42


def test_passages_are_cut_alike():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta5", "gammas", "delta--x", "épsilon"]) for _ in range(n)) + "  ." for n in (0, 1, PASSAGE, PASSAGE + 1, 3 * PASSAGE - 1, 3 * PASSAGE + 7)] + [None, "-- --"]
    cut = [part for t in texts for part in passages(alnum_words(t))]
    assert all(len(part) <= PASSAGE for part in cut) and [w for part in cut for w in part] == [w for t in texts for w in alnum_words(t)]
    vocabulary = {t: i for i, t in enumerate(sorted({t for part in cut for t in terms(part)}))}
    passage, term, n, parts = known_terms(texts, vocabulary, cut=True)
    assert parts.tolist() == [len(passages(alnum_words(t))) for t in texts]
    assert sorted(zip(passage.tolist(), term.tolist(), n.tolist())) == sorted((i, vocabulary[t], k) for i, part in enumerate(cut) for t, k in terms(part).items())


def test_long_texts_are_caught(spark):
    """Few words of one kind in a long text, among examples that are short and long."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.choice([40, 120, 2500]))]
        bad = i % 5 == 0
        for _ in range(max(3, len(words) // 40) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilest", "foulish", "grubby", "zanies", "mongrel"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = {r.doc_id: r.score for r in toxicity_scores(d, index).collect()}
    long = [i for i, y in held.items() if y and len(docs[i][1]) > 5000]
    assert len(long) > 8 and sum(rows[i] >= 0.7 for i in long) >= 0.9 * len(long)
    assert sum(rows[i] >= 0.7 for i, y in held.items() if not y) <= 2


def test_curve_is_flat_within_a_pool():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.9, 0.4])
    y = np.array([0.0, 0, 1, 0, 1, 1, 1])
    places, values = _rising(x, y, np.ones(7), 0.1)
    assert np.all(np.diff(places) >= 0) and np.all(np.diff(values) >= 0)
    at = np.interp(x, places, values)
    assert at[4] == at[5] and at[3] == at[6] and at[2] < at[4] and np.interp(0.6, places, values) == at[5]
