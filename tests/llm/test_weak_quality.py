import random

import numpy as np

from datebook.llm.weak_quality import Features, LinearScorer, fit, label_model, quality_scores, votes


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    accuracy, counts, truth = [0.95, 0.8, 0.7, 0.6, 0.9], {}, {}
    for y in (rng.random(40_000) < 0.7).astype(int):
        vote = [2 if rng.random() < 0.3 else y if rng.random() < a else 1 - y for a in accuracy]
        p = "".join(map(str, vote))
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + y
    posterior, good, chance = label_model(counts)
    assert abs(good - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(chance[j, 1, 1] / (chance[j, 1, 0] + chance[j, 1, 1]) - a) < 0.06
    big = [p for p in counts if counts[p] > 500]
    assert all(abs(posterior[p] - truth[p] / counts[p]) < 0.1 for p in big)


def test_scores_tell_junk_from_prose(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    rows, junk = [], set()
    for i in range(400):
        kind = rng.random()
        if kind < 0.1:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng.randint(30, 200)).split())
        elif kind < 0.2:
            text = " ".join(w for _ in range(10) for w in [word()] * 12)
        else:
            text = prose(rng.randint(40, 300))
        junk |= {i} if kind < 0.2 else set()
        rows.append((i, text, 1))
    rows += [(500, None, 1), (501, "", 1), (502, "word " * 40_000, 1), (502, "word " * 40_000, 1), (None, prose(60), 1)]
    got = {}
    for r in quality_scores(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect():
        got.setdefault(r.doc_id, r)
    assert sum(got[i].kept != (i in junk) for i in range(400)) >= 396
    assert not got[502].kept and got[None].kept and got[500] .score == got[501].score
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_scores(empty).count() == 0


def test_features_and_votes_of_odd_texts():
    assert len(Features()("")[0]) == 0 and len(votes(None)) == 9
    at, x = Features()("a a b")
    assert at[0] == 0 and abs(x[0] - 1 / 3) < 1e-9 and abs((x[1:] ** 2).sum() - 1) < 1e-9


def test_training_takes_one_text_of_an_id_and_no_more_than_its_bound(spark):
    rows = [(1, f"word{i} and more words {i} here. " * (i % 7 + 1)) for i in range(600)] + [(i, f"text {i} of its own. " * 9) for i in range(2, 40)] + [(None, "x y z")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    real = LinearScorer.fit
    LinearScorer.fit = classmethod(lambda cls, rows, targets, *a, **k: seen.append((len(rows), targets.tolist(), [x.tolist() for _, x in rows])) or real(rows, targets, *a, **k))
    try:
        for parts in (1, 5):
            fit(docs.repartition(parts), training=20)
    finally:
        LinearScorer.fit = real
    assert seen[0][0] == 20 and seen[0] == seen[1]


def test_posteriors_are_bayes_rule():
    counts = {"000": 5, "111": 40, "012": 3, "222": 2, "110": 9}
    posterior, good, chance = label_model(counts, rounds=3)
    again, share, held = label_model(counts, rounds=2)
    for p in counts:
        odds = [1 - share, share]
        for y in (0, 1):
            for j, v in enumerate(p):
                odds[y] *= held[j, y, int(v)]
        assert abs(posterior[p] - odds[1] / sum(odds)) < 1e-9
    total = sum(counts.values())
    assert abs(good - (sum(posterior[p] * n for p, n in counts.items()) + 1) / (total + 2)) < 1e-9
    for j in range(3):
        by_vote = [sum(posterior[p] * n for p, n in counts.items() if int(p[j]) == v) + 1 for v in range(3)]
        assert np.allclose(chance[j, 1], np.array(by_vote) / sum(by_vote))
