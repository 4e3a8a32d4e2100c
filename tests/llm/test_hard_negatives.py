import math

import numpy as np
from pyspark.sql import functions as F

from datebook.llm import hard_negatives as h

SCHEMA = "vec_id long, label string, embedding array<double>, rank int, low long"


def brute(rows, n_positives, n_negatives, low=30, high=90, scale=256):
    whole = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((i, label, [math.floor(scale * x) for x in vector]))
    whole = [r for r in whole if sum(x * x for x in r[2]) < 2**62]
    anchors = {}
    for i, label, v in whole:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, b"\xff" * 99, v)), (label, np.array(v, np.int64).tobytes(), v))
    found = []
    for i, (label, _, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        same, rest = [(j, -s) for s, j, other in scored if other == label], [(j, -s) for s, j, other in scored if other != label]
        for positive, score in set(same[:n_positives]):
            fits = [(j, s) for j, s in rest if low * score <= 100 * s <= high * score][:n_negatives]
            found += [(i, positive, k, j, score, s) for k, (j, s) in enumerate(fits, 1)]
    return sorted(found)


def got(spark, rows, parts=3, **options):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in h.hard_negatives(docs, F.col("vec_id") % 100 == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def sample():
    rng = np.random.default_rng(5)
    rows = [(int(i), "hot" if i % 3 == 0 else f"l{i % 5}", (rng.standard_normal(6) + 0.8).tolist()) for i in range(600)]
    rows += [(1000 + i, "tied", [0.5] * 6) for i in range(300)]  # more equal scores than are gathered
    rows += [(3000, None, [1.0] * 6), (3100, "hot", None), (None, "hot", [1.0] * 6), (3200, "hot", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3300, "hot", [math.nan] + [1.0] * 5), (3400, "hot", [math.inf] + [1.0] * 5), (3500, "hot", [1e300] * 6)]
    rows += [(3600, "short", [1.0, 2.0]), (3601, "short", [1.0, 1.0]), (3602, "long", [1.0, 0.5]), (3700, "empty", []), (3701, "empty", []), (3702, "other", [])]
    rows += [(4000, "hot", [-1.0] * 6), (2**63 - 1, "l1", [0.9] * 6), (-(2**63), "l2", [0.9] * 6), (4100, "big", [6e5] * 6), (4101, "big", [5e5] * 6), (4102, "large", [3e5] * 6)]
    return rows + rows[:3] + [(200, "zz", [1.0] * 6), (1001, "tied", [0.5] * 6)]


def test_against_brute_force(spark):
    rows = sample()
    assert got(spark, rows) == brute(rows, 5, 10)
    assert got(spark, rows, positives=2, negatives=3, low=-50, high=100, scale=3) == brute(rows, 2, 3, -50, 100, 3)


def test_small_blocks_and_digits(spark, monkeypatch):
    for name, value in (("ANCHORS", 3), ("ROWS", 17), ("BUCKETS", 32), ("GATHER", 2)):
        monkeypatch.setattr(h, name, value)
    rows = [r for r in sample()[::2] if r[0] is None or abs(r[0]) < 10**6]
    assert got(spark, rows, 2) == brute(rows, 5, 10)


def test_no_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, "a", [1.0]), (101, "b", [0.5])]) == []


def test_grid_joins_each_pair_once(spark):
    blocks, sides = spark.range(40).select((F.col("id") % 2).alias("k"), F.col("id").alias("a")), spark.range(15).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    for columns in (1, 3, 4):
        pairs = [(r.a, r.b) for r in h.grid_join(blocks, sides, ["k"], columns=columns).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in range(40) for b in range(15) if a % 2 == b % 2}
