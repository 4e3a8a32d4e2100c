"""Hard negatives by distributed radix selection.

A vector's components become ``floor(scale * x)``; a score is the integer inner product of two rows.
For each anchor the ``positives`` highest-scoring other rows of its label are its positives, and for each
anchor and positive the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
positive's are its hard negatives.  Higher scores come first, ties by smaller id.

Both are one operation, :func:`first_in_windows`: the first k rows of an anchor in a window of scores.  It never
gathers or sorts a window's rows.  Each round holds blocks of anchors against blocks of rows and counts the window's
rows in ``BUCKETS`` equal buckets of its score range; counts are added up, the bucket that holds the kth row is
the next round's range, and what lies above it is known to qualify.  When a single score is left and more rows
tie at it than are needed, the digits of the id go on where those of the score ended.  A window is done when
``GATHER`` rows or fewer qualify; then only these are gathered and ranked.  A task emits a window's counts only up to the bucket in which
its own rows reach k: what follows can't hold the kth row.  So neither a frequent label nor a vector that a third
of all rows share makes any task hold or send more.

Anchors are a stated query set, held against all rows in blocks of ``ANCHORS`` and ``ROWS``; the number
of rounds depends on the digits of scores and ids, not on the number of rows.

Edge cases: rows with a null id, label or vector, a null or non-finite component, or one whose squared length
doesn't fit 62 bits take no part (scores are longs); an empty vector scores 0; vectors of different lengths have no score.
Rows that repeat an id: as anchors the least (label, vector) stands, equal ones among an anchor's first rows make
one positive, as negatives they are returned as often as they stand; a row with the anchor's id is never another row.
Other columns are not read, names do not clash.  Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datebook.llm.common import checkpointed, grid_join, map_rows, table, written

#: Anchors and rows of a block; buckets of a digit; rows of a window from which they are counted on.
ANCHORS, ROWS, BUCKETS, GATHER = 512, 2048, 1024, 64
#: Integers up to here are exact as doubles.
EXACT = 2**53
LAST = 2**63 - 1


def quantised(vector: list, scale: int) -> np.ndarray | None:
    """``floor(scale * x)`` of each component, or None if the vector can't take part."""
    x = np.array([np.nan if v is None else v for v in vector], np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        fits = np.isfinite(x).all() and float(x @ x) < 2.0**62
    return x.astype(np.int64) if fits else None


def packed_rows(rows: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Blocks ``dim, ids, labels, vectors, longest`` of up to ``ROWS`` rows; ``longest`` is the largest squared length."""
    schema, most = "dim int, ids array<long>, labels array<string>, vectors binary, longest long", ROWS

    def work(slices):
        held = {}

        def block(dim):
            ids, labels, vectors = held.pop(dim)
            matrix = np.array(vectors, np.int64).reshape(len(ids), dim)
            return [[dim], [ids], [labels], [matrix.tobytes()], [int((matrix * matrix).sum(1).max())]]

        for columns in slices:
            for i, label, vector in zip(*columns):
                x = quantised(vector, scale)
                if x is not None:
                    ids, labels, vectors = held.setdefault(len(x), ([], [], []))
                    ids.append(i)
                    labels.append(label)
                    vectors.append(x)
                    if len(ids) == most:
                        yield block(len(x))
        for dim in list(held):
            yield block(dim)

    whole = rows.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("string").alias("l"), F.col(vector_col).alias("v")).filter("i IS NOT NULL AND l IS NOT NULL AND v IS NOT NULL")
    return map_rows(whole, work, schema)


def packed_anchors(windows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks of up to ``ANCHORS`` windows with their anchors: ``dim, keys, ids, labels, vectors, state``."""
    schema, most = "dim int, keys array<long>, ids array<long>, labels array<string>, vectors binary, state array<long>", ANCHORS

    def work(slices):
        held = {}

        def block(dim):
            keys, ids, labels, vectors, state = zip(*held.pop(dim))
            return [[dim], [keys], [ids], [labels], [b"".join(vectors)], [[x for s in state for x in s]]]

        for columns in slices:
            for key, i, label, dim, vector, state in zip(*columns):
                held.setdefault(dim, []).append((key, i, label, vector, state))
                if len(held[dim]) == most:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    state = F.array(*[F.col(c).cast("long") for c in STATE]).alias("state")
    return map_rows(windows.join(anchors, "anchor").select("key", "anchor", "label", "dim", "vector", state), work, schema)


#: A window's rows are ranked within scores ``low`` to ``high``; open are those of scores ``from_score`` to ``to_score``, and if these are one score, of ids
#: ``from_id`` to ``to_id``; ``need`` of the open ones qualify.  Done windows have need 0.
STATE = ["low", "high", "from_score", "to_score", "from_id", "to_id", "need"]


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exactly; by floating point where every partial sum is exact."""
    most = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if most(anchors) * most(rows) * anchors.shape[1] < EXACT:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return anchors @ rows.T


def _met(ids, labels, vectors, dim, state, row_ids, row_labels, row_vectors, same: bool, step: int = 128):
    """For ``step`` windows at a time: their numbers, and which row of them lies open, as window, row and score."""
    names, codes = np.unique(np.array([*labels, *row_labels], object).astype(str), return_inverse=True)
    own, theirs = codes[: len(labels)], codes[len(labels) :]
    left = np.frombuffer(vectors, np.int64).reshape(len(ids), dim)
    right = np.frombuffer(row_vectors, np.int64).reshape(len(row_ids), dim)
    ids, row_ids = np.array(ids, np.int64), np.array(row_ids, np.int64)
    for at in range(0, len(ids), step):
        part = slice(at, at + step)
        anchors, back = np.unique(left[part], axis=0, return_inverse=True)
        found = scores_of(anchors, right)[back.reshape(-1)]
        low, high = state[part, 0, None], state[part, 1, None]
        w, r = np.nonzero((found >= low) & (found <= high))
        fits = ((own[part][w] == theirs[r]) == same) & (ids[part][w] != row_ids[r])
        w, r = w[fits], r[fits]
        yield w + at, row_ids[r], found[w, r]


def _bucket(state: np.ndarray, ids: np.ndarray, scores: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each row in its window's open range, first rows first; -1 outside."""
    f, t, fi, ti = state[:, 2], state[:, 3], state[:, 4], state[:, 5]
    tied = f == t
    inside = (scores >= f) & (scores <= t) & (~tied | ((ids >= fi) & (ids <= ti)))
    # Unsigned differences: a range may span more than 63 bits.
    span = np.where(tied, ti.astype(np.uint64) - fi.astype(np.uint64), t.astype(np.uint64) - f.astype(np.uint64))
    past = np.where(tied, ids.astype(np.uint64) - fi.astype(np.uint64), t.astype(np.uint64) - scores.astype(np.uint64))
    return np.where(inside, (past // (span // np.uint64(buckets) + np.uint64(1))).astype(np.int64), -1)


def _histograms(pairs: DataFrame, same: bool) -> DataFrame:
    """``key, bucket, n`` of the open rows of each window."""
    buckets = BUCKETS

    def work(slices):
        for columns in slices:
            for dim, keys, ids, labels, vectors, flat, row_ids, row_labels, row_vectors in zip(*columns):
                state = np.array(flat, np.int64).reshape(len(keys), len(STATE))
                counts = np.zeros((len(keys), buckets), np.int64)
                for w, i, score in _met(ids, labels, vectors, dim, state, row_ids, row_labels, row_vectors, same):
                    bucket = _bucket(state[w], i, score, buckets)
                    counts += np.bincount((w * buckets + bucket)[bucket >= 0], minlength=counts.size).reshape(counts.shape)
                before = np.cumsum(counts, 1) - counts
                w, b = np.nonzero((counts > 0) & (before < state[:, 6, None]))
                yield [np.array(keys, np.int64)[w], b, counts[w, b]]

    return map_rows(pairs, work, "key long, bucket int, n long", 8).groupBy("key", "bucket").agg(F.sum("n").alias("n"))


def _gathered(pairs: DataFrame, same: bool) -> DataFrame:
    """``key, id, score`` of the rows that qualify: above the open range, or in it."""

    def work(slices):
        for columns in slices:
            for dim, keys, ids, labels, vectors, flat, row_ids, row_labels, row_vectors in zip(*columns):
                state = np.array(flat, np.int64).reshape(len(keys), len(STATE))
                for w, i, score in _met(ids, labels, vectors, dim, state, row_ids, row_labels, row_vectors, same):
                    _, _, f, t, _, ti, _ = state[w].T
                    good = (score > f) | ((score == f) & ((f < t) | (i <= ti)))
                    yield [np.array(keys, np.int64)[w[good]], i[good], score[good]]

    return map_rows(pairs, work, "key long, id long, score long", 8)


def _narrowed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The windows with the open range cut to the bucket that holds the last row needed, or closed.

    ``above`` counts the rows known to qualify; a window whose rows don't suffice takes all of them.
    """
    run = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))
    reached = run.join(windows.select("key", "need"), "key").filter("upto >= need").groupBy("key").agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
    tied = F.col("from_score") == F.col("to_score")
    # Widths in decimals: ranges may span more than 63 bits.
    big = lambda c: F.col(c).cast("decimal(20,0)")
    span = F.when(tied, big("to_id") - big("from_id")).otherwise(big("to_score") - big("from_score"))
    width = F.call_function("div", span.cast("decimal(38,0)"), F.lit(BUCKETS).cast("decimal(38,0)")) + 1
    first = (F.col("b.bucket").cast("decimal(20,0)") * F.col("width")).cast("decimal(38,0)")
    last = first + F.col("width") - 1
    joined = windows.join(reached, "key", "left").withColumn("width", width.cast("decimal(20,0)")).withColumn("tied", tied)
    score_from, score_to = F.greatest(big("from_score"), big("to_score") - last).cast("long"), (big("to_score") - first).cast("long")
    id_from, id_to = (big("from_id") + first).cast("long"), F.least(big("to_id"), big("from_id") + last).cast("long")
    short, ids = F.col("b").isNull(), F.col("tied")
    above = F.col("above") + F.col("b.upto") - F.col("b.n")
    moved = joined.select(
        "key", "anchor", "low", "high",
        F.when(short | ids, F.col("from_score")).otherwise(score_from).alias("from_score"),
        F.when(short | ids, F.col("to_score")).otherwise(score_to).alias("to_score"),
        F.when(short | ~ids, F.col("from_id")).otherwise(id_from).alias("from_id"),
        F.when(short | ~ids, F.col("to_id")).otherwise(id_to).alias("to_id"),
        F.when(short, 0).otherwise(F.col("need") - F.col("b.upto") + F.col("b.n")).alias("need"),
        F.when(short, F.col("above")).otherwise(above).alias("above"), F.coalesce("b.n", F.lit(0)).alias("open"),
    )
    single = (F.col("from_score") == F.col("to_score")) & (F.col("from_id") == F.col("to_id"))
    done = (F.col("need") == 0) | (F.col("above") + F.col("open") <= GATHER) | single
    return moved.withColumn("need", F.when(done, 0).otherwise(F.col("need"))).drop("open")


def first_in_windows(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """``key, id, score, rank``: the first ``k`` rows of each window (``key, anchor, low, high``).

    ``anchors`` has ``anchor, label, dim, vector``; ``same`` asks for rows of the anchor's label, else of other labels.
    """
    ids = (F.lit(-LAST - 1), F.lit(LAST))
    states = checkpointed(windows.select("key", "anchor", "low", "high", F.col("low").alias("from_score"), F.col("high").alias("to_score"), ids[0].alias("from_id"), ids[1].alias("to_id"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("above")).filter("low <= high"))
    bounds = blocks.select(F.explode("ids").alias("i")).agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("i").alias("n")).first()
    cells = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bounds.a is not None:
        states = states.withColumn("from_id", F.lit(bounds.a)).withColumn("to_id", F.lit(bounds.b))

    def pairs(some, n):
        # As many columns as make the copies of rows and of windows about equal.
        columns = round((cells * n / max(bounds.n, 1)) ** 0.5)
        named = packed_anchors(some, anchors).select("dim", "keys", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"), "state")
        met = grid_join(blocks.drop("longest"), named, ["dim"], columns=min(max(columns, 1), cells))
        return met.select("dim", "keys", "a_ids", "a_labels", "a_vectors", "state", "ids", "labels", "vectors")

    closed = states.filter("need = 0")
    active = states
    while n := active.count():
        moved = checkpointed(_narrowed(active, _histograms(pairs(active, n), same)))
        closed, active = closed.union(moved.filter("need = 0")), moved.filter("need > 0")
    found = _gathered(pairs(closed, closed.count()), same)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: "F.Column", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchors`` is a condition on ``rows``."""
    blocks = written(packed_rows(rows, scale, id_col, label_col, vector_col), "row-blocks")
    chosen = packed_rows(rows.filter(anchors), scale, id_col, label_col, vector_col)
    schema = "anchor long, label string, dim int, vector binary, bound long"
    # By Cauchy and Schwarz no score is larger than the root of the product of two squared lengths.
    most = blocks.agg(F.max("longest")).first()[0] or 0

    def unpacked(slices):
        for columns in slices:
            for dim, ids, labels, vectors in zip(*columns):
                squares = (np.frombuffer(vectors, np.int64).reshape(len(ids), dim) ** 2).sum(1).tolist()
                yield [ids, labels, [dim] * len(ids), [vectors[i * dim * 8 : (i + 1) * dim * 8] for i in range(len(ids))], [math.isqrt(x * most) for x in squares]]

    single = map_rows(chosen.select("dim", "ids", "labels", "vectors"), unpacked, schema, 4).groupBy("anchor").agg(F.min(F.struct("label", "vector", "dim", "bound")).alias("x"))
    own = checkpointed(single.select("anchor", "x.label", "x.dim", "x.vector", "x.bound"))
    windows = own.select(F.col("anchor").alias("key"), "anchor", (-F.col("bound")).alias("low"), F.col("bound").alias("high"))
    own = own.drop("bound")
    best = first_in_windows(blocks, own, windows, positives, True)
    best = checkpointed(best.select(F.col("key").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).distinct())
    share = lambda h: (F.lit(h).cast("decimal(10,0)") * F.col("positive_score").cast("decimal(20,0)")).cast("decimal(38,0)") / 100
    # A key of its own for each anchor and positive; positive_score tells apart positives that repeat an id.
    numbered = checkpointed(best.withColumn("key", F.monotonically_increasing_id()))
    between = numbered.select("key", "anchor", F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    found = first_in_windows(blocks, own, between, negatives, False)
    return numbered.join(found, "key").select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: Every anchor against every row.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
