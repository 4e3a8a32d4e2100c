"""Source divergence audit: how far the word counts of a language's sources lie apart.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  A language keeps the terms that
at least ``least`` of its documents hold, ``V`` of them.  In a group (a language and a source) and in a
language as a whole, a kept term of ``count`` places among the ``N`` places of all kept terms has
``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``; two of those differ by ``f = floor((p - q)**2 / (p + q))``.

* part ``pair``: of each group every other source of its language, by ``f`` summed over the kept terms;
* part ``term``: of each group the first ``top`` terms that it holds more often than its language, by ``f``.

Most kept terms are rare, and many have equal counts in the same sources.  So the columns of the term-by-source matrix
are grouped by their sparse vector of (source, count), each distinct vector is evaluated once for every
pair of sources, and what comes out counts as often as the vector stands.  Vectors are packed in blocks;
a language's sources are cut into tiles, and each block meets each pair of tiles, so a task holds
``BLOCK`` vectors and two tiles of ``TILE`` sources, however many sources there are.

Counts are added up in each task before they are shuffled, and by (language, source, term) before they
are gathered by term, so a frequent term or a hot source sends a row from each task.

All arithmetic is exact: in 64 bits where the numerator fits, else in 38 digits or in Python's integers.

Edge cases: null text, language and source are ''; a group without a kept term has N = 0 and its pairs
are evaluated all the same; without kept terms (V = 0) all pairs are 0; repeated rows count as often as
they stand; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datebook.llm.common import grid_join, map_rows, pa_schema, table, written

#: Distinct vectors in a block, sources in a tile.
BLOCK, TILE = 4096, 128
#: Entries of a task's counts from which they are passed on.
HELD = 400_000
SCALE = 10**9
#: The largest count whose numerator fits 64 bits.
FITS = (2**63 - 1) // SCALE - 2

_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n`` (places) and ``df`` (documents)."""

    def work(slices):
        places, texts, held = defaultdict(Counter), defaultdict(Counter), 0

        def flushed():
            flat = [(l, s, t, n, texts[l, s][t]) for (l, s), found in places.items() for t, n in found.items()]
            places.clear()
            texts.clear()
            for at in range(0, len(flat), 50_000):
                yield [list(x) for x in zip(*flat[at : at + 50_000])]

        for batch in slices:
            for text, lang, source in zip(*batch):
                words = text.encode().translate(_LETTERS).split()
                own = places[lang, source]
                before = len(own)
                own.update(words)
                texts[lang, source].update(set(words))
                held += len(own) - before
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    counted = map_rows(rows, work, "lang string, source string, term binary, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """``lang, term, vec`` (the sources that hold the term, with their counts, in order) and ``total``, its places."""
    vec = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec")
    return counts.groupBy("lang", "term").agg(vec, F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= least).drop("df")


def group_sizes(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, n`` and the language's ``v`` and ``all``; a row for each group of ``docs``."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col))]).distinct()
    places = kept.select("lang", F.explode("vec").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    return groups.join(places, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "all"])


def _p(count, total, v):
    """The smoothed share of a count, as a column."""
    of = total + 2 * v
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)")
    return 1 + F.when(count <= FITS, F.call_function("div", SCALE * (F.least(count, F.lit(FITS)) + 2), of)).otherwise(F.call_function("div", wide, of.cast("decimal(38,0)")))


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows of ``lang, starts, sources, counts, times``: up to ``BLOCK`` vectors of a language."""
    schema = "lang string, starts array<long>, sources array<string>, counts array<long>, times array<long>"

    def work(batches):
        held = defaultdict(lambda: ([0], [], [], []))

        def block(lang):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((lang, *held.pop(lang)), target)], schema=target)

        for batch in batches:
            vec = batch.column(1)
            ends = vec.offsets.to_numpy()
            sources, counts = (vec.values.field(k).to_pylist() for k in (0, 1))
            for i, (lang, times) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                starts, names, numbers, weights = held[lang]
                names += sources[ends[i] : ends[i + 1]]
                numbers += counts[ends[i] : ends[i + 1]]
                starts.append(len(names))
                weights.append(times)
                if len(weights) == BLOCK or len(names) >= BLOCK * TILE:
                    yield block(lang)
        for lang in list(held):
            yield block(lang)

    target = pa_schema(schema)
    return vectors.select("lang", "vec", "times").mapInArrow(work, schema)


def shares(counts: np.ndarray, sizes: list[int], v: int) -> np.ndarray:
    """``p`` of a matrix of counts, a column for each source, exactly."""
    of = np.array([n + 2 * v for n in sizes], np.int64)
    if counts.size and counts.max() > FITS:
        return (1 + SCALE * (counts.astype(object) + 2) // of.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + 2) // of


def tile_sums(starts, sources, counts, times, v, left, right, same: bool) -> np.ndarray:
    """``f`` summed over a block's vectors, a row for each source of ``left`` and a column for each of ``right``.

    ``left`` and ``right`` are pairs of names and sizes; if they are the ``same`` tile only what is right of the diagonal is filled.
    """
    row = np.repeat(np.arange(len(times)), np.diff(starts))
    tiles = []
    for names, sizes in (left, right):
        at = {s: i for i, s in enumerate(names)}
        column = np.fromiter((at.get(s, -1) for s in sources), np.int64, len(sources))
        matrix = np.zeros((len(times), len(names)), np.int64)
        inside = column >= 0
        matrix[row[inside], column[inside]] = np.asarray(counts, np.int64)[inside]
        tiles.append(shares(matrix, sizes, v))
    p, q = tiles
    weight = np.asarray(times, np.int64)
    out = np.zeros((p.shape[1], q.shape[1]), np.int64)
    for a in range(p.shape[1]):
        low = a + 1 if same else 0
        apart = p[:, a, None] - q[:, low:]
        out[a, low:] = weight @ (apart * apart // (p[:, a, None] + q[:, low:]))
    return out


def pair_values(vectors: DataFrame, groups: DataFrame, tile: int = TILE) -> DataFrame:
    """``lang, a, b, value`` of every two sources of a language, ``a`` before ``b``."""
    numbered = groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / tile))
    tiles = numbered.groupBy("lang", "tile", "v").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("of"))
    left, right = (tiles.select("lang", "v", F.col("tile").alias(f"t{k}"), F.col("of.source").alias(f"names{k}"), F.col("of.n").alias(f"sizes{k}")) for k in "ab")
    sides = left.join(right.drop("v"), "lang").filter("ta <= tb")

    def work(slices):
        for columns in slices:
            for lang, starts, sources, counts, times, v, ta, tb, na, sa, nb, sb in zip(*columns):
                if starts is None:  # a lane without blocks: the pairs exist, and so far they have nothing
                    sums = np.zeros((len(na), len(nb)), np.int64)
                else:
                    sums = tile_sums(starts, sources, counts, times, v, (na, sa), (nb, sb), ta == tb)
                for a, name in enumerate(na):
                    low = a + 1 if ta == tb else 0
                    if low < len(nb):
                        yield [[lang] * (len(nb) - low), [name] * (len(nb) - low), nb[low:], sums[a, low:]]

    met = grid_join(_blocks(vectors), sides, ["lang"], "right").select("lang", "starts", "sources", "counts", "times", "v", "ta", "tb", "namesa", "sizesa", "namesb", "sizesb")
    return map_rows(met, work, "lang string, a string, b string, value long", 16).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, tile: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank`` as told above; ranks from 1, equal values by item."""
    kept = written(kept_terms(term_counts(docs), least), "kept-terms")
    groups = written(group_sizes(docs, kept), "group-sizes")
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("times"))
    pairs = pair_values(vectors, groups, tile)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    places = kept.select("lang", "term", "total", F.explode("vec").alias("x")).select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), "total", F.col("x.n").alias("count"))
    shared = places.join(groups, ["lang", "source"]).select("lang", "source", "item", _p(F.col("count"), F.col("n"), F.col("v")).alias("p"), _p(F.col("total"), F.col("all"), F.col("v")).alias("q")).filter("p > q")
    terms = shared.withColumn("value", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


#: Every pair evaluated term by term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) USING (lang, source)),
full_p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v)::HUGEINT AS p
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lang_q AS (SELECT c.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v))::HUGEINT AS q FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY c.lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM full_p JOIN lang_q USING (lang, term) WHERE count > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10
"""
