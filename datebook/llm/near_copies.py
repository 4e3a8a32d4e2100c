"""Near copies: SimHash links and, beyond their reach, the Jaccard similarity of word shingles.

:func:`keep_one_of_similar` joins the components of two kinds of links.  Those of SimHash, by deletion
variants, are all pairs within two bits over the same shingles.  At a similarity of 0.8 fingerprints differ
in ten of 64 bits on average, too many for variants to index, so the pairs further apart come from here.

A document is the set of the XXH64 hashes of its word shingles.  Equal sets fold into one node.  Nodes
that share all ``ROWS`` minima of one of ``BANDS`` bands are candidates: a pair at similarity s is one
with a chance of ``1 - (1 - s**ROWS)**BANDS``, 0.9996 at 0.8.  Only pairs whose whole sets reach the
similarity link, and what links is joined into components.

Sets of sizes further apart than the similarity allows can't link; sizes are compared before any set is
fetched.

A band's key that many nodes share holds a large group of near copies, or a passage of many texts.  Its
nodes are first held against one of them for each class of sizes, the pivot: the one whose keys most nodes share, which
a text that others were edited from is.  Round by round a pivot from a component that had none yet is held against the nodes
of other components, as long as a round links one of ten pairs.  What is left outside the key's largest component is then searched exactly, by prefixes:
with hashes ordered from rare to common, two similar sets share one of their first ``n - ceil(s * n) + 1``.
Hashes that no other of these sets has need no partner, so texts that share a mere passage drop out at once;
a pair goes on to its whole sets only if behind a hash that they share enough others are left for the similarity.

Edge cases: null, empty and wordless texts have the empty set and are equal; texts of fewer words than
a shingle are one shingle; repeated ids each give a row, rows without an id are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from datebook.llm.common import checkpointed, map_rows, release_memory, release_shuffles
from datebook.llm.components import connected_components
from datebook.llm.simhash import fingerprints_of, keep_least, shingle_hashes
from datebook.llm.simhash import links as simhash_links

BANDS, ROWS = 20, 5
#: Nodes under one key up to which each is held against each.
FEW = 16

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted, as unsigned 64-bit integers."""
    return np.unique(shingle_hashes(text, size))


def node_ids(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set, none of them empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat ^= flat >> np.uint64(32)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            least = np.minimum.reduceat(flat * _FACTORS[b, r], starts)
            keys[:, b] = (keys[:, b] ^ (least ^ least >> np.uint64(29))) * _MIX[r]
    return keys


def _prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id_col``, ``fp`` (the SimHash fingerprint), ``node`` (the set's own hash), ``n`` (its size) and ``keys``, one for each band."""

    def work(slices):
        for ids, texts in slices:
            hashes = [shingle_hashes(t, size) for t in texts]
            sets = [np.unique(h) for h in hashes]
            keys = [np.zeros(0, np.int64)] * len(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            if some:
                for i, row in zip(some, band_keys([sets[i] for i in some]).view(np.int64)):
                    keys[i] = row
            yield [ids, fingerprints_of(hashes).view(np.int64), node_ids(sets), [len(s) for s in sets], keys]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, fp long, node long, n int, keys array<long>", 200)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``node, hashes`` of the documents of ``ids``."""

    def work(slices):
        for (texts,) in slices:
            sets = [shingle_set(t, size) for t in texts]
            yield [node_ids(sets), [s.view(np.int64) for s in sets]]

    rows = docs.withColumn(id_col, F.col(id_col).cast("long")).join(ids, id_col, "left_semi").select(text_col)
    return checkpointed(map_rows(rows, work, "node long, hashes array<long>", 200).dropDuplicates(["node"]))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose sets are similar enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _sized(similarity: float):
    """Whether the sizes ``n_a`` and ``n_b`` allow the similarity."""
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")


def _by_prefixes(rows: DataFrame, rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of a node of ``rest`` and one of ``rows`` (``node, n, component``) outside its component.

    Every pair that is similar enough is among them.
    """
    hashes = checkpointed(rows.join(sets, "node").select("node", "n", F.explode("hashes").alias("hash")))
    common = hashes.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = hashes.join(common, "hash").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("found"))
    # The hashes that the set alone has come first in its prefix; the little taken off guards against rounding up.
    length = (F.size("found") - F.ceil(similarity * F.col("n") - 1e-6) + 1).cast("int")
    marked = rows.join(rest.withColumn("apart", F.lit(True)), "node", "left")
    listed = ordered.filter(length > 0).select("node", F.size("found").alias("size"), F.posexplode(F.slice("found", F.lit(1), length)).alias("at", "f"))
    firsts = checkpointed(listed.select("node", "f.hash", (F.col("size") - 1 - F.col("at")).alias("behind")).join(marked, "node"))
    left = firsts.filter("apart").select("hash", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("behind").alias("behind_a"), F.col("component").alias("own"))
    right = firsts.select("hash", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("behind").alias("behind_b"), "component", "apart")
    # Two similar sets share no hash before the first that they share; what lies behind it must suffice.
    enough = F.least("behind_a", "behind_b") + 1 >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = left.join(right, "hash").filter("own <> component AND (a < b OR apart IS NULL)").filter(_sized(similarity) & enough)
    return met.select("a", "b").distinct()


def similar_links(shared: DataFrame, sets: DataFrame, similarity: float, few: int = FEW) -> DataFrame:
    """Links ``a, b`` among nodes that meet under a key of ``shared`` (``key``, ``node``, size ``n``, ``m`` nodes of the key)."""
    small = shared.filter(F.col("m") <= few)
    left, right = (small.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    alike = left.join(right, "key").filter("a < b").filter(_sized(similarity)).select("a", "b").distinct()
    links = checkpointed(_linked(alike, sets, similarity))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)))
    weights = shared.groupBy("node").agg(F.sum("m").alias("weight"))
    many = checkpointed(shared.filter(F.col("m") > few).join(weights, "node").select("key", "node", "n", size_class.alias("class"), "weight"))
    if many.isEmpty():
        return links

    place, turn, more = ["key", "class"], 0, True
    while more:
        # At first every node stands alone; the links between few are as good found later.
        rows = checkpointed(_named(many, links)) if turn else many.withColumn("component", F.col("node"))
        fresh = rows.join(rows.join(tried, [*place, "node"], "left_semi").select(*place, "component").distinct(), [*place, "component"], "left_anti") if turn else rows
        pivot = checkpointed(fresh.groupBy(*place).agg(F.max_by(F.struct("node", "component", "n"), F.struct("weight", "node")).alias("p")))
        tried = pivot.select(*place, "p.node").union(tried) if turn else pivot.select(*place, "p.node")
        held = rows.join(pivot, place).filter("component <> p.component").select(F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.n").alias("n_a"), F.col("n").alias("n_b"))
        pairs = checkpointed(held.filter(_sized(similarity)).select("a", "b").distinct())
        new, turn = checkpointed(_linked(pairs, sets, similarity)), turn + 1
        release_shuffles(links.sparkSession)
        links, more = checkpointed(links.union(new)), 10 * new.count() >= pairs.count() > 0
    rows = checkpointed(_named(many, links))
    largest = rows.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    rest = rows.join(largest, "key").filter("component <> main").select("node").distinct()
    pairs = _by_prefixes(rows.select("node", "n", "component").distinct(), rest, sets, similarity)
    return checkpointed(links.union(_linked(pairs, sets, similarity)))


def _named(many: DataFrame, links: DataFrame) -> DataFrame:
    """``many`` with the component of each node, its own where nothing links it."""
    return many.join(connected_components(links), "node", "left").select(*many.columns, F.coalesce("component", "node").alias("component"))


def similar_edges(docs: DataFrame, prints: DataFrame, size: int = 5, similarity: float = 0.8, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a, b`` between ids: of similar texts, and of each text with the least id of an equal set.

    ``prints`` are the :func:`_prints` of ``docs``.  A band's keys are counted before they are written: only those that nodes share are.
    """
    nodes = checkpointed(prints.groupBy("node").agg(F.min(id_col).alias(id_col), F.first("n").alias("n"), F.first("keys").alias("keys")).filter(F.col(id_col).isNotNull()))
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("key"))
    shared = checkpointed(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"))
    names = nodes.select("node", id_col)
    release_shuffles(docs.sparkSession)
    sets = _sets(docs, names.join(shared.select("node"), "node", "left_semi").select(id_col), id_col, text_col, size)
    found = similar_links(shared, sets, similarity, few)
    a, b = names.select(F.col("node").alias("a"), F.col(id_col).alias("id_a")), names.select(F.col("node").alias("b"), F.col(id_col).alias("id_b"))
    far = found.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return far.union(prints.select(F.col(id_col).alias("a"), "node").join(names, "node").select("a", F.col(id_col).alias("b")).filter("a <> b"))


def _members(docs: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """``id_col, component_id`` for every row; the component is the least id that links reach."""
    found = connected_components(edges).select(F.col("node").alias(id_col), "component")
    return docs.select(F.col(id_col).cast("long")).join(found, id_col, "left").select(id_col, F.coalesce("component", id_col).alias("component_id"))


def similar_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, few: int = FEW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, component_id`` by the links of :func:`similar_edges` alone."""
    prints = checkpointed(_prints(docs, id_col, text_col, size))
    return _members(docs, similar_edges(docs, prints, size, similarity, few, id_col, text_col), id_col)


def keep_one_of_similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the document of the least id stays.

    Of rows that repeat an id one stays; rows without an id are left alone.
    """
    release_memory()
    prints = checkpointed(_prints(docs, id_col, text_col, size))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("node")).filter("node IS NOT NULL"))
    copies = prints.select(id_col, "fp").join(nodes, "fp").select(F.col(id_col).alias("a"), F.col("node").alias("b"))
    edges = simhash_links(nodes).union(copies).union(similar_edges(docs, prints, size, similarity, id_col=id_col, text_col=text_col))
    return keep_least(docs, _members(docs, edges, id_col), id_col)
