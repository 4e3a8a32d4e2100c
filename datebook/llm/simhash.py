"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.  Two
fingerprints link when they differ in at most two bits, so of two 32-bit segments one differs by one
bit at most.  Each distinct fingerprint is indexed under both segments, whole and with each one bit
left out; fingerprints that meet under a key are verified, and what links is joined into components.

Copies fold into one distinct fingerprint before anything is compared.  A key that many distinct
fingerprints share is cut again by the halves of the other segment, under the same rule, so no link is
lost: below ``crowded`` a key's fingerprints are held against each other, above it those that share 47 of
64 bits, at most 2 ** 18.  Links and components stay in Spark.

Edge cases: null, empty and wordless texts have fingerprint zero and form one component like any
other; texts of fewer words than a shingle hash as a whole; repeated ids each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from datebook.llm.common import checkpointed, map_rows, space_words, table
from datebook.llm.components import connected_components


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; of fewer words as a whole; of none empty."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of texts by their shingles' hashes, as unsigned 64-bit integers."""
    counts, out = np.array([len(h) for h in hashes], np.int64), np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = _majority(np.concatenate(hashes), counts[some])
    return out


def text_fingerprints(texts: list[str | None], size: int = 3, seed: int = 42) -> np.ndarray:
    return fingerprints_of([shingle_hashes(t, size, seed) for t in texts])


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that more than half of them have.

    Bits are unpacked to bytes and summed eight bytes at a time, in runs of 255 so no byte overflows.
    """
    runs = -(-counts // 255)
    first = np.cumsum(counts) - counts
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(sums, np.cumsum(runs) - runs, axis=0)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint's 64 bits as a signed long."""

    def work(slices):
        for ids, texts in slices:
            yield [ids, pa.array(text_fingerprints(texts, size).view(np.int64))]

    return map_rows(docs.select(F.col(id_col).cast("long"), text_col), work, f"{id_col} long, fp long")


#: Distinct fingerprints under one key beyond which the key is cut again.
CROWDED = 1000


def _variants(rows: DataFrame, base: str, width: int) -> DataFrame:
    """Each row under the keys of both ``width``-bit halves of its lower ``2 * width`` bits.

    ``half`` is 0 for the lower one; ``gap`` is the bit left out, or ``width`` where none is.
    """
    return (
        rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * width + 1))))
        .withColumn("half", F.expr(f"CAST(v DIV {width + 1} AS INT)"))
        .withColumn("gap", F.expr(f"CAST(v % {width + 1} AS INT)"))
        .withColumn("part", F.expr(f"shiftrightunsigned(fp, half * {width}) & {(1 << width) - 1}L"))
        .withColumn("part", F.expr(f"CASE WHEN gap = {width} THEN part ELSE part & ~shiftleft(1L, gap) END"))
        .withColumn(base, F.expr(f"shiftleft(CAST(v AS BIGINT), {width}) | part"))
        .drop("v", "part")
    )


def _verified(rows: DataFrame, keys: list[str], width: int, most: int) -> DataFrame:
    """Links ``a, b`` among rows that share all ``keys``.

    A pair that meets under a key with a gap differs at the gap; where it doesn't, it also meets
    under the whole segment and is taken there.
    """
    left = rows.select(*keys, "half", "gap", F.col("fp").alias("fp_a"), F.col("node").alias("a"))
    right = rows.select(*keys, F.col("fp").alias("fp_b"), F.col("node").alias("b"))
    at_gap = f"(gap = {width} OR shiftrightunsigned(fp_a ^ fp_b, half * {width} + gap) & 1L = 1L)"
    return left.join(right, keys).filter(f"fp_a < fp_b AND bit_count(fp_a ^ fp_b) <= {most} AND {at_gap}").select("a", "b")


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links ``a, b`` between nodes of ``prints`` (distinct ``fp``, ``node``) at two differing bits or fewer."""
    keyed = _variants(prints.select("fp", "node"), "key", 32)
    shared = checkpointed(keyed.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1"))
    few = _verified(shared.filter(F.col("m") <= crowded), ["key"], 32, 2)
    # Under a crowded key the other segment differs in two bits at most: its 16-bit halves, by the same rule.
    other = shared.filter(F.col("m") > crowded).select("key", "node", F.col("fp").alias("whole"), F.expr("CASE half WHEN 0 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END").alias("fp"))
    again = _variants(other, "key2", 16)
    left = again.select("key", "key2", "half", "gap", F.col("fp").alias("part_a"), F.col("whole").alias("fp_a"), F.col("node").alias("a"))
    right = again.select("key", "key2", F.col("fp").alias("part_b"), F.col("whole").alias("fp_b"), F.col("node").alias("b"))
    many = left.join(right, ["key", "key2"]).filter("fp_a < fp_b AND bit_count(fp_a ^ fp_b) <= 2 AND (gap = 16 OR shiftrightunsigned(part_a ^ part_b, half * 16 + gap) & 1L = 1L)").select("a", "b")
    return few.union(many).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, crowded: int = CROWDED) -> DataFrame:
    """``id_col, fp, component_id`` for every row; the component is the least id that links reach."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, size))
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("node"))
    found = connected_components(links(distinct.filter("node IS NOT NULL"), crowded))
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the document of the least id stays.

    Of rows that repeat an id one stays; rows without an id are left alone.
    """
    return keep_least(docs, simhash_components(docs, id_col, text_col).select(id_col, "component_id"), id_col)


def keep_least(docs: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is its component's in ``members`` (``id_col, component_id``)."""
    members = checkpointed(members)
    kept = docs.join(members.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)
    repeated = members.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().filter("count > 1").select(id_col)
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, id_col, "left_anti").select(docs.columns).unionByName(kept.join(repeated, id_col, "left_semi").select(docs.columns).dropDuplicates([id_col]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
