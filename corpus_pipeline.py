"""From raw documents to token ids: toxicity, quality rules, near-duplicates, benchmark passages, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.  All but the last keep the columns of ``documents``.

Edge cases: null, empty and very short texts score as clean of toxicity and fail the quality rules; of rows that
repeat an id or a text one stays; a document that is nothing but benchmark words goes; without labels no
document is toxic unless the prior is; empty tables give no rows; further columns pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.llm import byte_bpe, decontamination, near_copies, quality_rules, toxicity
from datebook.llm.common import table, written

#: The tokenizer's file and pattern; every executor must be able to read the file.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand outside their group's fences go."""
    return quality_rules.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts within two SimHash bits, or alike by 0.8 or more in 5-word shingles, the document of the least id stays."""
    return near_copies.keep_one_of_similar(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the digest of what the ids decode to."""
    rows = byte_bpe.byte_bpe(docs, RANKS, PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", encode),
]

#: Hashing, nearest neighbours and merges are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
