"""Helpers that the corpus operators share: paths, row mapping and word splitting."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every byte outside digits, letters and non-ASCII into a space.
#: Code points from U+0080 up are made of bytes from 0x80 up, so this is the word class
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
_ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8; null has none."""
    return text.encode().translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (``[^\x20\x09-\x0D]+``) with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``taken``, whatever their case."""
    held = {c.lower() for c in taken}
    while name.lower() in held or any(c.startswith(f"{name.lower()}_") for c in held):
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, where unset one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context.getCheckpointDir()


def release_memory() -> None:
    """Give memory that models fitted before no longer use back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nobody holds any more.

    It does so when the driver's garbage is collected, which in a job of many small rounds may be long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where it outlives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder under a name of its own, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    release_memory()
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def map_rows(df: DataFrame, work: Callable[[Iterator[list]], Iterator[list]], schema: str, rows: int = 1000, chars: int = 8_000_000) -> DataFrame:
    """Run ``work`` over column lists of at most ``rows`` rows; ``work`` yields output column lists.

    A slice ends where its strings exceed ``chars`` bytes too; a longer single text stands alone.

    One call of ``work`` serves a whole partition, so that what it builds before its first slice
    (automata, merge tables, caches) is built once for the partition.
    """
    target = pa_schema(schema)

    def run(batches):
        columns, slices = None, ([c.to_pylist() for c in part.columns] for batch in batches for part in _parts(batch, rows, chars))
        for columns in work(slices):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
        # The worker lives on for other tasks.
        del slices, columns
        release_memory()

    return df.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, rows: int, chars: int) -> Iterator[pa.RecordBatch]:
    ends = sum((np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch.columns if pa.types.is_string(c.type)), np.zeros(batch.num_rows, np.int64))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right"))))
        yield batch.slice(at, to - at)
        at = to


def pa_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def crc_fold(column) -> "F.Column":
    """crc32 of an id as text, modulo 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def grid_join(blocks: DataFrame, sides: DataFrame, on: list[str], how: str = "inner", columns: int = 1) -> DataFrame:
    """Every row of ``blocks`` with every row of ``sides`` of equal ``on``; both hold packed arrays.

    ``on`` may have very few values, so both are dealt over a grid of about as many cells as the session has shuffle
    partitions: a block gets one of its lanes and stands in all ``columns``, a side gets a column and stands in all lanes.
    """
    cells = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, -(-cells // columns))
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*on, "lane", "column"]
    left = blocks.withColumn("lane", dealt(lanes)).withColumn("column", every(columns))
    right = sides.withColumn("column", dealt(columns)).withColumn("lane", every(lanes))
    return left.repartition(cells, *keys).join(right.repartition(cells, *keys), keys, how).drop("lane", "column")
