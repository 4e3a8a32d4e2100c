"""Keyed results as they arrive: the last write of each key out of a stream.

Under ``path`` each batch has a folder ``batch=N``, and a compaction one ``snapshot=N`` that holds the last write of each
key of all batches up to N.  A folder counts once its ``_SUCCESS`` stands, which Spark writes last; so a switch to a
new snapshot is the appearance of one file.  What a failure leaves behind has none and is ignored, and overwritten by the next try.
Readers take the newest whole snapshot and the batches after it: their cost depends on live keys and on what
came since, not on history.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from datebook.operators.cache import latest_entries

_FOLDER = re.compile(r"(batch|snapshot)=([0-9]+)")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str], at: str = "ts") -> StreamingQuery:
    """Write what has arrived of the stream ``rows`` to ``path``, in each batch the last write of each key.

    A batch has a folder of its own, so one that is run again after a failure replaces what it wrote
    before.  ``checkpoint`` and ``path`` lie in storage that all executors share.
    """

    def put(batch: DataFrame, n: int) -> None:
        latest_entries(batch, key, at).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _store(spark: SparkSession, path: str):
    """The file system of ``path``, which any executor's storage may be, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _whole(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of the batches and snapshots that are whole, ascending."""
    fs, where = _store(spark, path)
    found: dict[str, list[int]] = {"batch": [], "snapshot": []}
    for status in fs.listStatus(where) if fs.exists(where) else []:
        m = _FOLDER.fullmatch(status.getPath().getName())
        if m and fs.exists(status.getPath().suffix("/_SUCCESS")):
            found[m[1]].append(int(m[2]))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _current(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], int]:
    """The folders that a reader needs, and the last batch in them; -1 if there is none."""
    whole = _whole(spark, path)
    base = whole["snapshot"][-1:]
    since = [n for n in whole["batch"] if n > (base[0] if base else -1)]
    return [("snapshot", n) for n in base] + [("batch", n) for n in since], max([*base, *since], default=-1)


def upserted(spark: SparkSession, path: str, key: list[str], at: str = "ts", schema: str | None = None) -> DataFrame:
    """The last write of each key; of equal times the later batch counts.

    Without a whole batch there are no rows, of ``schema``; without that either it is an error.
    """
    folders, _ = _current(spark, path)
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"no whole batch under {path}")
        return spark.createDataFrame([], schema)
    parts = [spark.read.parquet(f"{path}/{kind}={n}").withColumn("_batch", F.lit(n)) for kind, n in folders]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return latest_entries(rows, key, at, ["_batch"]).drop("_batch")


def compact(spark: SparkSession, path: str, key: list[str], at: str = "ts") -> int:
    """Fold what there is into a new snapshot; its number, -1 if there is nothing.

    What the new snapshot and the one before it don't need is deleted after the switch, so a reader that began
    before still finds its files.  A failure before the switch changes nothing for readers, one after it leaves folders to the next compaction.
    """
    folders, last = _current(spark, path)
    if folders != [("snapshot", last)] and folders:
        upserted(spark, path, key, at).write.mode("overwrite").parquet(f"{path}/snapshot={last}")
    whole = _whole(spark, path)
    if len(whole["snapshot"]) > 1:
        before = whole["snapshot"][-2]
        fs, where = _store(spark, path)
        for kind, least in (("batch", before + 1), ("snapshot", before)):
            for n in whole[kind]:
                if n < least:
                    fs.delete(where.suffix(f"/{kind}={n}"), True)
    return last
