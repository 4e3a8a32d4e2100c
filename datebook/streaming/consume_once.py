"""Results that a stream stores and that one reader takes: the first read of a finished result is the only one that gets it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from datebook.operators.cache import TTL_MINUTES

#: The states of a result after which a read takes it; in any other it stays.
FINISHED = ("complete", "error")
#: What arrives: a result is put, or read by ``read_id``; ``ts`` is in milliseconds.
ARRIVALS = "url string, kind string, ts long, status string, result string, read_id string"
ANSWERS = "url string, read_id string, ts long, status string, result string"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_STATE = "ts long, status string, result string, taken long"


def _taking(minutes: int):
    """Work on the rows of one key: what waits under it, and when the last result that was taken had been put, are its state."""
    most = minutes * 60_000

    def work(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *waiting, taken = state.get if state.exists else (None,) * 4
        for chunk in rows:
            answers = []
            # Of one time, what is put comes before what is read.
            ordered = chunk.assign(_read=chunk["kind"] != "put").sort_values(["ts", "_read", "status", "result", "read_id"], kind="stable")
            for kind, ts, status, result, read_id in zip(*(ordered[c].tolist() for c in ("kind", "ts", "status", "result", "read_id"))):
                if kind == "put":
                    if (waiting[0] is None or ts >= waiting[0]) and (taken is None or ts > taken):
                        waiting = [ts, status, result]
                else:
                    there = waiting[0] is not None and 0 <= ts - waiting[0] <= most
                    answers.append((key[0], read_id, ts, *(waiting[1:] if there else (None, None))))
                    if there and waiting[1] in FINISHED:
                        taken, waiting = waiting[0], [None] * 3
            if answers:
                yield pd.DataFrame(answers, columns=["url", "read_id", "ts", "status", "result"])
        if waiting[0] is not None or taken is not None:
            state.update((*waiting, taken))
            # A key that nothing comes for is forgotten; until then a read looks at the age itself.
            state.setTimeoutDuration(most)

    return work


def answered(rows: DataFrame, minutes: int = TTL_MINUTES) -> DataFrame:
    """The answer to each read of the stream ``rows`` (:data:`ARRIVALS`), as :data:`ANSWERS`.

    A read gets what is stored under its url, if that was put no later than the read and at most ``minutes`` before it; a result that is
    finished is gone then.  Without one, status and result are null.  Of results under one url the last put counts; one put again
    with the time of a result that was taken, or an earlier one, as a repeated delivery is, isn't stored again.

    Rows without a time or of another kind are left out; a null url is the empty one.  The rows of a batch are
    taken in order of time within each Arrow batch of a key, so a key of very many rows stays in bounded memory.
    """
    known = rows.filter(F.col("kind").isin("put", "read") & F.col("ts").isNotNull()).withColumn("url", F.coalesce("url", F.lit("")))
    return known.groupBy("url").applyInPandasWithState(_taking(minutes), ANSWERS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def answer_stream(rows: DataFrame, path: str, checkpoint: str, minutes: int = TTL_MINUTES) -> StreamingQuery:
    """Write the answers to ``path``, each once; a restart with the same ``checkpoint`` goes on with what waits there.

    It ends when all that had arrived is answered.  Batches without rows are off for this stream, because for the sake of the
    timers Spark would go on with them for ever; a key is forgotten in the first batch with rows after its time.
    """
    conf = rows.sparkSession.conf
    held = conf.get(_EMPTY_BATCHES, "true")
    conf.set(_EMPTY_BATCHES, "false")
    try:
        return answered(rows, minutes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        # The stream has its own copy of the settings.
        conf.set(_EMPTY_BATCHES, held)
