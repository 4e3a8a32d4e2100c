"""Keyed results: the last write of a key, its time to live, and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: minutes that a result is kept.
TTL_MINUTES = 15


def cache_key(url: Column, prefix: str = "scan:") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(url, F.lit("")))


def latest_entries(rows: DataFrame, key: list[str], at: str = "ts", ties: list[str] = ()) -> DataFrame:
    """The row of the greatest ``at`` for each key; ``ties`` decide between equal times.

    An aggregate and not a window: a key with many writes is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(at, *[c for c in ties])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def fresh_entries(rows: DataFrame, now: Column, at: str = "ts", minutes: int = TTL_MINUTES) -> DataFrame:
    """Rows no older than ``minutes``; exactly that old still counts."""
    return rows.filter(F.col(at) >= now - F.make_dt_interval(mins=F.lit(minutes)))


def is_fresh_result(events: Column, ts: Column, started: Column) -> Column:
    return F.coalesce(events.isNotNull() & (ts >= started), F.lit(False))


def pending_selection(rows: DataFrame, now: Column, url: Column, seconds: int = 5) -> DataFrame:
    """A selection of the page at hand that is at most ``seconds`` old."""
    return rows.filter((F.col("url") == url) & (F.col("ts") >= now - F.make_dt_interval(secs=F.lit(seconds))))
