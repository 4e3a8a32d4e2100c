"""Inputs derived from the tables, the same in Spark and in SQL.

The tables hold no dates or times in their texts, so operators that look for them get these: they are
made inputs, not native data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew to all cores.

    How many partitions a scan has doesn't tell where its rows are: a file of one row group is cut into many, and all but one are empty.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


#: Blocks before the text of a document, by its id modulo their number.
LEADS = [
    "Jazz Night\n\nFriday, March 3, 2026 7:30 PM\n\nRoom 5, Main Street",
    "Subscribe to our newsletter\n\nOpen class\n\nMar\n\n5\n\nDoors at 18:00",
    "Plain words",
    "Workshop registration\n\n2026-04-12 9am\n\nCity Hall",
    "[a](u) [b](v) [c](w) [d](x)\n\nCookie settings\n\n- March 5 to March 7, live music",
]
#: How often the first lead stands again after the text of a seventh of the documents.
REPEATS = 100


def signal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, text``: documents between blocks that speak of events."""
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("doc_id") % len(LEADS)).cast("int") + 1)
    again = F.when(F.col("doc_id") % 7 == 0, F.array_join(F.array_repeat(F.lit(LEADS[0] + "\n\nand so on"), REPEATS), "\n\n")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat_ws("\n\n", lead, F.coalesce("text", F.lit("")), again).alias("text"))


def _sql(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


SIGNAL_DOCS_SQL = (
    "signal_docs AS (SELECT doc_id, lang, source, (CASE doc_id % 5 "
    + " ".join(f"WHEN {i} THEN {_sql(x)}" for i, x in enumerate(LEADS))
    + " END) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN repeat("
    + _sql(LEADS[0] + "\n\nand so on\n\n")
    + f", {REPEATS}) ELSE '' END AS text FROM documents)"
)


def cal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each row of ``events``: times in five styles, ends, places and repeats by its numbers."""
    rows = spread(table(spark, sf_dir, "events"))
    n, at = F.col("event_id"), F.col("ts")
    style = n % 5
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.when(style == 0, F.date_format(at, "h:mm a")).when(style == 1, F.date_format(at, "HH:mm")).when(style == 2, F.concat(F.date_format(at, "h:mm a"), F.lit(" ET"))).when(style == 3, F.concat(F.date_format(at, "HH:mm"), F.lit(" CET")))
    later = at + F.expr("INTERVAL '90' MINUTE")
    end = F.when((style <= 1) & (n % 2 == 0), F.date_format(later, "HH:mm")).when((style == 2) & (n % 4 == 0), F.concat(F.date_format(later, "h:mm a"), F.lit(" PST")))
    return rows.select(
        F.col("user_id").alias("user_id"),
        n.alias("pos"),
        F.concat(F.when(n % 3 == 0, " ").otherwise(""), F.initcap("event_type"), F.lit(", "), (F.col("user_id") % 9).cast("string")).alias("title"),
        F.lit(None).cast("string").alias("preview"),
        F.date_format(at, "yyyy-MM-dd").alias("startDate"),
        start.alias("startTime"),
        F.when(n % 6 == 0, F.date_format(F.date_add(at.cast("date"), (n % 3).cast("int")), "yyyy-MM-dd")).alias("endDate"),
        end.alias("endTime"),
        F.when(k % 4 != 0, F.concat(F.lit("Room "), (k % 7).cast("string"), F.lit("; Hall"))).alias("location"),
        F.when(n % 2 == 0, F.array_join(F.array_repeat(F.concat(F.lit("see, "), "event_type", F.lit(" \\ of the day\n")), (n % 5).cast("int") + 1), "")).alias("description"),
        F.when(n % 10 == 0, "FREQ=WEEKLY").alias("recurrence"),
    )


CAL_EVENTS_SQL = r"""
cal_events AS (SELECT user_id, event_id AS pos,
  (CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END) || upper(event_type[1]) || lower(event_type[2:]) || ', ' || CAST(user_id % 9 AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS preview,
  strftime(ts, '%Y-%m-%d') AS "startDate",
  CASE event_id % 5 WHEN 0 THEN strftime(ts, '%-I:%M %p') WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN strftime(ts, '%-I:%M %p') || ' ET' WHEN 3 THEN strftime(ts, '%H:%M') || ' CET' END AS "startTime",
  CASE WHEN event_id % 6 = 0 THEN strftime(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER), '%Y-%m-%d') END AS "endDate",
  CASE WHEN event_id % 5 <= 1 AND event_id % 2 = 0 THEN strftime(ts + INTERVAL 90 MINUTE, '%H:%M') WHEN event_id % 5 = 2 AND event_id % 4 = 0 THEN strftime(ts + INTERVAL 90 MINUTE, '%-I:%M %p') || ' PST' END AS "endTime",
  CASE WHEN CAST(props->>'$.k' AS INTEGER) % 4 <> 0 THEN 'Room ' || CAST(CAST(props->>'$.k' AS INTEGER) % 7 AS VARCHAR) || '; Hall' END AS location,
  CASE WHEN event_id % 2 = 0 THEN repeat('see, ' || event_type || ' \ of the day' || chr(10), CAST(event_id % 5 + 1 AS INTEGER)) END AS description,
  CASE WHEN event_id % 10 = 0 THEN 'FREQ=WEEKLY' END AS recurrence FROM events)
"""
