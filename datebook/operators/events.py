"""The event record: decoding, deduplication, time zones, past and upcoming, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from datebook.functions.text import escape_html, trim
from datebook.functions.times import convert_timezone, extract_timezone, format_date_time, is_event_past

FIELDS = ["title", "preview", "startDate", "startTime", "endDate", "endTime", "location", "description", "recurrence"]
EVENT = StructType([StructField(f, StringType()) for f in FIELDS])
_EVENTS = ArrayType(EVENT)


def _decoded(text: Column, single: bool) -> Column:
    """Events of one JSON text: an object with ``events``, a list, or with ``single`` one event; else null."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    listed = F.from_json(F.when(kind.startswith("ARRAY"), text), _EVENTS)
    inner = F.from_json(F.when(kind.startswith("OBJECT"), text), StructType([StructField("events", _EVENTS)]))["events"]
    lone = F.from_json(F.when(kind.startswith("OBJECT"), text), EVENT)
    out = F.when(kind.startswith("OBJECT<") & F.try_variant_get(value, "$.events[0]", "string").isNotNull(), inner).otherwise(F.coalesce(listed, inner))
    if single:
        out = F.coalesce(out, F.when((lone["title"] != "") & (lone["startDate"] != ""), F.array(lone)))
    return F.filter(out, lambda e: e.isNotNull())


def events_of_content(content: Column) -> Column:
    """Events of a message: JSON as it stands, else what stands in fences of code, else nothing."""
    fences = F.regexp_extract_all(content, F.lit(r"(?i)```(?:json)?\n([\s\S]*?)```"), F.lit(1))
    parts = F.when(F.size(fences) > 0, fences).otherwise(F.array(content))
    fallback = F.flatten(F.transform(parts, lambda p: F.coalesce(_decoded(trim(p), False), F.array().cast(_EVENTS))))
    valid = F.try_parse_json(content).isNotNull()
    return F.when(F.coalesce(content, F.lit("")) == "", F.array().cast(_EVENTS)).when(valid, F.coalesce(_decoded(content, True), F.array().cast(_EVENTS))).otherwise(fallback)


def events_of_response(df: DataFrame, response_col: str, out: str = "events") -> DataFrame:
    """``df`` with the events of all choices of a response (JSON text), in order."""
    schema = StructType([StructField("choices", ArrayType(StructType([StructField("message", StructType([StructField("content", StringType())]))])))])
    choices = F.coalesce(F.from_json(response_col, schema)["choices"], F.array().cast(schema["choices"].dataType))
    return df.withColumn(out, F.flatten(F.transform(choices, lambda c: events_of_content(c["message"]["content"]))))


def dedupe_key() -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(F.lower(trim(text("title"))).alias("title"), *[text(c).alias(c) for c in ("startDate", "startTime", "endDate", "endTime")], F.lower(trim(text("location"))).alias("location"))


def dedupe_events(events: DataFrame, batch: list[str], order: str = "pos") -> DataFrame:
    """The first event of each key in its batch, by ``order``; rows without any field are dropped.

    The key is a struct, so no character in a title can make two keys one.
    """
    first = Window.partitionBy(*batch, "_key").orderBy(order)
    some = events.filter(F.coalesce(*[F.col(c) for c in FIELDS if c in events.columns]).isNotNull())
    return some.withColumn("_key", dedupe_key()).withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_key", "_rank")


def in_user_zone(events: DataFrame, target: str) -> DataFrame:
    """Start and end moved to ``target`` where their time names a zone; an end without one stays as it is.

    An end without a date uses the start's date as it was, and gets a date when it is moved.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    start, end = extract_timezone(F.col("startTime")), extract_timezone(F.col("endTime"))
    end_date = F.when(given("endDate"), F.col("endDate")).otherwise(F.col("startDate"))
    moved = events.withColumn("_s", F.when(given("startTime") & start["timezone"].isNotNull(), convert_timezone(F.col("startDate"), start["cleanTime"], start["timezone"], target)))
    moved = moved.withColumn("_e", F.when(given("endTime") & end["timezone"].isNotNull(), convert_timezone(end_date, end["cleanTime"], end["timezone"], target)))
    return moved.withColumns({
        "startDate": F.coalesce("_s.date", "startDate"), "startTime": F.when(given("startTime"), F.coalesce("_s.time", start["cleanTime"])).otherwise(F.col("startTime")),
        "endDate": F.coalesce("_e.date", "endDate"), "endTime": F.when(given("endTime"), F.coalesce("_e.time", end["cleanTime"])).otherwise(F.col("endTime")),
    }).drop("_s", "_e")


def with_past(events: DataFrame, now: Column) -> DataFrame:
    """``events`` with boolean ``past``; the order and index of the list stay what they are."""
    return events.withColumn("past", is_event_past(F.struct("startDate", "startTime", "endDate", "endTime"), now))


def event_cards(events: DataFrame, clock: str = "12") -> DataFrame:
    """What a list shows of each event, escaped for HTML."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    title = F.coalesce(text("title"), F.lit("Untitled"))
    return events.select(
        "*",
        escape_html(F.coalesce(text("preview"), title)).alias("card_title"),
        escape_html(title).alias("card_full_title"),
        escape_html(format_date_time(F.col("startDate"), F.col("startTime"), clock)).alias("card_start"),
        escape_html(format_date_time(F.coalesce(text("endDate"), F.col("startDate")), F.col("endTime"), clock)).alias("card_end"),
        escape_html(F.coalesce("location", F.lit(""))).alias("card_location"),
        (F.coalesce("recurrence", F.lit("")) != "").alias("card_recurs"),
    )
