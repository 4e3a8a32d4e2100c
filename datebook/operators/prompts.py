"""Requests to a model as arrays of messages.  The system prompt is the caller's; no model is called here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "struct<role: string, content: string, parts: array<struct<type: string, text: string, url: string>>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).alias("parts")).cast(MESSAGE)


def event_context(now: Column, zone: Column, locale: Column, url: Column, title: Column, lang: Column, extra: Column) -> Column:
    """Context as a map; what the caller adds overrides the rest.  Null values are left out."""
    base = F.map_filter(F.create_map(*[x for k, v in (("nowUtc", now), ("tz", zone), ("locale", locale), ("pageUrl", url), ("pageTitle", title), ("pageLang", lang)) for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k)), extra)


def extraction_messages(system: Column, intro: Column, tables: Column, model_input: Column, images: Column) -> Column:
    """System and user messages, one for each table, the content, and the images in one message of parts."""
    tables, images = F.coalesce(tables, F.array().cast("array<string>")), F.coalesce(images, F.array().cast("array<string>"))
    none = F.array().cast(f"array<{MESSAGE}>")
    csv = F.concat(F.array(_message("user", F.lit("Tables of the page as CSV:"))), F.transform(tables, lambda t: _message("user", F.concat(F.lit("```csv\n"), t, F.lit("\n```")))))
    parts = F.concat(F.array(F.struct(F.lit("text").alias("type"), F.lit("Images to scan for events:").alias("text"), F.lit(None).cast("string").alias("url"))), F.transform(images, lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), u.alias("url"))))
    picture = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), parts.alias("parts")).cast(MESSAGE)
    return F.concat(
        F.array(_message("system", system), _message("user", intro)),
        F.when(F.size(tables) > 0, csv).otherwise(none),
        F.array(_message("user", F.lit("Page Content (Markdown/Text):")), _message("user", F.coalesce(model_input, F.lit("")))),
        F.when(F.size(images) > 0, F.array(picture)).otherwise(none),
    )


def message_chars(messages: Column) -> Column:
    """Characters of all contents: plain text, and of parts their text or else their JSON."""
    part = lambda p: F.length(F.coalesce(p["text"], F.to_json(p)))
    size = lambda m: F.length(F.coalesce(m["content"], F.lit(""))) + F.aggregate(F.coalesce(m["parts"], F.array().cast("array<struct<type: string, text: string, url: string>>")), F.lit(0), lambda n, p: n + part(p))
    return F.aggregate(messages, F.lit(0), lambda n, m: n + size(m))


def judge_request(expected: Column, extracted: Column) -> Column:
    """JSON for a judge: expected events without their labels and with their index, and the extracted ones."""
    listed = F.transform(expected, lambda e, i: F.struct(*[e[f].alias(f) for f in ("title", "date", "time", "location")], i.alias("expectedIndex")))
    return F.to_json(F.struct(listed.alias("expectedEvents"), extracted.alias("extractedEvents")))
