"""Whether extracted events are the expected ones, and what a judge's verdict comes to for each page.

Events are flat rows: ``page``, ``pos`` (the place in the page's list), and texts.  An expected event has ``title, date, time,
location``; an extracted one ``title, startDate, startTime, endDate, endTime`` and the others of
:data:`SEARCHED`.  All texts are parsed once a row, before rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datebook.functions import judging
from datebook.functions.text import blank_to_null, normalize_judge_text, normalize_judge_title, trim

#: What an extracted event is searched in, in this order.
SEARCHED = ["title", "preview", "startDate", "startTime", "endDate", "endTime", "location", "description", "recurrence", "category"]


def search_text(columns: list[str]) -> Column:
    """The non-empty ones of the searched columns that there are, joined by spaces."""
    return F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in SEARCHED if c in columns])


def parsed_expected(expected: DataFrame) -> DataFrame:
    """``page, pos, title_key`` and the parse of date and time; blank fields are null and match anything."""
    field = lambda c: blank_to_null(trim(F.col(c)))
    rows = expected.select("page", "pos", normalize_judge_title(F.col("title")).alias("title_key"), normalize_judge_text(field("date")).alias("date"), field("time").alias("time"), normalize_judge_text(field("time")).alias("time_text"), normalize_judge_text(field("location")).alias("location"))
    rows = rows.withColumns({c: blank_to_null(F.col(c)) for c in ("date", "time_text", "location")})
    date, time = F.col("date"), F.col("time")
    yearless = F.when(~judging.has_explicit_year(date), judging.month_day(date))
    return rows.withColumns({
        "dates": judging.date_range(date), "spans_dates": F.coalesce(judging.looks_like_date_range(date), F.lit(False)), "month_day": yearless, "date_key": judging.date_key(date),
        "times": judging.time_range(time), "spans_times": judging.looks_like_time_range(time), "minute": judging.single_time(time),
    })


def parsed_extracted(extracted: DataFrame) -> DataFrame:
    """``page, pos, title_key`` and the parse of both dates and times, and the text that is searched."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("startDate", "endDate", "startTime", "endTime")}
    rows = extracted.select(
        "page", F.col("pos").alias("found_pos"), normalize_judge_title(F.col("title")).alias("title_key"), texts["startTime"].alias("start"), texts["endTime"].alias("end"),
        *[normalize_judge_text(texts[c]).alias(k) for c, k in (("startDate", "start_date"), ("endDate", "end_date"), ("startTime", "start_text"), ("endTime", "end_text"))],
        normalize_judge_text(F.concat_ws(" ", *[blank_to_null(texts[c]) for c in ("startTime", "endTime")])).alias("range_text"), normalize_judge_text(search_text(extracted.columns)).alias("searched"),
    )
    start, end = F.col("start"), F.col("end")
    plain = (start != "") & (end != "") & judging.time_range(start).isNull() & judging.time_range(end).isNull()
    return rows.withColumns({
        "start_key": judging.date_key(F.col("start_date")), "end_key": judging.date_key(F.col("end_date")), "start_minute": judging.single_time(start), "end_minute": judging.single_time(end),
        "found_times": F.when(plain, judging.time_range(F.concat(start, F.lit(" - "), end))),
    }).drop("start", "end", "start_date", "end_date")


def _part_fits(key: Column, part: Column) -> Column:
    """A date against an end of a range; an end without a year is compared by month and day."""
    return F.coalesce(F.when(F.length(part) == 5, F.substring(key, 6, 5) == part).otherwise(key == part), F.lit(False))


def date_fits() -> Column:
    """By the columns of :func:`parsed_expected` and :func:`parsed_extracted`; a range needs both ends."""
    start, end, date = F.col("start_key"), F.col("end_key"), F.col("date")
    either = lambda test: F.coalesce(test(start), F.lit(False)) | F.coalesce(test(end), F.lit(False))
    both = _part_fits(start, F.col("dates.start")) & _part_fits(end, F.col("dates.end"))
    by_day = either(lambda k: F.substring(k, 6, 5) == F.col("month_day"))
    by_key = F.when(F.col("date_key").isNull(), F.contains("searched", date)).otherwise(either(lambda k: k == F.col("date_key")))
    return F.when(date.isNull(), True).when(F.col("spans_dates"), both).otherwise(by_day | by_key)


def time_fits() -> Column:
    """A range of times needs both ends; a single time is the event's start or its end; other texts are searched for."""
    text, times = F.col("time_text"), F.col("times")
    range_fits = F.coalesce((F.col("found_times.start") == times["start"]) & (F.col("found_times.end") == times["end"]), F.lit(False))
    single = F.coalesce(F.col("start_minute") == F.col("minute"), F.lit(False)) | F.coalesce(F.col("end_minute") == F.col("minute"), F.lit(False))
    held = lambda c: (F.col(c) != "") & F.contains(text, F.col(c))
    told = held("start_text") | held("end_text") | held("range_text") | F.contains("searched", text)
    return F.when(F.col("time").isNull(), True).when(times.isNotNull(), range_fits).when(F.col("spans_times"), False).when(F.col("minute").isNotNull(), single).otherwise(told)


def matched_events(expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """``page, pos`` of expected events that an extracted event of the page matches in title, date, time and place.

    An equi-join on page and title proposes, the parsed columns decide; so a page or a title that very many events have is a
    skewed key of a sort-merge join, which Spark splits.  Events without a title match nothing.
    """
    wanted = parsed_expected(expected).filter("title_key <> ''")
    found = parsed_extracted(extracted).filter("title_key <> ''")
    placed = F.coalesce(F.contains("searched", F.col("location")), F.lit(True))
    return wanted.join(found, ["page", "title_key"]).filter(date_fits() & time_fits() & placed).select("page", "pos").distinct()


def resolved(answers: DataFrame, expected: DataFrame, counts: DataFrame) -> DataFrame:
    """``answers`` (``page, expectedIndex, expectedTitle`` and others) with ``pos``, the expected event that is meant.

    A valid index counts, else the last expected event of that title; null if there is neither.
    """
    last = expected.select("page", normalize_judge_title(F.col("title")).alias("title_key"), "pos").filter("title_key <> ''").groupBy("page", "title_key").agg(F.max("pos").alias("by_title"))
    keyed = answers.withColumn("title_key", normalize_judge_title(F.col("expectedTitle"))).join(counts.select("page", "expected_count"), "page").join(last, ["page", "title_key"], "left")
    index = F.col("expectedIndex")
    return keyed.withColumn("pos", F.coalesce(F.when((index >= 0) & (index < F.col("expected_count")), index), "by_title")).drop("title_key", "by_title", "expected_count")


def judge_verdicts(pages: DataFrame, expected: DataFrame, extracted: DataFrame) -> DataFrame:
    """``page, passed, matches, misses, hallucinations`` for each of ``pages``.

    ``pages`` has ``page, exhaustive, expected_count`` and ``verdict`` (``passed, matches, misses, hallucinations``, the lists of structs as a judge
    answers).  Where events are expected, matches are the distinct ones that the judge names, with what it has
    extracted, and those that an extracted event matches; misses are the others that it names, and at least what
    is lacking.  Otherwise its lists are counted.  Null verdicts and lists are empty; a page without rows of events expects
    ``expected_count`` of them.  Hallucinations count against a page only if its expectations are exhaustive.
    """
    listed = F.coalesce("n_expected", F.lit(0))
    counted = pages.join(expected.groupBy("page").agg(F.count("*").cast("int").alias("n_expected")), "page", "left")
    counted = counted.select("page", "exhaustive", "verdict", listed.alias("n_expected"), F.when(listed > 0, listed).otherwise(F.coalesce("expected_count", F.lit(0))).alias("expected_count"))
    said = lambda c: counted.select("page", F.explode(f"verdict.{c}").alias("a"))
    hits = said("matches").filter("a.extractedTitle <> ''").select("page", "a.expectedIndex", "a.expectedTitle", F.lit(True).alias("hit"))
    lacks = said("misses").select("page", "a.expectedIndex", "a.expectedTitle", F.lit(False).alias("hit"))
    named = resolved(hits.union(lacks), expected, counted).filter("pos IS NOT NULL").select("page", "pos", "hit")
    events = named.union(matched_events(expected, extracted).withColumn("hit", F.lit(True))).groupBy("page", "pos").agg(F.max("hit").alias("hit"))
    sums = events.groupBy("page").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("lacks"))

    size = lambda c: F.greatest(F.coalesce(F.size(f"verdict.{c}"), F.lit(0)), F.lit(0))
    by_event = F.col("n_expected") > 0
    rows = counted.join(sums, "page", "left").withColumns({
        "matches": F.when(by_event, F.coalesce("hits", F.lit(0))).otherwise(size("matches")).cast("long"), "named": F.when(by_event, F.coalesce("lacks", F.lit(0))).otherwise(size("misses")).cast("long"), "hallucinations": size("hallucinations").cast("long"),
    })
    rows = rows.withColumn("misses", F.when((F.col("expected_count") > 0), F.greatest("named", F.col("expected_count") - F.col("matches"))).otherwise(F.col("named")))
    whole = F.when(F.col("expected_count") > 0, F.col("matches") >= F.col("expected_count")).otherwise(F.coalesce("verdict.passed", F.lit(False)))
    clean = ~F.coalesce("exhaustive", F.lit(False)) | (F.col("hallucinations") == 0)
    return rows.select("page", ((F.col("misses") == 0) & clean & whole).alias("passed"), "matches", "misses", "hallucinations")
