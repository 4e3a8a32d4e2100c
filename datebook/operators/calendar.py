"""Events as calendar links and iCalendar texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datebook.functions.patterns import S
from datebook.functions.text import let
from datebook.functions.times import to_wall_time

CRLF = "\r\n"
LINK = "https://calendar.google.com/calendar/u/0/r/eventedit?"
PRODUCT = "-//datebook//EN"


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _all_day() -> Column:
    return ~_given("startTime") & ~_given("endTime")


def start_time() -> Column:
    return to_wall_time(F.col("startDate"), F.col("startTime"))


def _explicit_end() -> Column:
    return to_wall_time(F.when(_given("endDate"), F.col("endDate")).otherwise(F.col("startDate")), F.col("endTime"))


def _days(x: Column, n: int) -> Column:
    return x + F.make_dt_interval(days=F.lit(n))


def _hours(x: Column, n: int) -> Column:
    return x + F.make_dt_interval(hours=F.lit(n))


def link_end() -> Column:
    """An explicit end after the start counts; else an hour for a start alone, a day for all day; else the end as it is."""

    def resolved(t: Column) -> Column:
        start, end = t["start"], t["end"]
        return F.when(end > start, F.when(_all_day(), _days(end, 1)).otherwise(end)).when(_given("startTime") & ~_given("endTime"), _hours(start, 1)).when(_all_day(), _days(start, 1)).otherwise(end)

    return let(F.struct(start_time().alias("start"), _explicit_end().alias("end")), resolved)


def _stamp(x: Column, all_day: Column) -> Column:
    return F.when(all_day, F.date_format(x, "yyyyMMdd")).otherwise(F.date_format(x, "yyyyMMdd'T'HHmmss"))


def link_dates() -> Column:
    """``start/end`` of a link, or null without a usable start and end."""
    both = F.struct(start_time().alias("start"), link_end().alias("end"))
    return let(both, lambda t: F.concat(_stamp(t["start"], _all_day()), F.lit("/"), _stamp(t["end"], _all_day())))


def calendar_link(zone: str | None = None) -> Column:
    """A link that opens the event in a calendar; blank fields are left out."""
    pairs = [("text", "title"), ("location", "location"), ("details", "description")]
    parts = [F.when(_given(c), F.concat(F.lit(f"{k}="), F.url_encode(c))) for k, c in pairs]
    parts.append(F.concat(F.lit("dates="), F.url_encode(link_dates())))
    parts.append(F.when(_given("recurrence"), F.concat(F.lit("recur="), F.url_encode(F.concat(F.lit("RRULE:"), "recurrence")))))
    parts.append(F.concat(F.lit("ctz="), F.url_encode(F.lit(zone))) if zone else F.lit(None).cast("string"))
    return F.concat(F.lit(LINK), F.concat_ws("&", *parts))


def escape_ics(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"), ("\r", "")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def fold_line(x: Column) -> Column:
    """Lines of 75 characters; those after the first start with a space."""
    rest = F.regexp_replace(F.substring(x, 76, 1 << 30), r"(?s)(.{74})(?=.)", "$1\r\n ")
    return F.when(F.length(x) <= 75, x).otherwise(F.concat(F.substring(x, 1, 75), F.lit(CRLF + " "), rest))


def vevent(uid: Column, stamp: Column) -> Column:
    """Lines of the event, or an empty list without a usable start; an end that can't be read is left out."""
    last = to_wall_time(F.col("endDate"), F.lit(None).cast("string"))
    line = lambda name, x: let(F.concat(F.lit(name + ":"), x), fold_line)

    def lines(start: Column) -> Column:
        day_end = let(last, lambda d: F.when(d > start, _days(d, 1)).otherwise(_days(start, 1)))
        end = F.when(_given("endTime"), _explicit_end()).otherwise(_hours(start, 1))
        whole = F.array(F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(start, "yyyyMMdd")), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(day_end, "yyyyMMdd")))
        timed = F.array(F.concat(F.lit("DTSTART:"), F.date_format(start, "yyyyMMdd'T'HHmmss")), F.concat(F.lit("DTEND:"), F.date_format(end, "yyyyMMdd'T'HHmmss")))
        head = F.array(F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")), F.when(_given("title"), line("SUMMARY", escape_ics(F.col("title")))))
        tail = F.array(F.when(_given("location"), line("LOCATION", escape_ics(F.col("location")))), F.when(_given("description"), line("DESCRIPTION", escape_ics(F.col("description")))), F.when(_given("recurrence"), line("RRULE", F.col("recurrence"))), F.lit("END:VEVENT"))
        return F.when(start.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.concat(head, F.when(_all_day(), whole).otherwise(timed), tail)))

    return let(start_time(), lines)


def vcalendar(lines: Column, product: str = PRODUCT) -> Column:
    """An iCalendar text around the lines of one or more events; null without any."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:{product}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH"]
    return F.when(F.size(lines) > 0, F.array_join(F.concat(F.array(*map(F.lit, head)), lines, F.array(F.lit("END:VCALENDAR"))), CRLF))


def ics_file_name() -> Column:
    title = F.when(_given("title"), F.col("title")).otherwise("event")
    safe = F.substring(F.regexp_replace(F.regexp_replace(title, r"[^a-zA-Z0-9\t\n\x0B\f\r _-]", ""), rf"{S}+", "_"), 1, 50)
    return F.concat(safe, F.lit("_"), F.replace(F.coalesce("startDate", F.lit("")), F.lit("-"), F.lit("")), F.lit(".ics"))


def exports(events: DataFrame, kind: str, uid: Column, stamp: Column, zone: str | None = None) -> DataFrame:
    """What is written for each event: an iCalendar text for ``icloud``, a link for anything else."""
    if kind == "icloud":
        return events.select("*", ics_file_name().alias("name"), vcalendar(vevent(uid, stamp)).alias("content")).filter("content IS NOT NULL")
    return events.select("*", F.lit(None).cast("string").alias("name"), calendar_link(zone).alias("content"))


def write_exports(rows: DataFrame, path: str) -> None:
    """One text a row, by kind of content; empty lines of an iCalendar text are its own line ends."""
    rows.select("content").write.mode("overwrite").text(path, lineSep="\n\n")
