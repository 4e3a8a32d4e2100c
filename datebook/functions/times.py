"""Dates and times of events, which are strings until a calendar needs them.

Wall times are ``timestamp_ntz`` throughout, so no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datebook.functions.patterns import ZONES, S
from datebook.functions.text import let, trim

_CLOCK = rf"([0-9]{{1,2}})(?::([0-9]{{2}}))?(?::([0-9]{{2}}))?{S}*([AaPp])[Mm]"


def _int(x: Column) -> Column:
    return x.try_cast("int")


def leading_int(x: Column) -> Column:
    """The number that a text starts with, after white space; else null."""
    return _int(F.regexp_extract(x, rf"^{S}*([+-]?[0-9]+)", 1))


def parse_time(x: Column) -> Column:
    """Struct of hours, minutes, seconds, or null.

    A clock time with AM or PM anywhere in the text comes first, else what is between colons.  There is
    no check of ranges: ``13 PM`` is hour 25.
    """

    def by_clock(g: Column) -> Column:
        hour, half = g["hour"], g["half"]
        hour = F.when((half == "p") & (hour != 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
        return F.struct(hour.alias("hours"), F.coalesce(g["minute"], F.lit(0)).alias("minutes"), F.coalesce(g["second"], F.lit(0)).alias("seconds"))

    def by_colon(parts: Column) -> Column:
        third = F.coalesce(F.get(parts, 2), F.lit(""))
        found = F.struct(leading_int(F.get(parts, 0)).alias("hours"), leading_int(F.get(parts, 1)).alias("minutes"), F.when(third == "", 0).otherwise(leading_int(third)).alias("seconds"))
        return let(found, lambda n: F.when((F.size(parts) >= 2) & n["hours"].isNotNull() & n["minutes"].isNotNull() & n["seconds"].isNotNull(), n))

    def parsed(t: Column) -> Column:
        group = lambda k: F.regexp_extract(t, _CLOCK, k)
        groups = F.struct(_int(group(1)).alias("hour"), _int(group(2)).alias("minute"), _int(group(3)).alias("second"), F.lower(group(4)).alias("half"))
        return F.when(t.rlike(_CLOCK), let(groups, by_clock)).otherwise(let(F.split(t, ":", -1), by_colon))

    return let(trim(x), parsed)


def extract_timezone(x: Column) -> Column:
    """Struct of the zone that a trailing abbreviation names, or null, and the time without it."""
    match = rf"(?i)^(.+?){S}+([a-z]{{2,5}}){S}*\z"
    known = F.create_map(*[F.lit(v) for pair in ZONES.items() for v in pair])
    zone = F.try_element_at(known, F.upper(F.regexp_extract(x, match, 2)))
    return let(zone, lambda z: F.struct(z.alias("timezone"), F.when(z.isNotNull(), trim(F.regexp_extract(x, match, 1))).otherwise(trim(F.coalesce(x, F.lit("")))).alias("cleanTime")))


def convert_timezone(date: Column, time: Column, source: Column, target: str | Column) -> Column:
    """Struct of date and ``HH:mm`` in ``target``; the input where anything about it is not as expected.

    In the hour that a clock skips the later offset's time is meant, in the hour that it repeats the
    earlier offset's; that is Spark's own rule.
    """
    target = F.lit(target) if isinstance(target, str) else target

    def wall(at: Column) -> Column:
        fits = at["hours"].between(0, 23) & at["minutes"].between(0, 59) & date.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z")
        return F.try_to_timestamp(F.when(fits, F.format_string("%s %02d:%02d", date, at["hours"], at["minutes"])), F.lit("yyyy-M-d HH:mm")).cast("timestamp_ntz")

    given = F.struct(date.alias("date"), time.alias("time"))
    moved = F.convert_timezone(source, target, let(parse_time(time), wall))
    shown = let(moved, lambda m: F.when(m.isNotNull(), F.struct(F.date_format(m, "yyyy-MM-dd").alias("date"), F.date_format(m, "HH:mm").alias("time"))))
    return F.when((source == target) | (time == ""), given).otherwise(F.coalesce(shown, given))


def is_event_past(event: Column, now: Column) -> Column:
    """Whether the event's end, else its start, lies before ``now`` (timestamp_ntz).

    Without a time the day's last millisecond counts.  Without a usable date it is not past.  A time
    without a colon gives the hour as it stands: ``7 PM`` is seven in the morning here.
    """
    date = F.coalesce(F.when(event["endDate"] != "", event["endDate"]), F.when(event["startDate"] != "", event["startDate"]))
    time = F.coalesce(F.when(event["endTime"] != "", event["endTime"]), F.when(event["startTime"] != "", event["startTime"]), F.lit(""))
    day = F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    clock = rf"([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{S}*([AaPp][Mm])?"

    def seconds(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, clock, k)

        def by_clock(g: Column) -> Column:
            hour = F.when((g["half"] == "PM") & (g["hour"] != 12), g["hour"] + 12).when((g["half"] == "AM") & (g["hour"] == 12), 0).otherwise(g["hour"])
            return hour * 3600 + g["minute"] * 60 + F.coalesce(g["second"], F.lit(0))

        groups = F.struct(_int(part(1)).alias("hour"), _int(part(2)).alias("minute"), _int(part(3)).alias("second"), F.upper(part(4)).alias("half"))
        plain = let(F.split(trim(t), ":", -1), lambda p: leading_int(F.get(p, 0)) * 3600 + F.when(F.size(p) == 1, 0).otherwise(leading_int(F.get(p, 1))) * 60)
        return F.when(t.rlike(clock), let(groups, by_clock)).when(t != "", plain)

    late = F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")
    end = day + F.coalesce(F.make_dt_interval(secs=let(time, seconds)), late)
    return F.coalesce(end < now, F.lit(False))


def format_date_time(date: Column, time: Column, clock: str = "12") -> Column:
    """``Jun 26, 2026 7:30 PM`` or with a 24-hour clock; text that isn't a date stays; no date is empty."""
    date, time = F.coalesce(date, F.lit("")), F.coalesce(time, F.lit(""))
    day = F.when(date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), date)
    at = F.when(time.rlike(r"^[0-9]{2}:[0-9]{2}(:[0-9]{2})?\z"), F.substring(time, 1, 5))
    stamp = F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(time == "", "00:00").otherwise(at)), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    raw = F.when(time == "", date).otherwise(F.concat(date, F.lit(" "), time))
    hours = "MMM dd, yyyy h:mm a" if clock == "12" else "MMM dd, yyyy HH:mm"
    shown = let(stamp, lambda s: F.when(time == "", F.date_format(s, "MMM dd, yyyy")).otherwise(F.date_format(s, hours)))
    return F.when(date == "", "").otherwise(F.coalesce(shown, raw))


def to_wall_time(date: Column, time: Column) -> Column:
    """``timestamp_ntz`` of a date and a time of 24 or 12 hours; midnight without a time; else null."""

    def clock(at: Column) -> Column:
        fits = at["hours"].between(0, 23) & at["minutes"].between(0, 59) & at["seconds"].between(0, 59)
        return F.when(fits, F.format_string("%02d:%02d:%02d", at["hours"], at["minutes"], at["seconds"]))

    text = F.when(F.coalesce(time, F.lit("")) == "", "00:00:00").otherwise(let(parse_time(time), clock))
    day = F.when(date.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), date)
    return F.try_to_timestamp(F.concat(day, F.lit(" "), text), F.lit("yyyy-M-d HH:mm:ss")).cast("timestamp_ntz")
