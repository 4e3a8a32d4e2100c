"""Queries over calendar events derived from ``events``, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.functions.times import convert_timezone, extract_timezone, format_date_time, parse_time
from datebook.operators import calendar, events
from datebook.plans.derived import CAL_EVENTS_SQL, cal_events, table

ZONE = "America/Los_Angeles"
NOW = datetime(2024, 1, 15, 12, 0)


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parse_time(F.col("startTime"))
    return cal_events(spark, sf_dir).select("pos", *[t[k].cast("long").alias(k) for k in ("hours", "minutes", "seconds")])


_CLOCK = r"([0-9]{1,2})(?::([0-9]{2}))?(?::([0-9]{2}))?\s*([AaPp])[Mm]"


def _time_sql(column: str) -> str:
    """hours, minutes and seconds of a column, by the clock or by colons."""
    g = lambda k: f"regexp_extract({column}, '{_CLOCK}', {k})"
    p = lambda k: f"TRY_CAST(regexp_extract(split_part({column}, ':', {k}), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT)"
    hour = f"CAST({g(1)} AS BIGINT)"
    return (
        f"CASE WHEN {g(4)} ILIKE 'p' AND {hour} <> 12 THEN {hour} + 12 WHEN {g(4)} ILIKE 'a' AND {hour} = 12 THEN 0 WHEN {g(4)} <> '' THEN {hour} WHEN contains({column}, ':') THEN {p(1)} END AS hours, "
        f"CASE WHEN {g(4)} <> '' THEN coalesce(TRY_CAST({g(2)} AS BIGINT), 0) WHEN contains({column}, ':') THEN {p(2)} END AS minutes, "
        f"CASE WHEN {g(4)} <> '' THEN coalesce(TRY_CAST({g(3)} AS BIGINT), 0) WHEN contains({column}, ':') THEN coalesce({p(3)}, 0) END AS seconds"
    )


PARSE_TIMES_SQL = f'WITH {CAL_EVENTS_SQL} SELECT pos, {_time_sql(chr(34) + "startTime" + chr(34))} FROM cal_events'


def tz_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_timezone(F.col("startTime"))
    return cal_events(spark, sf_dir).select("pos", x["timezone"].alias("timezone"), x["cleanTime"].alias("clean_time"))


_ZONES_SQL = "CASE {z} WHEN 'ET' THEN 'America/New_York' WHEN 'CET' THEN 'Europe/Paris' WHEN 'PST' THEN 'America/Los_Angeles' END"


def _zone_sql(column: str) -> str:
    return _ZONES_SQL.format(z=f"regexp_extract({column}, '\\s([A-Z]{{2,5}})$', 1)")


def _clean_sql(column: str) -> str:
    return f"CASE WHEN {_zone_sql(column)} IS NOT NULL THEN regexp_extract({column}, '^(.+?)\\s+[A-Z]{{2,5}}$', 1) ELSE coalesce({column}, '') END"


TZ_EXTRACT_SQL = f'WITH {CAL_EVENTS_SQL} SELECT pos, {_zone_sql(chr(34) + "startTime" + chr(34))} AS timezone, {_clean_sql(chr(34) + "startTime" + chr(34))} AS clean_time FROM cal_events'


def tz_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = events.in_user_zone(cal_events(spark, sf_dir), ZONE)
    return moved.select("pos", "startDate", "startTime", "endDate", "endTime")


def _moved_sql(prefix: str, date: str, time: str, target: str) -> str:
    """Wall time in the target zone, null where the time names no zone or the zone is the target."""
    clean, zone = _clean_sql(time), _zone_sql(time)
    stamp = f"COALESCE(TRY_STRPTIME({date} || ' ' || {clean}, '%Y-%m-%d %-I:%M %p'), TRY_STRPTIME({date} || ' ' || {clean}, '%Y-%m-%d %H:%M'))"
    return f"CASE WHEN {zone} <> '{target}' THEN timezone('{target}', timezone({zone}, {stamp})) END AS {prefix}_at"


TZ_CONVERT_SQL = f"""WITH {CAL_EVENTS_SQL}, moved AS (SELECT *, {_moved_sql('s', '"startDate"', '"startTime"', ZONE)}, {_moved_sql('e', 'coalesce("endDate", "startDate")', '"endTime"', ZONE)} FROM cal_events)
SELECT pos, coalesce(strftime(s_at, '%Y-%m-%d'), "startDate") AS "startDate", CASE WHEN "startTime" IS NOT NULL THEN coalesce(strftime(s_at, '%H:%M'), {_clean_sql('"startTime"')}) END AS "startTime",
CASE WHEN {_zone_sql('"endTime"')} = '{ZONE}' THEN coalesce("endDate", "startDate") ELSE coalesce(strftime(e_at, '%Y-%m-%d'), "endDate") END AS "endDate", CASE WHEN "endTime" IS NOT NULL THEN coalesce(strftime(e_at, '%H:%M'), {_clean_sql('"endTime"')}) END AS "endTime" FROM moved"""


#: Added to the place of an event that stands a second time.
AGAIN = 1_000_000_000


def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event twice, the second time in other case and between blanks; the whole key is compared."""
    rows = cal_events(spark, sf_dir)
    again = rows.withColumns({"pos": F.col("pos") + AGAIN, "title": F.concat(F.lit("  "), F.upper("title")), "location": F.concat(F.upper("location"), F.lit(" "))})
    return events.dedupe_events(rows.union(again), ["user_id"]).select("user_id", "pos", "title", "startDate", "startTime", "endDate", "endTime", "location")


DEDUPE_SQL = f"""WITH {CAL_EVENTS_SQL}, twice AS (SELECT user_id, pos, title, "startDate", "startTime", "endDate", "endTime", location FROM cal_events
UNION ALL SELECT user_id, pos + {AGAIN}, '  ' || upper(title), "startDate", "startTime", "endDate", "endTime", upper(location) || ' ' FROM cal_events)
SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY user_id, lower(trim(title)), "startDate", coalesce("startTime", ''), coalesce("endDate", ''), coalesce("endTime", ''), lower(trim(coalesce(location, ''))) ORDER BY pos) = 1"""


def past_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.with_past(cal_events(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return rows.groupBy("past").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


PAST_SQL = f"""WITH {CAL_EVENTS_SQL}, t AS (SELECT pos, CAST(coalesce("endDate", "startDate") AS DATE) AS d, coalesce("endTime", "startTime", '') AS t FROM cal_events),
u AS (SELECT pos, d, regexp_extract(t, '([0-9]{{1,2}}):([0-9]{{2}})\\s*([AP]M)?', 1) AS h, regexp_extract(t, '([0-9]{{1,2}}):([0-9]{{2}})\\s*([AP]M)?', 2) AS m, regexp_extract(t, '([0-9]{{1,2}}):([0-9]{{2}})\\s*([AP]M)?', 3) AS a FROM t),
v AS (SELECT pos, CASE WHEN h = '' THEN d + INTERVAL '23:59:59.999' HOUR_SECOND ELSE d + to_hours(CAST(h AS INTEGER) % CASE WHEN a = '' THEN 24 ELSE 12 END + CASE WHEN a = 'PM' THEN 12 ELSE 0 END) + to_minutes(CAST(m AS INTEGER)) END AS ends_at FROM u)
SELECT ends_at < TIMESTAMP '{NOW}' AS past, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, min(pos) AS first_pos, max(pos) AS last_pos FROM v GROUP BY 1""".replace("INTERVAL '23:59:59.999' HOUR_SECOND", "INTERVAL '23 hours 59 minutes 59.999 seconds'")


def format_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, time = F.col("startDate"), F.col("startTime")
    return cal_events(spark, sf_dir).select("pos", format_date_time(date, time).alias("shown_12"), format_date_time(date, time, "24").alias("shown_24"))


FORMAT_SQL = f"""WITH {CAL_EVENTS_SQL}, x AS (SELECT pos, "startDate" AS d, coalesce("startTime", '') AS t FROM cal_events)
SELECT pos, CASE WHEN t = '' THEN strftime(CAST(d AS DATE), '%b %d, %Y') WHEN regexp_matches(t, '^[0-9]{{2}}:[0-9]{{2}}$') THEN strftime(CAST(d || ' ' || t AS TIMESTAMP), '%b %d, %Y %-I:%M %p') ELSE d || ' ' || t END AS shown_12,
CASE WHEN t = '' THEN strftime(CAST(d AS DATE), '%b %d, %Y') WHEN regexp_matches(t, '^[0-9]{{2}}:[0-9]{{2}}$') THEN strftime(CAST(d || ' ' || t AS TIMESTAMP), '%b %d, %Y %H:%M') ELSE d || ' ' || t END AS shown_24 FROM x"""

# Calendar output takes events after their times have been cleaned, as the pipeline does.
_CLEAN_CTE = f"""clean AS (SELECT * REPLACE (CASE WHEN "startTime" IS NOT NULL THEN {_clean_sql('"startTime"')} END AS "startTime", CASE WHEN "endTime" IS NOT NULL THEN {_clean_sql('"endTime"')} END AS "endTime") FROM cal_events)"""
_WALL = "COALESCE(TRY_STRPTIME({d} || ' ' || coalesce({t}, '00:00'), '%Y-%m-%d %-I:%M %p'), TRY_STRPTIME({d} || ' ' || coalesce({t}, '00:00'), '%Y-%m-%d %H:%M'))"
_ENDS_CTE = f"""ends AS (SELECT *, {_WALL.format(d='"startDate"', t='"startTime"')} AS s, {_WALL.format(d='coalesce("endDate", "startDate")', t='"endTime"')} AS e, "startTime" IS NULL AND "endTime" IS NULL AS whole FROM clean)"""


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cal_events(spark, sf_dir)
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), extract_timezone(F.col(c))["cleanTime"]) for c in ("startTime", "endTime")})


def gcal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("pos", calendar.link_dates().alias("dates"), F.replace(calendar.calendar_link(ZONE), F.lit("+"), F.lit("%20")).alias("link"))


GCAL_SQL = f"""WITH {CAL_EVENTS_SQL}, {_CLEAN_CTE}, {_ENDS_CTE},
f AS (SELECT *, CASE WHEN e > s THEN CASE WHEN whole THEN e + INTERVAL 1 DAY ELSE e END WHEN "startTime" IS NOT NULL AND "endTime" IS NULL THEN s + INTERVAL 1 HOUR WHEN whole THEN s + INTERVAL 1 DAY ELSE e END AS x FROM ends),
g AS (SELECT *, CASE WHEN whole THEN strftime(s, '%Y%m%d') || '/' || strftime(x, '%Y%m%d') ELSE strftime(s, '%Y%m%dT%H%M%S') || '/' || strftime(x, '%Y%m%dT%H%M%S') END AS dates FROM f)
SELECT pos, dates, '{calendar.LINK}' || concat_ws('&', 'text=' || url_encode(title), 'location=' || url_encode(location), 'details=' || url_encode(description), 'dates=' || url_encode(dates), 'recur=' || url_encode('RRULE:' || recurrence), 'ctz=' || url_encode('{ZONE}')) AS link FROM g"""


def ics_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid, stamp = F.concat(F.col("pos").cast("string"), F.lit("@datebook")), F.lit(NOW).cast("timestamp_ntz")
    return _cleaned(spark, sf_dir).select("pos", calendar.ics_file_name().alias("name"), calendar.vcalendar(calendar.vevent(uid, stamp)).alias("content"))


_FOLD = "CASE WHEN length({x}) <= 75 THEN {x} ELSE {x}[:75] || chr(13) || chr(10) || ' ' || array_to_string(list_transform(range(0, CAST(ceil((length({x}) - 75) / 74.0) AS BIGINT)), lambda k: {x}[76 + 74 * k:149 + 74 * k]), chr(13) || chr(10) || ' ') END"
_ESCAPE = r"replace(replace(replace(replace({x}, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n')"


def _line_sql(name: str, column: str) -> str:
    return _FOLD.format(x=f"('{name}:' || {column})")


ICS_SQL = f"""WITH {CAL_EVENTS_SQL}, {_CLEAN_CTE}, {_ENDS_CTE},
f AS (SELECT *, CASE WHEN "endTime" IS NOT NULL THEN e ELSE s + INTERVAL 1 HOUR END AS x, CASE WHEN CAST("endDate" AS TIMESTAMP) > s THEN CAST("endDate" AS TIMESTAMP) + INTERVAL 1 DAY ELSE s + INTERVAL 1 DAY END AS dx FROM ends)
SELECT pos, replace(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9\\s_-]', '', 'g'), '\\s+', '_', 'g')[:50], chr(0), '') || '_' || replace("startDate", '-', '') || '.ics' AS name,
concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:{calendar.PRODUCT}', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'BEGIN:VEVENT', 'UID:' || CAST(pos AS VARCHAR) || '@datebook', 'DTSTAMP:{NOW:%Y%m%dT%H%M%SZ}',
{_line_sql('SUMMARY', _ESCAPE.format(x='title'))}, CASE WHEN whole THEN 'DTSTART;VALUE=DATE:' || strftime(s, '%Y%m%d') ELSE 'DTSTART:' || strftime(s, '%Y%m%dT%H%M%S') END, CASE WHEN whole THEN 'DTEND;VALUE=DATE:' || strftime(dx, '%Y%m%d') ELSE 'DTEND:' || strftime(x, '%Y%m%dT%H%M%S') END,
{_line_sql('LOCATION', _ESCAPE.format(x='location'))}, {_line_sql('DESCRIPTION', _ESCAPE.format(x='description'))}, {_line_sql('RRULE', 'recurrence')}, 'END:VEVENT', 'END:VCALENDAR') AS content FROM f"""


def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.event_cards(_cleaned(spark, sf_dir)).select("pos", "card_title", "card_location", "card_recurs")


CARDS_SQL = f"""WITH {CAL_EVENTS_SQL} SELECT pos, replace(title, '&', '&amp;') AS card_title, coalesce(location, '') AS card_location, recurrence IS NOT NULL AS card_recurs FROM cal_events"""


def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each user, where it is no older than the time to live."""
    from datebook.operators.cache import fresh_entries, latest_entries

    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("url"), "ts", F.col("event_type").alias("payload"), "event_id")
    now = F.lit(datetime(2024, 1, 30, 12, 0)).cast("timestamp_ntz")
    return fresh_entries(latest_entries(rows, ["url"], "ts", ["event_id"]), now, minutes=60 * 24 * 2).select("url", "payload", "event_id")


CACHE_SQL = """SELECT 'user/' || CAST(user_id AS VARCHAR) AS url, event_type AS payload, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND ts >= TIMESTAMP '2024-01-28 12:00:00'"""

QUERIES = {
    "parse_time": (parse_times, PARSE_TIMES_SQL),
    "tz_extract": (tz_extract, TZ_EXTRACT_SQL),
    "tz_convert": (tz_convert, TZ_CONVERT_SQL),
    "dedupe_events": (dedupe_events, DEDUPE_SQL),
    "past_split": (past_split, PAST_SQL),
    "format_datetime": (format_datetimes, FORMAT_SQL),
    "gcal_links": (gcal_links, GCAL_SQL),
    "ics_text": (ics_texts, ICS_SQL),
    "event_cards": (event_cards, CARDS_SQL),
    "cache_latest": (cache_latest, CACHE_SQL),
}
