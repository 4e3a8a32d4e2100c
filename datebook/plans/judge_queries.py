"""Queries over dates and times as they stand in texts, derived from ``events``, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.functions import judging
from datebook.functions.text import normalize_judge_text
from datebook.operators import matching
from datebook.plans.derived import spread, table


def judge_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in seven styles, and none."""
    at, style = F.col("ts"), F.col("event_id") % 8
    said = [F.concat(F.lit("on "), F.date_format(at, "yyyy-MM-dd"), F.lit(" at noon")), *(F.date_format(at, f) for f in ("MMMM d, yyyy", "d MMM yyyy", "M/d/yyyy", "dd-MM-yyyy", "MMM '31st,' yyyy", "MMMM d"))]
    text = F.coalesce(*(F.when(style == i, x) for i, x in enumerate(said)))
    rows = spread(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", text.alias("said")).withColumn("t", normalize_judge_text(F.col("said")))
    return rows.select("event_id", "said", judging.date_key(F.col("t")).alias("date_key"), judging.month_day(F.col("t")).alias("month_day"), judging.has_explicit_year(F.col("said")).alias("has_year"))


#: By the time stamp's own parts; no text is parsed.
JUDGE_DATES_SQL = """SELECT event_id,
CASE event_id % 8 WHEN 0 THEN strftime(ts, 'on %Y-%m-%d at noon') WHEN 1 THEN strftime(ts, '%B %-d, %Y') WHEN 2 THEN strftime(ts, '%-d %b %Y') WHEN 3 THEN strftime(ts, '%-m/%-d/%Y') WHEN 4 THEN strftime(ts, '%d-%m-%Y') WHEN 5 THEN strftime(ts, '%b 31st, %Y') WHEN 6 THEN strftime(ts, '%B %-d') END AS said,
CASE WHEN event_id % 8 <= 3 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 8 = 4 THEN CASE WHEN day(ts) > 12 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%d-%m') END WHEN event_id % 8 = 5 AND day(last_day(ts)) = 31 THEN strftime(ts, '%Y-%m-31') END AS date_key,
CASE WHEN event_id % 8 IN (1, 2, 6) THEN strftime(ts, '%m-%d') WHEN event_id % 8 = 5 THEN strftime(ts, '%m-31') END AS month_day,
event_id % 8 <= 5 AS has_year FROM events"""


def judge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in four styles, single times, and none."""
    at, style = F.col("ts"), F.col("event_id") % 6
    later = at + F.expr("INTERVAL '90' MINUTE")
    between = [("HH:mm", " - ", "HH:mm"), ("h:mm a", " – ", "h:mm a"), ("h:mm", " to ", "h:mm a"), ("h:mma", " until ", "h:mma 'ET'")]
    said = [F.concat(F.date_format(at, a), F.lit(word), F.date_format(later, b)) for a, word, b in between] + [F.date_format(at, "HH.mm"), F.lit("all day")]
    rows = spread(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", F.coalesce(*(F.when(style == i, x) for i, x in enumerate(said))).alias("said"))
    held = judging.time_range(F.col("said"))
    return rows.select("event_id", held["start"].alias("start_minute"), held["end"].alias("end_minute"), judging.single_time(F.col("said")).alias("single_minute"), judging.looks_like_time_range(F.col("said")).alias("looks_like_range"))


JUDGE_TIMES_SQL = """WITH timed AS (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS a, CAST(hour(ts + INTERVAL 90 MINUTE) * 60 + minute(ts + INTERVAL 90 MINUTE) AS INTEGER) AS b FROM events)
SELECT event_id, CASE WHEN event_id % 6 = 2 THEN CAST(a % 720 + b // 720 * 720 AS INTEGER) WHEN event_id % 6 <= 3 THEN a END AS start_minute, CASE WHEN event_id % 6 <= 3 THEN b END AS end_minute,
CASE WHEN event_id % 6 = 4 THEN a END AS single_minute, event_id % 6 <= 3 AS looks_like_range FROM timed"""


#: Styles of date ranges: what is said (Java's and DuckDB's formats of both ends), and the ends that are meant, in SQL over the dates ``a`` and ``b``.
#: Where only the first names the month, the second end lies in it too.
_SAME = "strftime(a, '%Y-%m-') || lpad(CAST(day(b) AS VARCHAR), 2, '0')"
_SAME_REAL = f"CASE WHEN day(b) <= day(last_day(a)) THEN {_SAME} END"
_RANGES = [
    (("MMM d", "-", "d', '"), ("%b %-d", "-", "%-d, "), True, f"CASE WHEN day(b) <= day(last_day(a)) THEN strftime(a, '%Y-%m-%d') END", _SAME_REAL),
    (("MMMM d", " \u2013 ", "MMMM d"), ("%B %-d", " \u2013 ", "%B %-d"), False, "strftime(a, '%m-%d')", "strftime(b, '%m-%d')"),
    (("EEE d", " - ", "'Sun' d MMMM"), ("%a %-d", " - ", "Sun %-d %B"), False, "strftime(b, '%m-') || strftime(a, '%d')", "strftime(b, '%m-%d')"),
    (("MMM d, yyyy", " to ", "MMM d"), ("%b %-d, %Y", " to ", "%b %-d"), False, "strftime(a, '%Y-%m-%d')", "CASE WHEN strftime(b, '%m-%d') = '02-29' AND day(last_day(make_date(year(a), 2, 1))) = 28 THEN '02-29' ELSE strftime(a, '%Y-') || strftime(b, '%m-%d') END"),
    (("MMMM d", " until ", "yyyy-MM-dd"), ("%B %-d", " until ", "%Y-%m-%d"), False, "CASE WHEN strftime(a, '%m-%d') = '02-29' AND day(last_day(make_date(year(b), 2, 1))) = 28 THEN '02-29' ELSE strftime(b, '%Y-') || strftime(a, '%m-%d') END", "strftime(b, '%Y-%m-%d')"),
    (("yyyy-MM-dd", " - ", "yyyy-MM-dd"), ("%Y-%m-%d", " - ", "%Y-%m-%d"), False, "strftime(a, '%Y-%m-%d')", "strftime(b, '%Y-%m-%d')"),
    (("'Feb 30", "-", "31, 2026'"), ("Feb 30", "-", "31, 2026"), False, "NULL", "NULL"),
    (("M/d/yyyy", "\u00a0\u2014\u00a0", "M/d/yyyy"), ("%-m/%-d/%Y", "\u00a0\u2014\u00a0", "%-m/%-d/%Y"), False, "strftime(a, '%Y-%m-%d')", "strftime(b, '%Y-%m-%d')"),
    (("MMMM d'th", "-", "'d'th'"), ("%B %-dth", "-", "%-dth"), False, "strftime(a, '%m-%d')", "strftime(a, '%m-') || strftime(b, '%d')"),
    (("MMM d", " - ", "MMM d"), ("%b %-d", " - ", "%b %-d"), True, "CASE WHEN strftime(a, '%m-%d') <> '02-29' OR day(last_day(make_date(year(b), 2, 1))) = 29 THEN strftime(b, '%Y-') || strftime(a, '%m-%d') END", "CASE WHEN strftime(a, '%m-%d') <> '02-29' OR day(last_day(make_date(year(b), 2, 1))) = 29 THEN strftime(b, '%Y-%m-%d') END"),
]
_KINDS = len(_RANGES) + 2


def _said_in_java(style, a: Column, b: Column) -> Column:
    (first, between, second), _, year, *_ = style
    if first.startswith("'Feb"):
        return F.lit("Feb 30-31, 2026")
    if second.startswith("'d"):
        return F.concat(F.date_format(a, "MMMM d'th'"), F.lit(between), F.date_format(b, "d'th'"))
    end = F.concat(F.date_format(b, "d"), F.lit(", ")) if year and second.startswith("d") else F.concat(F.date_format(b, second), F.lit(", ")) if year else F.date_format(b, second)
    return F.concat(F.date_format(a, first), F.lit(between), end, F.date_format(b, "yyyy") if year else F.lit(""))


def judge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges in ten styles, a single date, and none; the years differ."""
    a = F.col("ts") + F.make_ym_interval((F.col("event_id") % 4).cast("int"))
    b, style = a + F.make_dt_interval((F.col("event_id") % 45 + 1).cast("int")), F.col("event_id") % _KINDS
    said = [_said_in_java(x, F.col("a"), F.col("b")) for x in _RANGES] + [F.date_format("a", "MMMM d, yyyy")]
    rows = spread(table(spark, sf_dir, "events").select("event_id", "ts")).select("event_id", a.alias("a"), b.alias("b"))
    rows = rows.select("event_id", F.coalesce(*(F.when(style == i, x) for i, x in enumerate(said)), F.lit("whenever you like")).alias("said"))
    rows = rows.withColumn("t", normalize_judge_text(F.col("said"))).withColumn("r", judging.date_range(F.col("t")))
    return rows.select("event_id", "said", "r.start", "r.end", judging.looks_like_date_range(F.col("t")).alias("looks_like_range"))


def _said_in_duckdb(style) -> str:
    _, (first, between, second), year, *_ = style
    return f"strftime(a, '{first}') || '{between}' || strftime(b, '{second}{', ' if year and not second.endswith(', ') else ''}{'%Y' if year else ''}')"


JUDGE_RANGES_SQL = f"""WITH dated AS (SELECT event_id, ts + to_years(CAST(event_id % 4 AS INTEGER)) AS a, ts + to_years(CAST(event_id % 4 AS INTEGER)) + to_days(CAST(event_id % 45 + 1 AS INTEGER)) AS b FROM events)
SELECT event_id, CASE event_id % {_KINDS} {' '.join(f"WHEN {i} THEN {_said_in_duckdb(x)}" for i, x in enumerate(_RANGES))} WHEN {len(_RANGES)} THEN strftime(a, '%B %-d, %Y') ELSE 'whenever you like' END AS said,
CASE event_id % {_KINDS} {' '.join(f"WHEN {i} THEN {x[3]}" for i, x in enumerate(_RANGES))} END AS start, CASE event_id % {_KINDS} {' '.join(f"WHEN {i} THEN {x[4]}" for i, x in enumerate(_RANGES))} END AS "end",
event_id % {_KINDS} < {len(_RANGES)} AS looks_like_range FROM dated"""


#: Events of a page, kinds of expectations.
_PAGE, _EXPECTED = 12, 8


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected and extracted events: pages of twelve, whose titles repeat, each told one way and extracted another.

    By kind an expected event has an ISO date; month and day; a range of dates; a time; a range of times; a date of
    another month; only words for its date; only a place.  Every seventh event isn't extracted.
    """
    at, n = F.col("ts"), F.col("event_id")
    page, pos, kind = F.floor(n / _PAGE).alias("page"), (n % _PAGE).cast("int").alias("pos"), n % _EXPECTED
    title, place = F.concat(F.lit("Show "), F.col("user_id") % 5), F.concat(F.lit("Hall "), n % 2)
    next_day, later = at + F.expr("INTERVAL 1 DAY"), at + F.expr("INTERVAL 90 MINUTE")
    iso = lambda x: F.date_format(x, "yyyy-MM-dd")
    date = F.when(kind == 1, F.date_format(at, "MMMM d")).when(kind == 2, F.concat(F.date_format(at, "MMM d, yyyy"), F.lit(" \u2013 "), F.date_format(next_day, "MMM d, yyyy"))).when(kind == 5, iso(at + F.expr("INTERVAL 40 DAYS"))).when(kind == 6, "every  Evening").when(kind < 7, iso(at))
    time = F.when(kind == 3, F.date_format(at, "h:mm a")).when(kind == 4, F.concat(F.date_format(at, "h:mm a"), F.lit(" to "), F.date_format(later, "h:mm a"))).otherwise("")
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"))
    expected = rows.select(page, pos, title.alias("title"), date.alias("date"), time.alias("time"), F.when(kind % 2 == 1, place).alias("location"))
    ends = n % 3 > 0
    extracted = rows.filter(n % 7 != 0).select(
        page, pos, F.concat(F.lit(" "), F.upper(title), F.lit("\u00a0")).alias("title"), iso(at).alias("startDate"), F.date_format(at, "HH:mm").alias("startTime"), F.when(ends, iso(next_day)).alias("endDate"),
        F.when(ends, F.date_format(later, "HH:mm")).alias("endTime"), F.concat(place, F.lit(", Main Street")).alias("location"), F.when(n % 5 == 0, "Every evening").alias("description"),
    )
    return expected, extracted


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected events of each page that an extracted event matches."""
    return matching.matched_events(*_judged(spark, sf_dir))


_MATCHED_SQL = f"""e AS (SELECT event_id AS n, event_id // {_PAGE} AS page, CAST(event_id % {_PAGE} AS INTEGER) AS pos, event_id % {_EXPECTED} AS kind, user_id % 5 AS title, ts, CAST(ts AS DATE) AS d, hour(ts) * 60 + minute(ts) AS m,
  hour(ts + INTERVAL 90 MINUTE) * 60 + minute(ts + INTERVAL 90 MINUTE) AS m2, event_id % 2 AS hall, event_id % 3 > 0 AS ends FROM events),
matched AS (SELECT DISTINCT x.page, x.pos FROM e x JOIN e f ON x.page = f.page AND x.title = f.title AND f.n % 7 <> 0 AND (x.kind % 2 = 0 OR x.hall = f.hall)
  AND CASE x.kind WHEN 1 THEN strftime(x.d, '%m-%d') = strftime(f.d, '%m-%d') OR f.ends AND strftime(x.d, '%m-%d') = strftime(f.d + 1, '%m-%d') WHEN 2 THEN f.ends AND x.d = f.d WHEN 5 THEN x.d + 40 = f.d OR f.ends AND x.d + 40 = f.d + 1
    WHEN 6 THEN f.n % 5 = 0 WHEN 7 THEN true ELSE x.d = f.d OR f.ends AND x.d = f.d + 1 END
  AND CASE x.kind WHEN 3 THEN x.m = f.m OR f.ends AND x.m = f.m2 WHEN 4 THEN f.ends AND x.m = f.m AND x.m2 = f.m2 ELSE true END)"""
EVENT_MATCHES_SQL = f"WITH {_MATCHED_SQL} SELECT page, pos FROM matched"


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge's answers come to; pages whose number ends in 9 list no expected events, some say how many.

    The judge names events by index; by an index out of range, or none, and title; without what it extracted; and twice.
    """
    expected, extracted = _judged(spark, sf_dir)
    n = F.col("event_id")
    of = F.struct(F.when(n % 4 == 0, n % _PAGE).when(n % 4 == 1, 99).cast("int").alias("expectedIndex"), F.concat(F.lit("SHOW  "), F.col("user_id") % 5).alias("expectedTitle"), F.when(n % 6 != 0, "x").alias("extractedTitle"))
    found = lambda test: F.array_compact(F.collect_list(F.when(test, of)))
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id")).groupBy(F.floor(n / _PAGE).alias("page")).agg(found(n % 5 == 1).alias("matches"), found(n % 5 == 2).alias("misses"))
    page = F.col("page")
    verdict = F.struct((page % 2 == 0).alias("passed"), F.concat("matches", F.slice("matches", 1, 1)).alias("matches"), F.when(page % 3 != 0, F.col("misses")).alias("misses"), F.array_repeat(F.struct(F.lit("x").alias("extractedTitle")), (page % 3).cast("int")).alias("hallucinations"))
    pages = rows.select("page", (page % 4 < 2).alias("exhaustive"), F.when(page % 20 == 9, 2).alias("expected_count"), verdict.alias("verdict"))
    return matching.judge_verdicts(pages, expected.filter("page % 10 <> 9"), extracted)


JUDGE_VERDICTS_SQL = f"""WITH {_MATCHED_SQL}, pages_of AS (SELECT DISTINCT page FROM e), x AS (SELECT * FROM e WHERE page % 10 <> 9),
last AS (SELECT page, title, max(pos) AS pos FROM x GROUP BY page, title), size AS (SELECT page, count(*) AS n FROM x GROUP BY page),
named AS (SELECT e.page, e.n % 5 = 1 AS hit, CASE WHEN e.n % 4 = 0 AND e.pos < size.n THEN e.pos ELSE last.pos END AS pos FROM e JOIN size USING (page) LEFT JOIN last ON last.page = e.page AND last.title = e.title WHERE e.n % 5 = 1 AND e.n % 6 <> 0 OR e.n % 5 = 2 AND e.page % 3 <> 0),
hits AS (SELECT page, pos FROM named WHERE hit AND pos IS NOT NULL UNION SELECT page, pos FROM matched WHERE page % 10 <> 9),
lacks AS (SELECT page, pos FROM named WHERE NOT hit AND pos IS NOT NULL EXCEPT SELECT page, pos FROM hits),
raw AS (SELECT page, count(*) FILTER (n % 5 = 1) AS matches, CASE WHEN page % 3 <> 0 THEN count(*) FILTER (n % 5 = 2) ELSE 0 END AS misses FROM e GROUP BY page),
told AS (SELECT p.page, coalesce(size.n, CASE WHEN p.page % 20 = 9 THEN 2 ELSE 0 END) AS expected, p.page % 3 AS hallucinations,
  CASE WHEN size.n IS NULL THEN raw.matches + least(raw.matches, 1) ELSE (SELECT count(*) FROM hits WHERE hits.page = p.page) END AS matches, CASE WHEN size.n IS NULL THEN raw.misses ELSE (SELECT count(*) FROM lacks WHERE lacks.page = p.page) END AS named
  FROM pages_of p LEFT JOIN size USING (page) JOIN raw USING (page)),
summed AS (SELECT *, CASE WHEN expected > 0 THEN greatest(named, expected - matches) ELSE named END AS misses FROM told)
SELECT page, misses = 0 AND (page % 4 >= 2 OR hallucinations = 0) AND CASE WHEN expected > 0 THEN matches >= expected ELSE page % 2 = 0 END AS passed, CAST(matches AS BIGINT) AS matches, CAST(misses AS BIGINT) AS misses, CAST(hallucinations AS BIGINT) AS hallucinations FROM summed"""


QUERIES = {
    "judge_dates": (judge_dates, JUDGE_DATES_SQL),
    "judge_times": (judge_times, JUDGE_TIMES_SQL),
    "judge_ranges": (judge_ranges, JUDGE_RANGES_SQL),
    "event_matches": (event_matches, EVENT_MATCHES_SQL),
    "judge_verdicts": (judge_verdicts, JUDGE_VERDICTS_SQL),
}
