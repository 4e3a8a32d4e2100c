"""Values that are fixed by what the operators stand for."""

from pyspark.sql import functions as F

from datebook.functions import judging
from datebook.functions.text import fixture_file_name, normalize_judge_text, provider_name
from datebook.functions.times import extract_timezone, format_date_time
from datebook.operators.access import scan_block_reason
from datebook.operators.calendar import link_dates
from datebook.operators.html import Tree, markdown, table_snippets

EVENT = "startDate string, startTime string, endDate string, endTime string"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_link_dates(spark):
    rows = [("2025-10-05", "08:15", None, None), ("2025-10-05", "08:15", None, "10:45"), ("2025-10-05", None, None, None), ("2025-09-26", None, "2025-09-28", None)]
    got = [r[0] for r in spark.createDataFrame(rows, EVENT).coalesce(1).select(link_dates()).collect()]
    assert got == ["20251005T081500/20251005T091500", "20251005T081500/20251005T104500", "20251005/20251006", "20250926/20250929"]


def test_shown_times(spark):
    shown = lambda d, clock: format_date_time(F.lit(d), F.lit("19:30"), clock)
    assert one(spark, shown("2026-06-26", "12"), shown("2026-06-26", "24"), shown("not-a-date", "12")) == ("Jun 26, 2026 7:30 PM", "Jun 26, 2026 19:30", "not-a-date 19:30")


def test_zones(spark):
    for text, zone, clean in (("2:00 PM ET", "America/New_York", "2:00 PM"), ("14:00 CT", "America/Chicago", "14:00"), ("9:15 PM MT", "America/Denver", "9:15 PM"), ("noon", None, "noon")):
        assert tuple(one(spark, extract_timezone(F.lit(text)))[0]) == (zone, clean)


def test_names(spark):
    assert one(spark, fixture_file_name(F.lit("Southbank What's On")), provider_name(F.lit("openai")), provider_name(F.lit("new-provider"))) == ("southbank-what-s-on.json", "OpenAI", "New-provider")


def test_blocked_pages(spark):
    reasons = one(spark, *[scan_block_reason(F.lit(u)) for u in ("chrome://extensions/", "https://example.com/", "")])
    assert reasons[0] is not None and reasons[1:] == (None, None)


def test_markdown_and_tables():
    tree = Tree("<main><h1>Jazz</h1><p>At <b>eight</b><p>Hall</main><table><tr><th>Day<th>Act<tr><td>Fri<td>A \"b\"</table>")
    assert markdown(tree.root).startswith("# Jazz\n\nAt  **eight**\n\nHall")
    assert table_snippets(tree.root) == ['"Day","Act"\n"Fri","A ""b"""']


def test_dates_and_times_of_the_judge(spark):
    dates = {"Sept. 5th, 2026": "2026-09-05", "30 feb 2026": None, "31/12/2026": "2026-12-31", "13/13/2026": None, "2026-02-30 or May 1, 2026": None, "june 29, 2026 \u2013 Jul 2, 2026": "2026-06-29", "12026-03-05": None, "": None}
    rows = spark.createDataFrame([(t,) for t in dates] + [(None,)], "t string")
    got = dict(map(tuple, rows.withColumn("n", normalize_judge_text(F.col("t"))).select("t", judging.date_key(F.col("n"))).collect()))
    assert got == dates | {None: None}
    ranges = {"7-9 pm": (19 * 60, 21 * 60), "7-9pm": (7 * 60, 21 * 60), "11.30 a.m. to 1 p.m. EST": (690, 780), "12am until 12pm": (0, 720), "10:75 - 11": None, "13 pm - 14 pm": None, "25 - 26": None, "noon": None, "": None}
    rows = spark.createDataFrame([(t,) for t in ranges] + [(None,)], "t string")
    got = {r[0]: r[1] and tuple(r[1]) for r in rows.select("t", judging.time_range(F.col("t"))).collect()}
    assert got == ranges | {None: None}
    singles = {"7pm": 1140, "19.30 CET": 1170, "24:00": None, "7pm-9pm": None}
    rows = spark.createDataFrame([(t,) for t in singles], "t string")
    assert dict(map(tuple, rows.select("t", judging.single_time(F.col("t"))).collect())) == singles
