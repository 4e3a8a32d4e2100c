"""Date ranges, matching of events and judges' verdicts: expectations from reading the rules."""

from pyspark.sql import functions as F

from datebook.functions import judging
from datebook.functions.text import normalize_judge_text
from datebook.operators.matching import SEARCHED, judge_verdicts, matched_events

RANGES = {
    "Jun 5-7, 2026": ("2026-06-05", "2026-06-07"),
    "june 5th–7th": ("06-05", "06-07"),
    "Jun 5 - Jul 7": ("06-05", "07-07"),
    "Sept. 30 — Oct 2, 2026": ("2026-09-30", "2026-10-02"),
    "Fri 5 - Sun 7 June 2026": ("2026-06-05", "2026-06-07"),
    "5-7 jun": ("06-05", "06-07"),
    "June 29, 2026 to Jul 2": ("2026-06-29", "2026-07-02"),
    "Feb 29 until 2026-03-02": ("02-29", "2026-03-02"),
    "6/5/2026 - 13/7/2026": ("2026-06-05", "2026-07-13"),
    "２０２６-06-05 to 2026-06-07": ("2026-06-05", "2026-06-07"),
    "Feb 30-31, 2026": None,
    "June 5, 2026": None,
    "2026-06-05": None,
    "May 40 - May 41": None,
    "": None,
    None: None,
}
LOOKS = {"2026-06-05 2026-06-07": False, "2026-06-05 - 2026-06-07": True, "June 5-7": True, "5 - 7 June": True, "June 5": False, "7 until late": True, "today": False, "tomorrow": False}


def test_ranges(spark):
    rows = spark.createDataFrame([(t,) for t in [*RANGES, *LOOKS]], "t string").coalesce(1).withColumn("n", normalize_judge_text(F.col("t")))
    got = {r.t: (r.r and tuple(r.r), r.l) for r in rows.select("t", judging.date_range(F.col("n")).alias("r"), judging.looks_like_date_range(F.col("n")).alias("l")).collect()}
    assert {t: got[t][0] for t in RANGES} == RANGES
    assert {t: got[t][1] for t in LOOKS} == LOOKS


def test_spaces_that_are_not_ascii(spark):
    rows = spark.createDataFrame([("7 pm",), ("7 :30",), ("7 – 9 pm",), ("7pm\n",), ("7pm\n8",)], "t string").coalesce(1)
    got = {r[0]: (r[1], r[2] and tuple(r[2])) for r in rows.select("t", judging.single_time(F.col("t")), judging.time_range(F.col("t"))).collect()}
    assert got["7 pm"][0] == 1140 and got["7pm\n"][0] == 1140 and got["7pm\n8"][0] is None and got["7 – 9 pm"][1] == (1140, 1260)


EXPECTED = "page int, pos int, title string, date string, time string, location string"
FOUND = "page int, pos int, " + ", ".join(f"`{c}` string" for c in SEARCHED)


def found(title="Show", **fields):
    return tuple({"title": title, **fields}.get(c) for c in SEARCHED)


CASES = [
    (("Show", "June 29, 2026 - Jul 2, 2026", None, None), found(startDate="2026-06-29"), False),
    (("Show", "June 29, 2026 - Jul 2, 2026", None, None), found(startDate="2026-06-29", endDate="July 2, 2026"), True),
    (("Show", "June 29 - Jul 2", "", ""), found(startDate="2024-06-29", endDate="2025-07-02"), True),
    (("Show", None, "5-6 PM", None), found(startTime="5:00 PM", endTime="6:00 PM"), True),
    (("Show", None, "5 PM - 6 PM", None), found(startTime="17:00", endTime="18:30"), False),
    (("Show", None, "7 PM", None), found(startTime="18:00", endTime="19:00"), True),
    (("Show", None, "7 PM - late 99", None), found(startTime="19:00"), False),
    (("Show", None, "doors at noon", None), found(startTime="noon"), True),
    (("Show", "some day", None, None), found(description="Some  day soon"), True),
    (("Show", "some day", None, None), found(), False),
    (("Show", "June 5", None, None), found(startDate="2025-06-04", endDate="2025-06-05"), True),
    (("Show", "June 5, 2026", None, "café"), found(startDate="2026-06-05", location="The CAFÉ"), True),
    (("Show", None, None, "Hall"), found(location=None), False),
    ((" sHOW  ", None, None, None), found("Show"), True),
    (("", None, None, None), found(""), False),
    ((None, None, None, None), found(None), False),
    (("Show", "a", "b", "c"), None, False),
]


def test_events_match(spark):
    wanted = spark.createDataFrame([(i, 0, *w) for i, (w, _, _) in enumerate(CASES)], EXPECTED)
    got = spark.createDataFrame([(i, 0, *f) for i, (_, f, _) in enumerate(CASES) if f] * 2, FOUND)
    matched = {r.page for r in matched_events(wanted, got).collect()}
    assert matched == {i for i, (_, _, fits) in enumerate(CASES) if fits}
    assert matched_events(wanted, got.limit(0)).count() == 0 == matched_events(wanted.limit(0), got).count()


MATCH, MISS = "array<struct<expectedIndex:int,expectedTitle:string,extractedTitle:string>>", "array<struct<expectedIndex:int,expectedTitle:string>>"
PAGES = f"page int, exhaustive boolean, expected_count int, verdict struct<passed:boolean,matches:{MATCH},misses:{MISS},hallucinations:array<struct<extractedTitle:string>>>"


def test_verdicts(spark):
    """Page, exhaustive, count, verdict, and what it comes to."""
    a, b = (0, "A", "a"), (None, " b ", "b")
    told = [
        (0, False, 0, (False, [a, b], [], []), (True, 2, 0, 0)),
        (1, False, 0, (True, [a, a], [], []), (False, 1, 1, 0)),
        (2, True, 0, (True, [a, b], [], [("x",)]), (False, 2, 0, 1)),
        (3, False, 0, (True, [(9, "B", "b"), (-1, "none", "x"), (0, "A", "")], [(0, "A"), (1, "B"), (None, "A")], [("x",)]), (False, 1, 1, 1)),
        (4, None, None, None, (False, 0, 2, 0)),
        (10, False, None, None, (False, 0, 0, 0)),
        (11, False, None, (True, [a], None, None), (True, 1, 0, 0)),
        (12, False, 3, (True, [a], [(0, "A")], None), (False, 1, 2, 0)),
        (5, False, 0, (False, [], [(1, "B")], None), (True, 2, 0, 0)),
    ]
    pages = spark.createDataFrame([t[:4] for t in told], PAGES)
    wanted = spark.createDataFrame([(t[0], k, x, None, None, None) for t in told if t[0] < 10 for k, x in enumerate("AB")], EXPECTED)
    got = spark.createDataFrame([(5, k, *found(x)) for k, x in enumerate("ab")], FOUND)
    rows = {r.page: (r.passed, r.matches, r.misses, r.hallucinations) for r in judge_verdicts(pages, wanted, got).collect()}
    assert rows == {t[0]: t[4] for t in told}
