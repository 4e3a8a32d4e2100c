"""A page is audited in its own row, and its texts are neither written nor dealt out."""

import os

from pyspark.sql import functions as F

from datebook.functions.text import normalize_search_text, normalize_search_texts
from datebook.operators import audit
from datebook.operators.source_choice import preprocess_pages
from datebook.operators.stages import shared_folder
from datebook.plans import registry

SF = "/root/testdata/sf0.001"
EVENT = "struct<title: string, date: string, time: string, location: string, labels: array<string>>"


def audited(spark):
    held, lost = ("Café Night", "26 June 2026", "7:00 PM", "Main Hall", ["Tickets", " ", "Main Hall"]), (None, " 27 June 2026 ", "8:00 PM", None, ["Side – Room"])
    page = "Café Night\n\n26 June 2026\n\n7:00 PM\n\nMain Hall\n\nTickets"
    rows = [("a", page, ["Café night", "Nowhere"], [held, lost]), ("a", "27 June 2026, 8:00 PM, Side-Room", [], [lost]), (None, "empty", ["Closing"], None), ("b", None, None, [held])]
    df = spark.createDataFrame(rows, f"name string, text string, expectedAnchors array<string>, expectedEvents array<{EVENT}>").withColumns({"url": F.lit(""), "html": F.lit(""), "maxContextChars": F.lit(100), "maxPreviousContextGrowthRatio": F.lit(None).cast("double")})
    return df, audit.page_audit(preprocess_pages(df))


def test_pages_are_audited_in_their_rows(spark):
    df, rows = audited(spark)
    got = {(r.name, r.text): (r.missing_anchors, r.missing_events, r.passed) for r in rows.collect()}
    second = ["event-2: date=27 June 2026", "event-2: label-1=Side – Room", "event-2: time=8:00 PM"]
    all_held = ["Café Night: date=26 June 2026", "Café Night: label-1=Tickets", "Café Night: label-2= ", "Café Night: location=Main Hall", "Café Night: time=7:00 PM", "Café Night: title=Café Night"]
    texts = [r.text for r in df.collect()]
    assert got[("a", texts[0])] == (["Nowhere"], second, False)
    assert got[("a", texts[1])] == ([], [], True)
    assert got[(None, texts[2])] == (["Closing"], [], False)
    assert got[("b", None)] == ([], [x for x in all_held if "label-2" not in x], False)


def test_labels_of_pages(spark):
    df, _ = audited(spark)
    rows = audit.label_rows(df.withColumn("row", F.monotonically_increasing_id()), ["row", "name"], "expectedEvents", "text", "text")
    out = audit.label_audit(rows.filter("name = 'a'"), ["row"]).orderBy("row", "event").collect()
    assert [(r.event, r.title, r.labels, r.missing_source, r.passed) for r in out] == [(0, "Café Night", 6, [], True), (1, "event-2", 3, ["date", "label-1", "time"], False), (0, "event-1", 3, [], True)]


def test_texts_of_an_array(spark):
    rows = [(["Café – night", None, "(a )", "x"],), (["plain ,", ""],), ([],), (None,)]
    got = spark.createDataFrame(rows, "x array<string>").select("x", normalize_search_texts(F.col("x")).alias("n")).collect()
    one = {r.s: r.n for r in spark.createDataFrame([(s,) for x, in rows for s in x or []], "s string").select("s", normalize_search_text(F.col("s")).alias("n")).collect()}
    assert [r.n for r in got] == [None if r.x is None else [one[s] for s in r.x] for r in got]


def test_audits_write_and_deal_nothing(spark):
    folder = shared_folder(spark).removeprefix("file:")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    df = registry.queries()["page_audits"](spark, SF)
    assert df.count() == 50 and there() == before
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan


def test_white_space_of_all_kinds(spark):
    rows = {"a\t\tb \n c d \x0b\f\r": "a b c d", "é  x　 y ﻿z": "e x y z", " - a  -  b ": "-a-b", "": ""}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", normalize_search_text(F.col("x"))).collect()
    assert dict(map(tuple, got)) == rows
