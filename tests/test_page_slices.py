"""Pages are read, chosen and condensed in slices, and nothing is written on the way."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from datebook.functions import arrow_signals as A
from datebook.functions import patterns as P
from datebook.functions import signals, text
from datebook.operators import source_choice
from datebook.operators.stages import shared_folder
from datebook.plans.page_queries import made_pages

SF = "/root/testdata/sf0.001"


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 30] * 9 + [None, "y" * 500, ""]), pa.array(range(12))], ["a", "n"])
    parts = list(A.slices(batch, 5, 100))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert [p.num_rows for p in parts] == [3, 3, 4, 1, 1]
    assert list(A.slices(batch.slice(0, 0), 5)) == []


def test_pages_go_in_slices(spark, monkeypatch):
    """A batch of long texts and pages is never in one piece beside its blocks, its windows and its results."""
    seen = {}
    df = spark.createDataFrame([(0, "", "", "")], "page_id long, text string, html string, other string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: seen.update(run=run) or self)
    source_choice.preprocess_pages(df, keep=["page_id"])
    n = 1200
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["Jazz Night\n\nMarch 5\n\n7 PM\n\nRoom 5\n\n" + "Plain words xx\n\n" * 1300] * n), pa.array(["<h1>Jazz Night</h1><p>March 5, 7 PM, Room 5, doors" + "<p>Tickets on March 6" * 30] * n)], ["page_id", "text", "html"])
    rows, most, before = 0, 0, pa.total_allocated_bytes()
    for part in seen["run"](iter([batch.slice(0, 0), batch])):
        assert part.schema.names == ["page_id", "page", "csv_snippets", "model_input"]
        rows, most = rows + part.num_rows, max(most, pa.total_allocated_bytes() - before)
    assert rows == n and most < batch.nbytes


def test_nothing_is_written_on_the_way(spark):
    folder = shared_folder(spark).removeprefix("file:")
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    assert source_choice.preprocess_pages(made_pages(spark, SF, 11)).count() == 50
    assert there() == before


def test_arrays_and_columns_agree(spark):
    dice = random.Random(3)
    words = ["Fri", "March 5", "|", "Expand all", "accordion", "read more", "Read  more", "more information", "View details", "\n", "\r\n", "\f", "  ", " \x0b\n", "\n\n\n\n\n", " ", "[a](u)", "x" * 90, "7 pm", "İ"]
    rows = ["", " \n "] + ["".join(dice.choice(words) + dice.choice(["", " ", "\n"]) for _ in range(dice.choice([2, 8, 40]))) for _ in range(600)]
    x = F.col("x")
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, x string").select("i", text.normalize_model_text(x), signals.has_delimited_lead_date(x), signals.matches(x, P.DETAIL_CHROME), x.rlike(P.COLLAPSED), signals.has_place_detail(x)).orderBy("i").collect()
    t = A.Texts(pa.array(rows))
    columns = [A.normalized(pa.array(rows)).to_pylist(), source_choice.delimited_lead_dates(pa.array(rows)), t.count(P.DETAIL_CHROME), t.has(P.COLLAPSED), t.has(P.PLACE_DETAILS)]
    assert any(columns[1]) and max(columns[2]) > 2 and any(columns[3])
    for k, column in enumerate(columns):
        assert [r[k + 1] for r in got] == list(column), k


def test_tables_within_the_budget():
    table = "\n".join(["head", "a" * 5, "b" * 5])
    assert source_choice.fit_tables([table, table, table], 16 + 10) == [table, "head\naaaaa"]
    assert source_choice.fit_tables([table, table], 16 + 9) == [table]
    assert source_choice.fit_tables([table, "x"], 8) == ["x"]
