import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from datebook.operators.calendar import exports
from datebook.sources import json_files as J
from datebook.sources.named_files import _Done, _Writer, reports, write_named


def put(folder, **files):
    for name, value in files.items():
        (folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return str(folder)


def test_captured_pages(spark, tmp_path):
    folder = put(tmp_path, b={"name": "éclair", "html": "<p>x</p>", "more": 1, "expectedEvents": [{"title": "T", "labels": ["a"]}]}, a={"name": "zoo"}, c={"name": "Apple"}, report="no json", **{"llm-report-2": [1], "old-new-static-report": {}, "reporter": {"name": "dock"}})
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "inner").mkdir()
    put(tmp_path / "inner", d={"name": "deep"})
    rows = J.captured_fixtures(spark, folder).collect()
    assert [r.name for r in rows] == ["Apple", "dock", "éclair", "zoo"]
    assert rows[2].html == "<p>x</p>" and rows[2].expectedEvents[0].labels == ["a"] and rows[0].html is None


def test_missing_and_empty_folders(spark, tmp_path):
    assert J.captured_fixtures(spark, str(tmp_path / "none")).collect() == []
    assert J.captured_fixtures(spark, str(tmp_path)).collect() == []
    assert J.image_urls(spark, str(tmp_path / "*.png")).collect() == []


@pytest.mark.parametrize("text", ["{}", '"x"', "[1", "", "null"])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    folder = put(tmp_path, events=text + " ")
    with pytest.raises(PySparkException, match="must be a JSON array"):
        J.made_events(spark, folder + "/events.json").collect()


@pytest.mark.parametrize("text", ["[]", "3", '{"name": '])
def test_what_is_no_object_is_an_error(spark, tmp_path, text):
    with pytest.raises(PySparkException, match="must be a JSON object"):
        J.captured_fixtures(spark, put(tmp_path, x=text)).collect()


def test_events_and_corpus(spark, tmp_path):
    folder = put(tmp_path, events=[{"title": "A", "startDate": "2026-03-05", "extra": {}}, 7, {"title": "B"}], corpus=[{"name": " n ", "expectedEvents": [{"title": " T ", "time": " "}], "maxContextChars": -1}])
    events = J.made_events(spark, folder + "/events.json")
    assert [(r.pos, r.title, r.startDate) for r in events.orderBy("pos").collect()] == [(0, "A", "2026-03-05"), (1, None, None), (2, "B", None)]
    entry = J.cached_events(events.filter("pos <> 1"), F.lit("u"), F.lit(5)).first()
    assert entry.key == "scan:u" and [e.title for e in entry.events] == ["A", "B"] and entry.selected == [] and entry.ts == 5
    corpus = J.corpus_entries(spark, folder + "/corpus.json").first()
    assert corpus.name == "n" and corpus.url == "" and corpus.expectedEvents[0].labels == ["T"] and corpus.expectedEvents[0].time is None


def test_pasted_texts_and_images(spark, tmp_path):
    rows = J.pasted_texts(spark.createDataFrame([(1, " a\n"), (2, "  "), (3, None)], "id int, text string")).collect()
    assert [(r.id, r.text, r.title, r.lang, r.html, r.cache_results) for r in rows] == [(1, "a", "Custom Context", "en", None, False)]
    (tmp_path / "x.PNG").write_bytes(b"\x89P")
    (tmp_path / "y").write_bytes(b"\0")
    (tmp_path / "empty").write_bytes(b"")
    images = J.image_urls(spark, str(tmp_path / "*"))
    assert {tuple(r) for r in images.collect()} == {("x.PNG", "data:image/png;base64,iVA="), ("y", "data:application/octet-stream;base64,AA==")}
    pages = spark.createDataFrame([(1, "https://h/x.PNG"), (2, "data:text/plain,x.PNG"), (3, "https://h/z.png"), (4, None)], "id int, image string")
    assert {tuple(r) for r in J.with_image_data(pages, images).select("id", "image").collect()} == {(1, "data:image/png;base64,iVA="), (2, "data:text/plain,x.PNG"), (3, "https://h/z.png"), (4, None)}


def written(path):
    return {str(p.relative_to(path)).split("/", 1)[1]: p.read_bytes() for p in Path(path).glob("write=*/**/*") if p.is_file()}


def test_files_by_name_and_order(spark, tmp_path):
    rows = spark.createDataFrame([("a.ics", "A\r\n"), ("b/c", "B"), (None, None)], "name string, content string").coalesce(1)
    write_named(rows, str(tmp_path))
    first = {"part-00000/000000-a.ics": b"A\r\n", "part-00000/000001-b_c": b"B", "part-00000/000002": b"", "_SUCCESS": b""}
    assert written(tmp_path) == first
    write_named(rows.limit(1), f"file:{tmp_path}")
    assert len(list(tmp_path.iterdir())) == 2
    write_named(rows.filter("name = 'none'"), str(tmp_path), "overwrite")
    assert written(tmp_path) == {"_SUCCESS": b""}


def test_a_failed_write_leaves_what_was(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"), F.lit("x").alias("content"))
    write_named(rows, str(tmp_path))
    before = written(tmp_path)
    assert len(before) == 41
    broken = rows.withColumn("content", F.when(F.col("name") == "37", F.raise_error(F.lit("broken")).cast("string")).otherwise("y"))
    with pytest.raises(PySparkException):
        write_named(broken, str(tmp_path), "overwrite")
    assert written(tmp_path) == before
    assert spark.read.text(f"{tmp_path}", recursiveFileLookup=True).filter("value <> 'x'").count() == 0


def test_attempts_that_do_not_count_are_not_seen(tmp_path):
    writer = _Writer(str(tmp_path), ["name", "content"], False)
    for attempt in ("part-00001-one", "part-00001-two"):
        (tmp_path / f"_{writer.job}" / attempt).mkdir(parents=True)
        (tmp_path / f"_{writer.job}" / attempt / "000000").write_text(attempt)
    writer.commit([_Done("part-00001-two"), _Done(None)])
    assert written(tmp_path) == {"part-00001/000000": b"part-00001-two", "_SUCCESS": b""}


def test_reports_and_calendar_files(spark, tmp_path):
    write_named(reports(spark.createDataFrame([("p", True, None)], "name string, passed boolean, note string"), "name"), str(tmp_path / "r"))
    (text,) = [v for k, v in written(tmp_path / "r").items() if k.endswith("-p.json")]
    assert json.loads(text) == {"name": "p", "passed": True, "note": None} and text.startswith(b"{\n  ")
    events = spark.createDataFrame([("Jazz Night", "2026-03-05"), ("no day", None)], "title string, startDate string")
    for c in ("preview", "startTime", "endDate", "endTime", "location", "description", "recurrence"):
        events = events.withColumn(c, F.lit(None).cast("string"))
    write_named(exports(events, "icloud", F.lit("u"), F.to_timestamp(F.lit("2026-01-01"))), str(tmp_path / "c"))
    (name,) = [k for k in written(tmp_path / "c") if k.endswith(".ics")]
    assert name.endswith("/000000-Jazz_Night_20260305.ics")
