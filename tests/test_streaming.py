from pathlib import Path

import pytest

from datebook.streaming.upserts import compact, upsert_stream, upserted

SCHEMA = "url string, ts long, result string"


def arrive(spark, tmp_path, rows):
    source, out, checkpoint = (str(tmp_path / x) for x in ("source", "out", "checkpoint"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, ["url"]).awaitTermination()
    return out


def rows_of(spark, out):
    return {tuple(r) for r in upserted(spark, out, ["url"]).collect()}


def folders(out):
    return sorted(p.name for p in Path(out).iterdir())


def test_last_write_of_each_key(spark, tmp_path):
    arrivals = [[("a", 1, "old"), ("a", 3, "new"), ("b", 5, "b")], [("a", 2, "late"), ("b", 5, "again"), (None, 1, "no url")]]
    for rows in arrivals:
        out = arrive(spark, tmp_path, rows)
    assert upserted(spark, out, ["url"]).columns == ["url", "ts", "result"]
    assert rows_of(spark, out) == {("a", 3, "new"), ("b", 5, "again"), (None, 1, "no url")}


def test_compaction(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        upserted(spark, str(tmp_path / "out"), ["url"])
    assert upserted(spark, str(tmp_path / "out"), ["url"], schema=SCHEMA).count() == 0 and compact(spark, str(tmp_path / "out"), ["url"]) == -1
    for n in range(3):
        out = arrive(spark, tmp_path, [("a", n, f"a{n}"), (f"k{n}", 1, "x")])
    want = rows_of(spark, out)
    assert compact(spark, out, ["url"]) == 2 and rows_of(spark, out) == want and compact(spark, out, ["url"]) == 2
    out = arrive(spark, tmp_path, [("a", 1, "late"), ("b", 2, "equal"), ("k0", 1, "equal")])
    want = want - {("k0", 1, "x")} | {("b", 2, "equal"), ("k0", 1, "equal")}
    assert rows_of(spark, out) == want
    assert compact(spark, out, ["url"]) == 3 and rows_of(spark, out) == want
    assert folders(out) == ["batch=3", "snapshot=2", "snapshot=3"]
    assert {str(Path(f).parent.name) for f in upserted(spark, out, ["url"]).inputFiles()} == {"snapshot=3"}


def test_failure_between_write_and_switch(spark, tmp_path):
    out = arrive(spark, tmp_path, [("a", 1, "a"), ("b", 1, "b")])
    compact(spark, out, ["url"])
    out = arrive(spark, tmp_path, [("a", 2, "new")])
    want = rows_of(spark, out)
    # A snapshot whose files stand but whose commit never came, and a batch cut off.
    spark.createDataFrame([("a", 9, "half")], SCHEMA).write.parquet(f"{out}/snapshot=1")
    Path(f"{out}/snapshot=1/_SUCCESS").unlink()
    spark.createDataFrame([("a", 9, "half")], SCHEMA).write.parquet(f"{out}/batch=2")
    Path(f"{out}/batch=2/_SUCCESS").unlink()
    assert rows_of(spark, out) == want == {("a", 2, "new"), ("b", 1, "b")}
    assert compact(spark, out, ["url"]) == 1 and rows_of(spark, out) == want
    # After the switch but before the clean-up: the old folders are still there and don't count.
    assert "snapshot=0" in folders(out) and {str(Path(f).parent.name) for f in upserted(spark, out, ["url"]).inputFiles()} == {"snapshot=1"}
