from datebook.streaming.consume_once import ARRIVALS, answer_stream

MINUTE = 60_000


def arrive(spark, tmp_path, rows):
    source, out, checkpoint = (str(tmp_path / x) for x in ("source", "out", "checkpoint"))
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(source)
    query = answer_stream(spark.readStream.schema(ARRIVALS).parquet(source), out, checkpoint)
    assert query.awaitTermination(60)
    assert query.exception() is None
    return {r.read_id: (r.status, r.result) for r in spark.read.parquet(out).collect()}


def put(url, ts, result, status="complete"):
    return (url, "put", ts, status, result, None)


def read(url, ts, who):
    return (url, "read", ts, None, None, who)


NOTHING = (None, None)


def test_first_read_takes_it(spark, tmp_path):
    got = arrive(spark, tmp_path, [put("a", 100, "A"), read("a", 100, "a1"), read("a", 101, "a2"), put("b", 100, "B"), put("p", 100, "half", "pending"), read("p", 101, "p1"), put("e", 5, "old"), put("e", 7, "failed", "error"), read("early", 5, "early1"), read(None, 9, "null1"), (None, "put", 8, "complete", "N", None), ("a", "else", 1, None, None, "x"), read("a", None, "y")])
    assert got == {"a1": ("complete", "A"), "a2": NOTHING, "p1": ("pending", "half"), "early1": NOTHING, "null1": ("complete", "N")}
    # The stream starts again: what waits is still there, once; an old delivery of what was taken isn't.
    got = arrive(spark, tmp_path, [read("b", 200, "b1"), put("a", 100, "A"), read("a", 200, "a3"), put("p", 150, "whole"), read("p", 120, "late"), read("p", 160, "p2"), read("p", 170, "p3"), read("e", 8, "e1")])
    assert {k: got[k] for k in ("b1", "a3", "late", "p2", "p3", "e1")} == {"b1": ("complete", "B"), "a3": NOTHING, "late": ("pending", "half"), "p2": ("complete", "whole"), "p3": NOTHING, "e1": ("error", "failed")}
    got = arrive(spark, tmp_path, [put("a", 300, "new"), read("a", 300, "a4"), read("b", 300, "b2")])
    assert got["a4"] == ("complete", "new") and got["b2"] == NOTHING
    assert len(got) == 13


def test_old_results_are_gone(spark, tmp_path):
    got = arrive(spark, tmp_path, [put("a", 0, "A"), read("a", 15 * MINUTE, "just"), put("b", 0, "B"), read("b", 15 * MINUTE + 1, "over"), put("c", 10, "C"), read("c", 9, "before"), read("c", 11, "after")])
    assert got == {"just": ("complete", "A"), "over": NOTHING, "before": NOTHING, "after": ("complete", "C")}
