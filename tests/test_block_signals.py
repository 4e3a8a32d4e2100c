"""Scores and kinds of blocks by Arrow's expressions are those of the column expressions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from datebook.functions import arrow_signals as A
from datebook.functions import signals, text
from datebook.operators.blocks import signal_count, with_blocks, with_candidates

WORDS = ["Jazz", "March", "Mar", "5", "5th", "12", "2026", "10:30", "7", "pm", "AM", "to", "-", "–", "st.", "St", "Room", "cookie", "cookies", "subscribe", "Subscribe to", "newsletter", "next", "week", " ", "\t", "  ", "\n",
    "ſat", "K", "İstanbul", "[a](u)", "](", "|", "# ", "- ", ".", "Wed", "today", "tickets", "events", "dec. 9", "2026-03-05", "3/4", "x", "_", "Café", "where", " ", "login", "When", "calendar", "\f", "\r\n", "https://x", "\U0001f600"]


def texts():
    dice = random.Random(7)
    return ["", " ", "5 Mar.x", "March 5", "sept.", "5th, 2026"] + ["".join(dice.choice(WORDS) + dice.choice(["", " ", " "]) for _ in range(dice.choice([1, 2, 3, 8, 40]))) for _ in range(1500)]


def test_arrow_and_columns_agree(spark):
    rows, x = texts(), F.col("x")
    score = signals.score_block(x)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, x string").select("i", score.alias("s"), signals.is_noise(x, score), signals.is_title(x), signals.is_bridge(x), signals.is_month(x), signals.is_day(x), signal_count(x), text.line_fingerprint(x), text.trim(x)).orderBy("i").collect()
    t = A.Texts(pa.array(rows))
    s = A.scores(t)
    columns = [s, A.noise(t, s), A.titles(t), A.bridges(t), A.months(t), A.days(t), [len(A.signal_offsets(r)) for r in rows], [A.fingerprint(r) for r in rows], [A.strip(r) for r in rows]]
    assert max(s) > 20 and A.titles(t).any() and A.bridges(t).any() and A.months(t).any() and A.days(t).any()
    for k, column in enumerate(columns):
        assert [r[k + 1] for r in got] == list(column), k


def test_normalised_texts(spark):
    rows = texts()
    slow = F.regexp_replace(F.regexp_replace(F.col("x"), r"\r\n?", "\n"), r"[ \f\x0B]+", " ")
    slow = F.regexp_replace(F.regexp_replace(F.regexp_replace(slow, r"\n[ \f\x0B]+", "\n"), r"[ \f\x0B]+\n", "\n"), r"\n{4,}", "\n\n\n")
    slow = F.regexp_replace(slow, rf"^{A.S}+|{A.S}+\z", "")
    for a, b in spark.createDataFrame([(t,) for t in rows], "x string").select(slow, text.normalize_model_text(F.col("x"))).collect():
        assert a == b


def test_detail_lines(spark):
    rows = [("\n".join(texts()[k : k + 6]), " ".join(texts()[k + 3 : k + 5])) for k in range(0, 300, 6)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, t string").select("i", signals.detail_lines(F.col("h"), text.line_fingerprint(F.col("t"))))
    assert [r[1] for r in df.orderBy("i").collect()] == A.detail_lines(*[pa.array([r[k] for r in rows]) for k in (0, 1)])


def test_blocks_are_scored_a_batch_at_a_time(spark):
    df = with_candidates(with_blocks(spark.createDataFrame([("Jazz\n\nMarch 5",)], "text string"), F.col("text")))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_extract_all" not in plan and "rlike" not in plan
    assert [list(r) for r in df.select("scores", "priority").collect()] == [[[0, 10], [44, 44]]]
