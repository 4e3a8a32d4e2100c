import random
import re
from collections import Counter

from datebook.llm.quality_rules import judged, measured, quality_filter, sketches, thresholds

SCHEMA = "doc_id long, text string, lang string, source string, _q string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_measures_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a b\n\na b\n", "É 日本 😀 x#y", "same " * 9000, "a b c d e f g h " * 3, "line\nline \nline\n\x0b\nline"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r.m) for r in measured(rows, out="m").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_filter_keeps_ordinary_documents_and_drops_outliers(spark):
    rng = random.Random(1)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(100))
    rows = [(i, plain(), rng.choice(["en", None]), "hot" if i % 3 else f"s{i}", "x") for i in range(500)]
    rows += [(1000, " ".join(w + "###" for w in plain().split()), "en", "hot", "x"), (1001, None, "en", "hot", "x"), (1002, "again and " * 60, None, "hot", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(500))
    assert quality_filter(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, "w%d " % i * (20 + i), "en", "s", "") for i in range(40)], SCHEMA)
    rows = measured(docs)
    halves = sketches(rows.filter("doc_id < 20")).union(sketches(rows.filter("doc_id >= 20")))
    assert thresholds(halves).collect() == thresholds(sketches(rows)).collect()
    assert judged(rows, thresholds(halves)).count() == 40


def test_columns_of_the_input_keep_their_values(spark):
    rows = [(i, " ".join(f"word{k}" for k in range(i, i + 40)) if i % 5 else "few words", "en", "s", i * 7, -i, f"x{i}", i + 0.5) for i in range(40)]
    rows += rows[1:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _q bigint, _kept bigint, _F string, _q_a double")
    out = quality_filter(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if brute(r[1])[0] >= 20 and 100 * brute(r[1])[4] <= 30 * brute(r[1])[0])
