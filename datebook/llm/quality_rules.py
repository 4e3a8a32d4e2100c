"""Quality rules with thresholds that adapt to each language and source.

Everything here is DataFrame expressions.  Each document is measured once; per language and source a
histogram of each measure is kept over fixed log-linear buckets (sixteen to an octave), which is a
quantile sketch: two of them merge by adding counts, the error is bounded by a bucket's width, and
unlike a randomised sketch the result doesn't depend on the order of tasks.  Counts are added up before
the shuffle, so a hot source sends a few hundred rows from each task.

A group's thresholds are fences around its quartiles: above ``q75 + 4 * max(q75 - q25, slack)``, for
the mean word length also below ``q25 - 4 * max(...)``.  A group of fewer than ``LEAST`` documents uses
the merged sketch of its language, and a small language that of the whole table.

Edge cases: null text is empty text; null languages and sources are groups of their own; a text
without words fails the base rule; repeated rows count as often as they stand.  Columns added here
are held in one struct whose name avoids those of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datebook.llm.common import checkpointed, free_name, table, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Documents that a group must have for thresholds of its own.
LEAST = 200
#: How far beyond the quartiles a fence stands, in quartile ranges.
REACH = 4
#: Least quartile range of each measure: symbols, repeated lines and repeated words per thousand; hundredths of a letter.
SLACK = {"symbols": 50, "lines": 100, "repeats": 70, "length": 75}


def measured(docs: DataFrame, text_col: str = "text", out: str = "_q") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    own = [c for c in docs.columns if c != out]
    text = F.coalesce(F.col(text_col), F.lit(""))
    a, b, c, d = (f"{out}_{x}" for x in "abcd")
    words = docs.select(*own, F.filter(F.split(text, SPACE), lambda w: w != "").alias(a), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(b))
    hashed = words.select("*", F.transform(a, lambda w: F.xxhash64(w)).alias(c))
    count = F.size(a)
    starts = F.sequence(F.lit(0), count - WINDOW)
    windows = F.when(count >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.col(c)[i + k] for k in range(WINDOW)])))
    # Equal windows have equal hashes: only texts in which a hash repeats are looked at word by word.
    maybe = hashed.select(*own, a, b, windows.alias(c)).withColumn(c, (F.size(c) > F.size(F.array_distinct(c))))
    spelled = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(a, i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    ordered = maybe.withColumn(d, F.when(F.col(c), F.sort_array(spelled)))
    again = F.filter(d, lambda x, i: ((i > 0) & (F.get(d, i - 1)["w"] == x["w"])) | F.coalesce(F.get(d, i + 1)["w"] == x["w"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["to"])).alias("n"), (i + WINDOW).alias("to")),
        lambda s: s["n"],
    )
    measures = {
        "n_words": F.size(a),
        "word_chars": F.length(F.array_join(a, "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")),
        "n_dup_lines": F.size(b) - F.size(F.array_distinct(b)),
        "n_repeat_words": F.coalesce(F.when(F.col(c), covered), F.lit(0)),
        "n_lines": F.size(b),
    }
    return ordered.select(*own, F.struct(*[x.cast("long").alias(k) for k, x in measures.items()]).alias(out))


def base_failed(q) -> "F.Column":
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def _rates(q) -> dict:
    """The measures that thresholds are set for, as whole numbers."""
    share = lambda n, of, by: F.floor(by * n / F.greatest(of, F.lit(1)))
    return {"symbols": share(q["n_symbols"], q["n_words"], 1000), "lines": share(q["n_dup_lines"], q["n_lines"], 1000), "repeats": share(q["n_repeat_words"], q["n_words"], 1000), "length": share(q["word_chars"], q["n_words"], 100)}


def _bucket(v):
    octave = F.length(F.bin(v)) - 1
    return F.when(v < 16, v).otherwise(16 * (octave - 3) + F.floor(v / F.pow(F.lit(2.0), octave - 4)) % 16).cast("long")


def _floor_of(bucket):
    """The least value of a bucket."""
    return F.when(bucket < 16, bucket).otherwise((16 + bucket % 16) * F.pow(F.lit(2.0), F.floor(bucket / 16) - 1)).cast("long")


def sketches(rows: DataFrame, q: str = "_q", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Mergeable histograms: ``lang, source, measure, bucket, n``.  Texts without a word are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(v).alias("bucket")) for k, v in _rates(F.col(q)).items()]))
    return rows.filter(F.col(q)["n_words"] > 0).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), pairs.alias("x")).select("lang", "source", "x.*").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def _quartiles(merged: DataFrame, by: list[str]) -> DataFrame:
    """``by, measure, total, q25, q75``: the floors of the buckets that hold the quartiles."""
    merged = merged.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    at = Window.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(at.orderBy("bucket"))).withColumn("total", F.sum("n").over(at))
    reach = lambda p: _floor_of(F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("bucket"))))
    return run.groupBy(*by, "measure").agg(F.max("total").alias("total"), reach(1).alias("q25"), reach(3).alias("q75"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and the fences ``symbols, lines, repeats, length_low, length_high``."""
    own, lang, every = (_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    groups = own.select("lang", "source", "measure", F.struct("total", "q25", "q75").alias("own"))
    lang = lang.select(F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("total", "q25", "q75").alias("of_lang"))
    every = every.select(F.col("measure").alias("em"), F.struct("total", "q25", "q75").alias("of_all"))
    joined = groups.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("lm"))).join(every, F.col("measure") == F.col("em"))
    best = joined.select("lang", "source", "measure", F.when(F.col("own.total") >= LEAST, F.col("own")).when(F.col("of_lang.total") >= LEAST, F.col("of_lang")).otherwise(F.col("of_all")).alias("x"))
    fences = []
    for k, slack in SLACK.items():
        spread = REACH * F.greatest(F.col("x.q75") - F.col("x.q25"), F.lit(slack))
        mine = F.col("measure") == k
        if k == "length":
            fences += [F.max(F.when(mine, F.col("x.q25") - spread)).alias("length_low"), F.max(F.when(mine, F.col("x.q75") + spread)).alias("length_high")]
        else:
            fences.append(F.max(F.when(mine, F.col("x.q75") + spread)).alias(k))
    return best.groupBy("lang", "source").agg(*fences)


def judged(rows: DataFrame, fences: DataFrame, q: str = "_q", out: str = "_kept", lang_col: str = "lang", source_col: str = "source", fence: str = "_f") -> DataFrame:
    """``rows`` with boolean ``out``.  The fences are a row per group; Spark broadcasts them only below its threshold."""
    f = fences.select(F.struct("*").alias(fence))
    rate, of = _rates(F.col(q)), F.col(fence)
    fits = (rate["symbols"] <= of["symbols"]) & (rate["lines"] <= of["lines"]) & (rate["repeats"] <= of["repeats"]) & (rate["length"] >= of["length_low"]) & (rate["length"] <= of["length_high"])
    met = rows.join(f, rows[lang_col].eqNullSafe(of["lang"]) & rows[source_col].eqNullSafe(of["source"]), "left")
    return met.withColumn(out, ~base_failed(F.col(q)) & F.coalesce(fits, F.lit(False))).drop(fence)


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text, lang, source and any others) that pass, with the same columns.

    The measured rows are written once: the sketches read three of their columns, and a filter over
    written columns cannot be pushed into the measures, which would multiply their expressions.
    """
    q, kept, fence = (free_name(x, docs.columns) for x in ("_q", "_kept", "_f"))
    rows = written(measured(docs, out=q), "measured")
    return judged(rows, checkpointed(thresholds(sketches(rows, q))), q, kept, fence=fence).filter(F.col(kept)).select(docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(rows, thresholds(sketches(rows))).select("doc_id", *[F.col("_q")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(F.col("_q")).alias("base_failed"), F.col("_kept").alias("kept"))


#: Measures of ``{docs}`` (doc_id, text, lang, source).
MEASURED_SQL = r"""
q_words AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
q_lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM q_words) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
q_at AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM q_words WHERE len(w) >= 8),
q_spelled AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM q_at),
q_again AS (SELECT r, i FROM q_spelled QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
q_covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM q_again, range(0, 8) AS o(k) GROUP BY r),
q_measured AS (SELECT q_words.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM q_words LEFT JOIN q_lines USING (r) LEFT JOIN q_covered USING (r)),
q_rated AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS wlength FROM q_measured),
q_long AS (SELECT lang, source, measure, v FROM (
  SELECT lang, source, 'symbols' AS measure, symbols AS v FROM q_rated WHERE n_words > 0 UNION ALL SELECT lang, source, 'lines', lines FROM q_rated WHERE n_words > 0
  UNION ALL SELECT lang, source, 'repeats', repeats FROM q_rated WHERE n_words > 0 UNION ALL SELECT lang, source, 'length', wlength FROM q_rated WHERE n_words > 0)),
q_floor AS (SELECT lang, source, measure, CASE WHEN v < 16 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS b FROM q_long),
q_sets AS (SELECT 0 AS level, lang, source, measure, b FROM q_floor UNION ALL SELECT 1, lang, NULL, measure, b FROM q_floor UNION ALL SELECT 2, NULL, NULL, measure, b FROM q_floor),
q_upto AS (SELECT level, lang, source, measure, b, count(*) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, count(*) OVER (PARTITION BY level, lang, source, measure) AS total FROM q_sets),
q_quart AS (SELECT level, lang, source, measure, max(total) AS total, min(b) FILTER (upto * 4 >= total) AS q25, min(b) FILTER (upto * 4 >= total * 3) AS q75 FROM q_upto GROUP BY ALL),
q_best AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= 200 THEN o.q25 WHEN l.total >= 200 THEN l.q25 ELSE e.q25 END AS q25, CASE WHEN o.total >= 200 THEN o.q75 WHEN l.total >= 200 THEN l.q75 ELSE e.q75 END AS q75
  FROM q_quart o JOIN q_quart l ON l.level = 1 AND o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN q_quart e ON e.level = 2 AND e.measure = o.measure WHERE o.level = 0),
q_fences AS (SELECT lang, source, max(q75 + 4 * greatest(q75 - q25, 50)) FILTER (measure = 'symbols') AS f_symbols, max(q75 + 4 * greatest(q75 - q25, 100)) FILTER (measure = 'lines') AS f_lines,
  max(q75 + 4 * greatest(q75 - q25, 70)) FILTER (measure = 'repeats') AS f_repeats, max(q25 - 4 * greatest(q75 - q25, 75)) FILTER (measure = 'length') AS f_low, max(q75 + 4 * greatest(q75 - q25, 75)) FILTER (measure = 'length') AS f_high FROM q_best GROUP BY lang, source),
q_judged AS (SELECT r, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= f_symbols AND lines <= f_lines AND repeats <= f_repeats AND wlength >= f_low AND wlength <= f_high, false) AS kept
  FROM q_rated q LEFT JOIN q_fences f ON q.lang IS NOT DISTINCT FROM f.lang AND q.source IS NOT DISTINCT FROM f.source)
"""

ORACLE = "WITH " + MEASURED_SQL.replace("{docs}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged"
