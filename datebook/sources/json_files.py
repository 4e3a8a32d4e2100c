"""What the pipeline starts from: JSON files of fixtures, corpora and made events, pasted texts, and images.

Files are listed and read by Spark, from any storage it knows, each whole by one task.  A folder or pattern
without files has no rows, and so has a file of no bytes, which Spark passes over; any other file that isn't the JSON it should be is an error when its rows are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.functions import patterns as P
from datebook.functions.text import trim
from datebook.operators.audit import normalized_corpus
from datebook.operators.cache import cache_key

EVENT = "title string, preview string, startDate string, startTime string, endDate string, endTime string, location string, description string, recurrence string"
EXPECTED = "array<struct<title: string, date: string, time: string, location: string, labels: array<string>>>"
CORPUS = f"name string, url string, expectedAnchors array<string>, expectedEvents {EXPECTED}, maxContextChars double, maxPreviousContextGrowthRatio double"
FIXTURE = f"{CORPUS}, finalUrl string, capturedAt string, title string, lang string, html string, text string"
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}


def _some(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern fits a file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return any(f.isFile() for f in found or [])


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, value``: the names and contents of the files that the pattern fits."""
    if not _some(spark, pattern):
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def _or_error(good: Column, value: Column, problem: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(f": {problem}"))).cast("string"))


def json_arrays(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """``file, pos`` and the fields of ``schema``: a row for each object of the array that a file must hold.

    Absent fields are null, as are all of an element that is no object; further fields are left out.
    """
    whole = whole_files(spark, pattern)
    items = F.from_json(_or_error(F.json_array_length("value").isNotNull(), F.col("value"), "must be a JSON array"), "array<string>")
    return whole.select("file", F.posexplode(items).alias("pos", "item")).select("file", "pos", F.from_json("item", schema).alias("_e")).select("file", "pos", "_e.*")


def corpus_entries(spark: SparkSession, pattern: str) -> DataFrame:
    """The entries of corpus files, with what they leave out filled in."""
    return normalized_corpus(json_arrays(spark, pattern, CORPUS).drop("file", "pos"))


def captured_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """The captured pages of a folder: one object a ``.json`` file, without generated reports, ordered by name."""
    whole = whole_files(spark, folder.rstrip("/") + "/*.json").filter(~F.col("file").rlike(P.REPORT_FILE))
    text = _or_error(F.json_object_keys("value").isNotNull(), F.col("value"), "must be a JSON object")
    return whole.select(F.from_json(text, FIXTURE).alias("_f")).select("_f.*").orderBy(F.collate("name", "UNICODE"))


def made_events(spark: SparkSession, pattern: str) -> DataFrame:
    """``pos`` and event fields of files of made events."""
    return json_arrays(spark, pattern, EVENT).drop("file")


def cached_events(events: DataFrame, url: Column, at: Column) -> DataFrame:
    """One entry, as a scan of ``url`` would leave it: all events in order, none selected."""
    fields = [c for c in events.columns if c != "pos"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("e")))), lambda x: x["e"])
    return events.agg(listed.alias("events")).select(cache_key(url).alias("key"), "events", F.array().cast("array<int>").alias("selected"), at.alias("ts"))


def pasted_texts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose pasted text isn't blank, trimmed, as pages without markup that are never cached."""
    made = {text_col: F.when(F.col(text_col).isNotNull(), trim(F.col(text_col))), "html": F.lit(None).cast("string"), "title": F.lit("Custom Context"), "lang": F.lit("en"), "cache_results": F.lit(False)}
    return texts.withColumns(made).filter(F.col(text_col) != "")


def image_urls(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, url``: images as data addresses; the kind is told by the name's end, unknown ones are plain bytes."""
    if not _some(spark, pattern):
        return spark.createDataFrame([], "file string, url string")
    end = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, end), F.lit("application/octet-stream"))
    return spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("url"))


def with_image_data(pages: DataFrame, images: DataFrame, image_col: str = "image") -> DataFrame:
    """``image_col`` as a data address: one that is stays, a name found among ``images`` (:func:`image_urls`) is replaced, any other address stays."""
    held = pages.withColumn("_file", F.when(~F.startswith(image_col, F.lit("data:")), F.element_at(F.split(image_col, "/"), -1)))
    known = images.groupBy("file").agg(F.min("url").alias("_url")).withColumnRenamed("file", "_file")
    return held.join(known, "_file", "left").withColumn(image_col, F.coalesce("_url", image_col)).drop("_file", "_url")
