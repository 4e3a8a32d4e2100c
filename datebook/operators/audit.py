"""How much of what a page should say is left in the model's input, and whether fixtures fit their corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datebook.functions.patterns import MAX_CHARS
from datebook.functions.text import let, normalize_search_text, normalize_search_texts, round_number, trim
from datebook.operators.source_choice import csv_chars

LABEL_FIELDS = ["title", "date", "time", "location"]
CAPTURED = ["html", "text", "title", "lang", "finalUrl", "capturedAt"]
#: What :func:`listed_labels` gives.
LABELS = "array<struct<event: int, title: string, field: string, label: string>>"


class FixtureError(ValueError):
    """A corpus and its fixtures, or a selection and what there is, don't fit."""


def expected_event(e: Column) -> Column:
    """Trimmed fields, blank ones null, and the distinct labels: fields first, then the event's own."""
    fields = {f: F.when(trim(e[f]) != "", trim(e[f])) for f in LABEL_FIELDS}
    own = F.transform(F.coalesce(e["labels"], F.array().cast("array<string>")), trim)
    labels = F.array_distinct(F.filter(F.concat(F.array(*fields.values()), own), lambda x: x.isNotNull() & (x != "")))
    return F.struct(*[v.alias(k) for k, v in fields.items()], labels.alias("labels"))


def normalized_corpus(corpus: DataFrame) -> DataFrame:
    positive = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(default)
    return corpus.withColumns({
        "name": trim(F.coalesce("name", F.lit(""))), "url": trim(F.coalesce("url", F.lit(""))), "expectedAnchors": F.coalesce("expectedAnchors", F.array().cast("array<string>")),
        "expectedEvents": F.coalesce(F.transform("expectedEvents", expected_event), F.array()), "maxContextChars": positive("maxContextChars", MAX_CHARS), "maxPreviousContextGrowthRatio": positive("maxPreviousContextGrowthRatio", None),
    })


def integrity(corpus: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``name, problem``: entries without a snapshot, and snapshots without an entry."""
    lost = corpus.join(snapshots, "name", "left_anti").select("name", F.lit("no snapshot").alias("problem"))
    return lost.union(snapshots.join(corpus, "name", "left_anti").select("name", F.lit("not in the corpus").alias("problem")))


def joined_fixtures(corpus: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Corpus entries with what was captured; any problem of integrity is an error."""
    problems = integrity(corpus, snapshots).limit(20).collect()
    if problems:
        raise FixtureError("; ".join(f"{r.name}: {r.problem}" for r in problems))
    captured = [c for c in CAPTURED if c in snapshots.columns]
    return corpus.drop(*captured).join(snapshots.select("name", *captured), "name")


def selected(fixtures: DataFrame, names: list[str]) -> DataFrame:
    """The named fixtures, or all if none is named; a name that isn't there is an error."""
    if not names:
        return fixtures
    wanted = fixtures.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    if missing := [r.name for r in wanted.join(fixtures, "name", "left_anti").collect()]:
        raise FixtureError("no fixture named " + ", ".join(sorted(missing)))
    return fixtures.join(F.broadcast(wanted), "name", "left_semi")


def listed_labels(events: Column) -> Column:
    """Structs ``event, title, field, label`` of all labels of a page's expected events."""
    fields = lambda e: F.filter(F.array(*[F.struct(F.lit(f).alias("field"), trim(e[f]).alias("label")) for f in LABEL_FIELDS]), lambda x: x["label"] != "")
    own = lambda e: F.filter(F.array_distinct(F.coalesce(e["labels"], F.array().cast("array<string>"))), lambda x: (x != "") & ~F.array_contains(F.array(*[F.coalesce(e[f], F.lit("")) for f in LABEL_FIELDS]), x))
    listed = lambda e: F.concat(fields(e), F.transform(own(e), lambda x, i: F.struct(F.format_string("label-%d", i + 1).alias("field"), x.alias("label"))))
    title = lambda e, i: F.coalesce(e["title"], F.format_string("event-%d", i + 1))
    return F.flatten(F.transform(events, lambda e, i: F.transform(listed(e), lambda x: F.struct(i.alias("event"), title(e, i).alias("title"), x["field"].alias("field"), x["label"].alias("label")))))


def held_in(x: Column, found: Column) -> Column:
    """Whether ``x`` contains each of an array's texts; all are normalised, ``x`` once."""
    return let(normalize_search_text(x), lambda whole: F.transform(found, lambda s: F.contains(whole, s)))


def label_rows(df: DataFrame, keys: list[str], events_col: str, source_col: str, context_col: str) -> DataFrame:
    """A row for each label of each expected event, with its presence in the source and in the context."""
    rows = df.select(*keys, listed_labels(F.col(events_col)).alias("_l"), source_col, context_col)
    rows = rows.withColumn("_n", normalize_search_texts(F.col("_l.label")))
    # A page's texts are left behind before it is multiplied by its labels.
    rows = rows.select(*keys, F.explode(F.arrays_zip("_l", held_in(F.col(source_col), F.col("_n")).alias("in_source"), held_in(F.col(context_col), F.col("_n")).alias("in_context"))).alias("_r"))
    return rows.select(*keys, "_r._l.event", "_r._l.title", "_r._l.field", "_r._l.label", "_r.in_source", "_r.in_context")


def label_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each expected event the fields missed in the source and in the context."""
    missed = lambda c: F.array_sort(F.collect_list(F.when(~F.col(c), F.col("field"))))
    return rows.groupBy(*keys, "event", "title").agg(F.count("*").alias("labels"), missed("in_source").alias("missing_source"), missed("in_context").alias("missing_context"), (F.min("in_source") & F.min("in_context")).alias("passed"))


def page_audit(fixtures: DataFrame) -> DataFrame:
    """Sizes, shrink ratios, missing anchors and labels, and whether a page passes.

    ``fixtures`` have been preprocessed: ``page, model_input, csv_snippets`` beside the corpus's columns.  A page is
    audited in its own row, whatever its name, and its texts go nowhere.
    """
    context = F.concat_ws("\n", F.col("model_input"), F.col("csv_snippets"))
    ratio = lambda a, b: round_number(F.try_divide(a, F.when(b > 0, b)))
    df = fixtures.withColumns({"csv_chars": csv_chars(F.col("csv_snippets")), "separators": F.size("csv_snippets"), "markdown_chars": F.length("page.markdown")})
    df = df.withColumn("context_chars", F.length("model_input") + F.col("csv_chars") + F.col("separators"))
    df = df.withColumn("previous_chars", F.when(F.col("markdown_chars") > 0, F.col("markdown_chars") + F.col("csv_chars") + F.col("separators")))
    df = df.withColumns({"text_ratio": ratio(F.col("context_chars"), F.length("text")), "markdown_ratio": ratio(F.col("context_chars"), F.col("markdown_chars")), "previous_ratio": ratio(F.col("context_chars"), F.col("previous_chars"))})
    labels, anchors = listed_labels(F.col("expectedEvents")), F.coalesce("expectedAnchors", F.array().cast("array<string>"))
    df = df.withColumn("_listed", F.coalesce(labels, F.array().cast(LABELS))).withColumn("_said", F.concat(anchors, F.transform("_listed", lambda x: x["label"])))
    df = df.withColumn("_found", normalize_search_texts(F.col("_said")))
    # Anchors are looked for in the context alone, but stand with the labels, so that a text is normalised once.
    df = df.withColumns({"_in_context": held_in(context, F.col("_found")), "_in_source": held_in(F.col("text"), F.col("_found"))})
    events = F.concat(F.transform(anchors, lambda x: F.lit(None).cast("string")), F.transform("_listed", lambda x: F.concat(x["title"], F.lit(": "), x["field"], F.lit("="), x["label"])))
    lost = lambda names, held: F.array_sort(F.filter(F.zip_with(names, held, lambda x, there: F.when(~there, x)), lambda x: x.isNotNull()))
    out = df.withColumns({"missing_anchors": lost(anchors, F.slice("_in_context", 1, F.size(anchors))), "missing_events": lost(events, F.col("_in_context")), "missing_source_events": lost(events, F.col("_in_source"))})
    grown = F.coalesce(F.col("previous_ratio") <= F.col("maxPreviousContextGrowthRatio"), F.lit(True))
    return out.withColumn("passed", (F.size("missing_anchors") + F.size("missing_source_events") + F.size("missing_events") == 0) & (F.col("context_chars") <= F.col("maxContextChars")) & grown).drop("_listed", "_said", "_found", "_in_context", "_in_source")


def audit_report(pages: DataFrame) -> DataFrame:
    """Number of pages and whether all passed; no page is a pass."""
    return pages.agg(F.count("*").alias("page_count"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def audit_line() -> Column:
    """One line of text for an audited page."""
    shown = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0\z", ""), F.lit("n/a"))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {name}="), F.array_join(c, " | "))).otherwise("")
    head = F.format_string("%s %s context=%d textRatio=%s markdownRatio=%s previousRatio=%s", F.when(F.col("passed"), "PASS").otherwise("FAIL"), "name", "context_chars", shown("text_ratio"), shown("markdown_ratio"), shown("previous_ratio"))
    return F.concat(head, part("missing", "missing_anchors"), part("missingSourceEvents", "missing_source_events"), part("missingEvents", "missing_events"))


def errored_page(df: DataFrame, error_col: str, expected_col: str) -> DataFrame:
    """Pages whose evaluation failed: not passed, and every expected event missed."""
    bad = F.col(error_col).isNotNull()
    return df.withColumns({"passed": F.when(bad, False).otherwise(F.col("passed")), "misses": F.when(bad, F.size(expected_col)).otherwise(F.col("misses"))})
