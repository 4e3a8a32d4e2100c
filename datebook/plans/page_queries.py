"""Queries over pages: what may be scanned, their markdown, tables and model input, and the audit of those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.operators import access, audit
from datebook.operators.html import parsed_page
from datebook.operators.source_choice import csv_chars, preprocess_pages
from datebook.plans.derived import spread, table


def _tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, message``: addresses of four kinds and failures of three."""
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id")
    kind = F.pmod(n, F.lit(4))
    url = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("chrome://settings/"), n.cast("string"))).when(kind == 2, F.concat(F.lit("https://ChromeWebStore.google.com/detail/"), n.cast("string")))
    failure = F.pmod(n, F.lit(3))
    message = F.when(failure == 0, "Cannot access contents of URL").when(failure == 1, "Daily limit reached").otherwise("Network timed out")
    return pages.select("page_id", url.alias("url"), message.alias("message"))


_TABS_SQL = """tabs AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'chrome://settings/' || page_id WHEN 2 THEN 'https://ChromeWebStore.google.com/detail/' || page_id END AS url,
  CASE page_id % 3 WHEN 0 THEN 'Cannot access contents of URL' WHEN 1 THEN 'Daily limit reached' ELSE 'Network timed out' END AS message FROM pages)"""


def tab_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, message = F.col("url"), F.col("message")
    return _tabs(spark, sf_dir).select(
        "page_id", access.scan_block_reason(url).alias("reason"), access.required_scan_block_reason(url).alias("required_reason"), access.injection_failure(url, message).alias("failure"),
        access.is_rate_limit(F.lit("ERROR"), message).alias("rate_limited"), access.scan_error_kind(message).alias("error_kind"),
    )


_REASON_SQL = f"CASE page_id % 4 WHEN 1 THEN '{access.CHROME_PAGE}' WHEN 2 THEN '{access.WEB_STORE}' END"
TAB_ACCESS_SQL = f"""WITH {_TABS_SQL} SELECT page_id, {_REASON_SQL} AS reason, CASE WHEN url IS NULL THEN '{access.PROTECTED_PAGE}' ELSE {_REASON_SQL} END AS required_reason,
coalesce({_REASON_SQL}, CASE WHEN message LIKE 'Cannot access%' THEN '{access.PROTECTED_PAGE}' END) AS failure, message LIKE 'Daily%' AS rate_limited, CASE WHEN message LIKE '%timed out' THEN 'timeout' ELSE 'generic' END AS error_kind FROM tabs"""


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", parsed_page(F.col("html")).alias("page")).select("page_id", "page.title", "page.markdown", F.length("page.markdown").cast("long").alias("chars"))


def _table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose body starts with a table: one with a head, one without and of 40 long rows, or a head alone."""
    n = F.col("page_id")
    head = "<table><thead><tr><th>Name</th><th>Day</th></tr></thead>"
    short = F.concat(F.lit(head + "<tr><td>Show "), n.cast("string"), F.lit("</td><td>Mar "), (n % 28 + 1).cast("string"), F.lit('</td></tr><tr><td>A "b",\nc</td></tr></table>'))
    row = lambda k: F.concat(F.lit("<tr><td>r"), k.cast("string"), F.lit("</td><td>"), F.repeat(F.lit("x"), F.when(k == 1, 300).otherwise(20)), F.lit("</td></tr>"))
    long = F.concat(F.lit("<table>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), row), ""), F.lit("</table>"))
    found = F.when(n % 3 == 0, short).when(n % 3 == 1, long).otherwise(head + "</table>")
    return table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), found)).alias("html"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each table of a page that has a header and a body; the tables are made, as the pages have none."""
    return spread(_table_pages(spark, sf_dir)).select("page_id", parsed_page(F.col("html")).alias("page")).select("page_id", F.posexplode("page.tables").alias("idx", "csv"))


PAGE_TABLES_SQL = """WITH cells AS (SELECT '"r0","' || repeat('x', 20) || '"' || chr(10) || string_agg('"r' || k || '","' || CASE k WHEN 1 THEN repeat('x', 237) || '...' ELSE repeat('x', 20) END || '"', chr(10) ORDER BY k) AS csv FROM range(1, 31) t(k))
SELECT page_id, CAST(0 AS INTEGER) AS idx, CASE page_id % 3 WHEN 0 THEN '"Name","Day"' || chr(10) || '"Show ' || page_id || '","Mar ' || (page_id % 28 + 1) || '"' || chr(10) || '"A ""b"", c",""' ELSE csv END AS csv FROM pages, cells WHERE page_id % 3 <> 2 AND contains(html, '<body>')"""


#: Paragraphs of the made pages: what an event has, what a page has besides, and a line of no meaning of a given length.
_EVENT = {"title": "concat('Jazz Night ', page_id)", "date": "concat('March ', page_id % 28 + 1, ', 2026')", "time": "'7:30 PM'", "location": "'Room 5, Main Street'"}
_E, _D, _P = _EVENT["title"], f"concat({_EVENT['date']}, ' ', {_EVENT['time']})", _EVENT["location"]


def _filler(length: int) -> str:
    return f"rpad('Plain words of ', {length}, 'x')"


#: By kind of page its rendered text and its paragraphs: (paragraphs of the text, or None; what is between them; paragraphs of the page).
#: Which of the two the model gets follows from the rules of the choice, told beside each; nothing here is measured.
_KINDS = [
    (None, 2, [_E, _D, _P], "html"),  # no text
    ([_E, _D, _P], 2, [], "text"),  # an empty page
    ([_E, _D, _P, "'Rendered'"], 2, [_E, _D, _P], "text"),  # the text fits the budget and scores as the page does
    ([_E, _D], 2, [_E, _D, "concat('Doors open at the Grand Theater, Room ', page_id)"], "html"),  # the page adds where it is
    (["'Expand all'", _E, _D], 2, [_E, _D] + [_filler(198)] * 3, "html"),  # a closed accordion
    (["'Expand it'", _E, _D], 2, [_E, _D] + [_filler(198)] * 3, "text"),  # none
    ([_E, _D] + ["'Read more'"] * 6, 2, [_E, _D, _filler(198)], "html"),  # details behind links
    (["'Fri | March 5'", "'Expand all'", _E, _D], 2, [_E, _D] + [_filler(198)] * 3, "text"),  # an accordion, but with a dated row first
    ([_filler(198)] * 100, 2, [_E, _D, _P], "html"),  # beyond the budget, and the page isn't
    (([_E, _D, _P] + [_filler(98)] * 6) * 3 + [_filler(98)] * 159, 3, [_E, _D, _P], "text"),  # so too, but it tells of more events
    ([f"rpad('Fri | March 5 ', 198, 'x')"] + [_filler(198)] * 29, 3, [_filler(198)] * 40, "text"),  # a dated row first; tables leave 6015 characters
]
#: A line of a made table has 140 characters and a table 31 lines; the first three of a page count, and of the third 23 lines are left within 12000 characters.
_TABLES = f"""concat_ws('', transform(sequence(1, 4), t -> concat('<table><thead><tr><th>r00</th><th>', repeat('x', 132), '</th></tr></thead>', concat_ws('', transform(sequence(1, 30), k -> concat('<tr><td>r', lpad(k, 2, '0'), '</td><td>', repeat('x', 132), '</td></tr>'))), '</table>')))"""


def _runs(paragraphs: list[str]) -> list[tuple[str, int]]:
    """Paragraphs that repeat, with how often, so that formulas stay short."""
    out: list[tuple[str, int]] = []
    for p in paragraphs:
        out = [*out[:-1], (p, out[-1][1] + 1)] if out and out[-1][0] == p else [*out, (p, 1)]
    return out


def _page_text(paragraphs: list[str], breaks: int) -> str:
    """The paragraphs with so many line ends between them, as SQL that Spark and DuckDB read alike."""
    gap = f"repeat(chr(10), {breaks})"
    return "concat(" + f", {gap}, ".join(p if n == 1 else f"repeat(concat({p}, {gap}), {n - 1}), {p}" for p, n in _runs(paragraphs)) + ")"


def _by_kind(kinds: int, value) -> str:
    return f"CASE page_id % {kinds} " + " ".join(f"WHEN {k} THEN {value(k, *_KINDS[k])}" for k in range(kinds)) + " END"


def _text_sql(kinds: int) -> str:
    return _by_kind(kinds, lambda k, text, breaks, page, wins: "CAST(NULL AS STRING)" if text is None else _page_text(text, breaks))


def _html_sql(kinds: int) -> str:
    tags = lambda page: ", ".join(f"'<p>', {p}, '</p>'" if n == 1 else f"repeat(concat('<p>', {p}, '</p>'), {n})" for p, n in _runs(page))
    return _by_kind(kinds, lambda k, text, breaks, page, wins: f"concat('<html><head><title>Page</title></head><body>', {tags(page)}, {_TABLES if k == 10 else chr(39) * 2}, '</body></html>')" if page else "'<html><body></body></html>'")


def _chosen_sql(kinds: int) -> str:
    """The model's input: blocks of the text or the page that was chosen, with a blank line between them."""
    return _by_kind(kinds, lambda k, text, breaks, page, wins: _page_text(text if wins == "text" else page, 2))


def made_pages(spark: SparkSession, sf_dir: str, kinds: int) -> DataFrame:
    """``page_id, text, html`` for every page; the pages of the tables speak of no events, so texts and markup are made."""
    return spread(table(spark, sf_dir, "pages").select("page_id")).select("page_id", F.expr(_text_sql(kinds)).alias("text"), F.expr(_html_sql(kinds)).alias("html"))


def page_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model gets of each page: its text or its markdown, and tables, within the budget."""
    rows = preprocess_pages(made_pages(spark, sf_dir, len(_KINDS)), keep=["page_id"])
    return rows.select("page_id", "model_input", F.length("model_input").cast("long").alias("chars"), F.size("csv_snippets").cast("long").alias("tables"), csv_chars(F.col("csv_snippets")).cast("long").alias("csv_chars"))


MODEL_INPUT_SQL = f"""WITH chosen AS (SELECT page_id, {_chosen_sql(len(_KINDS))} AS model_input FROM pages)
SELECT page_id, model_input, CAST(length(model_input) AS BIGINT) AS chars, CAST(CASE page_id % {len(_KINDS)} WHEN 10 THEN 3 ELSE 0 END AS BIGINT) AS tables,
CAST(CASE page_id % {len(_KINDS)} WHEN 10 THEN 2 * (31 * 140 + 30) + 23 * 140 + 22 ELSE 0 END AS BIGINT) AS csv_chars FROM chosen"""


def site_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the tables' own pages, with the text that their markup shows."""
    rows = preprocess_pages(spread(table(spark, sf_dir, "pages").select("page_id", "html")), text_col=None, keep=["page_id"])
    return rows.select("page_id", "model_input", F.size("csv_snippets").cast("long").alias("tables"), F.length("model_input").cast("long").alias("chars"))


def _fixtures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A corpus without a tenth of the pages, and snapshots without another tenth."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), "page_id", "url", "html")
    return pages.filter("page_id % 10 <> 3").select("name", "page_id", "url"), pages.filter("page_id % 10 <> 7").select("name", "html")


def fixture_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.integrity(*_fixtures(spark, sf_dir))


FIXTURE_SQL = "SELECT 'page-' || page_id AS name, CASE page_id % 10 WHEN 7 THEN 'no snapshot' ELSE 'not in the corpus' END AS problem FROM pages WHERE page_id % 10 IN (3, 7)"


#: Kinds of pages that are audited, all but the one with tables; the most characters a page's input may have, and by how much it may grow.
_AUDITED, _MOST, _GROWTH = 10, 17000, 1.5


def page_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an expected event of each page, in its text and in the model's input."""
    pages = made_pages(spark, sf_dir, _AUDITED)
    event = F.struct(*[F.expr(_EVENT[f]).alias(f) for f in ("title", "date", "time", "location")], F.array(F.lit("Jazz")).alias("labels"))
    fixtures = pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.lit("").alias("url"), "html", "text", F.array(F.expr(_EVENT["title"])).alias("expectedAnchors"), F.array(event).alias("expectedEvents"),
        F.lit(_MOST).alias("maxContextChars"), F.lit(_GROWTH).alias("maxPreviousContextGrowthRatio"),
    )
    corpus = audit.normalized_corpus(fixtures)
    rows = audit.page_audit(preprocess_pages(corpus, keep=[c for c in corpus.columns if c != "html"]))
    joined = lambda c: F.array_join(c, "; ").alias(c)
    return rows.select("name", F.col("context_chars").cast("long").alias("context_chars"), "text_ratio", "markdown_ratio", "previous_ratio", *map(joined, ("missing_anchors", "missing_source_events", "missing_events")), "passed")


def _missing_sql(place) -> str:
    """Labels of the event that a kind's text, or its input, hasn't; in the order of their names."""
    labels = {"date": _D, "location": _P, "time": _D, "title": _E}

    def of(k, text, breaks, page, wins):
        held = place(text or [], page, wins)
        lost = [f for f, p in labels.items() if p not in held]
        extra = ["concat(title, ': label-1=Jazz')"] if _E not in held else []
        said = {f: f"concat(title, ': {f}=', {_EVENT[f]})" for f in labels}
        names = sorted([*lost, *(["label-1"] if extra else [])])
        return "concat_ws('; ', " + ", ".join(extra[0] if f == "label-1" else said[f] for f in names) + ")" if names else "''"

    return _by_kind(_AUDITED, of)


AUDIT_SQL = f"""WITH pages_of AS (SELECT page_id, {_E} AS title, {_text_sql(_AUDITED).replace('STRING', 'VARCHAR')} AS text, {_chosen_sql(_AUDITED)} AS model_input, {_by_kind(_AUDITED, lambda k, text, breaks, page, wins: f"length({_page_text(page, 2)})" if page else "0")} AS markdown FROM pages),
told AS (SELECT page_id, title, length(model_input) AS n, length(text) AS rendered, nullif(markdown, 0) AS markdown, {_missing_sql(lambda text, page, wins: text)} AS missing_source_events, {_missing_sql(lambda text, page, wins: text if wins == "text" else page)} AS missing_events FROM pages_of)
SELECT 'page-' || page_id AS name, CAST(n AS BIGINT) AS context_chars, floor(n * 10000.0::DOUBLE / rendered + 0.5) / 10000 AS text_ratio, floor(n * 10000.0::DOUBLE / markdown + 0.5) / 10000 AS markdown_ratio, floor(n * 10000.0::DOUBLE / markdown + 0.5) / 10000 AS previous_ratio,
CASE WHEN contains(missing_events, 'title=') THEN title ELSE '' END AS missing_anchors, missing_source_events, missing_events,
missing_source_events = '' AND missing_events = '' AND n <= {_MOST} AND coalesce(floor(n * 10000.0::DOUBLE / markdown + 0.5) / 10000 <= {_GROWTH}, true) AS passed FROM told"""


QUERIES = {
    "tab_access": (tab_access, TAB_ACCESS_SQL),
    "page_markdown": (page_markdown, None),
    "page_tables": (page_tables, PAGE_TABLES_SQL),
    "page_model_input": (page_model_input, MODEL_INPUT_SQL),
    "site_model_input": (site_model_input, None),
    "page_audits": (page_audits, AUDIT_SQL),
    "fixture_integrity": (fixture_integrity, FIXTURE_SQL),
}
