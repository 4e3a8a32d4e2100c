"""Queries over the blocks of texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.operators.blocks import block_rows, block_signals, condense, with_blocks, with_candidates
from datebook.plans.derived import SIGNAL_DOCS_SQL, signal_docs, spread, table

#: Characters that the selection queries leave of each text.
BUDGET = 3000


def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_blocks(spread(signal_docs(spark, sf_dir)), F.col("text")).select("lang", "source", F.explode_outer("blocks").alias("content")).filter("content IS NOT NULL")
    rows = rows.withColumn("_s", block_signals(F.col("content"))).select("lang", "source", "content", "_s.score", "_s.noise")
    return rows.groupBy("lang", "source").agg(
        F.count("*").alias("blocks"), F.sum(F.col("score").cast("long")).alias("score_sum"), F.count(F.when(F.col("noise"), 1)).alias("noise_blocks"), F.max(F.col("score").cast("long")).alias("score_max"), F.sum(F.length("content").cast("long")).alias("chars")
    )


def noise_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_rows(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return rows.filter("noise").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("score").cast("long").alias("score"), "content")


def _priorities(docs: DataFrame) -> DataFrame:
    rows = with_candidates(with_blocks(docs, F.col("text")))
    rows = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("priority", "scores")).alias("idx", "x"))
    return rows.filter("x.priority IS NOT NULL").select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("x.scores").cast("long").alias("score"), F.col("x.priority").cast("long").alias("priority"))


def candidate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priorities(spread(signal_docs(spark, sf_dir)))


def context_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condense(spread(signal_docs(spark, sf_dir)), "text", BUDGET).select("doc_id", "condensed", F.length("condensed").cast("long").alias("chars"))


_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_DATE = "(?i)" + "|".join([
    r"\b(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)(?:day)?\b",
    r"\b(?:today|tonight|tomorrow|yesterday|this\s+(?:morning|afternoon|evening|week|weekend)|next\s+(?:week|weekend))\b",
    rf"\b{_MONTH}\s+{_DAY}\s*(?:-|–|—|to|through)\s*{_MONTH}\s+{_DAY}(?:,\s*\d{{4}})?\b",
    rf"\b{_MONTH}\s+{_DAY}(?:,\s*\d{{4}})?\b", rf"\b{_DAY}\s+{_MONTH}(?:\s+\d{{4}})?\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b",
])
_TIME = r"(?i)\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b|\b\d{1,2}:\d{2}\b"
_EVENT = "event|calendar|ticket|tickets|rsvp|registration|doors|admission|presented|live|music|webinar|workshop|concert|screening|festival|meetup|lecture|panel|class|session|conference|show|performance|tour"
_PLACE = r"venue|location|where|address|room|auditorium|hall|street|st\.|avenue|ave\.|road|rd\."
_TITLE_EVENT = "event|workshop|concert|screening|festival|meetup|lecture|panel|class|session|conference|show|performance|tour|market|opera|jazz|theater|theatre|film|movie|comedy|dance|night|party|gala|fair"
_CHROME = "cookie|privacy policy|terms of use|terms and conditions|subscribe|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content"
_NOISE = "manage cookies?|cookies?|privacy policy|terms of use|terms and conditions|subscribe|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content|navigation"
_TITLE_CHROME = "privacy policy|terms of use|terms and conditions|newsletter|login|signin|signup|account|cart|copyright|all rights reserved|skip to content|navigation"
_COMPACT = "manage cookies?|cookies?|privacy policy|terms of use|subscribe|newsletter|login|account|copyright|navigation"


def _has(words: str, x: str = "c") -> str:
    return f"regexp_matches({x}, '(?i)\\b(?:{words})\\b')"


def _score(x: str) -> str:
    n = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    return (
        f"10 * {n(_DATE)} + 10 * {n(_TIME)} + CASE WHEN {_has(_EVENT, x)} THEN 5 ELSE 0 END + CASE WHEN {_has(_PLACE, x)} THEN 5 ELSE 0 END + CASE WHEN regexp_matches({x}, '^#{{1,6}}\\s') THEN 2 ELSE 0 END "
        f"+ CASE WHEN regexp_matches({x}, '^\\s*[-*]\\s+') THEN 1 ELSE 0 END - CASE WHEN {n('\\]\\(')} > 3 AND length({x}) < 200 THEN 5 ELSE 0 END - CASE WHEN {_has(_CHROME, x)} THEN 8 ELSE 0 END - CASE WHEN length(trim({x})) < 4 THEN 3 ELSE 0 END"
    )


_NOISY = f"(score < 8 AND ({_has(_NOISE)} OR len(regexp_extract_all(c, '\\]\\(')) > 2 AND length(c) < 220))"


def _blocks_sql(source: str) -> str:
    """CTEs down to ``scored (doc_id, lang, source, idx, c, score)``; no text here has a long paragraph full of signals."""
    t = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    norm = t("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\f\\v]+', ' ', 'g'), '\\n[ \\f\\v]+', chr(10), 'g'), '[ \\f\\v]+\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')")
    lines = f"list_filter(list_transform(string_split(p, chr(10)), lambda x: {t('x')}), lambda x: x <> '')"
    return f"""paragraphs AS (SELECT doc_id, lang, source, pi, {t('p')} AS p FROM (SELECT doc_id, lang, source, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, lang, source, regexp_split_to_array({norm}, '\\n\\s*\\n') AS ps FROM {source}))),
lined AS (SELECT *, {lines} AS ls FROM paragraphs WHERE p <> ''),
cut AS (SELECT doc_id, lang, source, pi, CASE WHEN len(ls) > 4 OR len(ls) > 1 AND list_max(list_transform(ls, lambda x: length(x))) <= 180 THEN ls ELSE [p] END AS bs FROM lined),
blocks AS (SELECT doc_id, lang, source, pi, unnest(bs) AS c, generate_subscripts(bs, 1) AS bi FROM cut),
scored AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY doc_id ORDER BY pi, bi) - 1 AS idx, c, CAST({_score('c')} AS BIGINT) AS score FROM blocks)"""


BLOCK_SCORES_SQL = f"WITH {SIGNAL_DOCS_SQL}, {_blocks_sql('signal_docs')} SELECT lang, source, count(*) AS blocks, CAST(sum(score) AS BIGINT) AS score_sum, count(*) FILTER ({_NOISY}) AS noise_blocks, max(score) AS score_max, CAST(sum(length(c)) AS BIGINT) AS chars FROM scored GROUP BY lang, source"
NOISE_SQL = f"WITH {_blocks_sql('documents')} SELECT doc_id, idx, score, c AS content FROM scored WHERE {_NOISY}"

_COMPACT_LINE = f"NOT contains(c, chr(10)) AND NOT regexp_matches(c, '{_DATE}') AND NOT regexp_matches(c, '(?i)^{_MONTH}$') AND NOT regexp_matches(c, '(?i)^{_DAY}(?:,?\\s*\\d{{4}})?$') AND NOT regexp_matches(c, '(?i)[\\]\\[]\\(|https?://')"
_WORDS = "len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> ''))"
_TITLE = f"""(length(c) <= 220 AND {_COMPACT_LINE} AND NOT regexp_matches(c, '(?i)^(?:date|time|when|where|venue|location|event date|event time|category|type|details|info|information)$') AND NOT {_has(_TITLE_CHROME)}
AND NOT regexp_matches(c, '(?i)^(?:cookie|cookies|subscribe)$') AND NOT {_has('manage\\s+cookies?')} AND NOT {_has('cookies?\\s+(?:settings|preferences|notice|policy|banner|consent|center|centre)')} AND NOT ({_has('cookies?')} AND NOT {_has(_TITLE_EVENT)})
AND NOT {_has('subscribe\\s+(?:for|to our|for our|now|today)')} AND NOT {_has('subscribe\\s+(?:to\\s+)?(?:updates?|newsletter|alerts?|emails?)')} AND NOT (regexp_matches(c, '(?i)^subscribe\\b') AND NOT regexp_matches(c, '^[Ss]ubscribe\\s+to\\s+[A-Z][A-Za-z0-9''.-]*(?:\\s+[A-Z][A-Za-z0-9''.-]*){{0,5}}$'))
AND NOT regexp_matches(c, '(?i)^subscribe\\s+to\\s+.*\\b(?:calendar|events?|mailing lists?|list|updates?|newsletter|alerts?|emails?|ical|ics|outlook|apple|google|yahoo|rss|feed)\\b')
AND {_WORDS} BETWEEN 1 AND 28 AND regexp_matches(c, '[A-Za-z]') AND (NOT regexp_matches(c, '\\.$') OR {_WORDS} <= 4 OR {_WORDS} <= 12 AND len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: regexp_matches(x, '^[A-Z][A-Za-z0-9''.-]*\\.?$'))) >= ceil({_WORDS} * 0.6)))"""
_BRIDGE = f"(length(c) <= 80 AND {_COMPACT_LINE} AND NOT regexp_matches(c, '[.!?]$') AND NOT {_has(_COMPACT)} AND {_WORDS} BETWEEN 1 AND 6 AND regexp_matches(c, '[A-Za-z]'))"

CANDIDATE_SQL = f"""WITH {SIGNAL_DOCS_SQL}, {_blocks_sql('signal_docs')},
kinds AS (SELECT doc_id, idx, score, length(c) AS n, {_NOISY} AS noise, {_TITLE} AS title, {_BRIDGE} AS bridge, regexp_matches(c, '(?i)^{_MONTH}$') AS month, regexp_matches(c, '(?i)^{_DAY}(?:,?\\s*\\d{{4}})?$') AS day FROM scored),
near AS (SELECT *, lead(day, 1, false) OVER w AS day1, lead(bridge, 1, false) OVER w AS bridge1, month AND lead(day, 1, false) OVER w OR day AND lead(month, 1, false) OVER w AS pair,
  {', '.join(f"CASE WHEN {f} >= 8 THEN {f} END AS h{n}" for n, f in ((0, 'score'), (1, 'lead(score, 1) OVER w'), (2, 'lead(score, 2) OVER w'), (3, 'lead(score, 3) OVER w'), ('m1', 'lag(score, 1) OVER w'), ('m2', 'lag(score, 2) OVER w')))} FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
paired AS (SELECT *, lag(pair, 1, false) OVER w AS p1, lag(pair, 2, false) OVER w AS p2, lag(pair, 3, false) OVER w AS p3, lag(pair, 4, false) OVER w AS p4, lead(pair, 1, false) OVER w AS n1, lead(pair, 2, false) OVER w AS n2 FROM near WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
proposed AS (SELECT doc_id, idx, score, greatest(
  CASE WHEN NOT noise THEN greatest(h3 + 3, h2 + 4, h1 + 8, h0 + 20, hm1 + 8, hm2 + 4, CASE WHEN score > 0 AND score < 8 THEN score END, CASE WHEN month AND day1 THEN h2 + 6 END, CASE WHEN month AND day1 THEN h3 + 6 END,
    CASE WHEN pair OR p1 THEN 16 END, CASE WHEN p2 THEN 15 END, CASE WHEN p3 THEN 14 END, CASE WHEN p4 THEN 13 END, CASE WHEN idx < 18 THEN CASE WHEN score > 0 OR idx < 3 AND n <= 800 THEN 44 ELSE 4 END END) END,
  CASE WHEN title THEN h1 + 9 END, CASE WHEN title AND bridge1 THEN h2 + 9 END, CASE WHEN title AND n1 THEN 17 END, CASE WHEN title AND bridge1 AND n2 THEN 17 END) AS priority FROM paired)
SELECT doc_id, idx, score, CAST(priority AS BIGINT) AS priority FROM proposed WHERE priority IS NOT NULL"""

QUERIES = {
    "block_scores": (block_scores, BLOCK_SCORES_SQL),
    "noise_blocks": (noise_blocks, NOISE_SQL),
    "candidate_priority": (candidate_priority, CANDIDATE_SQL),
    "context_select": (context_select, None),
}
