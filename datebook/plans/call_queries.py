"""Queries over model calls derived from ``conversations``, over their answers, and over accounts; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datebook.operators import prompts, settings, telemetry
from datebook.operators.events import events_of_response
from datebook.plans.derived import table


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each turn: usage in two spellings, and every third one failed."""
    rows = table(spark, sf_dir, "conversations").withColumn("clean", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", ""))
    n, style = F.length("clean"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    start = F.col("conv_id") * 1000 + F.col("turn")
    snake = F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":%d,"cost":0.5}}', n, F.floor(n / 4), n + F.floor(n / 4))
    camel = F.format_string('{"usage":{"promptTokens":"%d","completionTokens":%d,"promptTokensDetails":{"cachedTokens":%d}}}', n, F.floor(n / 5), F.floor(n / 2))
    return rows.select(
        "conv_id", "turn", F.concat(F.lit('{"model":"m","messages":[{"role":"user","content":"'), "clean", F.lit('"}]}')).alias("request"), F.when(style == 0, snake).when(style == 1, camel).alias("response"),
        start.alias("started_ms"), (start + n % 500).alias("responded_ms"), (start + n % 1000).alias("ended_ms"), F.when(style == 2, "timeout").alias("error"),
    )


#: Columns of a call, from the same lengths by arithmetic and not by way of JSON.
_CALLS_SQL = """sized AS (SELECT conv_id, turn, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')) AS BIGINT) AS n, (conv_id + turn) % 3 AS style FROM conversations),
calls AS (SELECT conv_id, turn, n AS prompt_chars, n + length('{"model":"m","messages":[{"role":"user","content":"' || '"}]}') AS body_chars, CAST(n % 1000 AS DOUBLE) AS duration_ms, CAST(n % 500 AS DOUBLE) AS first_response_ms, CASE WHEN style < 2 THEN CAST(n AS DOUBLE) END AS input_tokens,
  CASE style WHEN 0 THEN CAST(n // 4 AS DOUBLE) WHEN 1 THEN CAST(n // 5 AS DOUBLE) END AS output_tokens, CASE WHEN style = 1 THEN CAST(n // 2 AS DOUBLE) END AS cached_tokens, CAST(NULL AS DOUBLE) AS reasoning_tokens, CASE WHEN style = 0 THEN 0.5::DOUBLE END AS cost, style = 2 AS failed FROM sized),
timed AS (SELECT *, CASE WHEN duration_ms > 0 THEN floor(output_tokens * 1000.0::DOUBLE / duration_ms * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE END AS output_per_second FROM calls)"""


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.call_telemetry(_calls(spark, sf_dir))
    return rows.select("conv_id", "turn", "prompt_chars", "body_chars", "duration_ms", "first_response_ms", "usage.input_tokens", "usage.output_tokens", F.col("usage.cached_input_tokens").alias("cached_tokens"), "output_per_second", F.col("error").isNotNull().alias("failed"))


LLM_CALLS_SQL = f"WITH {_CALLS_SQL} SELECT conv_id, turn, prompt_chars, body_chars, duration_ms, first_response_ms, input_tokens, output_tokens, cached_tokens, output_per_second, failed FROM timed"


def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.summary(telemetry.call_telemetry(_calls(spark, sf_dir)))


def _stats_sql(x: str, name: str, places: int = 4) -> str:
    rounded = lambda v: f"floor(({v}) * {10**places} + 0.5::DOUBLE) / {10**places}::DOUBLE"
    return (
        f"count({x}) AS {name}_n, count(*) - count({x}) AS {name}_missing, CAST(min({x}) AS DOUBLE) AS {name}_min, CAST(max({x}) AS DOUBLE) AS {name}_max, "
        f"{rounded(f'CAST(sum({x}) AS DOUBLE) / count({x})')} AS {name}_mean, coalesce({rounded(f'CAST(sum({x}) AS DOUBLE)')}, 0::DOUBLE) AS {name}_total"
    )


_METRICS = {"duration": "duration_ms", "first_response": "first_response_ms", "prompt_chars": "prompt_chars", "input_tokens": "input_tokens", "cached_tokens": "cached_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_tokens", "output_per_second": "output_per_second"}
SUMMARY_SQL = f"WITH {_CALLS_SQL} SELECT count(*) AS calls, count(*) FILTER (failed) AS failed, {', '.join(_stats_sql(x, name) for name, x in _METRICS.items())}, {_stats_sql('cost', 'cost', 8)} FROM timed"


def extracted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of answers in five shapes: an object, a list, one event, a list in fences, and plain talk."""
    n = F.col("event_id")
    event = F.format_string('{"title":"%s %d","startDate":"%s","location":null}', "event_type", n, F.date_format("ts", "yyyy-MM-dd"))
    shapes = [F.concat(F.lit('{"events":['), event, F.lit("]}")), F.concat(F.lit("["), event, F.lit(","), event, F.lit("]")), event, F.concat(F.lit("Found:\n```json\n["), event, F.lit("]\n```")), F.lit("There are none.")]
    content = F.element_at(F.array(*shapes), (n % 5).cast("int") + 1)
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))).alias("response"))
    return events_of_response(rows, "response").select("event_id", F.posexplode("events").alias("idx", "e")).select("event_id", F.col("idx").cast("long").alias("idx"), "e.title", "e.startDate", "e.location")


EXTRACTED_SQL = """SELECT event_id, CAST(idx AS BIGINT) AS idx, event_type || ' ' || event_id AS title, strftime(ts, '%Y-%m-%d') AS "startDate", CAST(NULL AS VARCHAR) AS location
FROM events, range(0, 2) AS o(idx) WHERE event_id % 5 <> 4 AND (idx = 0 OR event_id % 5 = 1)"""


def account_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as text in three shapes: what is left, a limit, and neither."""
    kind, n = F.pmod(F.col("c_custkey"), F.lit(3)), F.col("c_acctbal")
    x = settings.balance(F.when(kind == 1, "5000"), n.cast("string"), F.when(kind == 0, n.cast("string")))
    band = settings.usage_band(F.abs(n), F.lit(9000.0))
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), band.alias("b")).select("c_custkey", "x.has_balance", "x.remaining", "b.band")


BALANCE_SQL = """SELECT c_custkey, coalesce(CASE c_custkey % 3 WHEN 0 THEN c_acctbal > 0 WHEN 1 THEN 5000 - c_acctbal > 0 END, true) AS has_balance, CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN 5000 - c_acctbal END AS remaining,
CASE WHEN least(100, abs(c_acctbal) * 100.0::DOUBLE / 9000) >= 90 THEN 'danger' WHEN abs(c_acctbal) * 100.0::DOUBLE / 9000 >= 70 THEN 'warning' ELSE 'normal' END AS band FROM customer"""


def model_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for models and their brands for providers; those of the largest sizes take structured output."""
    n = F.col("p_partkey")
    vendor = F.element_at(F.array(*[F.lit(v) for v in ("openai", "zeta", "google", "acme", "qwen")]), (n % 5).cast("int") + 1)
    models = table(spark, sf_dir, "part").select(F.concat(vendor, F.lit("/"), n.cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 40, F.array(F.lit("structured_outputs"))).otherwise(F.array().cast("array<string>")).alias("supported_parameters"))
    rows = settings.models_by_provider(models.filter(F.array_contains("supported_parameters", "structured_outputs")))
    return rows.select("provider", F.size("models").cast("long").alias("n"), F.col("models")[0]["name"].alias("first_model"))


MODELS_SQL = """SELECT ['openai', 'zeta', 'google', 'acme', 'qwen'][p_partkey % 5 + 1] AS provider, count(*) AS n, min(p_name) AS first_model FROM part WHERE p_size > 40 GROUP BY 1"""


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a request for each turn, with a table for every second one."""
    rows = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    tables = F.when(F.col("turn") % 2 == 0, F.array(F.lit('"a"\n"1"'))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("m", prompts.extraction_messages(F.lit("system"), F.lit("intro"), tables, F.col("t"), F.array().cast("array<string>")))
    return rows.select("conv_id", "turn", F.size("m").cast("long").alias("messages"), prompts.message_chars(F.col("m")).cast("long").alias("chars"))


MESSAGES_SQL = """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 6 ELSE 4 END::BIGINT AS messages, length(coalesce(text, '') || 'system' || 'intro' || 'Page Content (Markdown/Text):')::BIGINT + CASE WHEN turn % 2 = 0 THEN length('Tables of the page as CSV:' || '```csv' || '"a"' || '"1"' || '```') + 3 ELSE 0 END AS chars FROM conversations"""


QUERIES = {
    "llm_calls": (llm_calls, LLM_CALLS_SQL),
    "telemetry_summary": (telemetry_summary, SUMMARY_SQL),
    "extracted_events": (extracted_events, EXTRACTED_SQL),
    "account_balance": (account_balance, BALANCE_SQL),
    "model_groups": (model_groups, MODELS_SQL),
    "request_messages": (request_messages, MESSAGES_SQL),
}
