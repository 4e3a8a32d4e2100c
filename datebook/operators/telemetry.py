"""Measures of model calls: a row for each call, and one summary of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datebook.functions.text import round_number
from datebook.operators.settings import parse_number

#: Names under which a usage field may come.
ALIASES = {
    "input_tokens": ["prompt_tokens", "promptTokens", "input_tokens", "inputTokens"],
    "output_tokens": ["completion_tokens", "completionTokens", "output_tokens", "outputTokens"],
    "total_tokens": ["total_tokens", "totalTokens"],
    "cached_input_tokens": ["prompt_tokens_details.cached_tokens", "promptTokensDetails.cachedTokens", "input_tokens_details.cached_tokens", "inputTokensDetails.cachedTokens"],
    "reasoning_tokens": ["completion_tokens_details.reasoning_tokens", "completionTokensDetails.reasoningTokens", "output_tokens_details.reasoning_tokens", "outputTokensDetails.reasoningTokens"],
    "cost": ["cost", "total_cost", "totalCost"],
}


def first_finite(*values: Column) -> Column:
    return F.coalesce(*[parse_number(F.when(F.trim(v) != "", v)) for v in values])


def normalized_usage(response: Column) -> Column:
    """Usage of a response (JSON text): the first finite value of each field's names."""
    return F.struct(*[first_finite(*[F.get_json_object(response, f"$.usage.{p}") for p in paths]).alias(k) for k, paths in ALIASES.items()])


def per_second(tokens: Column, millis: Column) -> Column:
    return round_number(F.when(millis > 0, F.try_divide(tokens * 1000.0, millis)))


def call_telemetry(calls: DataFrame) -> DataFrame:
    """A row a call from ``request, response`` (JSON texts), ``started_ms, responded_ms, ended_ms, error``.

    Durations are never negative; a failed call is a row like any other.
    """
    span = lambda a, b: F.greatest(F.lit(0.0), parse_number(F.col(b).cast("string")) - parse_number(F.col(a).cast("string")))
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), span(a, b))
    messages = F.from_json(F.get_json_object("request", "$.messages"), "array<struct<content: string>>")
    rows = calls.withColumns({
        "duration_ms": both("started_ms", "ended_ms"), "first_response_ms": both("started_ms", "responded_ms"), "read_ms": both("responded_ms", "ended_ms"), "usage": normalized_usage(F.col("response")),
        "message_count": F.coalesce(F.size(messages), F.lit(0)).cast("long"), "prompt_chars": F.aggregate(F.coalesce(messages, F.array().cast("array<struct<content: string>>")), F.lit(0).cast("long"), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit("")))),
        "body_chars": F.length("request").cast("long"), "body_bytes": F.octet_length("request").cast("long"), "response_chars": F.length(F.coalesce("response", F.lit(""))).cast("long"), "model": F.get_json_object("request", "$.model"),
    })
    return rows.withColumns({"output_per_second": per_second(F.col("usage.output_tokens"), F.col("duration_ms")), "total_per_second": per_second(F.col("usage.total_tokens"), F.col("duration_ms"))})


def numeric_stats(x: Column, name: str, places: int = 4) -> list[Column]:
    """Values and missing ones, least, greatest, mean and total; the total of none is zero."""
    return [
        F.count(x).alias(f"{name}_n"), (F.count("*") - F.count(x)).alias(f"{name}_missing"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"),
        round_number(F.try_divide(F.sum(x), F.count(x)), places).alias(f"{name}_mean"), F.coalesce(round_number(F.sum(x), places), F.lit(0.0)).alias(f"{name}_total"),
    ]


METRICS = {"duration": "duration_ms", "first_response": "first_response_ms", "prompt_chars": "prompt_chars", "input_tokens": "usage.input_tokens", "cached_tokens": "usage.cached_input_tokens", "output_tokens": "usage.output_tokens", "reasoning_tokens": "usage.reasoning_tokens", "output_per_second": "output_per_second"}


def summary(rows: DataFrame) -> DataFrame:
    """One row over all calls: one aggregate, partial before the shuffle."""
    stats = [c for name, x in METRICS.items() for c in numeric_stats(F.col(x).cast("double"), name)]
    return rows.agg(F.count("*").alias("calls"), F.count(F.when(F.coalesce(F.col("error"), F.lit("")) != "", 1)).alias("failed"), *stats, *numeric_stats(F.col("usage.cost"), "cost", 8))
