"""Settings, the catalogue of models and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: providers that are listed first, in this order.
PREFERRED = ["google", "openai", "anthropic", "meta-llama", "mistralai", "deepseek", "qwen"]


def with_defaults(defaults: Column, stored: Column) -> Column:
    """A map in which stored keys win."""
    stored = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(stored, k)), stored)


def settings_changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def structured_models(models: DataFrame) -> DataFrame:
    """Models that support structured outputs, by name."""
    return models.filter(F.array_contains("supported_parameters", "structured_outputs")).orderBy(F.lower("name"), "name", "id")


def models_by_provider(models: DataFrame, preferred: list[str] = PREFERRED) -> DataFrame:
    """``provider, models``: preferred providers first, the others by name; models by name."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("provider"))
    rows = models.withColumn("provider", F.split("id", "/")[0])
    grouped = rows.groupBy("provider").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("models"))
    return grouped.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), "provider")


def parse_number(x: Column) -> Column:
    """Null stays null and blank text is zero; what isn't a finite number is null."""
    n = F.when(F.trim(x) == "", 0.0).otherwise(x.try_cast("double"))
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def balance(limit: Column, usage: Column, remaining: Column) -> Column:
    """What is left if that is given, else limit less usage, else without limit."""
    limit, usage, remaining = parse_number(limit), F.coalesce(parse_number(usage), F.lit(0.0)), parse_number(remaining)
    left = F.coalesce(remaining, limit - usage)
    return F.struct(F.coalesce(left > 0, F.lit(True)).alias("has_balance"), limit.alias("limit"), usage.alias("usage"), left.alias("remaining"))


def usage_band(used: Column, limit: Column) -> Column:
    """Share in percent, 100 at most, and its band: danger from 90, warning from 70."""
    share = F.least(F.lit(100.0), F.try_divide(used * 100.0, limit))
    return F.struct(share.alias("percent"), F.when(share >= 90, "danger").when(share >= 70, "warning").otherwise("normal").alias("band"))
