"""Usage rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemeter.functions.scalars import exact_sum, hit_rate, local_bucket, range_start, usd

MEASURES = ["requests", "input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens",
            "reasoning_tokens", "cost_usd", "unpriced_requests"]


def _sums() -> list[Column]:
    whole = lambda c: F.coalesce(exact_sum(c), F.lit(0)).cast("decimal(38,0)")
    return [
        F.count("*").alias("requests"),
        whole("input_tokens").alias("input_tokens"),
        whole("cache_read_tokens").alias("cache_read_tokens"),
        whole(F.col("cache_write_5m_tokens") + F.col("cache_write_1h_tokens")).alias("cache_write_tokens"),
        whole("output_tokens").alias("output_tokens"),
        whole("reasoning_tokens").alias("reasoning_tokens"),
        usd(whole("cost_pico")).alias("cost_usd"),
        F.count_if(F.col("cost_pico").isNull()).alias("unpriced_requests"),
    ]


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("cache_hit_rate", hit_rate(
        F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")))


def in_range(usage: DataFrame, range_name: str, now: int, zone: str = "UTC", tool: str = "all") -> DataFrame:
    """Requests since the start of a preset range, of one tool or all; both tests reach the scan."""
    out = usage.where(F.col("ts") >= range_start(range_name, F.lit(now), zone))
    return out if tool == "all" else out.where(F.col("tool") == tool)


def summary(usage: DataFrame) -> DataFrame:
    """One row of totals over the given requests."""
    return _with_rate(usage.agg(*_sums()))


def by_model(usage: DataFrame) -> DataFrame:
    """Totals per tool, model and plan membership, dearest first."""
    return _with_rate(usage.groupBy("tool", "model", "on_plan").agg(*_sums())).orderBy(
        F.desc("cost_usd"), F.desc("requests"), "tool", "model")


def series(usage: DataFrame, unit: str = "day", zone: str = "UTC") -> DataFrame:
    """Totals per local hour or day and tool."""
    return usage.groupBy(local_bucket("ts", unit, zone).alias("bucket"), "tool").agg(
        *[s for s, n in zip(_sums(), MEASURES) if n not in ("reasoning_tokens", "unpriced_requests")]).orderBy("bucket", "tool")


def spark_line(series_df: DataFrame) -> DataFrame:
    """Cost per bucket over all tools."""
    return series_df.groupBy("bucket").agg(F.round(F.sum("cost_usd"), 2).alias("cost_usd")).orderBy("bucket")


def requests_without_price(models: DataFrame) -> DataFrame:
    """Requests of models none of whose requests has a price."""
    return models.where(F.col("unpriced_requests") == F.col("requests")).agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))


def top_priced(models: DataFrame, n: int = 8) -> DataFrame:
    """Dearest on-plan models."""
    return models.where(F.col("on_plan") & (F.col("cost_usd") > 0)).orderBy(
        F.desc("cost_usd"), "tool", "model").limit(n)


def report(usage: DataFrame, range_name: str, now: int, zone: str = "UTC", tool: str = "all") -> dict[str, DataFrame]:
    """Summary, series and model split of a preset range over one filtered read."""
    chosen = in_range(usage, range_name, now, zone, tool)
    return {"summary": summary(chosen), "series": series(chosen, "hour" if range_name == "today" else "day", zone),
            "models": by_model(chosen)}
