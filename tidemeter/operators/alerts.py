"""Alert rows for verdicts that may be announced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.model import ALERT, ANALYSIS_VERSION, HOUR

COOLDOWN = 24 * HOUR


def candidate_alerts(groups: DataFrame, now: int) -> DataFrame:
    """Declared tighter / looser verdicts of the current analysis version, as alert rows."""
    g = groups.where(F.col("status").isin("tighter", "looser") & F.col("eligible") & F.col("declared")
                     & (F.col("analysis_version") == ANALYSIS_VERSION))
    detail = F.format_string(
        "%.0f%%; last %d windows %s about $%.1f, before that %d windows about $%.1f",
        F.abs(F.col("ratio") - 1) * 100, F.col("recent_n"), F.coalesce("ref_model", F.lit("")), F.col("recent_median"),
        F.col("baseline_n"), F.col("baseline_median"))
    day = F.date_format(F.timestamp_micros(F.col("baseline_to")), "MM-dd")
    return g.select(
        "account_id", "tool", F.concat_ws(":", "scope", "window", "plan_key").alias("window"),
        F.col("status").alias("direction"), F.lit(now).cast("bigint").alias("ts"), "ratio",
        F.when(F.col("cross_gap"), F.concat(detail, F.lit("; compared with windows before "), day)).otherwise(detail).alias("detail"),
        F.col("analysis_version").cast("int").alias("analysis_version"))


def new_alerts(groups: DataFrame, past: DataFrame, now: int, cooldown: int = COOLDOWN) -> DataFrame:
    """Alerts to add: none for a (limit and plan, direction) that already had one within the cool-down."""
    recent = past.where(F.col("ts") > now - cooldown).select("account_id", "tool", "window", "direction").distinct()
    return candidate_alerts(groups, now).join(
        recent, ["account_id", "tool", "window", "direction"], "left_anti").select(*ALERT.fieldNames())


def latest_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), "account_id", "tool", "window").limit(n)
