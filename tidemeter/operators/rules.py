"""Choices about data: windows and plans left out of the analysis, and deleted plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import CYCLE, LIMIT, RULE, SEC
from tidemeter.operators.temporal import interval_join

_KEY = ["account_id", "tool", "kind", "target"]


def upsert_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply rule changes (same columns plus ``seq``): the last per target wins, a NULL mode clears it."""
    latest = changes.groupBy(*_KEY).agg(F.max_by(F.struct("mode", "until"), "seq").alias("c")).select(*_KEY, "c.*")
    kept = rules.join(latest, _KEY, "left_anti")
    return kept.select(*RULE.fieldNames()).unionByName(latest.where(F.col("mode").isNotNull()).select(*RULE.fieldNames()))


def mark_excluded(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Flag windows chosen to be ignored."""
    chosen = (rules.where((F.col("kind") == "window") & (F.col("mode") == "ignore"))
              .select("account_id", "tool", F.col("target").alias("key"), F.lit(True).alias("excluded")).distinct())
    return windows.join(chosen, ["account_id", "tool", "key"], "left").na.fill(False, ["excluded"])


def mark_ignored(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """Set groups of an ignored plan to ``ignored``: not eligible, not declared."""
    plans = (rules.where((F.col("kind") == "plan") & (F.col("mode") == "ignore"))
             .select("account_id", "tool", F.col("target").alias("plan_key"), F.lit(True).alias("__off")).distinct())
    off = F.col("__off").isNotNull()
    return (groups.join(plans, ["account_id", "tool", "plan_key"], "left")
            .withColumn("status", F.when(off, "ignored").otherwise(F.col("status")))
            .withColumn("eligible", F.coalesce("eligible", F.lit(False)) & ~off)
            .withColumn("declared", F.coalesce("declared", F.lit(False)) & ~off).drop("__off"))


def delete_plan(usage: DataFrame, snapshots: DataFrame, links: DataFrame, windows: DataFrame, rules: DataFrame,
                plan: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables without one plan: its snapshots, its links, and requests left with no link; plus a tombstone.

    Snapshots without a plan go with their window; other plans' snapshots of the same time stay.
    """
    gone = windows.where(F.col("plan_type") == plan).select(
        *LIMIT, (F.col("reset_min") - SEC).alias("lo"), (F.col("reset_max") + SEC).alias("hi"), "key")
    span = gone.drop("key")
    loose = snapshots.where(F.col("plan_type").isNull() & F.col("resets_at").isNotNull())
    kept_snaps = (snapshots.where(F.col("plan_type").isNotNull() & (F.col("plan_type") != plan))
                  .unionByName(interval_join(loose, span, LIMIT, "resets_at", "lo", "hi", how="left_anti", closed=True))
                  .unionByName(snapshots.where(F.col("plan_type").isNull() & F.col("resets_at").isNull())))
    keep = interval_join(links, span, LIMIT, "resets_at", "lo", "hi", how="left_anti", closed=True)
    lost = links.select("account_id", "tool", F.col("usage_id").alias("id")).distinct().join(
        keep.select("account_id", "tool", F.col("usage_id").alias("id")), ["account_id", "tool", "id"], "left_anti")
    kept_usage = usage.join(lost, ["account_id", "tool", "id"], "left_anti").select(*usage.columns)
    stale = gone.select("account_id", "tool", F.lit("window").alias("kind"), F.col("key").alias("target"))
    tombs = gone.select("account_id", "tool").distinct().select(
        "account_id", "tool", F.lit("plan").alias("kind"), F.lit(plan).alias("target"), F.lit("deleted").alias("mode"),
        F.lit(now).cast("bigint").alias("until"))
    kept_rules = (rules.join(stale, _KEY, "left_anti").join(tombs.select(*_KEY), _KEY, "left_anti")
                  .select(*RULE.fieldNames()).unionByName(tombs))
    return kept_usage, kept_snaps, keep, kept_rules


def drop_deleted(rows: DataFrame, rules: DataFrame, plan: str = "plan_type", at: str = "ts") -> DataFrame:
    """Ingest filter: rows of a deleted plan up to the moment of its deletion."""
    dead = (rules.where((F.col("kind") == "plan") & (F.col("mode") == "deleted"))
            .groupBy(F.col("account_id").alias("__a"), F.col("tool").alias("__t"), F.col("target").alias("__p"))
            .agg(F.max("until").alias("__until")))
    return rows.join(dead, (F.col("account_id") == F.col("__a")) & (F.col("tool") == F.col("__t"))
                     & (F.col(plan) == F.col("__p")) & (F.col(at) <= F.col("__until")), "left_anti")


def data_overview(windows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per plan: first and last sight, window counts and the chosen mode; deleted plans without data included."""
    w = windows.groupBy("account_id", "tool", "plan_key").agg(
        F.min("start").alias("first"), F.max("last_seen").alias("last"), F.count("*").alias("windows"),
        F.count_if("excluded").alias("ignored_windows"))
    plans = rules.where(F.col("kind") == "plan").select(
        "account_id", "tool", F.col("target").alias("plan_key"), "mode", "until")
    both = w.join(plans, ["account_id", "tool", "plan_key"], "full")
    return both.where(F.col("windows").isNotNull() | (F.col("mode") == "deleted")).select(
        "account_id", "tool", "plan_key", "first", "last", "windows", "ignored_windows",
        F.coalesce("mode", F.lit("keep")).alias("mode"),
        F.when(F.col("windows").isNull(), F.col("until")).alias("deleted_at"))
