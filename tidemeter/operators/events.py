"""Traces of announced rule changes: response fields, plans, new limits, early resets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import DAY, LIMIT, SEC
from tidemeter.operators.temporal import equal_runs

NEW_AFTER = DAY
GONE_BEFORE = 2 * DAY
EARLY_BY = 600 * SEC
SEEN_AGAIN = 60 * SEC

_DETAIL = {"window": "string", "scope": "string", "plan_from": "string", "plan_to": "string", "pct": "double",
           "due": "bigint", "maybe_switch": "boolean", "change": "string", "source": "string", "fields": "array<string>"}


def _event(df: DataFrame, kind: str, **detail: Column) -> DataFrame:
    return df.select("account_id", "tool", "ts", F.lit(kind).alias("kind"),
                     *[detail.get(n, F.lit(None)).cast(t).alias(n) for n, t in _DETAIL.items()])


def merge_shapes(shapes: DataFrame) -> DataFrame:
    """Shape registry: first and last sight per fingerprint, whatever the order of arrival."""
    return shapes.groupBy("account_id", "tool", "source", "fingerprint").agg(
        F.first("shape").alias("shape"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def field_lifetimes(shapes: DataFrame) -> DataFrame:
    """First and last sight of every field path, with the bounds of its source."""
    keys = ["account_id", "tool", "source"]
    bounds = shapes.groupBy(*keys).agg(F.min("first_ts").alias("first_all"), F.max("last_ts").alias("last_all"))
    paths = shapes.select(*keys, F.explode("shape").alias("path"), "first_ts", "last_ts")
    spans = paths.groupBy(*keys, "path").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return spans.join(bounds, keys)


def schema_events(shapes: DataFrame) -> DataFrame:
    """Fields that appeared or vanished; those of the same hour form one event."""
    life = field_lifetimes(shapes)
    hour = lambda c: F.bround(F.col(c) / F.lit(3600.0 * SEC))

    def changed(rows: DataFrame, at: str, change: str, when) -> DataFrame:
        g = rows.groupBy("account_id", "tool", "source", hour(at).alias("hour")).agg(
            when(at).alias("ts"), F.array_sort(F.collect_set("path")).alias("fields"))
        return _event(g, "schema", change=F.lit(change), source=F.col("source"), fields=F.col("fields"))

    added = changed(life.where(F.col("first_ts") > F.col("first_all") + NEW_AFTER), "first_ts", "added", F.min)
    gone = changed(life.where(F.col("last_ts") < F.col("last_all") - GONE_BEFORE), "last_ts", "removed", F.max)
    return added.unionByName(gone)


def plan_events(snapshots: DataFrame) -> DataFrame:
    """A plan different from the last known one."""
    keys = ["account_id", "tool"]
    known = snapshots.where(F.col("plan_type") != "").groupBy(*keys, "ts").agg(
        F.min_by("plan_type", F.struct("scope", "window")).alias("plan"))
    runs = equal_runs(known, keys, "ts", F.col("plan") == F.col("prev.plan")).groupBy(*keys, "run").agg(
        F.min("ts").alias("ts"), F.first("plan").alias("plan"))
    turns = runs.withColumn("before", F.lag("plan").over(Window.partitionBy(*keys).orderBy("run")))
    return _event(turns.where(F.col("before").isNotNull()), "plan", plan_from=F.col("before"), plan_to=F.col("plan"))


def window_events(snapshots: DataFrame) -> DataFrame:
    """A limit first seen more than a day after the account's first snapshot."""
    first = snapshots.groupBy(*LIMIT).agg(F.min("ts").alias("ts"))
    first = first.withColumn("first_all", F.min("ts").over(Window.partitionBy("account_id", "tool")))
    return _event(first.where(F.col("ts") > F.col("first_all") + NEW_AFTER), "window",
                  window=F.col("window"), scope=F.col("scope"))


def early_resets(cycle_rows: DataFrame) -> DataFrame:
    """A new cycle well before the old one was due, the old one not being seen again."""
    w = Window.partitionBy(*LIMIT).orderBy("first_seen", "reset_min")
    c = cycle_rows.withColumn("ts", F.lead("first_seen").over(w))
    early = (F.col("ts") < F.col("reset_max") - EARLY_BY) & (F.col("last_seen") <= F.col("ts") + SEEN_AGAIN)
    return _event(c.where(early), "reset", window=F.col("window"), scope=F.col("scope"), pct=F.col("peak_percent"),
                  due=F.col("reset_max"), maybe_switch=F.col("tool") == "linked")


def all_events(snapshots: DataFrame, cycle_rows: DataFrame, shapes: DataFrame, now: int, days: int = 90, n: int | None = None) -> DataFrame:
    """Every event of the last ``days``, newest first; with ``n`` the newest so many, as a view shows them."""
    parts = [schema_events(shapes), plan_events(snapshots), window_events(snapshots), early_resets(cycle_rows)]
    return recent_events(reduce(DataFrame.unionByName, parts), now, days, n)


def recent_events(events: DataFrame, now: int, days: int = 90, n: int | None = None) -> DataFrame:
    newest = events.where(F.col("ts") >= now - days * DAY).orderBy(F.desc("ts"), "account_id", "tool", "kind", "window", "scope")
    return newest if n is None else newest.limit(n)
