"""Which of several copies of a record survives.  Arrival order is (file, block, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRIVAL = ["file", "block", "seq"]


def best_per_message(messages: DataFrame) -> DataFrame:
    """Best copy of a message inside one file: final beats partial, then more output, then the earlier."""
    keys = ["account_id", "tool", "id", "file"]
    rest = F.struct(*[c for c in messages.columns if c not in keys])
    best = messages.groupBy(*keys).agg(F.min_by(rest, F.struct(
        (~F.col("final")).alias("f"), (-F.col("output_tokens")).alias("o"), "block", "seq")).alias("r"))
    return best.select(*keys, "r.*").select(*messages.columns)


def merge_messages(messages: DataFrame) -> DataFrame:
    """One row per message over all files: the first file's copy, with output, reasoning and cost of the
    first copy that has the largest output.  Copies combine map-side, so a message repeated endlessly is
    no hot spot."""
    keys = ["account_id", "tool", "id"]
    grown = ["output_tokens", "reasoning_tokens", "cost_pico"]
    fixed = [c for c in messages.columns if c not in [*keys, *grown]]
    one = messages.groupBy(*keys).agg(
        F.min_by(F.struct(*fixed), F.struct(*ARRIVAL)).alias("a"),
        F.min_by(F.struct(*grown), F.struct((-F.col("output_tokens")).alias("o"), *ARRIVAL)).alias("g"))
    return one.select(*keys, "a.*", "g.*").select(*messages.columns)


def merge_into_usage(usage: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert of a later batch into stored usage: an existing id only ever gains output, reasoning and cost."""
    keys = ["account_id", "tool", "id"]
    new = batch.select(*keys, F.struct(*[c for c in usage.columns if c not in keys]).alias("n"))
    old = usage.select(*keys, F.struct(*[c for c in usage.columns if c not in keys]).alias("o"))
    both = old.join(new, keys, "full")
    grew = F.col("o").isNotNull() & (F.col("n.output_tokens") > F.col("o.output_tokens"))
    pick = lambda c: F.when(F.col("o").isNull(), F.col(f"n.{c}")).otherwise(
        F.when(grew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in ("output_tokens", "reasoning_tokens", "cost_pico")
        else F.col(f"o.{c}"))
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in usage.columns])


def first_wins(rows: DataFrame, keys: list[str], arrival: list[str] = ARRIVAL) -> DataFrame:
    """Earliest arrival per key."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("r"))
            .select(*keys, "r.*").select(*rows.columns))


def add_missing(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: stored rows plus the batch's rows of unknown keys."""
    return stored.unionByName(batch.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def replace_rows(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace by key."""
    return stored.join(batch.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(batch)
