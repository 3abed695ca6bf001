"""Idempotent table sinks over Parquet folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.operators.dedup import first_wins


def stored(df: DataFrame, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first write."""
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None, arrival: list[str] | None = None) -> None:
    """Insert-or-ignore: append only rows whose key the table does not have yet.

    Of rows with one key the first by ``arrival`` is taken; without it the smallest row, so that a run again takes the same.
    """
    fresh = first_wins(df, keys, arrival or [c for c in df.columns if c not in keys])
    old = stored(df, path)
    if old is not None:
        fresh = fresh.join(old.select(*keys), keys, "left_anti").select(*df.columns)
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite exactly the partitions ``df`` has rows for; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merge_into(df: DataFrame, table: str, keys: list[str], update_if: str, update: list[str]) -> None:
    """Upsert into a catalogue table whose format supports MERGE: insert unknown keys, and where
    ``update_if`` holds (over ``s`` source and ``t`` target) take the ``update`` columns."""
    on = F.expr(" AND ".join(f"t.{k} = s.{k}" for k in keys))
    (df.alias("s").mergeInto(f"{table}", on).whenMatched(F.expr(update_if)).update({c: F.col(f"s.{c}") for c in update})
     .whenNotMatched().insertAll().merge())
