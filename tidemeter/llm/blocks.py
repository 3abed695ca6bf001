"""Large buckets dealt into blocks, so that every pair of blocks is a task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sub-keys under which the rows of a large bucket learn how many blocks it has.
SHARES = 64


def block_pairs(rows: DataFrame, unit: str) -> DataFrame:
    """Each row once for every pair of blocks it takes part in: ``i`` <= ``j``, its own block ``salt``; ``parts`` blocks are in its bucket."""
    return (rows.withColumn("salt", F.expr(f"pmod(xxhash64({unit}), parts)"))
            .withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
            .withColumns({"i": F.least("salt", "other"), "j": F.greatest("salt", "other")}).drop("other", "parts"))


def dealt(rows: DataFrame, bucket: str, unit: str, parts: DataFrame) -> DataFrame:
    """``block_pairs`` of rows by their ``bucket``; ``parts`` holds every bucket's number of blocks.

    Only buckets of several blocks are looked up, under ``SHARES`` sub-keys each: no task reads, or multiplies, a whole large bucket.
    """
    large = parts.select(bucket, "parts").filter("parts > 1").withColumn("share", F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")))
    met = rows.withColumn("share", F.expr(f"pmod(xxhash64({unit}), {SHARES}L)")).join(large, [bucket, "share"], "left")
    return block_pairs(met.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).drop("share"), unit)
