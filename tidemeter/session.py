"""Session helpers: lineage cuts in the shared checkpoint folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only for a local master with none set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemeter-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` below the checkpoint folder, or another that all executors share, and read it back.

    Ends the lineage reliably: later stages survive executor loss without recomputing what came before,
    and Spark plans them with the true size of the table.
    """
    path = f"{(folder or checkpoint_dir(df.sparkSession)).rstrip('/')}/tidemeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, max_rows: int) -> bool:
    """Whether a bounded count proves ``df`` has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows

