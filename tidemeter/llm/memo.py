"""Memory of Python workers: what they keep from one task to the next, and how much text they get at once."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
_HOME = "_kept_by_this_process"


def per_process(key: Hashable, build: Callable[[], T]) -> T:
    """``build()``, once for each process and key.

    Functions reach the workers by value, so what a module keeps in its globals ends with the task; this does not.
    Only for values that depend on the key alone and are of bounded size.
    """
    kept = sys.modules.setdefault(_HOME, types.ModuleType(_HOME)).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


#: Bytes of one Arrow batch of texts.
TEXT_BATCH = 8 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of a session that works on texts by bytes; rows differ too much in size for a bound by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH))
    return spark
