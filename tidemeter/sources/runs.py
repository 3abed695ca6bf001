"""Tables that streams keep up to date: runs of batches that are merged on reading and, level by level, on disk.

Each batch writes one run, a folder named after its number; a batch that is run again replaces its own.  After every ``fan_in`` runs
of one level they are merged to one run of the next, as files of a log-structured merge tree are.  So a table of n batches is
``fan_in`` times log(n) folders at most, every row is written again only log(n) times, and no batch reads what is stored.
Which row of a key stands is settled by ``merge``, on reading and on merging alike; it must not matter in which groups rows are
merged.  Only complete folders count, and a run is removed one batch after the run that holds it was completed, so readers
that have begun keep their files.  A folder holds one directory per value of ``part``: a bucket of the key or a day, by which reads are
pruned.  One stream writes to a table under one ``writer`` name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of a row's run among all runs; larger is newer.
RUN = "__run"
Merge = Callable[[DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder of any file system that Spark reads; none if there is no such folder."""
    system, at = _folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    system, at = _folder(spark, path)
    system.delete(at, True)


def bucket(keys: Sequence[str], buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# -- which row of a key stands; all of these may be applied to any grouping of the runs -------------------

def oldest(keys: Sequence[str], arrival: Sequence[str] = ()) -> Merge:
    """The first that came; of rows of one batch the first by ``arrival``, then the smallest."""
    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, RUN)]
        return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(RUN, *arrival, *rest)).alias("r")).select(*keys, "r.*")
    return merge


def newest(keys: Sequence[str]) -> Merge:
    """The last that came; of rows of one batch the greatest."""
    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, RUN)]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(RUN, *_ordered(df, rest))).alias("r")).select(*keys, "r.*")
    return merge


def grown(keys: Sequence[str], by: str, with_it: Sequence[str], arrival: Sequence[str] = ()) -> Merge:
    """The first that came, but ``by`` and ``with_it`` from the first of those with the largest ``by``: an id may only ever gain."""
    def merge(df: DataFrame) -> DataFrame:
        taken = [by, *with_it]
        fixed = [c for c in df.columns if c not in (*keys, *taken, RUN)]
        return df.groupBy(*keys).agg(
            F.min_by(F.struct(*fixed), F.struct(RUN, *arrival)).alias("f"),
            F.min_by(F.struct(*taken), F.struct((-F.col(by)).alias("by"), RUN, *arrival)).alias("g")).select(*keys, "f.*", "g.*")
    return merge


def combined(keys: Sequence[str], **how: Callable[[str], Column]) -> Merge:
    """Every other column by its own aggregate, such as ``F.min``, ``F.max`` or ``F.sum``."""
    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[f(c).cast(df.schema[c].dataType).alias(c) for c, f in how.items()])
    return merge


def _ordered(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not df.schema[c].dataType.simpleString().startswith("map")]


class RunTable:
    """One table of runs below ``path``."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge | None = None, part: Column | None = None, fan_in: int = 16, writer: str = "w"):
        self.spark, self.path, self.merge, self.fan_in, self.writer = spark, path.rstrip("/"), merge, fan_in, writer
        self.part = F.lit(0) if part is None else part

    def _at(self, writer: str, first: int, last: int) -> str:
        return f"{self.path}/{writer}-{first}-{last}"

    def _complete(self) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {}
        for name in names(self.spark, self.path):
            m = re.fullmatch(r"(\w+)-(\d+)-(\d+)", name)
            if m and "_SUCCESS" in names(self.spark, f"{self.path}/{name}"):
                out.setdefault(m[1], []).append((int(m[2]), int(m[3])))
        return out

    def runs(self, until: int | None = None) -> list[tuple[str, int, int]]:
        """Complete runs that no other holds, of batches before ``until`` if that is given."""
        out = []
        for writer, found in self._complete().items():
            kept = [r for r in found if until is None or r[1] < until]
            out += [(writer, a, b) for a, b in kept if not any((c, d) != (a, b) and c <= a and b <= d for c, d in kept)]
        return sorted(out, key=lambda r: (r[1], r[0]))

    def _settled(self, df: DataFrame) -> DataFrame:
        return (self.merge(df) if self.merge else df).drop(RUN)

    def _of(self, runs: Sequence[tuple[str, int, int]], keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame | None:
        """The rows of all runs; None if none of them has a row."""
        parts = []
        for k, run in enumerate(runs):
            if any(n.startswith("part=") for n in names(self.spark, self._at(*run))):
                df = self.spark.read.parquet(self._at(*run))
                parts.append((keep(df) if keep else df).drop("part").withColumn(RUN, F.lit(k)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def read(self, keep: Callable[[DataFrame], DataFrame] | None = None, until: int | None = None) -> DataFrame | None:
        """The table as it stands, or None before its first row.  ``keep`` picks rows before they are merged; a filter on ``part`` prunes files."""
        rows = self._of(self.runs(until), keep)
        return None if rows is None else self._settled(rows)

    def _write(self, df: DataFrame, first: int, last: int) -> None:
        # rebalanced, so that a large part is written by several tasks
        dealt = df.withColumn("part", self.part).hint("rebalance", F.col("part"))
        dealt.write.mode("overwrite").partitionBy("part").parquet(self._at(self.writer, first, last))

    def write(self, rows: DataFrame, batch: int) -> None:
        """Make ``rows`` the run of ``batch``, and merge runs where a level is full.  Doing so again changes nothing."""
        mine = self._complete().get(self.writer, [])
        if any(a < b and a <= batch <= b for a, b in mine):
            return
        self._write(self._settled(rows.withColumn(RUN, F.lit(0))), batch, batch)
        width = self.fan_in
        while (batch + 1) % width == 0:
            first = batch + 1 - width
            inside = [r for r in self.runs(batch + 1) if r[0] == self.writer and first <= r[1]]
            stored = self._of(inside, None)
            self._write(rows.limit(0) if stored is None else self._settled(stored), first, batch)
            width *= self.fan_in
        self._sweep(batch)

    def _sweep(self, batch: int) -> None:
        """Remove runs that a run completed before this batch holds."""
        mine = self._complete().get(self.writer, [])
        for a, b in mine:
            if any((c, d) != (a, b) and c <= a and b <= d < batch for c, d in mine):
                remove(self.spark, self._at(self.writer, a, b))
