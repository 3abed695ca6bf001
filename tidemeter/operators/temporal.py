"""Temporal building blocks: sessions by gap, interval joins, as-of lookups, span algebra, blocked scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import DAY, HOUR


def bucket_of(at: Column, width: int) -> Column:
    """Floor bucket of an instant; exact, and right for negative instants."""
    return ((at - F.pmod(at, F.lit(width))) / F.lit(width)).cast("bigint")


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str,
                  width: int = DAY, how: str = "inner", closed: bool = False) -> DataFrame:
    """Rows of ``points`` whose ``at`` lies in ``[lo, hi)`` (``[lo, hi]`` when ``closed``) of ``spans``.

    Spans are spread over fixed buckets, so the join is an equi join on (keys, bucket) with a residual
    test.  Each point meets a span in exactly one bucket, hence no duplicates.  Keys must not be null.
    """
    last = F.col(hi) if closed else F.col(hi) - 1
    spread = (spans.where(F.col(lo) <= last)
              .withColumn("__b", F.explode(F.sequence(bucket_of(F.col(lo), width), bucket_of(last, width)))))
    tagged = points.withColumn("__b", bucket_of(F.col(at), width))
    left, right = tagged.alias("p"), spread.alias("s")
    cond = F.col("p.__b") == F.col("s.__b")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    upper = F.col(f"p.{at}") <= F.col(f"s.{hi}") if closed else F.col(f"p.{at}") < F.col(f"s.{hi}")
    cond = cond & (F.col(f"p.{at}") >= F.col(f"s.{lo}")) & upper
    if how in ("left_semi", "left_anti"):
        return left.join(right, cond, how).drop("__b")
    extra = [c for c in spans.columns if c not in keys]
    clash = set(extra) & set(points.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return left.join(right, cond, how).select(
        *[F.col(f"p.{c}").alias(c) for c in points.columns], *[F.col(f"s.{c}").alias(c) for c in extra])


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_lo: str, l_hi: str, r_lo: str, r_hi: str,
                 width: int = DAY) -> DataFrame:
    """Pairs of open-overlapping spans: ``r_lo < l_hi`` and ``r_hi > l_lo``.

    Both sides are spread over buckets; a pair is kept only in the bucket where its overlap begins, so
    it comes out once.
    """
    a = left.withColumn("__b", F.explode(F.sequence(
        bucket_of(F.col(l_lo), width), F.greatest(bucket_of(F.col(l_lo), width), bucket_of(F.col(l_hi), width))))).alias("a")
    b = right.withColumn("__b", F.explode(F.sequence(
        bucket_of(F.col(r_lo), width), F.greatest(bucket_of(F.col(r_lo), width), bucket_of(F.col(r_hi), width))))).alias("b")
    cond = F.col("a.__b") == F.col("b.__b")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    cond = cond & (F.col(f"b.{r_lo}") < F.col(f"a.{l_hi}")) & (F.col(f"b.{r_hi}") > F.col(f"a.{l_lo}"))
    cond = cond & (F.col("a.__b") == bucket_of(F.greatest(F.col(f"a.{l_lo}"), F.col(f"b.{r_lo}")), width))
    extra = [c for c in right.columns if c not in keys]
    clash = set(extra) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return a.join(b, cond).select(
        *[F.col(f"a.{c}").alias(c) for c in left.columns], *[F.col(f"b.{c}").alias(c) for c in extra])


def values_by_slice(edges: DataFrame, keys: Sequence[str], at: str, value: str, first: Column, last: Column, width: int) -> DataFrame:
    """A value that changes at instants ``at``, laid out by slice of time for lookups as of an instant.

    One row per key and slice between ``first`` and ``last`` (slice numbers, from columns of ``edges`` that are the same over a key),
    from the slice of the first change on: ``carry``, the value in force as the slice begins, and ``changes``, those inside it in order.
    Changes before ``first`` or after ``last`` are held by these slices.  So a point finds its value by an equi join on
    (key, slice), however long the key's history, and no key is gathered in one place.
    """
    slot = F.least(F.greatest(bucket_of(F.col(at), width), first), last)
    held = edges.withColumn("slice", slot).withColumn("__last", last).groupBy(*keys, "slice").agg(
        F.max("__last").alias("__last"), F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value")))).alias("changes"))
    w = Window.partitionBy(*keys).orderBy("slice")
    done = F.element_at("changes", -1)["value"]
    run = held.select(*keys, "slice", "changes", F.lag(done).over(w).alias("carry"), done.alias("__done"),
                      F.coalesce(F.lead("slice").over(w) - 1, F.col("__last")).alias("__to"))
    laid = run.withColumn("__s", F.explode(F.sequence("slice", F.greatest("slice", "__to"))))
    here = F.col("__s") == F.col("slice")
    return laid.select(*keys, F.col("__s").alias("slice"), F.when(here, F.col("carry")).otherwise(F.col("__done")).alias("carry"),
                       F.when(here, F.col("changes")).alias("changes"))


def value_at(at: str) -> Column:
    """The value in force at an instant, from a row joined with ``values_by_slice``; a change counts from its own instant on."""
    upto = F.filter("changes", lambda c: c["at"] <= F.col(at))
    return F.coalesce(F.try_element_at(upto, F.lit(-1))["value"], F.col("carry"))


def merge_spans(spans: DataFrame, keys: Sequence[str], lo: str = "start", hi: str = "end", slice_span: int = HOUR) -> DataFrame:
    """Union of touching or overlapping closed spans per key.

    Two blocked scans: how far earlier spans reach, and the number of breaks so far; a key with a huge
    number of spans is no single task's work.
    """
    one = spans.select(*keys, lo, hi).distinct().withColumn("__slice", bucket_of(F.col(lo), slice_span))
    reach = blocked_scan(one, keys, "__slice", [lo, hi], high=[hi])
    breaks = reach.withColumn("__new", F.when(F.col(f"{hi}__high") >= F.col(lo), 0).otherwise(1)).drop(f"{hi}__high")
    isles = blocked_scan(breaks, keys, "__slice", [lo, hi], total=["__new"])
    return isles.groupBy(*keys, "__new__total").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__new__total")


def blocked_scan(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str],
                 last: Sequence[str] = (), first: Sequence[str] = (), high: Sequence[str] = (),
                 total: Sequence[str] = ()) -> DataFrame:
    """Running values per key, computed block by block so that one huge key spreads over many tasks.

    ``block`` is an integer column that never decreases along the key's order (a file split, a slice of
    time).  Per block the summaries are partially aggregated; a short scan over blocks gives what each
    block inherits; a scan inside the block finishes the job.  Adds, per column ``c``:
    ``c__last`` / ``c__first`` (last / first non-null up to and including the row),
    ``c__high`` (largest value strictly before the row) and ``c__total`` (sum up to and including it, 0 if
    there is none).  The rows are dealt out by (key, block) once; summaries and scan both read that one exchange.
    """
    df = df.repartition(*keys, block)
    pos = F.struct(*order)
    ends = []
    for c in last:
        ends.append(F.max_by(c, F.when(F.col(c).isNotNull(), pos)).alias(f"__{c}_l"))
    for c in first:
        ends.append(F.min_by(c, F.when(F.col(c).isNotNull(), pos)).alias(f"__{c}_f"))
    for c in high:
        ends.append(F.max(c).alias(f"__{c}_h"))
    for c in total:
        ends.append(F.sum(c).alias(f"__{c}_t"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inherited = df.groupBy(*keys, block).agg(*ends).select(
        *keys, block,
        *[F.last(f"__{c}_l", ignorenulls=True).over(before).alias(f"__{c}_l") for c in last],
        *[F.first(f"__{c}_f", ignorenulls=True).over(before).alias(f"__{c}_f") for c in first],
        *[F.max(f"__{c}_h").over(before).alias(f"__{c}_h") for c in high],
        *[F.sum(f"__{c}_t").over(before).alias(f"__{c}_t") for c in total])
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(inherited, [*keys, block])
    return out.select(
        *df.columns,
        *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"__{c}_l")).alias(f"{c}__last") for c in last],
        *[F.coalesce(F.col(f"__{c}_f"), F.first(c, ignorenulls=True).over(upto)).alias(f"{c}__first") for c in first],
        *[F.greatest(F.max(c).over(prior), F.col(f"__{c}_h")).alias(f"{c}__high") for c in high],
        *[(F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(F.col(f"__{c}_t"), F.lit(0))).alias(f"{c}__total")
          for c in total])


def equal_runs(df: DataFrame, keys: Sequence[str], at: str, same: Column, span: int = HOUR, ties: Sequence[str] = ()) -> DataFrame:
    """Number runs of consecutive rows (by ``at``, then ``ties``) per key for which ``same`` holds against the row before.

    ``same`` may use the row's columns and ``prev.<column>``.  Works slice of time by slice of time, so
    a key with a huge history spreads over many tasks.  Adds ``run``.  The rows are dealt out by (key, slice) once, as
    wholes; the ends of slices and both scans read that one exchange.
    """
    dealt = (df.select(*keys, bucket_of(F.col(at), span).alias("__slice"), F.struct(*df.columns).alias("__row"))
             .repartition(*keys, "__slice"))
    sliced = dealt.select(*keys, "__slice", "__row", *[F.col("__row")[c].alias(c) for c in df.columns if c not in keys])
    w = Window.partitionBy(*keys, "__slice").orderBy(at, *ties)
    over = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy(*keys, "__slice").agg(F.max_by("__row", F.struct(at, *ties)).alias("__end")).select(
        *keys, "__slice", F.last("__end").over(over).alias("__carry"))
    flagged = (sliced.join(ends, [*keys, "__slice"])
               .withColumn("prev", F.coalesce(F.lag("__row").over(w), F.col("__carry")))
               .withColumn("__start", F.when(F.col("prev").isNotNull() & F.coalesce(same, F.lit(False)), 0).otherwise(1)))
    starts = flagged.groupBy(*keys, "__slice").agg(F.sum("__start").alias("__n")).select(
        *keys, "__slice", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__base"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.join(starts, [*keys, "__slice"]).select(
        *df.columns, (F.col("__base") + F.sum("__start").over(upto)).alias("run"))
