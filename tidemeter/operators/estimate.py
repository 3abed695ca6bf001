"""What a full window is worth: measured capacity, and local plus inferred estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions.scalars import confidence
from tidemeter.model import CYCLE, DAY, ESTIMATE_BLOCKERS, Params
from tidemeter.operators.evidence import _noncode
from tidemeter.operators.temporal import interval_join
from tidemeter.operators.windows import percent_at


def weekly_samples(matched: DataFrame, points: DataFrame, windows: DataFrame, step_rows: DataFrame, p: Params) -> DataFrame:
    """Timeline of weekly percent, non-code points and rounding error.

    Share tables hold over [as_of, last_as_of], so every weekly snapshot in between is a sample too.  A
    share reading is paired with the percent of the same poll, up to ``poll_pair`` later.
    """
    valid = matched.where((F.col("scope") == "all") & ~F.col("invalid"))
    cols = [*CYCLE, "week_start", "as_of", "noncode", "noncode_err"]
    edges = valid.select(*cols, F.explode(F.array("as_of", "last_as_of")).alias("t"))
    spans = valid.select(*cols, "last_as_of")
    inside = interval_join(points.select(*CYCLE, F.col("ts").alias("t")), spans, CYCLE, "t", "as_of", "last_as_of",
                           closed=True).select(*cols, "t")
    moments = edges.unionByName(inside).distinct().withColumn("paired", F.col("t") + p.poll_pair)
    at = _noncode(percent_at(moments, windows, step_rows, "paired")).where(F.col("pct").isNotNull())
    return at.select("account_id", "tool", "t", F.col("week_start").alias("week"), "as_of",
                     F.col("pct").alias("w"), "pp", "err")


def split_windows(windows: DataFrame, samples: DataFrame, step_rows: DataFrame, p: Params) -> DataFrame:
    """Share of the collected source in five-hour windows, from the weekly percent's moves meanwhile.

    Takes the last sample in the window and the last one shortly before it (or the window's first one,
    if little was used by then).  When the week rolls over in between, the old week's rise and the new
    week's level add up.  Bounds assume every rounding error points the same way.
    """
    five = windows.where((F.col("tool") == "timed") & (F.col("window") == "five_hour") & (F.col("scope") == "all"))
    own = five.select(*CYCLE, "start", "last_seen", (F.col("start") - p.split_max_gap).alias("__lo"),
                      (F.col("last_seen") + p.split_tail).alias("__hi"))
    near = interval_join(samples.withColumnRenamed("t", "at"), own, ["account_id", "tool"], "at", "__lo", "__hi",
                         DAY // 4, closed=True)
    s = F.struct(F.col("at").alias("t"), "week", "as_of", "w", "pp", "err")
    inside = F.col("at") > F.col("start")
    # One row per week first: the last sample of each week is what a rollover needs.
    weekly = near.groupBy(*CYCLE, "start", "last_seen", "week").agg(
        F.max(s).alias("week_last"), F.max(F.when(inside, s)).alias("in_last"), F.min(F.when(inside, s)).alias("in_first"),
        F.max(F.when(~inside, s)).alias("before"))
    ends = weekly.groupBy(*CYCLE, "start", "last_seen").agg(
        F.max("in_last").alias("s1"), F.min("in_first").alias("first"), F.max("before").alias("before"),
        F.collect_list("week_last").alias("weeks"))  # at most the few weeks a window touches
    ends = ends.where(F.col("s1").isNotNull() & (F.col("last_seen") - F.col("s1.t") <= p.split_max_gap))
    ends = percent_at(ends.withColumn("__t", F.col("first.t")), windows, step_rows, "__t").drop("__t")
    low_start = (F.col("first") != F.col("s1")) & (F.col("pct") <= p.split_start_pct)
    ends = (ends.withColumn("s0", F.coalesce("before", F.when(low_start, F.col("first"))))
            .where(F.col("s0").isNotNull())
            .withColumn("e", F.filter("weeks", lambda x: x["week"] == F.col("s0.week"))[0]))
    same = F.col("s0.week") == F.col("s1.week")

    def moved(f: str):
        return F.when(same, F.col(f"s1.{f}") - F.col(f"s0.{f}")).otherwise(
            F.col(f"e.{f}") - F.col(f"s0.{f}") + F.col(f"s1.{f}"))

    ew = F.when(same, 1.0).otherwise(1.5)
    en = F.col("s0.err") + F.col("s1.err") + F.when(same, 0.0).otherwise(F.col("e.err"))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    d = (ends.withColumn("dw", moved("w")).withColumn("dn", moved("pp")).withColumn("ew", ew).withColumn("en", en)
         .where(F.col("dw") >= p.split_min_weekly))
    return d.select(*CYCLE, F.struct(
        (100 * (1 - clamp(F.col("dn") / F.col("dw")))).alias("code"),
        (100 * (1 - clamp((F.col("dn") + F.col("en")) / (F.col("dw") - F.col("ew"))))).alias("code_low"),
        (100 * (1 - clamp((F.col("dn") - F.col("en")) / (F.col("dw") + F.col("ew"))))).alias("code_high"),
        F.col("dw").alias("weekly_delta"), F.col("dn").alias("noncode_delta"),
        F.col("s0.t").alias("from"), F.col("s1.t").alias("to")).alias("split"))


def capacity(windows: DataFrame) -> DataFrame:
    """Dollars of a full window with its rounding interval, for conditional windows only."""
    ok = F.col("supported") & (F.col("quality") == "conditional") & (F.col("used_percent") >= 1) & (F.col("cost_at_snapshot") > 0)
    at = lambda d: F.when(ok, F.col("cost_at_snapshot") / ((F.col("used_percent") + d) / 100))
    return (windows.withColumn("cap", at(0.0)).withColumn("cap_low", at(0.5)).withColumn("cap_high", at(-0.5))
            .withColumn("confidence", F.when(ok, confidence("used_percent"))))


def estimate(windows: DataFrame, p: Params) -> DataFrame:
    """Add ``estimate`` (local and inferred dollars, bounds, conflict) or ``est_why`` it is missing.

    Linked tools count as wholly local; weekly windows take the collected share from the source table,
    five-hour windows from their split.  Needs no coverage claim.
    """
    b, sp = F.col("b"), F.col("split")
    linked = F.col("tool") == "linked"
    weekly = ~linked & (F.col("window") == "seven_day") & b.isNotNull()
    short = ~linked & (F.col("window") == "five_hour") & sp.isNotNull()
    pick = lambda w, s: F.when(linked, 100.0).when(weekly, w).when(short, s)
    w = (windows.withColumn("code", pick(b["code"], sp["code"]))
         .withColumn("code_low", pick(F.greatest(F.lit(0.0), b["code"] - 0.5), sp["code_low"]))
         .withColumn("code_high", pick(F.least(F.lit(100.0), b["code"] + 0.5), sp["code_high"]))
         .withColumn("basis", F.when(linked, "local_only").when(weekly, "breakdown").when(short, "window_delta")))
    blockers = F.array(*[F.lit(c) for c in ESTIMATE_BLOCKERS])
    excused = F.array(*[F.lit(c) for c in ESTIMATE_BLOCKERS if c != "suspect_unrecorded"])
    blocked = F.filter("reasons", lambda r: F.array_contains(F.when(linked, blockers).otherwise(excused), r["code"]))
    w = w.withColumn("__blocker", F.try_element_at(blocked, F.lit(1))["code"])
    why = (F.when(~F.col("supported"), "unsupported")
           .when(F.col("basis").isNull(), F.when(F.col("window") == "five_hour", "no_split").otherwise("no_breakdown"))
           .when(F.col("__blocker").isNotNull(), F.col("__blocker"))
           .when((F.col("used_percent") < p.min_fit_pct) | (F.col("cost_at_snapshot") <= 0), "too_little")
           .when((F.col("code") < p.estimate_min_code) | (F.col("code_low") < p.estimate_min_code_low), "code_share_low"))
    cost, pct = F.col("cost_at_snapshot"), F.col("used_percent")
    w = w.withColumn("est_why", why)
    ok = F.col("est_why").isNull()
    safe = lambda c: F.when(ok, c)
    total = cost * 100 / F.col("code")
    conflict = F.col("external_pct") - (100 - F.col("code_low")) / 100 * pct
    est = F.struct(
        F.col("basis"), safe(F.when(conflict >= p.estimate_conflict, conflict).otherwise(0.0)).alias("conflict_pct"),
        cost.alias("local"), safe(total - cost).alias("inferred"), safe(total).alias("total"),
        safe(cost * 100 / F.col("code_high")).alias("total_low"), safe(cost * 100 / F.col("code_low")).alias("total_high"),
        F.col("code").alias("code_pct"), (100 - F.col("code")).alias("noncode_pct"), "code_low", "code_high",
        safe(total / (pct / 100)).alias("cap"),
        safe(cost * 1e4 / ((pct + 0.5) * F.col("code_high"))).alias("cap_low"),
        safe(cost * 1e4 / ((pct - 0.5) * F.col("code_low"))).alias("cap_high"),
        F.when(short, sp["weekly_delta"]).alias("weekly_delta"), F.when(short, sp["noncode_delta"]).alias("noncode_delta"))
    return w.withColumn("estimate", F.when(ok, est)).drop("code", "code_low", "code_high", "basis", "__blocker")
