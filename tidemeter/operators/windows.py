"""Quota cycles ("windows"): rebuilt from percent snapshots, and the spend attributed to them.

The snapshot table is read once, into a digest with one row per (limit, reset bucket, percent value).
A percent series has few distinct values, so even a limit that holds a large part of all snapshots
shrinks to a handful of rows in the map-side combine; all per-limit ordering happens on that digest.
Requests are never ordered: each finds its segment (cycle and step) by an interval join and is
summed with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions.scalars import exact_sum, fit_key, in_scope, scope_supported, usd
from tidemeter.model import CYCLE, DAY, HOUR, LIMIT, SEC, WINDOW_SECONDS, Params
from tidemeter.operators.temporal import blocked_scan, bucket_of, interval_join, value_at, values_by_slice

_FAR = 1 << 62


def snapshot_digest(snapshots: DataFrame, p: Params) -> DataFrame:
    """One row per (limit, reset bucket, percent): extents, latest plan and window length."""
    known = snapshots.where(F.col("resets_at").isNotNull() & F.col("window_seconds").isNotNull())
    plan = F.when(F.col("plan_type") != "", F.col("plan_type"))
    keys = [*LIMIT, bucket_of(F.col("resets_at"), p.reset_jitter).alias("reset_bucket"), "used_percent"]
    # By plan and length first: these buffers hold numbers only, so the snapshots are hashed and never sorted; structs come on the few rows left.
    few = known.groupBy(*keys, plan.alias("plan"), "window_seconds").agg(
        F.min("resets_at").alias("reset_min"), F.max("resets_at").alias("reset_max"),
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.count("*").alias("n"))
    return few.groupBy(*LIMIT, "reset_bucket", "used_percent").agg(
        F.min("reset_min").alias("reset_min"), F.max("reset_max").alias("reset_max"),
        F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"),
        F.max(F.when(F.col("plan").isNotNull(), F.struct(F.col("ts_max").alias("ts"), "plan"))).alias("last_plan"),
        F.min(F.struct(F.col("reset_min").alias("resets_at"), "window_seconds")).alias("first_reset"),
        F.sum("n").alias("snapshots"))


def reset_sessions(digest: DataFrame, p: Params) -> DataFrame:
    """(limit, reset bucket) -> ``reset_min`` of its cycle: a new one starts after a reset gap above the jitter.

    All resets of one bucket are within the jitter of each other, so ordering the buckets of a limit
    (a number bounded by elapsed time, not by rows) is enough.
    """
    w = Window.partitionBy(*LIMIT).orderBy("reset_bucket")
    buckets = digest.groupBy(*LIMIT, "reset_bucket").agg(F.min("reset_min").alias("lo"), F.max("reset_max").alias("hi"))
    gap = F.col("lo") - F.lag("hi").over(w)
    return (buckets.withColumn("__new", F.when(gap <= p.reset_jitter, F.lit(None)).otherwise(F.col("lo")))
            .withColumn("cycle_min", F.last("__new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .select(*LIMIT, "reset_bucket", "cycle_min"))


def cycle_digest(snapshots: DataFrame, p: Params) -> DataFrame:
    """The snapshot digest keyed by cycle."""
    return owned_digest(snapshot_digest(snapshots, p), p)


def owned_digest(digest: DataFrame, p: Params) -> DataFrame:
    """A snapshot digest, perhaps merged from those of several batches, keyed by cycle."""
    owner = reset_sessions(digest, p).withColumnRenamed("cycle_min", "reset_min")
    return digest.drop("reset_min").join(owner, [*LIMIT, "reset_bucket"])


def cycles(digest: DataFrame, p: Params) -> DataFrame:
    """Cycle rows: reset range, first and last sight, plan, length and the [start, end) they own.

    Timed tools cannot own the same instant twice: where the next cycle (by first sight) starts before
    this one ends, both are cut at max(next start, this last sight).
    """
    base = digest.groupBy(*CYCLE).agg(
        F.max("reset_max").alias("reset_max"), F.min("ts_min").alias("first_seen"), F.max("ts_max").alias("last_seen"),
        F.max("last_plan")["plan"].alias("plan_type"), F.min("first_reset")["window_seconds"].alias("window_seconds"),
        F.max("used_percent").alias("peak_percent"), F.sum("snapshots").alias("snapshots"))
    base = base.withColumn("start", F.col("reset_min") - F.col("window_seconds") * SEC).withColumn("end", F.col("reset_max"))
    w = Window.partitionBy(*LIMIT).orderBy("first_seen", "reset_min")
    timed = F.col("tool") == "timed"
    # The pair's test uses the next start before, and the own end before any cut: one pass suffices.
    next_cut = F.when(timed & (F.lead("start").over(w) < F.col("end")),
                      F.greatest(F.lead("start").over(w), F.col("last_seen")))
    cut = base.withColumn("__cut", next_cut)
    return (cut.withColumn("end", F.coalesce("__cut", "end"))
            .withColumn("start", F.coalesce(F.lag("__cut").over(w), F.col("start"))).drop("__cut")
            .withColumn("attribution", F.when(timed, "time").otherwise("linked"))
            .withColumn("supported", scope_supported("tool", "scope"))
            .withColumn("active", F.col("end") > p.now)
            .withColumn("key", F.concat_ws(":", "scope", "window", F.floor(F.col("reset_min") / SEC).cast("string"))))


def steps(digest: DataFrame) -> DataFrame:
    """Rises of the monotone percent of each cycle.

    The earliest snapshot of every percent value decides: a value is a step if nothing at least as
    large was seen before it.  ``prev_ts`` is NULL for the first step; ``unsegmented`` marks a rise
    already present at the very first snapshot.
    """
    per_value = digest.groupBy(*CYCLE, "used_percent").agg(F.min("ts_min").alias("ts"))
    w = Window.partitionBy(*CYCLE).orderBy("ts", F.desc("used_percent"))
    before = F.coalesce(F.max("used_percent").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = F.min("ts").over(Window.partitionBy(*CYCLE))
    rises = (per_value.withColumn("before", F.greatest(before, F.lit(0.0))).withColumn("first_seen", first)
             .where(F.col("used_percent") > F.col("before")))
    n = Window.partitionBy(*CYCLE).orderBy("ts")
    return rises.select(
        *CYCLE, F.row_number().over(n).alias("step_no"), "ts", F.lag("ts").over(n).alias("prev_ts"),
        F.col("used_percent").alias("pct"), (F.col("used_percent") - F.col("before")).alias("dpct"),
        (F.col("ts") == F.col("first_seen")).alias("unsegmented"))


def segments(windows: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Half-open time segments of each supported cycle: one per step, one up to the last sight, one after.

    ``step_no`` is 0 for the part after the last step and -1 for the part after the last sight.  A request
    belongs to the first snapshot at or after it, so a segment is (previous, this] = [previous+1, this+1).
    """
    w = Window.partitionBy(*CYCLE).orderBy("ts")
    own = windows.where("supported").select(*CYCLE, "reset_max", "start", "end", "last_seen", "attribution")
    edges = step_rows.select(*CYCLE, "step_no", "ts").join(own, CYCLE)
    rising = edges.select(*CYCLE, "reset_max", "start", "end", "attribution", "step_no",
                          (F.coalesce(F.lag("ts").over(w), F.lit(-_FAR)) + 1).alias("lo"), (F.col("ts") + 1).alias("hi"))
    top = step_rows.groupBy(*CYCLE).agg(F.max("ts").alias("top"))
    tails = own.join(top, CYCLE, "left").withColumn("top", F.coalesce("top", F.lit(-_FAR)) + 1)
    tail = tails.select(*CYCLE, "reset_max", "start", "end", "attribution", F.explode(F.array(
        F.struct(F.lit(0).alias("step_no"), F.col("top").alias("lo"), (F.col("last_seen") + 1).alias("hi")),
        F.struct(F.lit(-1).alias("step_no"), (F.col("last_seen") + 1).alias("lo"), F.lit(_FAR).alias("hi")))).alias("s"))
    whole = rising.unionByName(tail.select(*CYCLE, "reset_max", "start", "end", "attribution", "s.*"))
    timed = F.col("attribution") == "time"
    return (whole.withColumn("lo", F.when(timed, F.greatest("lo", "start")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(timed, F.least("hi", "end")).otherwise(F.col("hi")))
            .where(F.col("lo") < F.col("hi")).drop("start", "end"))


def attribute(usage: DataFrame, links: DataFrame, segs: DataFrame, p: Params) -> DataFrame:
    """On-plan requests placed in cycles and segments: by time for timed tools, by link for linked ones."""
    on_plan = usage.where("on_plan").select(
        "id", "account_id", F.col("tool"), "ts", "model", "cost_pico",
        (F.col("input_tokens") + F.col("cache_read_tokens") + F.col("output_tokens")).alias("tokens"))
    timed_segs = segs.where(F.col("attribution") == "time").drop("reset_max", "attribution")
    timed = interval_join(on_plan.where(F.col("tool") == "timed"), timed_segs, ["account_id", "tool"], "ts", "lo", "hi", DAY // 4)
    linked_use = on_plan.where(F.col("tool") == "linked")
    bridge = (links.where(F.col("resets_at").isNotNull())
              .select(F.col("usage_id").alias("id"), "account_id", "tool", "scope", "window", "resets_at"))
    joined = bridge.join(linked_use, ["account_id", "tool", "id"])
    linked = _linked_to_segments(joined, segs.where(F.col("attribution") == "linked").drop("attribution"), p)
    cols = [*CYCLE, "step_no", "id", "ts", "model", "cost_pico", "tokens"]
    both = timed.select(*cols).unionByName(linked.select(*cols))
    return both.where(in_scope("tool", "scope", "model"))


def _linked_to_segments(requests: DataFrame, segs: DataFrame, p: Params) -> DataFrame:
    """Linked requests with the segment of their window: by limit, quarter hour of the reset and hour of the request.

    A window's requests share its reset, so the hour spreads them; the exact reset and instant are residual tests.  Requests
    more than an hour outside the window that their own link names are few; they go by the reset alone, under an hour that is none.
    Both go in one join, so the requests are made once.
    """
    length, none = _length(), F.lit(_FAR)
    near = (F.col("ts") >= F.col("resets_at") - length - HOUR) & (F.col("ts") <= F.col("resets_at") + HOUR)
    reach = segs.withColumn("reset_lo", F.col("reset_min") - p.link_slack).withColumn("reset_hi", F.col("reset_max") + p.link_slack)
    lo = F.greatest("lo", F.col("reset_lo") - length - HOUR)
    hi = F.least(F.col("hi") - 1, F.col("reset_hi") + HOUR)
    inside = F.when(lo <= hi, F.sequence(bucket_of(lo, HOUR), bucket_of(hi, HOUR))).otherwise(F.array().cast("array<bigint>"))
    hours = (reach.withColumn("__h", F.explode(F.concat(inside, F.array(none))))
             .withColumn("__r", F.explode(F.sequence(bucket_of(F.col("reset_lo"), p.reset_jitter), bucket_of(F.col("reset_hi"), p.reset_jitter)))).alias("s"))
    r = (requests.withColumn("__h", F.when(near, bucket_of(F.col("ts"), HOUR)).otherwise(none))
         .withColumn("__r", bucket_of(F.col("resets_at"), p.reset_jitter))).alias("r")
    cond = F.col("r.resets_at").between(F.col("s.reset_lo"), F.col("s.reset_hi")) & (F.col("r.ts") >= F.col("s.lo")) & (F.col("r.ts") < F.col("s.hi"))
    for k in (*LIMIT, "__h", "__r"):
        cond = cond & (F.col(f"r.{k}") == F.col(f"s.{k}"))
    extra = [c for c in segs.columns if c not in LIMIT]
    return r.join(hours, cond).select(*[F.col(f"r.{c}").alias(c) for c in requests.columns], *[F.col(f"s.{c}").alias(c) for c in extra])


def segment_spend(attributed: DataFrame) -> DataFrame:
    """Spend per (cycle, segment, regressor): dollars if priced, else million tokens."""
    priced = F.col("cost_pico").isNotNull()
    return (attributed.groupBy(*CYCLE, "step_no", fit_key("model", priced).alias("rate_key"))
            .agg(exact_sum("cost_pico").alias("pico"), exact_sum(F.when(~priced, F.col("tokens"))).alias("tokens"),
                 F.count_if(~priced).alias("unpriced_requests"))
            .withColumn("value", F.coalesce(usd("pico"), F.col("tokens").cast("double") / 1e6)))


def window_costs(spend: DataFrame) -> DataFrame:
    """Per cycle: cost at the last snapshot, cost so far and unpriced requests."""
    return spend.groupBy(*CYCLE).agg(
        F.coalesce(usd(F.sum(F.when(F.col("step_no") >= 0, F.col("pico")))), F.lit(0.0)).alias("cost_at_snapshot"),
        F.coalesce(usd(F.sum("pico")), F.lit(0.0)).alias("cost_so_far"),
        F.sum("unpriced_requests").alias("unpriced_requests"))


def window_vector(spend: DataFrame) -> DataFrame:
    """Spend per (cycle, regressor) up to the last snapshot."""
    return spend.where(F.col("step_no") >= 0).groupBy(*CYCLE, "rate_key").agg(
        F.coalesce(usd(F.sum("pico")), F.sum("tokens").cast("double") / 1e6).alias("value"))


def fill_plans(windows: DataFrame) -> DataFrame:
    """Give a cycle without a plan that of the cycle of the same limit with the nearest start (tie: earlier)."""
    w = Window.partitionBy(*LIMIT).orderBy("start", "reset_min")
    mark = F.when(F.col("plan_type").isNotNull(), F.struct(F.col("start").alias("at"), F.col("plan_type").alias("plan")))
    back = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    out = windows.withColumn("__back", back).withColumn("__ahead", ahead)
    nearest = (F.when(F.col("__back").isNull(), F.col("__ahead.plan"))
               .when(F.col("__ahead").isNull(), F.col("__back.plan"))
               .when(F.col("start") - F.col("__back.at") <= F.col("__ahead.at") - F.col("start"), F.col("__back.plan"))
               .otherwise(F.col("__ahead.plan")))
    return out.withColumn("plan_type", F.coalesce("plan_type", nearest)).drop("__back", "__ahead")


def build_windows(snapshots: DataFrame, usage: DataFrame, links: DataFrame, p: Params,
                  keep=lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, steps, segment spend).  ``keep`` may cut lineage of what is used again."""
    digest = keep(owned_digest(keep(snapshot_digest(snapshots, p)), p))
    rows = cycles(digest, p)
    rises = steps(digest)
    spend = keep(segment_spend(attribute(usage, links, segments(rows, rises), p)))
    return windows_with_spend(rows, rises, spend), rises, spend


def windows_with_spend(rows: DataFrame, rises: DataFrame, spend: DataFrame) -> DataFrame:
    """Cycle rows with their percent, their costs and a plan."""
    top = rises.groupBy(*CYCLE).agg(
        F.max("pct").alias("used_percent"),
        F.max(F.when(F.col("unsegmented"), F.col("dpct"))).alias("unsegmented_pct"))
    windows = (rows.join(top, CYCLE, "left").join(window_costs(spend), CYCLE, "left")
               .na.fill(0.0, ["used_percent", "unsegmented_pct", "cost_at_snapshot", "cost_so_far"])
               .na.fill(0, ["unpriced_requests"]))
    return fill_plans(windows).withColumn("plan_key", F.coalesce("plan_type", F.lit("")))


#: Width of the slices of time in which a cycle's percent is looked up.
_SLICE = DAY // 4


def _length() -> Column:
    """Length of a window by its name; a month and a day where that says nothing."""
    return F.coalesce(*[F.when(F.col("window") == n, F.lit(s * SEC)) for n, s in WINDOW_SECONDS.items()], F.lit(31 * DAY))


def _bounds(reset: Column) -> tuple[Column, Column]:
    """First and last slice of the cycle of a reset: what lies outside belongs to the outermost slices."""
    last = bucket_of(reset, _SLICE) + 1
    return last - F.ceil(_length() / _SLICE).cast("bigint") - 2, last


def _slice_of(at: str, reset: Column) -> Column:
    first, last = _bounds(reset)
    return F.least(F.greatest(bucket_of(F.col(at), _SLICE), first), last)


def _edges(windows: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Where the monotone percent of a cycle changes: to zero at its first sight, then at its steps."""
    edges = (step_rows.select(*CYCLE, F.col("ts").alias("__ts"), "pct")
             .unionByName(windows.select(*CYCLE, F.col("first_seen").alias("__ts"), F.lit(0.0).alias("pct"))))
    return edges.groupBy(*CYCLE, "__ts").agg(F.max("pct").alias("pct"))


def percent_at(moments: DataFrame, windows: DataFrame, step_rows: DataFrame, at: str = "t") -> DataFrame:
    """Monotone percent of a cycle at moments of it (rows keyed by cycle); NULL before its first snapshot."""
    reset = F.col("reset_min")
    laid = values_by_slice(_edges(windows, step_rows), CYCLE, "__ts", "pct", *_bounds(reset), _SLICE)
    found = moments.withColumn("slice", _slice_of(at, reset)).join(laid, [*CYCLE, "slice"], "left")
    return found.select(*moments.columns, value_at(at).alias("pct"))


def snapshot_points(snapshots: DataFrame, windows: DataFrame, step_rows: DataFrame, p: Params) -> DataFrame:
    """Every snapshot with its cycle and the monotone percent at it: one join, by limit, reset bucket and slice of time."""
    known = snapshots.where(F.col("resets_at").isNotNull() & F.col("window_seconds").isNotNull())
    reset_bucket = bucket_of(F.col("resets_at"), p.reset_jitter).alias("reset_bucket")
    extents = known.groupBy(*LIMIT, reset_bucket).agg(F.min("resets_at").alias("reset_min"), F.max("resets_at").alias("reset_max"))
    owner = reset_sessions(extents, p).withColumnRenamed("cycle_min", "reset_min")
    # a snapshot knows its reset bucket only, so what it looks up is laid out for each bucket of a cycle, also of one that is not in ``windows``
    edges = owner.join(_edges(windows, step_rows), CYCLE, "left").withColumn("__ts", F.coalesce("__ts", F.lit(-_FAR)))
    reset = F.col("reset_bucket") * p.reset_jitter
    laid = values_by_slice(edges, [*CYCLE, "reset_bucket"], "__ts", "pct", *_bounds(reset), _SLICE)
    pts = known.select(*LIMIT, "ts", reset_bucket).withColumn("slice", _slice_of("ts", reset))
    return pts.join(laid, [*LIMIT, "reset_bucket", "slice"]).select(*CYCLE, "ts", value_at("ts").alias("pct"))


def spend_at_snapshots(points: DataFrame, attributed: DataFrame, slice_span: int = DAY // 96) -> DataFrame:
    """Points with the cumulative cost of the cycle's requests up to and including each.

    Requests and snapshots of a cycle form one timeline, summed slice by slice so a huge cycle spreads
    over many tasks; requests sharing an instant are added up first.
    """
    spend = attributed.groupBy(*CYCLE, "ts").agg(F.coalesce(exact_sum("cost_pico"), F.lit(0)).alias("pico"))
    line = (spend.withColumn("kind", F.lit(0)).withColumn("pct", F.lit(None).cast("double"))
            .unionByName(points.select(*CYCLE, "ts", "pct").withColumn("pico", F.lit(0).cast("decimal(28,0)"))
                         .withColumn("kind", F.lit(1)))
            .withColumn("pico", F.col("pico").cast("decimal(28,0)"))
            .withColumn("slice", bucket_of(F.col("ts"), slice_span)))
    run = blocked_scan(line, CYCLE, "slice", ["ts", "kind"], total=["pico"])
    return run.where(F.col("kind") == 1).select(*CYCLE, "ts", "pct", usd("pico__total").alias("cost"))
