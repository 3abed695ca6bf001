"""Report views over analysed windows and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import CYCLE, DAY, GROUP, LIMIT, SEC

RELIABLE_WINDOWS = 4
LIVE_SPAN = 14 * DAY


def current_windows(windows: DataFrame) -> DataFrame:
    """The account's windows in use: the newest-seen cycle per limit, of the plan seen last.

    Ordered as shown: supported limits first, five-hour before longer, then by scope.
    """
    seen = windows.where(F.col("last_seen").isNotNull())
    row = F.struct(*[c for c in windows.columns if c not in LIMIT])
    top = seen.groupBy(*LIMIT).agg(F.max_by(row, F.struct("last_seen", -F.col("start"))).alias("w")).select(*LIMIT, "w.*")
    tool = Window.partitionBy("account_id", "tool")
    plan = F.max(F.struct("last_seen", "plan_type")).over(tool)["plan_type"]
    return (top.withColumn("__plan", plan).where(F.col("__plan").isNull() | F.col("plan_type").eqNullSafe(F.col("__plan")))
            .drop("__plan").orderBy("account_id", "tool", ~F.col("supported"), F.col("window") != "five_hour", "scope"))


_GROUP_SHOWN = ["ref_model", "ref_cap", "baseline_median", "recent_median", "status", "ratio", "threshold",
                "eligible", "declared", "blocked", "fit_basis", "since"]


def with_group(windows: DataFrame, groups: DataFrame) -> DataFrame:
    """Windows with the verdict of their (limit, plan), if it has one."""
    cols = [c for c in _GROUP_SHOWN if c not in windows.columns]
    return windows.drop(*[c for c in _GROUP_SHOWN if c in windows.columns]).join(
        groups.select(*GROUP, *_GROUP_SHOWN), GROUP, "left") if cols else windows


def remaining_by_model(current: DataFrame, groups: DataFrame) -> DataFrame:
    """Dollars left in active conditional windows if only one model were used."""
    rates = groups.where(F.col("fit_basis") == "conditional").select(*GROUP, F.explode("rates").alias("r")).where(
        (F.col("r.unit") == "usd") & F.col("r.cap_if_only").isNotNull())
    live = current.where(F.col("active") & (F.col("quality") == "conditional"))
    left = F.greatest(F.lit(0.0), 100 - F.col("used_percent"))
    return live.select(*CYCLE, "plan_key", "used_percent").join(rates, GROUP).select(
        *CYCLE, F.col("r.model").alias("model"), (left / F.col("r.pct_per_unit")).alias("usd"),
        (F.col("r.windows") >= RELIABLE_WINDOWS).alias("reliable"))


def pace(windows: DataFrame, now: int) -> DataFrame:
    """Projected percent at the reset, exhaustion time and whether the window will last.

    Too early (under a tenth elapsed) or too little used (under 2 %) gives no forecast.
    """
    n = F.lit(now)
    raw = F.try_divide((n - F.col("start")).cast("double"), (F.col("end") - F.col("start")).cast("double"))
    elapsed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    ok = (F.col("used_percent") >= 2) & (F.col("elapsed") >= 0.1)
    eta = F.col("start") + (n - F.col("start")) * F.try_divide(F.lit(100.0), F.col("used_percent"))
    return (windows.withColumn("elapsed", elapsed)
            .withColumn("projected", F.when(ok, F.try_divide("used_percent", "elapsed")))
            .withColumn("exhausted_at", F.when(ok, F.round(eta).cast("bigint")))
            .withColumn("will_last", F.when(ok, eta >= F.col("end"))))


def pending_spend(windows: DataFrame) -> DataFrame:
    """Spend after the last snapshot."""
    return windows.withColumn("pending_usd", F.greatest(F.lit(0.0), F.col("cost_so_far") - F.col("cost_at_snapshot")))


def range_too_wide(cap_low, cap_high, basis, weekly_delta, max_spread: float = 1.5, min_weekly: float = 5):
    """Whether a capacity range says too little to be shown."""
    return F.coalesce(cap_high > cap_low * max_spread, F.lit(False)) | F.coalesce(
        (basis == "window_delta") & (weekly_delta < min_weekly), F.lit(False))


def live_groups(groups: DataFrame, now: int) -> DataFrame:
    """Groups seen in the last two weeks and not ignored."""
    return groups.where((F.col("last_seen") > now - LIVE_SPAN) & (F.col("status") != "ignored"))


def banner_groups(groups: DataFrame, now: int) -> DataFrame:
    return live_groups(groups, now).where(F.col("eligible") & F.col("status").isin("tighter", "looser"))


def shown_rates(groups: DataFrame, now: int) -> DataFrame:
    """Single-model capacities of live groups, cheapest first within a group."""
    r = live_groups(groups, now).select(*GROUP, F.explode("rates").alias("r")).select(*GROUP, "r.*")
    return r.where((F.col("unit") == "usd") & F.col("cap_if_only").isNotNull()).orderBy(*GROUP, "cap_if_only", "model")


def latest_windows(windows: DataFrame, n: int = 150) -> DataFrame:
    return windows.orderBy(F.desc("end"), "account_id", "tool", "scope", "window", "reset_min").limit(n)


def public_columns(windows: DataFrame) -> DataFrame:
    """Window rows without working columns."""
    inner = ["plan_key", "reset_max", "late_external", "b", "split", "flagged", "ambiguous", "located", "claim_why",
             "gap_kinds", "until", "in_span", "in_fit", "ref_rate", "est_why", "snapshots", "peak_percent"]
    return windows.drop(*inner)


def window_detail(windows: DataFrame, account_id: int, tool: str, scope: str, window: str, end: int,
                  children: DataFrame) -> DataFrame:
    """Points or steps of the window that ends within a second of ``end``."""
    hit = windows.where((F.col("account_id") == account_id) & (F.col("tool") == tool) & (F.col("scope") == scope)
                        & (F.col("window") == window) & (F.abs(F.col("end") - end) < SEC)).select(*CYCLE)
    return children.join(hit, CYCLE)


def trend_in_view(trend: DataFrame) -> DataFrame:
    """Trend points without outliers that took no part: compared points set the range."""
    g = Window.partitionBy(*GROUP)
    any_used = F.max("in_trend").over(g)
    ref = F.when(any_used, F.when(F.col("in_trend"), F.col("v"))).otherwise(F.col("v"))
    t = (trend.withColumn("v", F.round("value", 2)).withColumn("__ref", ref)
         .withColumn("lo", F.greatest(F.lit(0.0), F.min("__ref").over(g) * 0.75))
         .withColumn("hi", F.max("__ref").over(g) * 1.25))
    return t.where(F.col("in_trend") | F.col("v").between(F.col("lo"), F.col("hi"))).drop("__ref", "v")


def fold_time(trend: DataFrame, short_gap: int = 7 * DAY, long_gap: int = 14 * DAY) -> DataFrame:
    """Position of trend points on an axis whose long pauses are squeezed to a fixed width.

    Adds ``pause_days`` (pause before the point, if long) and ``folded`` (axis position).
    """
    g = Window.partitionBy(*GROUP)
    order = g.orderBy("last_seen")
    limit = F.when(F.col("window") == "five_hour", short_gap).otherwise(long_gap)
    pause = F.col("last_seen") - F.lag("last_seen").over(order)
    t = trend.withColumn("__limit", limit.cast("bigint")).withColumn("__pause", F.when(pause > F.col("__limit"), pause))
    kept = F.max("last_seen").over(g) - F.min("last_seen").over(g) - F.coalesce(F.sum("__pause").over(g), F.lit(0))
    width = F.greatest(F.col("__limit") / 3.0, kept * 0.06)
    t = t.withColumn("__width", width)
    # Points at one instant share their position: a RANGE frame includes all peers.
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.coalesce(F.sum(F.col("__pause") - F.col("__width")).over(upto), F.lit(0.0))
    return (t.withColumn("pause_days", F.col("__pause") / F.lit(float(DAY)))
            .withColumn("folded", F.col("last_seen") - shift).drop("__limit", "__pause", "__width"))


def annotate_trend(trend: DataFrame, events: DataFrame) -> DataFrame:
    """Events that fall on a group's trend: same tool, same or no window, not before its first point."""
    first = trend.groupBy(*GROUP).agg(F.min("last_seen").alias("from_ts"))
    e = events.select(F.col("account_id").alias("__a"), F.col("tool").alias("__t"), F.col("window").alias("event_window"),
                      F.col("ts").alias("event_ts"), F.col("kind").alias("event_kind"))
    cond = ((F.col("account_id") == F.col("__a")) & (F.col("tool") == F.col("__t"))
            & (F.col("event_window").isNull() | (F.col("event_window") == F.col("window"))) & (F.col("event_ts") >= F.col("from_ts")))
    return first.join(e, cond).drop("__a", "__t")
