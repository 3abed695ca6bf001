"""Recent windows against a baseline: fit sets, comparable values, verdicts and who may be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import ANALYSIS_VERSION, CYCLE, GROUP, Params
from tidemeter.operators.rates import explain_vector, rate_rows, reference_model


def _short(p: Params) -> Column:
    return F.col("window_seconds") <= p.short_window_seconds


def split_roles(windows: DataFrame, member: Column, p: Params, prefix: str = "") -> DataFrame:
    """Split the members of each group into recent, baseline and older windows.

    Short windows: last sight within 72 h is recent, older within 21 d is baseline.  Long windows: the
    newest is recent, up to four before it within 42 d are baseline.  Adds ``<prefix>recent``,
    ``<prefix>baseline``, ``<prefix>older_rank`` (1 = newest older window) and the group counts
    ``<prefix>recent_n``, ``<prefix>baseline_n``, ``<prefix>older_n``.
    """
    short = _short(p)
    when = F.when(short, F.col("last_seen")).otherwise(F.col("end"))
    out = windows.withColumn("__m", F.coalesce(member, F.lit(False)))
    ranked = Window.partitionBy(*GROUP, "__m").orderBy(F.desc("__at"), F.desc("start"), F.desc("reset_min"))
    out = out.withColumn("__at", when).withColumn("__rank", F.row_number().over(ranked))
    recent = F.col("__m") & F.when(short, F.col("last_seen") >= p.now - p.short_recent).otherwise(F.col("__rank") == 1)
    out = out.withColumn(f"{prefix}recent", recent)
    older = F.col("__m") & ~F.col(f"{prefix}recent")
    whole = Window.partitionBy(*GROUP)
    out = out.withColumn(f"{prefix}recent_n", F.count_if(f"{prefix}recent").over(whole))
    rank = F.when(older, F.col("__rank") - F.col(f"{prefix}recent_n"))
    base = older & F.when(short, F.col("last_seen") >= p.now - p.short_baseline).otherwise(
        (F.col("end") >= p.now - p.long_baseline) & (rank <= p.long_baseline_n))
    return (out.withColumn(f"{prefix}older_rank", rank).withColumn(f"{prefix}baseline", base)
            .withColumn(f"{prefix}baseline_n", F.count_if(f"{prefix}baseline").over(whole))
            .withColumn(f"{prefix}older_n", F.count(f"{prefix}older_rank").over(whole)).drop("__m", "__at", "__rank"))


def _rule(p: Params, name: str) -> Column:
    return F.when(_short(p), getattr(p, f"short_{name}")).otherwise(getattr(p, f"long_{name}"))


def fit_members(windows: DataFrame, p: Params) -> DataFrame:
    """Mark the fit set: windows of the analysis span and, where the recent baseline is too short, the
    last ones before the break."""
    usable = ~F.col("excluded")
    w = split_roles(windows, usable & (F.col("used_percent") >= p.min_trend_pct), p, "a_")
    span = usable & (F.col("end") >= p.now - p.analysis_span)
    anchor = (F.col("a_baseline_n") < _rule(p, "min_baseline")) & (F.col("a_older_rank") <= _rule(p, "fallback") + p.anchor_extra)
    return (w.withColumn("in_span", span).withColumn("in_fit", span | F.coalesce(anchor, F.lit(False)))
            .drop(*[f"a_{c}" for c in ("recent", "baseline", "older_rank", "recent_n", "baseline_n", "older_n")]))


def comparable_values(windows: DataFrame, vectors: DataFrame, fits: DataFrame, p: Params) -> DataFrame:
    """Each window's estimate as if spent on the group's reference model only; marks trend members.

    Without a reference model the plain estimate stands.  With one, a window whose spend the fitted
    rates cover to less than 70 % drops out, as does one whose estimate its own evidence contradicts.
    """
    any_span = Window.partitionBy(*GROUP)
    pool = (windows.select(*CYCLE, "plan_key", "contaminated", "in_span", "in_fit")
            .withColumn("__any", F.max("in_span").over(any_span))
            .where(~F.col("contaminated") & F.when(F.col("__any"), F.col("in_span")).otherwise(F.col("in_fit"))))
    ref = reference_model(vectors.join(pool.select(*CYCLE), CYCLE), fits)
    parts = explain_vector(vectors, fits, CYCLE).select(*CYCLE, "local_usd", "usd_expected", "usd_covered")
    w = windows.join(ref, GROUP, "left").join(parts, CYCLE, "left").na.fill(0.0, ["local_usd", "usd_expected", "usd_covered"])
    cap = F.col("estimate.cap")
    covered = (F.col("local_usd") > 0) & (F.col("usd_expected") > 0) & (
        F.try_divide("usd_covered", "usd_expected") >= 0.7)
    value = F.when(F.col("ref_model").isNull(), cap).when(
        covered, cap * F.try_divide(F.try_divide("usd_expected", "ref_rate"), F.col("local_usd")))
    has = F.col("estimate").isNotNull()
    w = w.withColumn("value", F.when(has, value))
    clash = F.col("estimate.conflict_pct") > 0
    return (w.withColumn("est_why", F.when(has & F.col("value").isNull(), "model_unpriced")
                         .when(has & clash, "estimate_conflict").otherwise(F.col("est_why")))
            .withColumn("in_trend", F.coalesce(has & F.col("value").isNotNull() & ~F.col("excluded") & (F.col("start") >= p.since)
                                               & ~clash & (F.col("used_percent") >= p.min_trend_pct) & F.col("in_fit"), F.lit(False)))
            .drop("local_usd", "usd_expected", "usd_covered"))


def robust_spread(values: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """1.4826 x MAD / median per key, at least 0.05; the default for fewer than three values."""
    med = values.groupBy(*keys).agg(F.median(value).alias("med"), F.count(value).alias("n"))
    mad = values.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"),
                                                    F.first("med").alias("med"), F.first("n").alias("n"))
    usable = (F.col("n") >= 3) & (F.col("med") != 0)
    return mad.select(*keys, F.when(usable, F.greatest(F.lit(1.4826) * F.col("mad") / F.nullif("med", F.lit(0.0)), F.lit(0.05)))
                      .otherwise(default).alias("spread"))


def compare(windows: DataFrame, vectors: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(windows with ``role``, verdict per group): recent trend windows against the baseline.

    A baseline broken off by a pause falls back to the last windows before it.  Where recent spend
    shares too little with the baseline's models, the verdict is ``model_changed`` with a raw ratio.
    """
    w = split_roles(windows, F.col("in_trend"), p, "t_")
    cross = (F.col("t_baseline_n") < _rule(p, "min_baseline")) & (F.col("t_older_n") >= _rule(p, "min_baseline"))
    w = w.withColumn("cross_gap", cross)
    base = F.when(F.col("cross_gap"), F.coalesce(F.col("t_older_rank") <= _rule(p, "fallback"), F.lit(False))).otherwise(F.col("t_baseline"))
    w = w.withColumn("__base", base)
    g = Window.partitionBy(*GROUP)
    w = w.withColumn("__base_n", F.count_if("__base").over(g))
    enough = (F.col("t_recent_n") >= _rule(p, "min_recent")) & (F.col("__base_n") >= _rule(p, "min_baseline"))
    w = w.withColumn("role", F.when(enough & F.col("t_recent"), "recent").when(enough & F.col("__base"), "baseline"))
    head = w.groupBy(*GROUP).agg(
        F.max("t_recent_n").alias("recent_n"), F.max("__base_n").alias("baseline_n"), F.max("cross_gap").alias("cross_gap"),
        F.min(F.when(F.col("__base"), F.col("start"))).alias("baseline_from"),
        F.max(F.when(F.col("__base"), F.col("end"))).alias("baseline_to"),
        F.min(F.when(F.col("role") == "recent", F.col("start"))).alias("__recent_from"),
        F.median(F.when(F.col("role") == "recent", F.col("value"))).alias("recent_median"),
        F.median(F.when(F.col("role") == "baseline", F.col("value"))).alias("baseline_median"),
        F.median(F.when(F.col("role") == "recent", F.col("estimate.cap"))).alias("__raw_recent"),
        F.median(F.when(F.col("role") == "baseline", F.col("estimate.cap"))).alias("__raw_baseline"))
    spread = robust_spread(w.where(F.col("role") == "baseline"), GROUP, "value", p.default_spread)
    shift = model_overlap(w.where(F.col("role").isNotNull()).select(*CYCLE, "plan_key", "role"), vectors, p)
    v = head.join(spread, GROUP, "left").join(shift, GROUP, "left")
    ready = F.col("recent_median").isNotNull() & F.col("baseline_median").isNotNull()
    noise = p.change_z * F.col("spread") * F.sqrt(1 / F.col("recent_n") + 1 / F.col("baseline_n"))
    v = (v.withColumn("ratio", F.when(ready, F.try_divide("recent_median", "baseline_median")))
         .withColumn("threshold", F.when(ready, F.greatest(F.lit(p.min_change), noise)))
         .withColumn("model_overlap", F.when(ready, F.coalesce("model_overlap", F.lit(1.0))))
         .withColumn("gap_days", F.when(ready & F.col("cross_gap"), F.greatest(
             F.lit(0.0), (F.col("__recent_from") - F.col("baseline_to")) / 86_400e6))))
    changed = ready & (F.col("model_overlap") < p.model_overlap)
    for c in ("raw_recent", "raw_baseline"):
        v = v.withColumn(c, F.when(changed, F.col(f"__{c}")))
    status = (F.when(~ready, "insufficient").when(changed, "model_changed")
              .when(F.col("ratio") < 1 - F.col("threshold"), "tighter")
              .when(F.col("ratio") > 1 + F.col("threshold"), "looser").otherwise("stable"))
    v = (v.withColumn("raw_ratio", F.try_divide("raw_recent", "raw_baseline")).withColumn("status", status)
         .drop("__recent_from", "__raw_recent", "__raw_baseline", "spread"))
    return w.drop("__base", "__base_n", "cross_gap", *[f"t_{c}" for c in (
        "recent", "baseline", "older_rank", "recent_n", "baseline_n", "older_n")]), v


def model_overlap(roles: DataFrame, vectors: DataFrame, p: Params) -> DataFrame:
    """Per group: recent spend from models that matter in the baseline, and the main model of each side."""
    usd = vectors.where(F.col("rate_key").startswith("usd:")).select(*CYCLE, "rate_key", "value")
    spent = roles.join(usd, CYCLE).groupBy(*GROUP, "rate_key").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "recent", F.col("value"))), F.lit(0.0)).alias("r"),
        F.coalesce(F.sum(F.when(F.col("role") == "baseline", F.col("value"))), F.lit(0.0)).alias("b"))
    g = Window.partitionBy(*GROUP)
    shares = (spent.withColumn("rs", F.try_divide("r", F.sum("r").over(g))).withColumn("bs", F.try_divide("b", F.sum("b").over(g))))
    name = lambda c: F.regexp_replace(F.min(F.struct((-F.col(c)).alias("s"), "rate_key"))["rate_key"], "^usd:", "")
    out = shares.groupBy(*GROUP).agg(
        F.coalesce(F.sum(F.when(F.col("bs") >= p.shared_model_share, F.col("rs"))), F.lit(0.0)).alias("model_overlap"),
        name("bs").alias("model_before"), name("rs").alias("model_after"), F.sum("r").alias("r"), F.sum("b").alias("b"))
    return out.where((F.col("r") > 0) & (F.col("b") > 0)).drop("r", "b")


def eligibility(windows: DataFrame, verdicts: DataFrame, p: Params) -> DataFrame:
    """Verdicts with ``eligible``, ``declared``, ``blocked`` reason counts and ``not_eligible``.

    Only a comparison whose every window has an estimate is eligible; it is declared when all of them
    are also covered by a claim.  Too few trend windows, though enough cycles exist, is not_eligible.
    """
    usable = windows.where(~F.col("excluded"))
    compared = F.col("role").isNotNull()
    facts = usable.groupBy(*GROUP).agg(
        F.first("window_seconds").alias("window_seconds"),
        F.coalesce(F.min(F.when(compared, F.col("estimate").isNotNull() & F.col("in_trend"))), F.lit(True)).alias("all_valued"),
        F.coalesce(F.min(F.when(compared, F.col("quality") == "conditional")), F.lit(True)).alias("all_declared"),
        F.count_if(F.col("role") == "recent").alias("nr"), F.count_if(F.col("role") == "baseline").alias("nb"))
    cand = F.col("supported") & (F.col("used_percent") >= p.min_trend_pct) & (
        F.col("end") >= p.now - p.analysis_span) & (F.col("start") >= p.since)
    c = split_roles(usable, cand, p, "c_")
    stuck = (F.col("c_recent") | F.col("c_baseline")) & (F.col("estimate").isNull() | F.col("est_why").isNotNull())
    counts = (c.where(stuck).groupBy(*GROUP, F.coalesce("est_why", F.lit("no_estimate")).alias("code")).agg(F.count("*").alias("n"))
              .groupBy(*GROUP).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("blocked")))
    room = c.groupBy(*GROUP).agg(
        F.max((F.col("c_recent_n") >= _rule(p, "min_recent"))
              & (F.greatest("c_baseline_n", "c_older_n") >= _rule(p, "min_baseline"))).alias("room"))
    v = (verdicts.join(facts, GROUP, "left").join(counts, GROUP, "left").join(room, GROUP, "left"))
    open_case = F.col("status") == "insufficient"
    eligible = F.col("status").isin("stable", "tighter", "looser") & F.col("all_valued") & (
        F.col("nr") >= _rule(p, "min_recent")) & (F.col("nb") >= _rule(p, "min_baseline"))
    v = v.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    return (v.withColumn("declared", F.col("eligible") & F.col("all_declared"))
            .withColumn("blocked", F.when(open_case, F.col("blocked")))
            .withColumn("status", F.when(open_case & F.col("blocked").isNotNull() & F.col("room"), "not_eligible")
                        .otherwise(F.col("status")))
            .drop("window_seconds", "all_valued", "all_declared", "nr", "nb", "room"))


def group_rows(windows: DataFrame, verdicts: DataFrame, fits: DataFrame, p: Params) -> DataFrame:
    """One report row per (limit, plan): bounds, fit, reference model, verdict.  Observed fits hide money."""
    bounds = windows.groupBy(*GROUP).agg(
        F.first("plan_type").alias("plan_type"), F.first("window_seconds").alias("window_seconds"),
        F.first("supported").alias("supported"), F.max("last_seen").alias("last_seen"), F.max("end").alias("latest_end"),
        F.count("*").alias("windows_n"), F.count_if("in_trend").alias("estimated_n"),
        F.first("ref_model").alias("ref_model"), F.first("ref_rate").alias("ref_rate"))
    rates = rate_rows(fits).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("windows")).alias("order"), "model", "unit", "windows", "pct_per_unit", "cap_if_only"))).alias("rates"))
    f = fits.select(*GROUP, F.col("basis").alias("fit_basis"), "fit_windows", (F.col("median_error") * 100).alias("median_error_pct"))
    g = (bounds.join(verdicts, GROUP, "left").join(f, GROUP, "left").join(rates, GROUP, "left")
         .withColumn("fit_windows", F.coalesce("fit_windows", F.lit(0)))
         .withColumn("ref_cap", F.when(F.col("fit_basis") == "conditional", 100 / F.col("ref_rate")))
         .withColumn("value_model", F.col("ref_model"))
         .withColumn("rates", F.transform("rates", lambda r: r.dropFields("order")))
         .withColumn("status", F.when(F.col("supported"), F.col("status")).otherwise("unsupported"))
         .withColumn("analysis_version", F.lit(ANALYSIS_VERSION)).withColumn("since", F.lit(p.since)))
    return g.drop("ref_rate")


def trend_rows(windows: DataFrame, p: Params) -> DataFrame:
    """Points of the trend: valued windows of the analysis span and the baseline before a break."""
    return windows.where(F.col("value").isNotNull() & (
        (F.col("end") >= p.now - p.analysis_span) | (F.col("role") == "baseline"))).select(
        *CYCLE, "plan_type", "plan_key", "key", "start", "end", "last_seen", "value", F.col("used_percent").alias("pct"),
        "external_pct", "contaminated", "in_trend", F.col("cost_at_snapshot").alias("cost"), "excluded", "role",
        "quality", "claimed", F.col("estimate.cap_low").alias("cap_low"), F.col("estimate.cap_high").alias("cap_high"))
