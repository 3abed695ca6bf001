"""The full analysis: from facts to windows, groups and trend points."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter import model as M
from tidemeter.model import CYCLE, GROUP, Params
from tidemeter.operators import estimate as E
from tidemeter.operators import evidence as V
from tidemeter.operators import rates as R
from tidemeter.operators import rules as D
from tidemeter.operators import trend as T
from tidemeter.operators import windows as W
from tidemeter.session import cut


@dataclass
class Inputs:
    """Tables of one analysis; those not given are empty."""

    spark: SparkSession
    usage: DataFrame
    snapshots: DataFrame
    links: DataFrame | None = None
    breakdowns: DataFrame | None = None
    claims: DataFrame | None = None
    logins: DataFrame | None = None
    gaps: DataFrame | None = None
    rules: DataFrame | None = None
    _empty: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        schema = {"links": M.LINK, "breakdowns": M.BREAKDOWN, "claims": M.CLAIM, "logins": M.LOGIN,
                  "gaps": M.GAP, "rules": M.RULE}[name]
        given = getattr(self, name)
        return given if given is not None else self.spark.createDataFrame([], schema)


@dataclass
class Result:
    windows: DataFrame
    steps: DataFrame
    groups: DataFrame
    trend: DataFrame
    fits: DataFrame
    vectors: DataFrame
    samples: DataFrame


def _best_fit(fits: DataFrame) -> DataFrame:
    """The first basis available per group: conditional, observed, else the rough fit of the first round."""
    order = F.when(F.col("basis") == "conditional", 0).when(F.col("basis") == "observed", 1).otherwise(2)
    body = F.struct(order.alias("o"), *[c for c in fits.columns if c not in GROUP])
    return (fits.groupBy(*GROUP).agg(F.min_by(body, order).alias("f")).select(*GROUP, "f.*").drop("o")
            .withColumn("basis", F.when(F.col("basis") == "rough", "observed").otherwise(F.col("basis"))))


def analyze(inputs: Inputs, p: Params) -> Result:
    """Two fitting rounds: a rough fit flags unexplained rises, then only the windows that passed are fitted.

    Lineage is cut where a table feeds both rounds.
    """
    windows, step_rows, spend = W.build_windows(inputs.snapshots, inputs.usage, inputs.table("links"), p, keep=cut)
    windows = D.mark_excluded(windows, inputs.table("rules"))
    windows = cut(T.fit_members(windows, p))
    step_rows = cut(step_rows)
    vectors = W.window_vector(spend).join(windows.select(*CYCLE, "plan_key"), CYCLE)
    evidence, matched = V.gather(windows, step_rows, inputs.table("breakdowns"), inputs.table("gaps"),
                                 inputs.table("logins"), inputs.table("claims"), p, keep=cut)
    weekly = windows.where((F.col("window") == "seven_day") & (F.col("scope") == "all") & (F.col("tool") == "timed"))
    weekly_snaps = inputs.snapshots.where(
        (F.col("window") == "seven_day") & (F.col("scope") == "all") & (F.col("tool") == "timed"))
    points = W.snapshot_points(weekly_snaps, weekly, step_rows, p)
    samples = E.weekly_samples(matched, points, windows, step_rows, p)
    split = E.split_windows(windows, samples, step_rows, p)
    known = cut(windows.join(evidence, CYCLE, "left").join(split, CYCLE, "left"))

    def judged(fits: DataFrame) -> tuple[DataFrame, DataFrame]:
        flagged, shown = R.flag_external(known, step_rows, spend, fits, p, keep=cut)
        return V.assess(flagged, p), shown

    def vector_of(rows: DataFrame, basis: str) -> DataFrame:
        return vectors.join(rows.select(*CYCLE, "used_percent"), CYCLE).withColumn("basis", F.lit(basis))

    fit_set = windows.where("in_fit and supported")
    usable = F.col("used_percent") >= p.min_fit_pct
    rough = cut(R.fit_rates(vector_of(fit_set.where(usable), "rough"), p.min_model_windows))
    first, _ = judged(rough)
    first = first.where("in_fit and supported").select(*CYCLE, "used_percent", "quality", "contaminated")
    first = cut(first)
    clean = R.fit_rates(
        vector_of(first.where(F.col("quality") == "conditional"), "conditional").unionByName(
            vector_of(first.where(~F.col("contaminated") & usable), "observed")), p.min_model_windows)
    fits = cut(_best_fit(clean.unionByName(rough)))
    second, shown = judged(fits)
    valued = cut(T.comparable_values(E.estimate(E.capacity(second), p), vectors, fits, p))
    roles, verdicts = T.compare(valued, vectors, p)
    roles = cut(roles)
    verdicts = T.eligibility(roles, verdicts, p)
    groups = D.mark_ignored(T.group_rows(roles, verdicts, fits, p), inputs.table("rules"))
    return Result(roles, shown, groups, T.trend_rows(roles, p), fits, vectors, samples)
