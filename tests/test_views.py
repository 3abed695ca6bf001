"""Views over events, verdicts and rates, on small tables with worked-out results."""

import pytest
from pyspark.sql import functions as F

from tidemeter import model as M
from tidemeter.model import DAY, HOUR, SEC
from tidemeter.operators import alerts, events, rates, views

NOW = 1_706_659_200 * SEC
KEYS = "account_id long, tool string, scope string, window string, plan_key string"


def test_a_view_shows_the_newest_events(spark):
    rows = [(a, "timed", NOW - k * DAY, "plan", None, "all") for a in (1, 2) for k in range(6)]
    found = events.recent_events(spark.createDataFrame(rows, "account_id long, tool string, ts long, kind string, window string, scope string"), NOW, 4, 5)
    assert [(r.account_id, (NOW - r.ts) // DAY) for r in found.collect()] == [(1, 0), (2, 0), (1, 1), (2, 1), (1, 2)]
    assert events.recent_events(found.limit(0), NOW, 4, 5).count() == 0


def verdicts(spark, rows):
    """(account, status, eligible, declared, version, cross gap) as groups."""
    schema = f"{KEYS}, status string, eligible boolean, declared boolean, analysis_version int, cross_gap boolean, last_seen long"
    g = spark.createDataFrame([(a, "timed", "all", "five_hour", "plus", *x, NOW - HOUR) for a, *x in rows], schema)
    return g.withColumns({"ratio": F.lit(0.5), "recent_median": F.lit(10.26), "baseline_median": F.lit(20.0), "recent_n": F.lit(3), "baseline_n": F.lit(5),
                          "ref_model": F.lit("m"), "baseline_to": F.lit(NOW)})


def test_alerts_are_of_declared_changes_and_rest_for_a_day(spark):
    v = M.ANALYSIS_VERSION
    g = verdicts(spark, [(1, "tighter", True, True, v, False), (2, "looser", True, True, v, True), (3, "stable", True, True, v, False), (4, "tighter", False, True, v, False),
                         (5, "tighter", True, False, v, False), (6, "tighter", True, True, v - 1, False), (7, "tighter", True, True, v, False), (8, "tighter", True, True, v, False)])
    past = spark.createDataFrame([(a, "timed", "all:five_hour:plus", d, NOW - h * HOUR, 0.5, "", v) for a, d, h in [(7, "tighter", 23), (8, "tighter", 25), (1, "looser", 1)]], M.ALERT)
    new = alerts.new_alerts(g, past, NOW)
    got = {r.account_id: r for r in new.collect()}
    assert set(got) == {1, 2, 8}
    assert got[1].detail == "50%; last 3 windows m about $10.3, before that 5 windows about $20.0"
    assert got[2].detail.endswith("; compared with windows before 01-31") and got[2].direction == "looser"
    assert [r.account_id for r in alerts.latest_alerts(new, 2).collect()] == [1, 2]


def test_banner_of_live_changes(spark):
    g = verdicts(spark, [(k, s, e, False, 1, False) for k, (s, e) in enumerate([("tighter", True), ("tighter", False), ("stable", True), ("ignored", True), ("looser", True)])])
    g = g.withColumn("last_seen", F.when(F.col("account_id") == 4, NOW - 14 * DAY).otherwise(F.col("last_seen")))
    assert [r.account_id for r in views.banner_groups(g, NOW).collect()] == [0]


def test_a_negative_rate_leaves_and_the_rest_is_fitted_again(spark):
    cycles = [(1.0, 1.0, 1.0), (2.0, 1.0, 4.0), (3.0, 2.0, 5.0)]  # exactly 3 and -2
    rows = [(1, "timed", "all", "five_hour", "plus", "rough", k, name, value, used) for k, (x, y, used) in enumerate(cycles) for name, value in [("usd:x", x), ("usd:y", y)]]
    got = rates.fit_rates(spark.createDataFrame(rows, f"{KEYS}, basis string, reset_min long, rate_key string, value double, used_percent double")).first()
    assert [(r.rate_key, r.windows) for r in got.rates] == [("usd:x", 3), ("usd:y", 3)]
    assert [r.rate for r in got.rates] == pytest.approx([24 / 14, 0.0]) and got.fit_windows == 3


def test_dollars_left_by_model(spark):
    cycle = "account_id long, tool string, scope string, window string, reset_min long, plan_key string"
    current = spark.createDataFrame([(a, "timed", "all", "five_hour", 9, "plus", used, active, q) for a, used, active, q in [
        (1, 40.0, True, "conditional"), (1, 120.0, True, "conditional"), (2, 10.0, True, "waiting"), (3, 10.0, False, "conditional")]],
        f"{cycle}, used_percent double, active boolean, quality string")
    rate = "rates array<struct<model string, unit string, windows long, pct_per_unit double, cap_if_only double>>"
    listed = [("m1", "usd", 4, 2.0, 50.0), ("m2", "usd", 3, 0.5, 200.0), ("m3", "mtok", 9, 1.0, 100.0), ("m4", "usd", 9, 0.0, None)]
    groups = spark.createDataFrame([(a, "timed", "all", "five_hour", "plus", "conditional", listed) for a in (1, 2, 3)], f"{KEYS}, fit_basis string, {rate}")
    got = sorted((r.model, r.usd, r.reliable) for r in views.remaining_by_model(current, groups).collect())
    assert got == [("m1", 0.0, True), ("m1", 30.0, True), ("m2", 0.0, False), ("m2", 120.0, False)]
