"""Temporal building blocks against brute force; one key holds most rows throughout."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemeter.model import SEC, Params
from tidemeter.operators import temporal as T
from tidemeter.operators import windows as W


@pytest.fixture(scope="module")
def rnd():
    return random.Random(7)


def hot_key(r):
    return 0 if r.random() < 0.6 else r.randrange(1, 5)


def test_interval_join(spark, rnd):
    pts = [(hot_key(rnd), i, rnd.randrange(-500, 2000)) for i in range(400)]
    spans = [(hot_key(rnd), j, lo := rnd.randrange(-500, 2000), lo + rnd.randrange(-3, 400)) for j in range(60)]
    p = spark.createDataFrame(pts, "k long, i long, t long")
    s = spark.createDataFrame(spans, "k long, j long, lo long, hi long")
    for closed in (False, True):
        got = sorted((r.i, r.j) for r in T.interval_join(p, s, ["k"], "t", "lo", "hi", 50, closed=closed).collect())
        assert got == sorted((i, j) for k, i, t in pts for kk, j, lo, hi in spans if k == kk and (lo <= t <= hi if closed else lo <= t < hi))
    anti = {r.i for r in T.interval_join(p, s, ["k"], "t", "lo", "hi", 50, how="left_anti").collect()}
    assert anti == {i for k, i, t in pts if not any(k == kk and lo <= t < hi for kk, _, lo, hi in spans)}


def test_overlap_join(spark, rnd):
    def some(n):
        return [(hot_key(rnd), j, lo := rnd.randrange(0, 1000), lo + rnd.randrange(-5, 150)) for j in range(n)]
    a, b = some(80), some(80)
    da = spark.createDataFrame(a, "k long, i long, lo long, hi long")
    db = spark.createDataFrame(b, "k long, j long, s long, e long")
    got = sorted((r.i, r.j) for r in T.overlap_join(da, db, ["k"], "lo", "hi", "s", "e", 37).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] and y[3] > x[2] and y[2] <= y[3])
    assert [g for g in got if b[g[1]][2] <= b[g[1]][3]] == want


def test_merge_spans(spark, rnd):
    spans = [(hot_key(rnd), lo := rnd.randrange(0, 3000), lo + rnd.randrange(0, 30)) for _ in range(250)]
    spans += spans[:20]
    df = spark.createDataFrame(spans, "k long, start long, end long")
    got = sorted(tuple(r) for r in T.merge_spans(df, ["k"], slice_span=100).select("k", "start", "end").collect())
    want = []
    for k, lo, hi in sorted(spans):
        if want and want[-1][0] == k and lo <= want[-1][2]:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([k, lo, hi])
    assert got == [tuple(w) for w in want]


def test_blocked_scan_equals_one_window(spark, rnd):
    rows = [(hot_key(rnd), i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"])) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t long, v long, s string").withColumn("b", T.bucket_of(F.col("t"), 40))
    got = T.blocked_scan(df, ["k"], "b", ["t"], last=["s"], first=["v"], high=["v"], total=["v"])
    w = Window.partitionBy("k").orderBy("t")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.last("s", True).over(upto).alias("s__last"), F.first("v", True).over(upto).alias("v__first"),
                     F.max("v").over(prior).alias("v__high"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("v__total"))
    assert got.exceptAll(want).count() == 0 and got.count() == 600


def test_equal_runs(spark, rnd):
    rows = [(hot_key(rnd), i, rnd.choice("aab")) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = {(r.k, r.t): r.run for r in T.equal_runs(df, ["k"], "t", F.col("v") == F.col("prev.v"), span=16).collect()}
    for k in range(5):
        run, last = 0, None
        for _, t, v in sorted(r for r in rows if r[0] == k):
            run, last = run + (v != last), v
            assert got[k, t] == run


def test_cycles_do_not_depend_on_arrival_order(spark, rnd):
    rows = []
    for i in range(300):
        ts = rnd.randrange(0, 200_000)
        reset = ts - ts % 18_000 + 18_000 + rnd.randrange(3)
        rows.append((hot_key(rnd), "timed", "all", "five_hour", ts * SEC + i, float(rnd.randrange(0, 100)), reset * SEC, 18000, "plus", "t"))
    from tidemeter.model import SNAPSHOT
    p = Params(now=10**15)
    outs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        d = W.cycle_digest(spark.createDataFrame(rows, SNAPSHOT), p)
        outs.append((sorted(map(str, W.cycles(d, p).collect())), sorted(map(str, W.steps(d).collect()))))
    assert outs[0] == outs[1]
    # The monotone percent, recomputed row by row.
    by = {}
    for a, *_, ts, pct, reset, _, _, _ in rows:
        by.setdefault((a, reset // (18_000 * SEC)), []).append((ts, pct))
    steps = {}
    for st in W.steps(d).collect():
        steps.setdefault((st.account_id, st.reset_min // (18_000 * SEC)), []).append((st.ts, st.pct))
    for k, seen in by.items():
        top, want = 0.0, []
        for ts, pct in sorted(seen):
            if pct > top:
                top = pct
                want.append((ts, pct))
        assert sorted(steps.get(k, [])) == want


def test_snapshots_are_hashed_to_their_digest(spark, rnd):
    """As by one pass over the rows, with ties of reset and instant and with null plans; no snapshot is sorted on the way."""
    from tidemeter.model import SNAPSHOT
    plans = [None, "", "basic", "plus"]
    rows = [(hot_key(rnd), "timed", "all", "five_hour", rnd.choice([None, 1, 2, 3]), rnd.choice([None, 1.0, 2.0]), rnd.choice([None, 5, 6, 1000 * SEC]),
             rnd.choice([None, 100, 200]), rnd.choice(plans), "t") for _ in range(400)]
    df = spark.createDataFrame(rows, SNAPSHOT)
    p = Params(now=10**15)
    got = W.snapshot_digest(df, p)
    known = [r for r in df.collect() if r.resets_at is not None and r.window_seconds is not None]
    want = {}
    for r in known:
        want.setdefault((r.account_id, r.resets_at // p.reset_jitter, r.used_percent), []).append(r)
    found = {(r.account_id, r.reset_bucket, r.used_percent): r for r in got.collect()}
    assert found.keys() == want.keys()
    for k, of in want.items():
        r, seen, named = found[k], [x.ts for x in of if x.ts is not None], [x for x in of if x.plan_type]
        assert (r.reset_min, r.reset_max, r.snapshots) == (min(x.resets_at for x in of), max(x.resets_at for x in of), len(of))
        assert (r.ts_min, r.ts_max) == (min(seen, default=None), max(seen, default=None))
        assert (r.last_plan and tuple(r.last_plan)) == (max(((x.ts, x.plan_type) for x in named), key=lambda y: (y[0] is not None, y[0] or 0, y[1])) if named else None)
        assert tuple(r.first_reset) == min((x.resets_at, x.window_seconds) for x in of)
    assert "HashAggregate" in got._jdf.queryExecution().executedPlan().toString()


def test_share_readings_are_kept_once(spark):
    """One reading per instant, the first by its content; the runs read what was kept."""
    from tidemeter.operators.evidence import compact_breakdowns
    rows = lambda pct: [("chat", "chat", pct)]
    readings = spark.createDataFrame(
        [(1, "timed", "seven_day", t, 0, rows(pct), []) for t, pct in ((1, 5.0), (1, 4.0), (2, 4.0), (3, 6.0), (4, 6.0), (9, 4.0))],
        "account_id long, tool string, window string, as_of long, window_start long, rows array<struct<key string, display_name string, percent double>>, issues array<string>")
    kept = []
    got = compact_breakdowns(readings, Params(now=10**15), keep=lambda df: kept.append(df.count()) or df)
    assert kept == [5]
    assert sorted((r.as_of, r.last_as_of, r.rows[0].percent) for r in got.collect()) == [(1, 2, 4.0), (3, 4, 6.0), (9, 9, 4.0)]


def test_linked_requests_are_made_once(spark, rnd):
    """Near their window or far from it, they find the segment that holds their reset and instant, in one join."""
    p, hour = Params(now=10**15), 3600 * SEC
    segs = []
    for a in range(3):
        for c in range(4):
            reset = (a + 5 * c + 5) * hour
            edge = reset - 2 * hour
            segs += [(a, "linked", "codex", "five_hour", reset, reset + SEC, 1, -(1 << 62), edge), (a, "linked", "codex", "five_hour", reset, reset + SEC, -1, edge, 1 << 62)]
    requests = [(f"e{i}", rnd.randrange(3), "linked", "codex", "five_hour", rnd.choice([None, rnd.randrange(-40 * hour, 60 * hour)]),
                 (rnd.randrange(3) + 5 * rnd.randrange(4) + 5) * hour + rnd.randrange(3) * SEC) for i in range(500)]
    s = spark.createDataFrame(segs, "account_id long, tool string, scope string, window string, reset_min long, reset_max long, step_no int, lo long, hi long")
    r = spark.createDataFrame(requests, "id string, account_id long, tool string, scope string, window string, ts long, resets_at long")
    joined = W._linked_to_segments(r, s, p)
    assert joined._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    got = sorted((x.id, x.reset_min, x.step_no) for x in joined.collect())
    assert got == sorted((i, g[4], g[6]) for i, a, *_, ts, at in requests for g in segs
                         if a == g[0] and ts is not None and g[4] - p.link_slack <= at <= g[5] + p.link_slack and g[7] <= ts < g[8])
    assert len(got) > 50


def test_rates_from_sums_of_products():
    """Where no coefficient is negative it is least squares; otherwise the most negative leaves and the rest is solved again."""
    import numpy as np

    from tidemeter.operators.rates import _nonnegative

    def plain(a, b, names):
        free = np.linalg.lstsq(a[:, names], b, rcond=None)[0] if names else np.zeros(0)
        if (free >= 0).all():
            out = np.zeros(a.shape[1])
            out[names] = free
            return out
        return plain(a, b, [n for n in names if n != names[int(np.argmin(free))]])

    r = np.random.default_rng(11)
    for _ in range(60):
        a, b = r.normal(0.4, 0.6, (9, 3)), r.random(9)
        assert np.allclose(_nonnegative(a.T @ a, a.T @ b), plain(a, b, [0, 1, 2]), atol=1e-8)


def test_checkpoint_dir_of_the_session_is_used(spark, tmp_path):
    from tidemeter.session import checkpoint_dir, cut
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    df = cut(spark.range(5))
    assert df.count() == 5 and df.inputFiles()[0].startswith("file:") and not df.isStreaming
