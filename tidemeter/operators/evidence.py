"""What is known about where a window's usage came from: source shares, gaps, logins, coverage claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.model import COLLECTED_SOURCES, CYCLE, DAY, KNOWN_SOURCES, QUALITY, SEC, Params
from tidemeter.operators.dedup import first_wins
from tidemeter.operators.temporal import equal_runs, interval_join, overlap_join
from tidemeter.operators.windows import percent_at

_FAR = 1 << 62


# -- source shares --------------------------------------------------------------------------------

def compact_breakdowns(readings: DataFrame, p: Params, keep=lambda df: df) -> DataFrame:
    """Runs of equal share tables of the same week become one row with ``[as_of, last_as_of]``.

    ``keep`` may cut the lineage of the readings, one per instant, which the runs read more than once.
    """
    keys = ["account_id", "tool", "window"]
    packed = keep(first_wins(readings.withColumn("rows", F.array_sort("rows")), [*keys, "as_of"],
                             ["ts"] if "ts" in readings.columns else [F.to_json(F.struct("window_start", "rows", "issues"))]))
    same_week = F.col("window_start").eqNullSafe(F.col("prev.window_start")) | (
        F.abs(F.col("window_start") - F.col("prev.window_start")) <= p.reset_jitter)
    run = equal_runs(packed, keys, "as_of", same_week & (F.col("rows") == F.col("prev.rows")), span=7 * DAY)
    return run.groupBy(*keys, "run").agg(
        F.min("as_of").alias("as_of"), F.max("as_of").alias("last_as_of"),
        F.min_by(F.struct("window_start", "rows", "issues"), "as_of").alias("head")).select(
        *keys, "as_of", "last_as_of", "head.*")


def source_shares(breakdowns: DataFrame) -> DataFrame:
    """Shares of collected / known / unknown sources, their rounding bounds, and validity.

    A total clearly above 100 makes the table invalid; a clearly missing part counts as unknown.
    """
    rows = F.col("rows")
    bad = lambda r: r["percent"].isNull() | r["key"].startswith("_")
    kept = F.filter(rows, lambda r: ~bad(r))
    of_code = F.filter(kept, lambda r: r["key"].isin(COLLECTED_SOURCES))
    of_known = F.filter(kept, lambda r: r["key"].isin(KNOWN_SOURCES))
    of_other = F.filter(kept, lambda r: ~r["key"].isin(COLLECTED_SOURCES + KNOWN_SOURCES))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, r: acc + r["percent"])
    names = lambda a: F.transform(F.filter(a, lambda r: r["percent"] > 0),
                                  lambda r: F.coalesce(F.when(r["display_name"] != "", r["display_name"]), r["key"]))
    slack = F.size(rows) * 0.5
    s = (breakdowns.withColumn("code", total(of_code)).withColumn("known", total(of_known))
         .withColumn("unknown_seen", total(of_other))
         .withColumn("n_known", F.size(of_known)).withColumn("n_unknown", F.size(of_other))
         .withColumn("known_names", names(of_known)).withColumn("unknown_names", names(of_other)))
    seen = F.col("code") + F.col("known") + F.col("unknown_seen")
    broken = F.arrays_overlap(F.coalesce("issues", F.array().cast("array<string>")),
                              F.array(F.lit("not_object"), F.lit("rows_missing"), F.lit("bad_row")))
    s = s.withColumn("invalid", broken | F.exists(rows, bad) | (seen - slack > 100))
    missing = 100 - seen - slack
    s = s.withColumn("unknown", F.when((missing > 0) & ~F.col("invalid"), F.col("unknown_seen") + missing)
                     .otherwise(F.col("unknown_seen")))
    return (s.withColumn("known_hi", F.col("known") + 0.5 * F.col("n_known"))
            .withColumn("unknown_hi", F.col("unknown") + 0.5 * F.col("n_unknown"))
            .withColumn("noncode", F.col("known") + F.col("unknown"))
            .withColumn("noncode_err", 0.5 * (F.col("n_known") + F.col("n_unknown")))
            .drop("unknown_seen", "n_known", "n_unknown"))


_SHARE_COLS = ["as_of", "last_as_of", "rows", "code", "known", "unknown", "invalid", "known_hi", "unknown_hi",
               "noncode", "noncode_err", "known_names", "unknown_names"]


def week_breakdowns(weeks: DataFrame, shares: DataFrame, p: Params) -> DataFrame:
    """Share tables matched to weekly cycles: read inside the week, and of a week that starts with it."""
    spans = (weeks.where(F.col("window") == "seven_day")
             .select(*CYCLE, F.col("start").alias("week_start"), F.col("last_seen").alias("week_seen"),
                     (F.col("start") - p.reset_jitter).alias("__lo"), (F.col("end") + p.reset_jitter).alias("__hi")))
    reads = shares.where(F.col("window") == "seven_day").drop("window", "issues")
    hit = interval_join(reads, spans, ["account_id", "tool"], "as_of", "__lo", "__hi", closed=True)
    near = F.col("window_start").isNull() | (F.abs(F.col("window_start") - F.col("week_start")) <= p.reset_jitter)
    return hit.where(near).drop("__lo", "__hi", "window_start")


def latest_breakdown(matched: DataFrame, p: Params) -> DataFrame:
    """Per weekly cycle the newest share table not clearly after its last snapshot."""
    return (matched.where(F.col("as_of") <= F.col("week_seen") + p.reset_jitter)
            .groupBy(*CYCLE).agg(F.max_by(F.struct(*_SHARE_COLS), "as_of").alias("b")))


def _noncode(matched: DataFrame) -> DataFrame:
    return (matched.withColumn("pp", F.col("noncode") / 100 * F.col("pct"))
            .withColumn("err", F.col("noncode_err") / 100 * F.col("pct") + 0.5 * F.col("noncode") / 100))


def noncode_intervals(matched: DataFrame, windows: DataFrame, step_rows: DataFrame) -> DataFrame:
    """Spans between share readings of a week, classed by the change of non-code points.

    ``kind``: flagged (a clear rise), ambiguous (within rounding) or quiet.  A span is missing where a
    reading could not be used: neither the span before nor the one after it is located.
    """
    whole = matched.where(F.col("scope") == "all")
    moments = whole.select(*CYCLE, "week_start", "as_of", "invalid", "noncode", "noncode_err",
                           F.explode(F.array("as_of", "last_as_of")).alias("t"))
    w = Window.partitionBy(*CYCLE).orderBy("as_of", "t")
    passed = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (moments.withColumn("__passed", F.greatest(F.col("week_start"), passed))
             .where(F.col("t") > F.col("__passed")).drop("__passed"))
    at = _noncode(percent_at(fresh, windows, step_rows))
    usable = F.col("pct").isNotNull() & ~F.col("invalid")
    at = at.withColumn("point", F.when(usable, F.struct("pp", "err")))
    by_time = Window.partitionBy(*CYCLE).orderBy("t")
    prev = F.lag(F.struct("t", "point")).over(by_time)
    seed = F.struct(F.col("week_start").alias("t"), F.struct(F.lit(0.0).alias("pp"), F.lit(0.0).alias("err")).alias("point"))
    pairs = at.withColumn("prev", F.coalesce(prev, seed)).where(F.col("point").isNotNull() & F.col("prev.point").isNotNull())
    rise = F.col("pp") - F.col("prev.point.pp")
    return pairs.select(
        *CYCLE, F.col("prev.t").alias("span_start"), F.col("t").alias("span_end"),
        F.when(rise > F.col("prev.point.err") + F.col("err"), "flagged").when(rise > 1e-9, "ambiguous")
        .otherwise("quiet").alias("kind"))


def noncode_in_windows(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """Per window: does it overlap a flagged / ambiguous span, and do located spans cover all of it."""
    own = windows.select(*CYCLE, "start", "until")
    reach = spans.select("account_id", "tool", "span_start", "span_end", "kind").distinct()
    hits = overlap_join(own.withColumn("until_1", F.col("until") + 1).withColumn("start_1", F.col("start") - 1),
                        reach, ["account_id", "tool"], "start_1", "until_1", "span_start", "span_end")
    w = Window.partitionBy(*CYCLE).orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.max("span_end").over(w))
    real = (F.col("span_start") < F.col("until")) & (F.col("span_end") > F.col("start"))
    steps = (hits.withColumn("gap", F.col("span_start") > reached)
             .withColumn("solid", F.max("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    facts = steps.groupBy(*CYCLE).agg(
        F.max(real & (F.col("kind") == "flagged")).alias("flagged"),
        F.max(real & (F.col("kind") == "ambiguous")).alias("ambiguous"),
        F.max(F.when(~F.col("solid"), F.col("span_end"))).alias("covered_to"))
    return own.join(facts, CYCLE, "left").select(
        *CYCLE, F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
        (F.greatest("start", F.coalesce("covered_to", "start")) >= F.col("until")).alias("located"))


# -- collection gaps, logins, claims --------------------------------------------------------------

def gap_kinds(windows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Kinds of collection gaps that overlap each window."""
    spans = gaps.select("account_id", "tool", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), "kind").distinct()
    hit = overlap_join(windows.select(*CYCLE, "start", "until"), spans, ["account_id", "tool"],
                       "start", "until", "gap_start", "gap_end")
    return hit.groupBy(*CYCLE).agg(F.array_sort(F.collect_set("kind")).alias("gap_kinds"))


def login_changes(seen: DataFrame) -> DataFrame:
    """Only the moments at which the observed login differs from the one before."""
    known = seen.where(F.col("login").isNotNull() & (F.col("login") != ""))
    known = known.groupBy("account_id", "tool", "ts").agg(F.min("login").alias("login"))  # of several at one instant the first by name
    run = equal_runs(known, ["account_id", "tool"], "ts",
                     F.col("login") == F.col("prev.login"))
    return run.groupBy("account_id", "tool", "run").agg(
        F.min("ts").alias("ts"), F.first("login").alias("login")).drop("run")


def _horizon(windows: DataFrame, at: str) -> DataFrame:
    """The latest such moment of any window, for each account and tool."""
    return windows.groupBy("account_id", "tool").agg(F.max(at).alias("horizon"))


def window_logins(windows: DataFrame, logins: DataFrame, p: Params) -> DataFrame:
    """Logins active in each window: those seen inside it and the last one seen before it."""
    w = Window.partitionBy("account_id", "tool").orderBy("ts")
    spans = (logins.join(_horizon(windows, "last_seen"), ["account_id", "tool"], "left").select(
        "account_id", "tool", "login", F.col("ts").alias("seen_from"),
        (F.coalesce(F.lead("ts").over(w), F.greatest("ts", "horizon", F.lit(p.now))) + 1).alias("seen_to")))
    own = windows.select(*CYCLE, "start", (F.col("last_seen") + 1).alias("seen_end"))
    hit = overlap_join(own, spans, ["account_id", "tool"], "start", "seen_end", "seen_from", "seen_to")
    return hit.groupBy(*CYCLE).agg(F.count_distinct("login").alias("login_n"), F.min("login").alias("login"))


def claim_check(windows: DataFrame, claims: DataFrame, logins: DataFrame, p: Params) -> DataFrame:
    """Per window: ``claimed``, and otherwise the reason no coverage claim applies."""
    open_end = F.coalesce("end", F.lit(_FAR))
    per_tool = claims.groupBy("account_id", "tool").agg(F.min("start").alias("first_claim"))
    per_login = claims.groupBy("account_id", "tool", "login").agg(F.max(open_end).alias("claimed_to"))
    w = Window.partitionBy("account_id", "tool", "login").orderBy("start")
    reach = (claims.groupBy("account_id", "tool", "login", "start").agg(F.max(open_end).alias("to"))
             .select("account_id", "tool", "login", F.col("start").alias("claim_lo"),
                     F.lead("start").over(w).alias("claim_next"),
                     F.max("to").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("reach")))
    # No window of the account starts after the horizon, so it can close the last span.
    reach = (reach.join(_horizon(windows, "start"), ["account_id", "tool"], "left")
             .withColumn("claim_hi", F.coalesce("claim_next", F.greatest("claim_lo", "horizon", F.lit(p.now)) + 1)).drop("claim_next", "horizon"))
    own = (windows.select(*CYCLE, "start", "until").join(window_logins(windows, logins, p), CYCLE, "left")
           .join(per_tool, ["account_id", "tool"], "left").join(per_login, ["account_id", "tool", "login"], "left"))
    in_force = interval_join(own.where(F.col("login_n") == 1).select(*CYCLE, "login", "start"), reach,
                             ["account_id", "tool", "login"], "start", "claim_lo", "claim_hi").select(*CYCLE, "reach")
    own = own.join(in_force, CYCLE, "left")
    why = (F.when(F.col("first_claim").isNull(), "no_claim")
           .when(F.col("first_claim") > F.col("start"), "claim_after_start")
           .when(F.col("login_n") > 1, "account_changed")
           .when(F.col("login").isNull(), "account_unknown")
           .when(F.col("claimed_to").isNull(), "claim_other_account")
           .when(F.col("reach") >= F.col("until"), F.lit(None))
           .when(F.col("claimed_to") >= F.col("until"), "claim_after_start").otherwise("claim_ended"))
    return own.select(*CYCLE, why.alias("claim_why"), why.isNull().alias("claimed"))


def claim_spans(switches: DataFrame) -> DataFrame:
    """Coverage claims from on/off switches (account_id, tool, ts, login, on).

    Switching on opens a claim for the login unless that one is open already; it ends the claim of any
    other login.  Switching off ends whatever is open.
    """
    w = Window.partitionBy("account_id", "tool").orderBy("ts")
    state = F.struct(F.col("on"), F.when(F.col("on"), F.col("login")).alias("login"))
    marked = switches.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    turns = marked.where(~F.col("state").eqNullSafe(F.col("before")))
    return (turns.withColumn("end", F.lead("ts").over(w)).where("on")
            .select("account_id", "tool", "login", F.col("ts").alias("start"), "end"))


def _with_current(logins: DataFrame, claims: DataFrame, how: str) -> DataFrame:
    current = logins.groupBy("account_id", "tool").agg(F.max_by("login", "ts").alias("current"))
    return claims.join(current, ["account_id", "tool"], how)


def coverage_status(logins: DataFrame, claims: DataFrame) -> DataFrame:
    """Per account and tool: is the login known, and does an open claim cover it or another login."""
    open_claim = F.col("end").isNull() & F.col("start").isNotNull()
    both = _with_current(logins, claims, "full").groupBy("account_id", "tool").agg(
        F.max(F.col("current").isNotNull()).alias("account_known"),
        F.min(F.when(open_claim, F.struct("start", "login", "current"))).alias("open"), F.count("start").alias("claims"))
    own = F.col("open.login").eqNullSafe(F.col("open.current"))
    return both.select("account_id", "tool", "account_known", (F.col("open").isNotNull() & own).alias("on"),
                       (F.col("open").isNotNull() & ~own).alias("other_account"), F.col("open.start").alias("since"), "claims")


def claim_history(logins: DataFrame, claims: DataFrame) -> DataFrame:
    """Every claim, marked if it belongs to the current login."""
    return _with_current(logins, claims, "left").select(
        "account_id", "tool", "start", "end", F.col("login").eqNullSafe(F.col("current")).alias("current_account"))


# -- quality --------------------------------------------------------------------------------------

def gather(windows: DataFrame, step_rows: DataFrame, breakdowns: DataFrame, gaps: DataFrame, logins: DataFrame,
           claims: DataFrame, p: Params, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(evidence per window that no rate fit changes, share tables matched to weeks)."""
    w = windows.withColumn("until", F.least("end", "last_seen"))
    timed = w.where(F.col("tool") == "timed")
    matched = keep(week_breakdowns(timed, source_shares(breakdowns.where(F.col("tool") == "timed")), p))
    spans = noncode_intervals(matched, windows, step_rows)
    short = noncode_in_windows(timed.where(F.col("window") == "five_hour"), spans)
    out = (w.select(*CYCLE, "until").join(gap_kinds(w, gaps), CYCLE, "left")
           .join(latest_breakdown(matched, p), CYCLE, "left").join(short, CYCLE, "left")
           .join(claim_check(w, claims, logins, p), CYCLE, "left"))
    return out, matched


def _reason(code: str, level: str, when: Column, **detail: Column) -> Column:
    none = {"kinds": "array<string>", "as_of": "bigint", "share": "double", "names": "array<string>", "pct": "double"}
    fields = [detail.get(n, F.lit(None)).cast(t).alias(n) for n, t in none.items()]
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(QUALITY.index(level)).alias("level"), *fields))


def assess(windows: DataFrame, p: Params) -> DataFrame:
    """Quality state and ordered reasons of windows that carry evidence and external-rise columns; worst level wins."""
    timed, week = F.col("tool") == "timed", F.col("window") == "seven_day"
    weekly, b = timed & week, F.col("b")
    limit = p.source_share_limit
    has = weekly & b.isNotNull()
    short = timed & (F.col("window") == "five_hour")
    cover = F.coalesce("located", F.lit(False))
    blur = F.coalesce("ambiguous", F.lit(False)) | ~cover
    flagged = F.coalesce("flagged", F.lit(False))
    fresh_jump = F.col("active") & F.col("late_external")
    waiting = (F.col("used_percent") < p.min_fit_pct) | (F.col("cost_at_snapshot") <= 0)
    mixed = (b["known_hi"] < limit) & (b["unknown_hi"] < limit) & (b["known_hi"] + b["unknown_hi"] >= limit)
    found = F.array_compact(F.array(
        _reason("collect_gap", "incomplete", F.col("gap_kinds").isNotNull(), kinds=F.col("gap_kinds")),
        _reason("no_breakdown", "unconfirmed", weekly & b.isNull()),
        _reason("breakdown_stale", "unconfirmed", has & (F.col("last_seen") - b["last_as_of"] > p.breakdown_stale),
                as_of=b["last_as_of"]),
        _reason("breakdown_invalid", "source_unknown", has & b["invalid"] & (F.col("used_percent") >= 1)),
        _reason("unknown_sources", "source_unknown", has & (b["unknown_hi"] >= limit), share=b["unknown"], names=b["unknown_names"]),
        _reason("uncollected_sources", "incomplete", has & (b["known_hi"] >= limit), share=b["known"], names=b["known_names"]),
        _reason("uncollected_sources", "incomplete", has & mixed, share=b["noncode"],
                names=F.concat(b["known_names"], b["unknown_names"])),
        _reason("noncode_in_window", "incomplete", short & flagged),
        _reason("noncode_unlocated", "unconfirmed", short & ~flagged & blur),
        _reason("aligning", "aligning", F.col("contaminated") & fresh_jump),
        _reason("suspect_unrecorded", "unconfirmed", F.col("contaminated") & ~fresh_jump, pct=F.col("external_pct")),
        _reason("waiting", "waiting", waiting)))
    worst = lambda a: F.coalesce(F.array_min(F.transform(a, lambda r: r["level"])), F.lit(len(QUALITY) - 1))
    out = windows.withColumn("__found", found)
    # Added last: the claim reason, or a note that a claim contradicts the evidence (which lowers nothing).
    unclaimed = F.struct(F.col("claim_why").alias("code"), F.lit(QUALITY.index("unconfirmed")).alias("level"),
                         *[F.lit(None).cast(t).alias(n) for n, t in (("kinds", "array<string>"), ("as_of", "bigint"),
                           ("share", "double"), ("names", "array<string>"), ("pct", "double"))])
    conflict = _reason("claim_conflict", "conditional", worst(F.col("__found")) <= QUALITY.index("source_unknown"))
    out = out.withColumn("__all", F.array_compact(F.concat("__found", F.array(
        F.when(F.col("claimed"), conflict).otherwise(unclaimed)))))
    names = F.array(*[F.lit(q) for q in QUALITY])
    ok = F.col("supported")
    return (out.withColumn("quality", F.when(ok, F.element_at(names, worst(F.col("__all")) + 1)))
            .withColumn("reasons", F.when(ok, F.col("__all")))
            .withColumn("claimed", ok & F.col("claimed"))
            .withColumn("bias_pct", F.when(ok & has & (b["noncode"] > 0), b["noncode"]))
            .drop("__found", "__all"))
