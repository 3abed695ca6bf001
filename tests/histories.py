"""Metering histories written as cycles of spending and readings, and the tables they make.

A cycle is a list of moments; at each some models spend dollars and the quota shows a percent.  ``steady`` makes
cycles from a known price of one percent, so tests can work the expected capacity out instead of stating it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemeter import model as M
from tidemeter.model import SEC

TODAY = 512 * 86_400
HOUR, DAY = 3_600, 86_400
SPAN = {"five_hour": 5 * HOUR, "seven_day": 7 * DAY}


@dataclass
class Cycle:
    """``moments``: (seconds after the start, {model: dollars}, percent shown or None)."""

    start: float
    moments: list
    window: str = "five_hour"
    plan: str | None = "plus"
    reset: float | None = None

    @property
    def resets_at(self):
        return self.start + SPAN[self.window] if self.reset is None else self.reset


def steady(start, dollars: dict, percent_of: dict, parts=8, every=95, window="five_hour", plan="plus") -> Cycle:
    """Spending in equal parts; the percent follows ``percent_of`` (percent per dollar of each model)."""
    share = {m: d / parts for m, d in dollars.items()}
    step = sum(share[m] * percent_of[m] for m in share)
    return Cycle(start, [(every * (k + 1), share, step * (k + 1)) for k in range(parts)], window, plan)


@dataclass
class Account:
    """One account: its cycles and everything else that was seen.  All times are seconds before (negative) or after today."""

    cycles: list = field(default_factory=list)
    tool: str = "linked"
    claims: list = field(default_factory=lambda: [(-400 * DAY, None, "me")])
    logins: list = field(default_factory=lambda: [(-400 * DAY, "me")])
    shares: list = field(default_factory=list)  # (as of, seen until, week's start, {source: percent})
    gaps: list = field(default_factory=list)  # (from, to, kind)
    rules: list = field(default_factory=list)  # (kind, target, mode)
    others: list = field(default_factory=list)  # (at, model, dollars or None, on plan)


UNCLAIMED = {"claims": [], "logins": []}


def us(seconds):
    return None if seconds is None else round((TODAY + seconds) * SEC)


def target(scope, cycle: Cycle) -> str:
    """How a rule names a cycle."""
    return f"{scope}:{cycle.window}:{int(TODAY + cycle.resets_at)}"


def tables(spark, accounts: dict[str, Account]):
    """The analysis' inputs; account numbers follow the order of ``accounts``."""
    from tidemeter.plans.analysis import Inputs

    rows = {t: [] for t in ("usage", "links", "snapshots", "breakdowns", "claims", "logins", "gaps", "rules")}
    for number, a in enumerate(accounts.values(), 1):
        scope = "codex" if a.tool == "linked" else "all"
        spent = [(c.start + at, m, d, True, c) for c in a.cycles for at, by, _ in c.moments for m, d in by.items()]
        spent += [(at, m, d, on, None) for at, m, d, on in a.others]
        for k, (at, m, d, on, c) in enumerate(spent):
            name = f"r{number}/{k}"
            rows["usage"].append((name, number, a.tool, us(at), m, on, None, 0, 0, 0, 0, 0, 0, None, None if d is None else round(d * 10**12)))
            if c is not None and a.tool == "linked":
                rows["links"].append((name, number, a.tool, scope, c.window, us(c.resets_at)))
        rows["snapshots"] += [(number, a.tool, scope, c.window, us(c.start + at), float(p), us(c.resets_at), M.WINDOW_SECONDS[c.window], c.plan, "test")
                              for c in a.cycles for at, _, p in c.moments if p is not None]
        rows["breakdowns"] += [(number, a.tool, "seven_day", us(at), us(until), us(week), [(s, s, float(p)) for s, p in of.items()], [])
                               for at, until, week, of in a.shares]
        rows["claims"] += [(number, a.tool, who, us(x), us(y)) for x, y, who in a.claims]
        rows["logins"] += [(number, a.tool, us(x), who) for x, who in a.logins]
        rows["gaps"] += [(number, a.tool, us(x), us(y), kind, None) for x, y, kind in a.gaps]
        rows["rules"] += [(number, a.tool, kind, what, mode, None) for kind, what, mode in a.rules]
    kinds = {"usage": M.USAGE, "links": M.LINK, "snapshots": M.SNAPSHOT, "breakdowns": M.BREAKDOWN, "claims": M.CLAIM, "logins": M.LOGIN, "gaps": M.GAP,
             "rules": M.RULE}
    return Inputs(spark, **{t: spark.createDataFrame(r, kinds[t]) for t, r in rows.items()})
