"""Column expressions shared by the operators.  Local-time ones expect a session time zone of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemeter.model import DAY, PLAN_PREFIXES, SCOPE_PATTERNS, SEC, WINDOW_SECONDS


def usd(pico: Column | str) -> Column:
    """Pico-dollars (BIGINT or exact DECIMAL sum) as dollars."""
    c = F.col(pico) if isinstance(pico, str) else pico
    return c.cast("double") / F.lit(1e12)


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum of a BIGINT that cannot overflow on a hot key."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(20,0)"))


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text to epoch microseconds; no zone means UTC, bad text gives NULL.

    Fractions longer than six digits are cut.  The text must carry a zone before the cast, so the
    result does not depend on the session zone.
    """
    c = F.col(text) if isinstance(text, str) else text
    s = F.regexp_replace(F.trim(c), "Z", "+00:00")
    s = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    zoned = F.when(s.rlike(r"[+-]\d{2}:?\d{2}(:\d{2})?$") & s.rlike(r"\d[T ]\d"), s) \
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00+00:00"))) \
        .otherwise(F.concat(s, F.lit("+00:00")))
    shaped = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"), zoned)
    # A bare hour is not a timestamp literal for the cast: complete it.
    full = F.regexp_replace(shaped, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})([+-])", "$1:00$2")
    # The usual form casts as it is; only the others need reshaping.
    usual = c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$")
    return F.unix_micros(F.when(usual, c.try_cast("timestamp")).otherwise(full.try_cast("timestamp")))


def epoch_us(seconds: Column | str) -> Column:
    """Epoch seconds (fractional allowed) to microseconds."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(c.cast("double") * SEC).cast("bigint")


def window_name(seconds: Column | str) -> Column:
    """Proper name of a window length, else whole days or hours."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    hours = F.floor(s / 3600).cast("bigint")
    out = F.when(hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("_day"))) \
        .otherwise(F.concat(hours.cast("string"), F.lit("_hour")))
    for name, n in WINDOW_SECONDS.items():
        out = F.when(s == n, F.lit(name)).otherwise(out)
    return out


def window_seconds(name: Column | str) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    out = F.lit(None).cast("bigint")
    for k, v in WINDOW_SECONDS.items():
        out = F.when(n == k, F.lit(v).cast("bigint")).otherwise(out)
    return out


def base_name(model: Column | str) -> Column:
    """Model name as prices are keyed: lower case, without context mark, provider path, variant or spaces."""
    c = F.col(model) if isinstance(model, str) else model
    m = F.regexp_replace(F.lower(F.trim(c)), r"\[1m\]", "")
    m = F.element_at(F.split(m, "/"), -1)
    m = F.replace(F.element_at(F.split(m, ":"), 1), F.lit("@"), F.lit("-"))
    # Most names are in that form already and skip the work.
    return F.when(c.rlike("^[a-z0-9._-]+$"), c).otherwise(m)


def undated(name: Column) -> Column:
    return F.regexp_replace(name, r"-(\d{8}|\d{4}-\d{2}-\d{2})$", "")


def without_effort(name: Column) -> Column:
    return F.regexp_replace(name, r"-(minimal|low|medium|high|xhigh|max)$", "")


def lookup_candidates(model: Column | str) -> Column:
    """Normalised names to look a price up by, exact first; repeats are kept in place."""
    m = base_name(model)
    return F.array(m, undated(m), without_effort(undated(m)))


def is_on_plan(tool: Column | str, model: Column | str, prefixes: dict[str, list[str]] = PLAN_PREFIXES) -> Column:
    """Whether a request of ``model`` consumes the subscription of ``tool``."""
    t = F.col(tool) if isinstance(tool, str) else tool
    m = F.lower(F.trim(F.col(model) if isinstance(model, str) else model))
    hit = F.lit(False)
    for name, heads in prefixes.items():
        any_head = F.lit(False)
        for head in heads:
            any_head = any_head | m.startswith(head)
        hit = hit | ((t == name) & any_head)
    return ~m.contains("/") & hit


def scope_supported(tool: Column | str, scope: Column | str) -> Column:
    t = F.col(tool) if isinstance(tool, str) else tool
    s = F.col(scope) if isinstance(scope, str) else scope
    hit = F.lit(False)
    for name, sc, _ in SCOPE_PATTERNS:
        hit = hit | ((t == name) & (s == sc))
    return hit


def in_scope(tool: Column | str, scope: Column | str, model: Column | str) -> Column:
    """Whether the limit ``scope`` of ``tool`` counts requests of ``model`` (case-insensitive)."""
    t = F.col(tool) if isinstance(tool, str) else tool
    s = F.col(scope) if isinstance(scope, str) else scope
    m = F.col(model) if isinstance(model, str) else model
    hit = F.lit(False)
    for name, sc, pattern in SCOPE_PATTERNS:
        test = (t == name) & (s == sc)
        hit = hit | (test & m.ilike(pattern) if pattern else test)
    return hit


def fit_key(model: Column | str, priced: Column) -> Column:
    """Regressor of a request: dollars of the model if priced, else its million tokens."""
    m = F.col(model) if isinstance(model, str) else model
    return F.concat(F.when(priced, F.lit("usd:")).otherwise(F.lit("mtok:")), m)


def confidence(pct: Column | str) -> Column:
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.when(p >= 20, "high").when(p >= 5, "medium").otherwise("low")


def hit_rate(fresh: Column, read: Column, write: Column) -> Column:
    """Cache reads over prompt tokens; NULL for an empty prompt."""
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.try_divide(z(read), F.nullif(z(fresh) + z(read) + z(write), F.lit(0.0)))


def round_reset(us: Column | str) -> Column:
    """Reset instant rounded half-even to the minute, in epoch seconds."""
    c = F.col(us) if isinstance(us, str) else us
    return (F.bround(c / F.lit(60.0 * SEC)) * 60).cast("bigint")


def digest(salt: str, *parts: Column) -> Column:
    """Irreversible 16-hex identity digest."""
    text = [p.cast("string") for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), *text), 256), 1, 16)


def range_start(name: str, now: Column, zone: str = "UTC") -> Column:
    """Start of a report range in epoch micros: local midnight for today, else a span back from ``now``."""
    if name == "today":
        local = F.date_trunc("DAY", F.from_utc_timestamp(F.timestamp_micros(now), zone))
        return F.unix_micros(F.to_utc_timestamp(local, zone))
    days = {"7d": 7, "30d": 30}.get(name, 7)
    return now - F.lit(days * DAY)


def local_bucket(ts: Column | str, unit: str, zone: str = "UTC") -> Column:
    """Label of the local hour (``yyyy-MM-dd HH:00``) or local day of an instant."""
    c = F.col(ts) if isinstance(ts, str) else ts
    fmt = "yyyy-MM-dd HH:00" if unit == "hour" else "yyyy-MM-dd"
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(c), zone), fmt)

