"""Data model: keys, schemas, fixed values and job parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SEC = 1_000_000
HOUR = 3_600 * SEC
DAY = 86_400 * SEC

# One metered limit of one account, one reset cycle of it, and the analysis group of cycles.
LIMIT = ["account_id", "tool", "scope", "window"]
CYCLE = [*LIMIT, "reset_min"]
GROUP = [*LIMIT, "plan_key"]

# Window lengths with a proper name.
WINDOW_SECONDS = {"five_hour": 18_000, "seven_day": 604_800, "thirty_day": 2_592_000}

# Model-name prefixes that consume the subscription, per tool.
PLAN_PREFIXES = {"timed": ["claude-"], "linked": ["gpt-", "codex-", "o1", "o3", "o4"]}

# Fixed values: (tool, scope) -> case-insensitive pattern of the models the limit counts.
SCOPE_PATTERNS = [
    ("timed", "all", None),
    ("timed", "opus", "%opus%"),
    ("timed", "sonnet", "%sonnet%"),
    ("timed", "fable", "%fable%"),
    ("linked", "codex", None),
]

# Usage sources in the weekly share table.
COLLECTED_SOURCES = ["claude_code"]
KNOWN_SOURCES = ["chat", "cowork"]

# Keys removed from archived responses.
IDENTITY_KEYS = ["email", "user_id", "account_id"]

# Window quality, worst first.
QUALITY = ["incomplete", "source_unknown", "aligning", "waiting", "unconfirmed", "conditional"]

# Reasons that stop an estimate.
ESTIMATE_BLOCKERS = ["breakdown_invalid", "breakdown_stale", "collect_gap", "suspect_unrecorded", "aligning"]

ANALYSIS_VERSION = 4
OTHER_KEY = "(other)"


@dataclass(frozen=True)
class Params:
    """Thresholds of the analysis; spans in microseconds, percents in points."""

    now: int
    since: int = 0
    min_change: float = 0.20
    model_overlap: float = 0.5

    reset_jitter: int = 900 * SEC
    link_slack: int = SEC
    analysis_span: int = 60 * DAY
    min_fit_pct: float = 5
    min_trend_pct: float = 10
    min_model_windows: int = 2

    external_min_step: float = 3
    external_factor: float = 3
    external_slack: float = 2
    idle_min_step: float = 2
    contaminated_share: float = 0.15
    align_span: int = 600 * SEC

    source_share_limit: float = 5.0
    breakdown_stale: int = 7200 * SEC
    shared_model_share: float = 0.10
    change_z: float = 2.5
    default_spread: float = 0.20

    short_window_seconds: int = 6 * 3600
    short_recent: int = 72 * HOUR
    short_baseline: int = 21 * DAY
    short_min_recent: int = 3
    short_min_baseline: int = 5
    short_fallback: int = 10
    long_baseline: int = 42 * DAY
    long_baseline_n: int = 4
    long_min_recent: int = 1
    long_min_baseline: int = 2
    long_fallback: int = 4
    anchor_extra: int = 4

    estimate_min_code: float = 20
    estimate_min_code_low: float = 10
    split_max_gap: int = 1800 * SEC
    split_min_weekly: float = 3
    split_start_pct: float = 5
    poll_pair: int = 10 * SEC
    split_tail: int = 60 * SEC
    estimate_conflict: float = 3

    @classmethod
    def from_settings(cls, now: int, *, min_change_pct: float = 20, model_overlap_pct: float = 50,
                      analysis_since: int = 0) -> "Params":
        """User settings, clamped to their allowed ranges."""
        return cls(
            now=now,
            since=min(4_102_444_800 * SEC, max(0, analysis_since)),
            min_change=min(60, max(5, min_change_pct)) / 100,
            model_overlap=min(90, max(10, model_overlap_pct)) / 100,
        )


def clamp_history_days(days: int) -> int:
    """Import horizon setting, clamped to its allowed range."""
    return min(3650, max(7, int(days)))


_L, _S, _D, _B, _I = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


USAGE = _struct(
    id=_S, account_id=_L, tool=_S, ts=_L, model=_S, on_plan=_B, session_id=_S,
    input_tokens=_L, cache_read_tokens=_L, cache_write_5m_tokens=_L, cache_write_1h_tokens=_L,
    output_tokens=_L, reasoning_tokens=_L, speed=_S, cost_pico=_L,
)
SNAPSHOT = _struct(
    account_id=_L, tool=_S, scope=_S, window=_S, ts=_L, used_percent=_D, resets_at=_L,
    window_seconds=_L, plan_type=_S, source=_S,
)
LINK = _struct(usage_id=_S, account_id=_L, tool=_S, scope=_S, window=_S, resets_at=_L)
SHARE_ROW = _struct(key=_S, display_name=_S, percent=_D)
BREAKDOWN = _struct(
    account_id=_L, tool=_S, window=_S, as_of=_L, last_as_of=_L, window_start=_L,
    rows=T.ArrayType(SHARE_ROW), issues=T.ArrayType(_S),
)
CLAIM = _struct(account_id=_L, tool=_S, login=_S, start=_L, end=_L)
LOGIN = _struct(account_id=_L, tool=_S, ts=_L, login=_S)
GAP = _struct(account_id=_L, tool=_S, start=_L, end=_L, kind=_S, detail=_S)
RULE = _struct(account_id=_L, tool=_S, kind=_S, target=_S, mode=_S, until=_L)
SHAPE = _struct(account_id=_L, tool=_S, source=_S, fingerprint=_S, shape=T.ArrayType(_S), first_ts=_L, last_ts=_L)
ARCHIVE = _struct(account_id=_L, tool=_S, first_ts=_L, last_ts=_L, body=_S)
RESPONSE = _struct(account_id=_L, tool=_S, ts=_L, plan_type=_S, body=_S)
ALERT = _struct(account_id=_L, tool=_S, window=_S, direction=_S, ts=_L, ratio=_D, detail=_S, analysis_version=_I)

PRICE_FIELDS = ["input", "output", "cache_read", "cache_write", "cache_write_1h"]
_RATES = [T.StructField(n, _L) for n in PRICE_FIELDS]
TIER = T.StructType([T.StructField("size", _L), *_RATES])
# Prices are micro-dollars per million tokens, so tokens * price is pico-dollars.
PRICE = T.StructType([
    T.StructField("model", _S), *_RATES,
    T.StructField("tiers", T.ArrayType(TIER)), T.StructField("fast", T.StructType(_RATES)),
    T.StructField("source", _S), T.StructField("alias_of", _S),
])
