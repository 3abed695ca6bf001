"""Building blocks of the oracle SQL: the same data and rules, written row by row for DuckDB."""

from __future__ import annotations

LIM = "account_id, tool, scope, win"
CYC = f"{LIM}, reset_min"

# name -> (names it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: str, sql: str) -> None:
    CTES[name] = (needs.split(), sql.strip())


def sql(final: str, *needs: str) -> str:
    """WITH clause of everything ``needs`` rests on, then ``final``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in CTES[n][0]:
                visit(d)
            order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {head}\n{final.strip()}" if order else final.strip()


_cte("ev0", "", r"""
SELECT event_id, user_id % 4 AS account_id, user_id, event_type, epoch_us(ts) AS us,
  CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN user_id % 2 = 0 THEN 'timed' ELSE 'linked' END AS tool,
  CASE WHEN user_id % 2 = 0 THEN 'all' ELSE 'codex' END AS scope, day(ts) AS day,
  CASE WHEN epoch_us(ts) >= 1705708800000000 THEN 7200000000 ELSE 0 END AS off
FROM events""")
_cte("ev", "ev0", """
SELECT *, us - (us - off) % 18000000000 AS start5, us - us % 604800000000 AS start7,
  us - (us - off) % 18000000000 + 18000000000 + event_id % 3 * 1000000 AS reset5,
  us - us % 604800000000 + 604800000000 + event_id % 3 * 1000000 AS reset7,
  CASE WHEN event_type = 'error' THEN 'vendor/error' WHEN tool = 'timed' THEN 'claude-' || event_type
       ELSE 'gpt-' || event_type END AS model,
  CASE WHEN day = 10 THEN NULL WHEN day < 16 THEN 'basic' ELSE 'plus' END AS plan
FROM ev0""")
_cte("usage", "ev", """
SELECT 'e' || event_id AS id, account_id, tool, us AS ts, model, event_type <> 'error' AS on_plan, user_id,
  k * 100 + 50 AS inp, cents AS rd, event_id % 7 * 10 AS w5, event_id % 5 * 10 AS w1, event_id % 11 * 20 + k AS outp,
  event_id % 3 AS reas, CASE WHEN event_id % 10 = 0 THEN 'fast' ELSE 'standard' END AS speed, event_id, day
FROM ev""")
_cte("price", "", """
SELECT h || '-' || kind AS model, p.* FROM (VALUES ('claude'), ('gpt')) hh(h), (VALUES
  ('click', 2000000, 10000000, 200000, NULL, NULL, 8000, 4000000, 15000000, NULL, NULL, NULL, NULL),
  ('view', 4000000, 20000000, 400000, 5000000, NULL, NULL, NULL, NULL, 8000000, 40000000, 800000, 10000000),
  ('purchase', 1000000, 5000000, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
  ('signup', 3000000, 15000000, 300000, 3750000, 6000000, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
) p(kind, p_in, p_out, p_rd, p_w5, p_w1, t_size, t_in, t_out, f_in, f_out, f_rd, f_w5)
WHERE NOT (h = 'gpt' AND kind = 'signup')""")
_cte("rated", "usage price", """
SELECT u.*, p.model AS price_key, p.p_rd, p.p_w5, p.p_w1, p.f_rd, p.f_w5, u.speed = 'fast' AND p.f_in IS NOT NULL AS is_fast,
  CASE WHEN u.speed = 'fast' AND p.f_in IS NOT NULL THEN p.f_in
       WHEN p.t_size IS NOT NULL AND inp + rd + w5 + w1 > p.t_size THEN p.t_in ELSE p.p_in END AS r_in,
  CASE WHEN u.speed = 'fast' AND p.f_in IS NOT NULL THEN p.f_out
       WHEN p.t_size IS NOT NULL AND inp + rd + w5 + w1 > p.t_size THEN p.t_out ELSE p.p_out END AS r_out
FROM usage u LEFT JOIN price p ON p.model = u.model""")
_cte("priced", "rated", """
SELECT * EXCLUDE (p_rd, p_w5, p_w1, f_rd, f_w5, is_fast, r_in, r_out),
  inp * r_in + rd * coalesce(CASE WHEN is_fast THEN f_rd ELSE p_rd END, r_in)
  + w5 * coalesce(CASE WHEN is_fast THEN f_w5 ELSE p_w5 END, r_in * 5 // 4) + w1 * coalesce(p_w1, r_in * 2)
  + outp * r_out AS pico
FROM rated""")
_cte("snap", "ev", """
SELECT account_id, tool, scope, 'five_hour' AS win, us AS ts, resets AS resets_at, CAST(18000 AS BIGINT) AS ws, plan,
  CAST(least(100, greatest(0, raw)) AS DOUBLE) AS pct
FROM (SELECT *, reset5 AS resets, (us - start5) * CASE WHEN account_id = 1 AND day >= 28 THEN 45 ELSE 30 END // 18000000000 + k % 3
      - CASE WHEN event_id % 13 = 0 THEN 6 ELSE 0 END AS raw FROM ev)
UNION ALL
SELECT account_id, tool, scope, 'seven_day', us, resets, CAST(604800 AS BIGINT), plan, CAST(least(100, greatest(0, raw)) AS DOUBLE)
FROM (SELECT *, reset7 AS resets, (us - start7) * 100 // 604800000000 + k % 7
      - CASE WHEN event_id % 13 = 0 THEN 6 ELSE 0 END AS raw FROM ev)""")
_cte("lnk", "ev", """
SELECT 'e' || event_id AS id, account_id, tool, scope, 'five_hour' AS win, reset5 AS resets_at FROM ev WHERE tool = 'linked'
UNION ALL SELECT 'e' || event_id, account_id, tool, scope, 'seven_day', reset7 FROM ev WHERE tool = 'linked'""")

# -- cycles, steps, attribution -------------------------------------------------------------------
_cte("snap_n", "snap", f"""
SELECT *, sum(new) OVER (PARTITION BY {LIM} ORDER BY resets_at, ts ROWS UNBOUNDED PRECEDING) AS sid FROM (
  SELECT *, CASE WHEN resets_at - lag(resets_at) OVER (PARTITION BY {LIM} ORDER BY resets_at, ts) <= 900000000 THEN 0 ELSE 1 END AS new
  FROM snap)""")
_cte("snap_c", "snap_n", f"SELECT *, min(resets_at) OVER (PARTITION BY {LIM}, sid) AS reset_min FROM snap_n")
_cte("cyc0", "snap_c", f"""
SELECT {CYC}, max(resets_at) AS reset_max, min(ts) AS first_seen, max(ts) AS last_seen, any_value(ws) AS ws,
  arg_max(plan, ts) FILTER (WHERE plan IS NOT NULL) AS plan_type, max(pct) AS peak, count(*) AS snapshots,
  reset_min - any_value(ws) * 1000000 AS s0
FROM snap_c GROUP BY {CYC}""")
_cte("cyc", "cyc0", f"""
SELECT *, coalesce(lag(cutp) OVER w, s0) AS s, coalesce(cutp, reset_max) AS e,
  scope || ':' || win || ':' || (reset_min // 1000000) AS key FROM (
  SELECT *, CASE WHEN tool = 'timed' AND lead(s0) OVER w < reset_max THEN greatest(lead(s0) OVER w, last_seen) END AS cutp
  FROM cyc0 WINDOW w AS (PARTITION BY {LIM} ORDER BY first_seen))
WINDOW w AS (PARTITION BY {LIM} ORDER BY first_seen)""")
_cte("points", "snap_c", f"""
SELECT {CYC}, ts, greatest(0, max(pct) OVER (PARTITION BY {CYC} ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS pct FROM snap_c""")
_cte("steps", "points", f"""
SELECT *, row_number() OVER (PARTITION BY {CYC} ORDER BY ts) AS step_no, lag(ts) OVER (PARTITION BY {CYC} ORDER BY ts) AS prev_ts FROM (
  SELECT *, pct - coalesce(lag(pct) OVER w, 0) AS dpct, row_number() OVER w = 1 AS unseg
  FROM points WINDOW w AS (PARTITION BY {CYC} ORDER BY ts)) WHERE dpct > 0""")
_cte("att0", "priced lnk cyc", """
SELECT c.account_id, c.tool, c.scope, c.win, c.reset_min, c.last_seen, u.id, u.ts, u.model, u.pico, u.inp + u.rd + u.outp AS tokens
FROM priced u JOIN cyc c ON c.account_id = u.account_id AND c.tool = u.tool AND u.ts >= c.s AND u.ts < c.e
WHERE u.on_plan AND c.tool = 'timed'
UNION ALL
SELECT c.account_id, c.tool, c.scope, c.win, c.reset_min, c.last_seen, u.id, u.ts, u.model, u.pico, u.inp + u.rd + u.outp
FROM priced u JOIN lnk l ON l.id = u.id JOIN cyc c ON c.account_id = l.account_id AND c.tool = l.tool AND c.scope = l.scope
  AND c.win = l.win AND l.resets_at BETWEEN c.reset_min - 1000000 AND c.reset_max + 1000000
WHERE u.on_plan AND c.tool = 'linked'""")
_cte("att", "att0 steps", """
SELECT a.*, coalesce(st.step_no, CASE WHEN a.ts <= a.last_seen THEN 0 ELSE -1 END) AS step_no,
  CASE WHEN pico IS NULL THEN 'mtok:' ELSE 'usd:' END || model AS rate_key
FROM att0 a ASOF LEFT JOIN steps st ON st.account_id = a.account_id AND st.tool = a.tool AND st.scope = a.scope
  AND st.win = a.win AND st.reset_min = a.reset_min AND st.ts >= a.ts""")
_cte("spend", "att", f"""
SELECT {CYC}, step_no, rate_key, sum(pico) AS pico, sum(tokens) FILTER (WHERE pico IS NULL) AS tokens,
  count(*) FILTER (WHERE pico IS NULL) AS unpriced,
  coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, CAST(sum(tokens) AS DOUBLE) / 1e6) AS val
FROM att GROUP BY {CYC}, step_no, rate_key""")
_cte("costs", "spend", f"""
SELECT {CYC}, coalesce(CAST(sum(pico) FILTER (WHERE step_no >= 0) AS DOUBLE) / 1e12, 0) AS cost_at,
  coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, 0) AS cost_far, sum(unpriced) AS unpriced FROM spend GROUP BY {CYC}""")
_cte("vec", "spend", f"""
SELECT {CYC}, rate_key, coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, CAST(sum(tokens) AS DOUBLE) / 1e6) AS val
FROM spend WHERE step_no >= 0 GROUP BY {CYC}, rate_key""")
_cte("plans", "cyc", f"""
SELECT c.account_id, c.tool, c.scope, c.win, c.reset_min, coalesce(c.plan_type, arg_min(k.plan_type, (abs(k.s - c.s), k.s))) AS plan_key
FROM cyc c LEFT JOIN cyc k ON c.plan_type IS NULL AND k.plan_type IS NOT NULL AND k.account_id = c.account_id AND k.tool = c.tool
  AND k.scope = c.scope AND k.win = c.win
GROUP BY c.account_id, c.tool, c.scope, c.win, c.reset_min, c.plan_type""")
_cte("win", "cyc plans costs steps ignored", f"""
SELECT c.*, coalesce(p.plan_key, '') AS plan_key, coalesce(t.used, 0) AS used, coalesce(t.unseg, 0) AS unseg_pct, coalesce(o.cost_at, 0) AS cost_at,
  coalesce(o.cost_far, 0) AS cost_far, coalesce(o.unpriced, 0) AS unpriced, c.e > 1706659200000000 AS active,
  least(c.e, c.last_seen) AS until, i.key IS NOT NULL AS excluded
FROM cyc c LEFT JOIN plans p USING ({CYC}) LEFT JOIN costs o USING ({CYC})
LEFT JOIN (SELECT {CYC}, max(pct) AS used, max(dpct) FILTER (WHERE unseg) AS unseg FROM steps GROUP BY {CYC}) t USING ({CYC})
LEFT JOIN ignored i ON i.account_id = c.account_id AND i.tool = c.tool AND i.key = c.key""")
_cte("ignored", "ev", """
SELECT DISTINCT account_id, tool, scope || ':five_hour:' || ((start5 + 18000000000) // 1000000) AS key
FROM ev WHERE event_type = 'purchase' AND cents > 25000""")

# -- evidence -------------------------------------------------------------------------------------
_cte("reads", "ev", """
SELECT account_id, tool, us AS as_of, start7 + event_id % 3 * 1000000 AS wstart,
  CAST(us // 21600000000 % 9 AS DOUBLE) AS chat, CASE WHEN us // 86400000000 % 7 = 3 THEN 6.0 ELSE 0.0 END AS fresh
FROM ev WHERE event_type = 'view'""")
_cte("runs", "reads", """
SELECT *, sum(new) OVER (PARTITION BY account_id, tool ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN chat = lag(chat) OVER w AND fresh = lag(fresh) OVER w AND abs(wstart - lag(wstart) OVER w) <= 900000000
            THEN 0 ELSE 1 END AS new FROM reads WINDOW w AS (PARTITION BY account_id, tool ORDER BY as_of))""")
_cte("brk", "runs", """
SELECT account_id, tool, min(as_of) AS as_of, max(as_of) AS last_as_of, arg_min(wstart, as_of) AS wstart,
  any_value(chat) AS chat, any_value(fresh) AS fresh, any_value(chat) + any_value(fresh) AS noncode,
  0.5 * (1 + CASE WHEN any_value(fresh) > 0 THEN 1 ELSE 0 END) AS noncode_err
FROM runs GROUP BY account_id, tool, run""")
_cte("wbrk", "win brk", """
SELECT w.account_id, w.tool, w.scope, w.win, w.reset_min, w.s AS wk_start, w.last_seen AS wk_seen, b.* EXCLUDE (account_id, tool)
FROM win w JOIN brk b ON b.account_id = w.account_id AND b.tool = w.tool AND b.as_of BETWEEN w.s - 900000000 AND w.e + 900000000
  AND abs(b.wstart - w.s) <= 900000000 WHERE w.tool = 'timed' AND w.win = 'seven_day'""")
_cte("lbrk", "wbrk", f"""
SELECT * FROM wbrk WHERE as_of <= wk_seen + 900000000
QUALIFY row_number() OVER (PARTITION BY {CYC} ORDER BY as_of DESC) = 1""")
_cte("chain0", "wbrk", f"""
SELECT * FROM (SELECT {CYC}, wk_start, as_of, noncode, noncode_err, as_of AS t FROM wbrk
  UNION SELECT {CYC}, wk_start, as_of, noncode, noncode_err, last_as_of FROM wbrk) WHERE t > wk_start
QUALIFY row_number() OVER (PARTITION BY {CYC}, t ORDER BY as_of) = 1""")
_cte("chain", "chain0 points", """
SELECT c.*, p.pct, c.noncode / 100 * p.pct AS pp, c.noncode_err / 100 * p.pct + 0.5 * c.noncode / 100 AS err
FROM chain0 c ASOF LEFT JOIN points p ON p.account_id = c.account_id AND p.tool = c.tool AND p.scope = c.scope AND p.win = c.win
  AND p.reset_min = c.reset_min AND p.ts <= c.t""")
_cte("noncode", "chain", f"""
SELECT {CYC}, t0 AS span_start, t AS span_end,
  CASE WHEN pp - pp0 > err0 + err THEN 'flagged' WHEN pp - pp0 > 1e-9 THEN 'ambiguous' ELSE 'quiet' END AS kind
FROM (SELECT *, coalesce(lag(t) OVER w, wk_start) AS t0, CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE lag(pp) OVER w END AS pp0,
        CASE WHEN lag(t) OVER w IS NULL THEN 0 ELSE lag(err) OVER w END AS err0
      FROM chain WINDOW w AS (PARTITION BY {CYC} ORDER BY t)) WHERE pp IS NOT NULL AND pp0 IS NOT NULL""")
_cte("five", "win", "SELECT * FROM win WHERE tool = 'timed' AND win = 'five_hour'")
_cte("covers", "five noncode", """
SELECT account_id, tool, scope, win, reset_min, max(CASE WHEN gap THEN NULL ELSE span_end END) AS covered_to FROM (
  SELECT *, max(span_start > reached) OVER (PARTITION BY reset_min, account_id, tool ORDER BY span_start, span_end ROWS UNBOUNDED PRECEDING) AS gap FROM (
    SELECT f.account_id, f.tool, f.scope, f.win, f.reset_min, f.s, n.span_start, n.span_end, greatest(f.s, coalesce(max(n.span_end) OVER (
      PARTITION BY f.account_id, f.tool, f.reset_min ORDER BY n.span_start, n.span_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.s)) AS reached
    FROM five f JOIN noncode n ON n.account_id = f.account_id AND n.tool = f.tool AND n.span_start <= f.until AND n.span_end >= f.s))
GROUP BY ALL""")
_cte("fivenon", "five noncode covers", """
SELECT f.account_id, f.tool, f.scope, f.win, f.reset_min,
  EXISTS (SELECT 1 FROM noncode n WHERE n.kind = 'flagged' AND n.account_id = f.account_id AND n.tool = f.tool
          AND n.span_start < f.until AND n.span_end > f.s) AS flagged,
  EXISTS (SELECT 1 FROM noncode n WHERE n.kind = 'ambiguous' AND n.account_id = f.account_id AND n.tool = f.tool
          AND n.span_start < f.until AND n.span_end > f.s) AS ambiguous,
  greatest(f.s, coalesce(c.covered_to, f.s)) >= f.until AS located
FROM five f LEFT JOIN covers c ON c.account_id = f.account_id AND c.tool = f.tool AND c.scope = f.scope AND c.reset_min = f.reset_min""")
_cte("gapk", "win ev", """
SELECT w.account_id, w.tool, w.scope, w.win, w.reset_min, list_sort(list(DISTINCT CASE WHEN g.event_id % 2 = 0 THEN 'read_error' ELSE 'parse_error' END)) AS kinds
FROM win w JOIN ev g ON g.account_id = w.account_id AND g.tool = w.tool AND g.event_type = 'error' AND g.cents > 20000
  AND g.us < w.until AND g.us + 600000000 > w.s GROUP BY ALL""")
_cte("sight", "ev", """
SELECT account_id, tool, us AS ts, 'L' || account_id || CASE WHEN account_id = 2 AND day >= 12 THEN 'b' ELSE 'a' END AS login
FROM ev WHERE event_type = 'click'""")
_cte("logins", "sight", """
SELECT account_id, tool, ts, login FROM (SELECT *, lag(login) OVER (PARTITION BY account_id, tool ORDER BY ts) AS p FROM sight)
WHERE p IS DISTINCT FROM login""")
_cte("wlog", "win logins", """
SELECT w.account_id, w.tool, w.scope, w.win, w.reset_min, count(DISTINCT l.login) AS login_n, min(l.login) AS login
FROM win w JOIN (SELECT *, lead(ts) OVER (PARTITION BY account_id, tool ORDER BY ts) AS nxt FROM logins) l
  ON l.account_id = w.account_id AND l.tool = w.tool AND l.ts <= w.last_seen AND (l.ts >= w.s OR l.nxt IS NULL OR l.nxt >= w.s)
GROUP BY ALL""")
_cte("claims", "sight", """
SELECT account_id, tool, min(login) AS login, min(ts) AS cs, min(ts) FILTER (WHERE account_id = 1 AND ts >= 1706140800000000) AS ce
FROM sight WHERE account_id < 3 GROUP BY account_id, tool""")
_cte("claimw", "win wlog claims", """
SELECT w.account_id, w.tool, w.scope, w.win, w.reset_min, CASE
  WHEN c.cs IS NULL THEN 'no_claim' WHEN c.cs > w.s THEN 'claim_after_start' WHEN l.login_n > 1 THEN 'account_changed'
  WHEN l.login IS NULL THEN 'account_unknown' WHEN l.login <> c.login THEN 'claim_other_account'
  WHEN coalesce(c.ce, 9e18) >= w.until THEN NULL ELSE 'claim_ended' END AS why
FROM win w LEFT JOIN wlog l USING (account_id, tool, scope, win, reset_min) LEFT JOIN claims c ON c.account_id = w.account_id AND c.tool = w.tool""")

# -- unexplained rises without fitted rates, quality, estimates ------------------------------------
_cte("stspend", "steps spend", f"""
SELECT st.*, coalesce(x.loc, 0) AS loc, coalesce(x.usd, 0) AS usd FROM steps st LEFT JOIN (
  SELECT {CYC}, step_no, sum(val) AS loc, coalesce(sum(val) FILTER (WHERE rate_key LIKE 'usd:%'), 0) AS usd
  FROM spend WHERE step_no > 0 GROUP BY {CYC}, step_no) x USING ({CYC}, step_no)""")
_cte("lrate", "stspend", f"""
SELECT {CYC}, min(ratio) FILTER (WHERE acc >= tot / 2) AS lrate FROM (
  SELECT *, dpct / loc AS ratio, sum(loc) OVER (PARTITION BY {CYC} ORDER BY dpct / loc, loc, step_no ROWS UNBOUNDED PRECEDING) AS acc,
    sum(loc) OVER (PARTITION BY {CYC}) AS tot FROM stspend WHERE loc > 0) GROUP BY {CYC}""")
_cte("ext", "stspend lrate", f"""
SELECT *, CASE WHEN unseg THEN 0 WHEN loc <= 0 THEN CASE WHEN dpct >= 2 THEN dpct ELSE 0 END
  WHEN dpct >= 3 AND dpct >= 3 * expected + 2 THEN dpct - expected ELSE 0 END AS external
FROM (SELECT st.*, coalesce(l.lrate, 0) * st.loc AS expected FROM stspend st LEFT JOIN lrate l USING ({CYC}))""")
_cte("winx", "win ext", f"""
SELECT w.*, least(coalesce(x.raw, 0), w.used) AS ext_pct, coalesce(x.late, false) AS late,
  w.used > 0 AND least(coalesce(x.raw, 0), w.used) / nullif(w.used, 0) >= 0.15 AS contaminated
FROM win w LEFT JOIN (SELECT e.account_id, e.tool, e.scope, e.win, e.reset_min, sum(external) AS raw,
    max(external > 0 AND c.last_seen - e.ts <= 600000000) AS late
  FROM ext e JOIN cyc c USING ({CYC}) GROUP BY ALL) x USING ({CYC})""")
_cte("known", "winx lbrk fivenon gapk claimw", f"""
SELECT w.*, b.as_of IS NOT NULL AS has_b, b.last_as_of, b.chat, b.fresh, b.noncode, 100 - b.chat - b.fresh AS code_b,
  b.chat + 0.5 AS known_hi, b.fresh + CASE WHEN b.fresh > 0 THEN 0.5 ELSE 0 END AS unknown_hi,
  n.flagged, n.ambiguous, n.located, g.kinds, c.why
FROM winx w LEFT JOIN lbrk b USING ({CYC}) LEFT JOIN fivenon n USING ({CYC}) LEFT JOIN gapk g USING ({CYC}) LEFT JOIN claimw c USING ({CYC})""")
_cte("reason", "known", f"""
SELECT {CYC}, ord, code, lvl FROM (
  SELECT *, unnest([
    {{'ord': 1, 'code': CASE WHEN kinds IS NOT NULL THEN 'collect_gap' END, 'lvl': 0}},
    {{'ord': 2, 'code': CASE WHEN wk AND NOT has_b THEN 'no_breakdown' END, 'lvl': 4}},
    {{'ord': 3, 'code': CASE WHEN wk AND has_b AND last_seen - last_as_of > 7200000000 THEN 'breakdown_stale' END, 'lvl': 4}},
    {{'ord': 5, 'code': CASE WHEN wk AND has_b AND unknown_hi >= 5 THEN 'unknown_sources' END, 'lvl': 1}},
    {{'ord': 6, 'code': CASE WHEN wk AND has_b AND known_hi >= 5 THEN 'uncollected_sources' END, 'lvl': 0}},
    {{'ord': 7, 'code': CASE WHEN wk AND has_b AND known_hi < 5 AND unknown_hi < 5 AND known_hi + unknown_hi >= 5 THEN 'uncollected_sources' END, 'lvl': 0}},
    {{'ord': 8, 'code': CASE WHEN fh AND flagged THEN 'noncode_in_window' END, 'lvl': 0}},
    {{'ord': 9, 'code': CASE WHEN fh AND NOT flagged AND (ambiguous OR NOT located) THEN 'noncode_unlocated' END, 'lvl': 4}},
    {{'ord': 10, 'code': CASE WHEN contaminated AND active AND late THEN 'aligning' END, 'lvl': 2}},
    {{'ord': 11, 'code': CASE WHEN contaminated AND NOT (active AND late) THEN 'suspect_unrecorded' END, 'lvl': 4}},
    {{'ord': 12, 'code': CASE WHEN used < 5 OR cost_at <= 0 THEN 'waiting' END, 'lvl': 3}},
    {{'ord': 13, 'code': why, 'lvl': 4}}], recursive := true)
  FROM (SELECT *, tool = 'timed' AND win = 'seven_day' AS wk, tool = 'timed' AND win = 'five_hour' AS fh FROM known)) WHERE code IS NOT NULL""")
_cte("quality", "known reason", f"""
SELECT k.*, coalesce(r.lvl, 5) AS lvl, ['incomplete', 'source_unknown', 'aligning', 'waiting', 'unconfirmed', 'conditional'][coalesce(r.lvl, 5) + 1] AS quality,
  list_concat(coalesce(r.codes, CAST([] AS VARCHAR[])), CASE WHEN k.why IS NULL AND coalesce(r.lvl, 5) <= 1 THEN ['claim_conflict'] ELSE CAST([] AS VARCHAR[]) END) AS codes
FROM known k LEFT JOIN (SELECT {CYC}, min(lvl) AS lvl, list(code ORDER BY ord) AS codes FROM reason GROUP BY {CYC}) r USING ({CYC})""")
_cte("samples", "wbrk points", f"""
SELECT m.account_id, m.tool, m.t, m.wk_start AS week, m.as_of, p.pct AS w, m.noncode / 100 * p.pct AS pp,
  m.noncode_err / 100 * p.pct + 0.5 * m.noncode / 100 AS err FROM (
  SELECT *, t + 10000000 AS paired FROM (
    SELECT {CYC}, wk_start, as_of, noncode, noncode_err, as_of AS t FROM wbrk
    UNION SELECT {CYC}, wk_start, as_of, noncode, noncode_err, last_as_of FROM wbrk
    UNION SELECT b.account_id, b.tool, b.scope, b.win, b.reset_min, b.wk_start, b.as_of, b.noncode, b.noncode_err, p.ts
      FROM wbrk b JOIN points p USING ({CYC}) WHERE p.ts BETWEEN b.as_of AND b.last_as_of)) m
ASOF JOIN points p ON p.account_id = m.account_id AND p.tool = m.tool AND p.scope = m.scope AND p.win = m.win AND p.reset_min = m.reset_min
  AND p.ts <= m.paired""")
_cte("split1", "five samples", """
SELECT f.account_id, f.tool, f.scope, f.win, f.reset_min, f.s, f.last_seen,
  arg_max(x, x.t) FILTER (WHERE x.t > f.s) AS s1, arg_min(x, x.t) FILTER (WHERE x.t > f.s) AS first, arg_max(x, x.t) FILTER (WHERE x.t <= f.s) AS bef
FROM five f JOIN samples x ON x.account_id = f.account_id AND x.tool = f.tool AND x.t BETWEEN f.s - 1800000000 AND f.last_seen + 60000000
GROUP BY ALL""")
_cte("split2", "split1 points samples", """
SELECT q.account_id, q.tool, q.scope, q.win, q.reset_min, q.s0, q.s1, (SELECT arg_max(x, x.t) FROM samples x WHERE x.account_id = q.account_id AND x.tool = q.tool
    AND x.week = q.s0.week AND x.t BETWEEN q.s0.t AND q.s1.t) AS ee
FROM (SELECT a.*, CASE WHEN bef IS NOT NULL THEN bef WHEN a.first.t <> a.s1.t AND p.pct <= 5 THEN a.first END AS s0
  FROM (SELECT *, first.t AS ft FROM split1 WHERE s1 IS NOT NULL AND last_seen - s1.t <= 1800000000) a
  ASOF LEFT JOIN points p ON p.account_id = a.account_id AND p.tool = a.tool AND p.scope = a.scope AND p.win = a.win
    AND p.reset_min = a.reset_min AND p.ts <= a.ft) q
WHERE s0 IS NOT NULL""")
_cte("split", "split2", """
SELECT account_id, tool, scope, win, reset_min, dw, dn, s0.t AS t0, s1.t AS t1,
  100 * (1 - least(1, greatest(0, dn / dw))) AS code, 100 * (1 - least(1, greatest(0, (dn + en) / (dw - ew)))) AS code_low,
  100 * (1 - least(1, greatest(0, (dn - en) / (dw + ew)))) AS code_high
FROM (SELECT *, CASE WHEN s0.week = s1.week THEN s1.w - s0.w ELSE ee.w - s0.w + s1.w END AS dw,
    CASE WHEN s0.week = s1.week THEN s1.pp - s0.pp ELSE ee.pp - s0.pp + s1.pp END AS dn,
    CASE WHEN s0.week = s1.week THEN 1.0 ELSE 1.5 END AS ew,
    s0.err + s1.err + CASE WHEN s0.week = s1.week THEN 0 ELSE ee.err END AS en FROM split2) WHERE dw >= 3""")
_cte("est0", "quality split", f"""
SELECT q.*, x.dw, x.dn, CASE WHEN tool = 'linked' THEN 100.0 WHEN win = 'seven_day' AND has_b THEN q.code_b WHEN win = 'five_hour' THEN x.code END AS c,
  CASE WHEN tool = 'linked' THEN 100.0 WHEN win = 'seven_day' AND has_b THEN greatest(0, q.code_b - 0.5) WHEN win = 'five_hour' THEN x.code_low END AS c_low,
  CASE WHEN tool = 'linked' THEN 100.0 WHEN win = 'seven_day' AND has_b THEN least(100, q.code_b + 0.5) WHEN win = 'five_hour' THEN x.code_high END AS c_high,
  list_filter(codes, lambda z: z IN ('breakdown_invalid', 'breakdown_stale', 'collect_gap', 'aligning') OR (tool = 'linked' AND z = 'suspect_unrecorded'))[1] AS blocker
FROM quality q LEFT JOIN split x USING ({CYC})""")
_cte("est", "est0", """
SELECT *, CASE WHEN why_e IS NULL THEN cost_at * 100 / c END AS total, CASE WHEN why_e IS NULL THEN cost_at * 100 / c / (used / 100) END AS cap,
  CASE WHEN why_e IS NULL THEN cost_at * 1e4 / ((used + 0.5) * c_high) END AS cap_low,
  CASE WHEN why_e IS NULL THEN cost_at * 1e4 / ((used - 0.5) * c_low) END AS cap_high,
  CASE WHEN why_e IS NULL THEN CASE WHEN ext_pct - (100 - c_low) / 100 * used >= 3 THEN ext_pct - (100 - c_low) / 100 * used ELSE 0 END END AS conflict
FROM (SELECT *, CASE WHEN c IS NULL THEN CASE WHEN win = 'five_hour' THEN 'no_split' ELSE 'no_breakdown' END WHEN blocker IS NOT NULL THEN blocker
  WHEN used < 5 OR cost_at <= 0 THEN 'too_little' WHEN c < 20 OR c_low < 10 THEN 'code_share_low' END AS why_e FROM est0)""")

# -- trend without a reference model ---------------------------------------------------------------
_cte("fitm", "win", """
SELECT *, NOT excluded AND e >= 1706659200000000 - 60 * 86400000000 AS in_span, coalesce(NOT excluded AND used >= 10 AND base_n < CASE WHEN ws <= 21600 THEN 5 ELSE 2 END
    AND orank <= CASE WHEN ws <= 21600 THEN 14 ELSE 8 END, false) AS anchor FROM (
  SELECT *, sum(CASE WHEN m AND NOT rec AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 21 * 86400000000
      ELSE e >= 1706659200000000 - 42 * 86400000000 AND orank <= 4 END THEN 1 ELSE 0 END) OVER (PARTITION BY account_id, tool, scope, win, plan_key) AS base_n FROM (
    SELECT *, CASE WHEN m AND NOT rec THEN rk - sum(CASE WHEN rec THEN 1 ELSE 0 END) OVER (PARTITION BY account_id, tool, scope, win, plan_key) END AS orank FROM (
      SELECT *, m AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 72 * 3600000000 ELSE rk = 1 END AS rec FROM (
        SELECT *, NOT excluded AND used >= 10 AS m, row_number() OVER (PARTITION BY account_id, tool, scope, win, plan_key, NOT excluded AND used >= 10
          ORDER BY CASE WHEN ws <= 21600 THEN last_seen ELSE e END DESC, s DESC) AS rk FROM win))))""")
_cte("trend", "est fitm", f"""
SELECT t.*, f.in_span, f.in_span OR f.anchor AS in_fit, t.cap IS NOT NULL AND NOT t.excluded AND t.conflict = 0 AND t.used >= 10 AND (f.in_span OR f.anchor) AS in_trend
FROM est t JOIN fitm f USING ({CYC})""")
_G = "account_id, tool, scope, win, plan_key"
_cte("roles", "trend", f"""
SELECT *, CASE WHEN rn >= CASE WHEN ws <= 21600 THEN 3 ELSE 1 END AND bn >= CASE WHEN ws <= 21600 THEN 5 ELSE 2 END THEN
  CASE WHEN rec THEN 'recent' WHEN base THEN 'baseline' END END AS role FROM (
 SELECT *, sum(base::INT) OVER g AS bn FROM (
  SELECT *, CASE WHEN cross_gap THEN coalesce(orank <= CASE WHEN ws <= 21600 THEN 10 ELSE 4 END, false) ELSE base0 END AS base FROM (
   SELECT *, sum(base0::INT) OVER g < CASE WHEN ws <= 21600 THEN 5 ELSE 2 END AND count(orank) OVER g >= CASE WHEN ws <= 21600 THEN 5 ELSE 2 END AS cross_gap FROM (
    SELECT *, in_trend AND NOT rec AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 21 * 86400000000
       ELSE e >= 1706659200000000 - 42 * 86400000000 AND orank <= 4 END AS base0 FROM (
     SELECT *, CASE WHEN in_trend AND NOT rec THEN rk - rn END AS orank FROM (
      SELECT *, sum(rec::INT) OVER g AS rn FROM (
       SELECT *, in_trend AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 72 * 3600000000 ELSE rk = 1 END AS rec FROM (
        SELECT *, row_number() OVER (PARTITION BY {_G}, in_trend ORDER BY CASE WHEN ws <= 21600 THEN last_seen ELSE e END DESC, s DESC) AS rk FROM trend))
      WINDOW g AS (PARTITION BY {_G}))) ) WINDOW g AS (PARTITION BY {_G}))) WINDOW g AS (PARTITION BY {_G}))""")
_cte("spread", "roles", f"""
SELECT {_G}, CASE WHEN any_value(n) >= 3 AND any_value(med) <> 0 THEN greatest(1.4826 * median(abs(cap - med)) / any_value(med), 0.05) ELSE 0.2 END AS spread
FROM (SELECT *, median(cap) OVER (PARTITION BY {_G}) AS med, count(*) OVER (PARTITION BY {_G}) AS n FROM roles WHERE role = 'baseline') GROUP BY {_G}""")
_cte("overlap", "roles vec", f"""
SELECT {_G}, coalesce(sum(rs) FILTER (WHERE bs >= 0.1), 0) AS ov, arg_min(substr(rate_key, 5), (-bs, rate_key)) AS before, arg_min(substr(rate_key, 5), (-rs, rate_key)) AS after
FROM (SELECT *, r / nullif(sum(r) OVER (PARTITION BY {_G}), 0) AS rs, b / nullif(sum(b) OVER (PARTITION BY {_G}), 0) AS bs FROM (
  SELECT {_G}, v.rate_key, coalesce(sum(v.val) FILTER (WHERE role = 'recent'), 0) AS r, coalesce(sum(v.val) FILTER (WHERE role = 'baseline'), 0) AS b
  FROM roles JOIN vec v USING ({CYC}) WHERE role IS NOT NULL AND v.rate_key LIKE 'usd:%' GROUP BY {_G}, v.rate_key))
GROUP BY {_G} HAVING sum(r) > 0 AND sum(b) > 0""")
_cte("verdict", "roles spread overlap", f"""
SELECT *, CASE WHEN rmed IS NULL OR bmed IS NULL THEN 'insufficient' WHEN coalesce(ov, 1) < 0.5 THEN 'model_changed'
  WHEN rmed / bmed < 1 - thr THEN 'tighter' WHEN rmed / bmed > 1 + thr THEN 'looser' ELSE 'stable' END AS status FROM (
  SELECT h.*, s.spread, o.ov, o.before, o.after, greatest(0.2, 2.5 * s.spread * sqrt(1.0 / nullif(rn, 0) + 1.0 / nullif(bn, 0))) AS thr FROM (
    SELECT {_G}, max(rn) AS rn, max(bn) AS bn, bool_or(cross_gap) AS cross_gap, min(s) FILTER (WHERE base) AS bfrom, max(e) FILTER (WHERE base) AS bto,
      median(cap) FILTER (WHERE role = 'recent') AS rmed, median(cap) FILTER (WHERE role = 'baseline') AS bmed FROM roles GROUP BY {_G}) h
  LEFT JOIN spread s USING ({_G}) LEFT JOIN overlap o USING ({_G}))""")
_cte("cand", "est", f"""
SELECT *, coalesce(why_e, 'estimate_conflict') AS code, (rec OR base) AND (why_e IS NOT NULL OR conflict > 0) AS stuck, sum(rec::INT) OVER g >= CASE WHEN ws <= 21600 THEN 3 ELSE 1 END
  AND greatest(sum(base::INT) OVER g, sum((m AND NOT rec)::INT) OVER g) >= CASE WHEN ws <= 21600 THEN 5 ELSE 2 END AS room FROM (
 SELECT *, m AND NOT rec AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 21 * 86400000000
   ELSE e >= 1706659200000000 - 42 * 86400000000 AND rk - sum(rec::INT) OVER g <= 4 END AS base FROM (
  SELECT *, m AND CASE WHEN ws <= 21600 THEN last_seen >= 1706659200000000 - 72 * 3600000000 ELSE rk = 1 END AS rec FROM (
   SELECT *, row_number() OVER (PARTITION BY {_G}, m ORDER BY CASE WHEN ws <= 21600 THEN last_seen ELSE e END DESC, s DESC, reset_min DESC) AS rk FROM (
    SELECT *, used >= 10 AND e >= 1706659200000000 - 60 * 86400000000 AS m FROM est WHERE NOT excluded)))
 WINDOW g AS (PARTITION BY {_G})) WINDOW g AS (PARTITION BY {_G})""")
_cte("shown", "verdict cand", f"""
SELECT v.*, CASE WHEN v.status = 'insufficient' AND c.n > 0 AND c.room THEN 'not_eligible' ELSE v.status END AS shown
FROM verdict v LEFT JOIN (SELECT {_G}, bool_or(room) AS room, count(*) FILTER (WHERE stuck) AS n FROM cand GROUP BY {_G}) c USING ({_G})""")
GROUP_COLS = _G
