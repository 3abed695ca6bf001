"""One query per operator over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tidemeter import model as M
from tidemeter.functions import scalars as S
from tidemeter.model import CYCLE, DAY, GROUP, LIMIT, SEC
from tidemeter.operators import alerts as A
from tidemeter.operators import dedup, pricing, temporal, views
from tidemeter.operators import estimate as E
from tidemeter.operators import events as X
from tidemeter.operators import evidence as V
from tidemeter.operators import rates as R
from tidemeter.operators import rules as D
from tidemeter.operators import trend as T
from tidemeter.operators import usage as U
from tidemeter.operators import windows as W
from tidemeter.plans import driver_tables as D0
from tidemeter.plans.analysis import Result, analyze
from tidemeter.plans.driver_tables import NOW, PARAMS
from tidemeter.plans.oracle_ctes import GROUP_COLS, sql
from tidemeter.session import checkpoint_dir, cut
from tidemeter.sources import logs, responses
from tidemeter.streaming import jobs, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_KEPT: dict[tuple, object] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def forget() -> None:
    """Drop intermediate tables shared between queries, so that each is measured in full."""
    _KEPT.clear()


def _kept(spark: SparkSession, sf: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def r9(df: DataFrame, *cols: str) -> DataFrame:
    """Round derived doubles, whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _rounded(cols: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c.split('.')[-1]}" for c in cols.split())


# -- usage and prices ------------------------------------------------------------------------------

_SUMS = """count(*) AS requests, CAST(sum(inp) AS DOUBLE) AS input_tokens, CAST(sum(rd) AS DOUBLE) AS cache_read_tokens,
 CAST(sum(w5 + w1) AS DOUBLE) AS cache_write_tokens, CAST(sum(outp) AS DOUBLE) AS output_tokens"""
_MORE = """CAST(sum(reas) AS DOUBLE) AS reasoning_tokens, coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, 0) AS cost_usd,
 count(*) FILTER (WHERE pico IS NULL) AS unpriced_requests,
 CAST(sum(rd) AS DOUBLE) / nullif(CAST(sum(inp) + sum(rd) + sum(w5 + w1) AS DOUBLE), 0) AS cache_hit_rate"""


def _plain(df: DataFrame) -> DataFrame:
    """Wide exact sums as DOUBLE for comparison."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


@query("usage_by_model", sql(f"SELECT tool, model, on_plan, {_SUMS}, {_MORE} FROM priced GROUP BY tool, model, on_plan", "priced"))
def usage_by_model(spark, sf):
    return _plain(U.by_model(D0.priced(spark, sf)))


@query("usage_summary", sql(f"SELECT {_SUMS}, {_MORE} FROM priced", "priced"))
def usage_summary(spark, sf):
    return _plain(U.summary(D0.priced(spark, sf)))


@query("usage_series_day", sql(f"""SELECT strftime(make_timestamp(ts), '%Y-%m-%d') AS bucket, tool, {_SUMS},
 coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, 0) AS cost_usd FROM priced GROUP BY 1, 2""", "priced"))
def usage_series_day(spark, sf):
    return _plain(U.series(D0.priced(spark, sf), "day"))


@query("usage_series_hour_local", sql(f"""SELECT strftime(make_timestamp(ts + 8 * 3600000000), '%Y-%m-%d %H:00') AS bucket, tool, {_SUMS},
 coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, 0) AS cost_usd FROM priced GROUP BY 1, 2""", "priced"))
def usage_series_hour_local(spark, sf):
    return _plain(U.series(D0.priced(spark, sf), "hour", "Asia/Singapore"))


@query("usage_spark_line", sql("""SELECT strftime(make_timestamp(ts), '%Y-%m-%d') AS bucket,
 round(sum(pico) / 1e12, 2) AS cost_usd FROM priced GROUP BY 1""", "priced"))
def usage_spark_line(spark, sf):
    return U.spark_line(U.series(D0.priced(spark, sf), "day"))


@query("usage_last_week_of_tool", sql(f"""SELECT tool, model, on_plan, {_SUMS}, {_MORE} FROM priced
 WHERE ts >= {NOW} - 7 * 86400000000 AND tool = 'linked' GROUP BY tool, model, on_plan""", "priced"))
def usage_last_week_of_tool(spark, sf):
    return _plain(U.report(D0.priced(spark, sf), "7d", NOW, tool="linked")["models"])


@query("usage_today_hours", sql(f"""SELECT strftime(make_timestamp(ts), '%Y-%m-%d %H:00') AS bucket, tool, {_SUMS},
 coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, 0) AS cost_usd FROM priced WHERE ts >= {NOW - DAY} GROUP BY 1, 2""", "priced"))
def usage_today_hours(spark, sf):
    return _plain(U.report(D0.priced(spark, sf), "today", NOW - 1)["series"])


@query("usage_top_models", sql("""SELECT tool, model, CAST(sum(pico) AS DOUBLE) / 1e12 AS cost_usd FROM priced WHERE on_plan
 GROUP BY tool, model HAVING sum(pico) > 0 ORDER BY cost_usd DESC, tool, model LIMIT 8""", "priced"))
def usage_top_models(spark, sf):
    return U.top_priced(U.by_model(D0.priced(spark, sf))).select("tool", "model", "cost_usd")


@query("usage_requests_without_price", sql("""SELECT coalesce(sum(n), 0)::BIGINT AS requests FROM (
 SELECT count(*) AS n FROM priced GROUP BY tool, model, on_plan HAVING count(pico) = 0)""", "priced"))
def usage_requests_without_price(spark, sf):
    return U.requests_without_price(U.by_model(D0.priced(spark, sf)))


@query("request_cost", sql("SELECT id, price_key, pico AS cost_pico FROM priced", "priced"))
def request_cost(spark, sf):
    df = pricing.lookup(D0.usage(spark, sf), D0.prices(spark))
    return df.select("id", "price_key", pricing.cost_pico().alias("cost_pico"))


@query("repriced_cost", sql("""SELECT id, pico AS old_pico, CASE WHEN price_key LIKE '%-purchase' THEN
 inp * 2000000 + rd * 2000000 + w5 * 2500000 + w1 * 4000000 + outp * 5000000 ELSE pico END AS cost_pico FROM priced""", "priced"))
def repriced_cost(spark, sf):
    old = D0.priced(spark, sf)
    table = D0.prices(spark)
    newer = table.withColumn("input", F.when(F.col("model").endswith("-purchase"), 2_000_000).otherwise(F.col("input")).cast("bigint"))
    stored = pricing.catalog_version(table).first()["version"]
    again, _ = pricing.reprice_if_changed(old, newer, stored)
    return old.select("id", F.col("cost_pico").alias("old_pico")).join(again.select("id", "cost_pico"), "id")


@query("used_models", sql("""SELECT tool, model, on_plan, price_key, count(*) AS requests, max(ts) AS last_used FROM priced
 GROUP BY tool, model, on_plan, price_key""", "priced"))
def used_models(spark, sf):
    return pricing.used_models(D0.usage(spark, sf), D0.prices(spark)).drop("price")


@query("unpriced_models", sql("""SELECT tool, model, on_plan, count(*) AS requests, max(ts) AS last_used FROM priced
 WHERE on_plan GROUP BY tool, model, on_plan HAVING count(price_key) = 0""", "priced"))
def unpriced_models(spark, sf):
    return pricing.unpriced_models(D0.usage(spark, sf), D0.prices(spark))


@query("catalog_requests", sql("""SELECT p.model, p.p_in AS input, count(u.id) AS requests FROM price p LEFT JOIN priced u ON u.price_key = p.model
 GROUP BY p.model, p.p_in""", "priced"))
def catalog_requests(spark, sf):
    return pricing.catalog_requests(D0.usage(spark, sf), D0.prices(spark)).select("model", "input", "requests")


@query("price_display", sql("""SELECT u.tool, u.model, u.requests, p_in / 1e6 AS input, p_out / 1e6 AS output, p_rd / 1e6 AS cache_read,
 p_w5 / 1e6 AS cache_write, CASE WHEN p_w5 IS NOT NULL THEN coalesce(p_w1 / 1e6, CASE WHEN u.model LIKE 'claude-%' THEN p_in / 1e6 * 2 END) END AS cache_write_1h,
 t_size AS tier_size, f_in IS NOT NULL AS has_fast, p.model IS NULL AS no_price
 FROM (SELECT tool, model, count(*) AS requests FROM priced WHERE on_plan GROUP BY tool, model) u LEFT JOIN price p ON p.model = u.model""", "priced", "price"))
def price_display(spark, sf):
    shown = pricing.price_display(pricing.used_models(D0.usage(spark, sf), D0.prices(spark)))
    return shown.drop("priced_as", "alias_of", "source")


@query("price_sources", sql("""SELECT u.tool, u.m AS model, count(*) AS requests, CASE WHEN p.model <> u.m THEN p.model END AS priced_as,
 CASE WHEN p.model LIKE '%-click' THEN 'm-base' END AS alias_of, CASE WHEN p.model LIKE '%-view' THEN 'override' END AS source, p.model IS NULL AS no_price
 FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN model || '-high' ELSE model END AS m FROM usage WHERE on_plan) u LEFT JOIN price p ON p.model = u.model
 GROUP BY ALL""", "usage", "price"))
def price_sources(spark, sf):
    """What shown prices rest on: half of the requests name an effort, some entries are aliases or overrides."""
    of = F.col("model")
    table = (D0.prices(spark).withColumn("source", F.when(of.endswith("-view"), "override").otherwise(F.col("source")))
             .withColumn("alias_of", F.when(of.endswith("-click"), "m-base")))
    used = D0.usage(spark, sf).withColumn("model", F.when(F.substring("id", 2, 20).cast("bigint") % 2 == 0, F.concat("model", F.lit("-high"))).otherwise(of))
    return pricing.price_display(pricing.used_models(used, table)).select("tool", "model", "requests", "priced_as", "alias_of", "source", "no_price")


@query("catalog_version", f"""WITH p AS (SELECT lower(p_brand || '-' || p_type) AS model, max(p_size) AS output,
  CAST(round(min(p_retailprice) FILTER (WHERE p_retailprice > 0)) AS BIGINT) AS input FROM part WHERE p_size > 0 GROUP BY 1),
h AS (SELECT sha256('{{"model":"' || model || '"' || CASE WHEN output <> 49 AND input IS NOT NULL THEN ',"input":' || input ELSE '' END || ',"output":' || output || '}}') AS h FROM p)
SELECT sha1(count(*) || '|' || {" || '|' || ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))}) AS version FROM h""")
def catalog_version(spark, sf):
    part = _part_prices(spark, sf, 0)
    return pricing.catalog_version(part)


def _part_prices(spark, sf, over: int) -> DataFrame:
    p = D0.load(spark, sf, "part").where(F.col("p_size") > over)
    base = F.round(F.min(F.when(F.col("p_retailprice") > 0, F.col("p_retailprice")))).cast("bigint")
    rows = p.groupBy(F.lower(F.concat_ws("-", "p_brand", "p_type")).alias("model")).agg(base.alias("input"), F.max("p_size").cast("bigint").alias("output"))
    null = lambda c: F.lit(None).cast(M.PRICE[c].dataType).alias(c)
    return rows.select("model", F.when(F.col("output") != 49, F.col("input")).alias("input"), "output",
                       *[null(c) for c in ("cache_read", "cache_write", "cache_write_1h", "tiers", "fast")],
                       F.lit(f"layer{over}").alias("source"), null("alias_of"))


@query("price_layer_merge", """WITH l AS (SELECT lower(p_brand || '-' || p_type) AS model, t.o, CAST(round(min(p_retailprice)) AS BIGINT) AS input, max(p_size)::BIGINT AS output
 FROM part, (VALUES (0), (30)) t(o) WHERE p_size > t.o GROUP BY 1, 2)
SELECT model, arg_max(input, o) AS input, arg_max(output, o) AS output, 'layer' || max(o) AS source FROM l WHERE output <> 49 GROUP BY model""")
def price_layer_merge(spark, sf):
    merged = pricing.merge_layers([_part_prices(spark, sf, 0), _part_prices(spark, sf, 30)])
    return merged.select("model", "input", "output", "source")


@query("price_name_candidates", r"""SELECT p_partkey, c1, regexp_replace(c1, '-(\d{8}|\d{4}-\d{2}-\d{2})$', '') AS c2,
 regexp_replace(regexp_replace(c1, '-(\d{8}|\d{4}-\d{2}-\d{2})$', ''), '-(minimal|low|medium|high|xhigh|max)$', '') AS c3
FROM (SELECT p_partkey, lower(p_type) || '-' || replace(p_name, ' ', '-') || CASE p_size % 4 WHEN 0 THEN '-20240115' WHEN 1 THEN '-2024-01-15' WHEN 2 THEN '-high' ELSE '-max-20240115' END AS c1 FROM part)""")
def price_name_candidates(spark, sf):
    p = D0.load(spark, sf, "part")
    tail = F.element_at(F.array(F.lit("-20240115"), F.lit("-2024-01-15"), F.lit("@High"), F.lit("-MAX@20240115")), (F.col("p_size") % 4 + 1).cast("int"))
    raw = F.concat(F.lit("  Vendor/"), "p_brand", F.lit("/"), "p_type", F.lit("[1m]-"), F.replace("p_name", F.lit(" "), F.lit("-")), tail, F.lit(":beta "))
    c = S.lookup_candidates(raw)
    return p.select("p_partkey", c[0].alias("c1"), c[1].alias("c2"), c[2].alias("c3"))


# -- scalar expressions ----------------------------------------------------------------------------

@query("parse_timestamps", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN epoch_us(date_trunc('second', ts))
 WHEN event_id % 5 = 1 THEN epoch_us(ts) // 1000 * 1000 - 7200000000 ELSE epoch_us(ts) END AS us FROM events""")
def parse_timestamps(spark, sf):
    e = D0.load(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    i = F.col("event_id") % 5
    full = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(i == 0, F.concat(full, F.lit("Z"))).when(i == 1, F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+02:00")))
            .when(i == 2, F.concat(full, F.lit("987+00:00"))).when(i == 3, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.concat(full, F.lit("??"))))
    return e.select("event_id", S.parse_iso(text).alias("us"))


@query("window_names", """SELECT CASE s WHEN 18000 THEN 'five_hour' WHEN 604800 THEN 'seven_day' WHEN 2592000 THEN 'thirty_day'
 ELSE CASE WHEN s // 3600 >= 24 THEN (s // 3600 // 24) || '_day' ELSE (s // 3600) || '_hour' END END AS name, count(*) AS n
FROM (SELECT CAST(l_quantity AS BIGINT) * (l_linenumber * 3600) AS s FROM lineitem) GROUP BY 1""")
def window_names(spark, sf):
    s = F.col("l_quantity").cast("bigint") * (F.col("l_linenumber") * 3600)
    return D0.load(spark, sf, "lineitem").groupBy(S.window_name(s).alias("name")).agg(F.count("*").alias("n"))


@query("plan_membership", """SELECT p_partkey, m, t, NOT contains(m, '/') AND CASE t WHEN 'timed' THEN starts_with(lower(m), 'claude-')
 ELSE starts_with(lower(m), 'gpt-') OR starts_with(lower(m), 'o3') END AS on_plan
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Claude-' WHEN 1 THEN 'gpt-' WHEN 2 THEN 'O3' WHEN 3 THEN 'x/claude-' ELSE '' END || p_type AS m,
 CASE WHEN p_partkey % 2 = 0 THEN 'timed' ELSE 'linked' END AS t FROM part)""")
def plan_membership(spark, sf):
    head = F.element_at(F.array(*[F.lit(x) for x in ("Claude-", "gpt-", "O3", "x/claude-", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    p = D0.load(spark, sf, "part").select("p_partkey", F.concat(head, "p_type").alias("m"),
                                          F.when(F.col("p_partkey") % 2 == 0, "timed").otherwise("linked").alias("t"))
    return p.withColumn("on_plan", S.is_on_plan("t", "m"))


@query("reset_minutes", sql("""SELECT event_id, (((us // 30000000) // 2 + CASE WHEN (us // 30000000) % 2 = 0 THEN 0
 WHEN ((us // 30000000) // 2) % 2 = 0 THEN 0 ELSE 1 END) * 60)::BIGINT AS reset FROM ev""", "ev"))
def reset_minutes(spark, sf):
    return D0.events(spark, sf).select("event_id", S.round_reset(F.expr("us div 30000000 * 30000000")).alias("reset"))


@query("identity_digests", """SELECT event_id, substr(sha256('s' || chr(31) || user_id || chr(31) || event_type), 1, 16) AS digest FROM events""")
def identity_digests(spark, sf):
    return D0.load(spark, sf, "events").select("event_id", S.digest("s", F.col("user_id"), F.col("event_type")).alias("digest"))


@query("confidence_buckets", sql("""SELECT win AS "window", CASE WHEN pct >= 20 THEN 'high' WHEN pct >= 5 THEN 'medium' ELSE 'low' END AS confidence,
 count(*) AS n FROM snap GROUP BY 1, 2""", "snap"))
def confidence_buckets(spark, sf):
    return D0.snapshots(spark, sf).groupBy("window", S.confidence("used_percent").alias("confidence")).agg(F.count("*").alias("n"))


@query("fit_variables", sql("""SELECT CASE WHEN pico IS NULL THEN 'mtok:' ELSE 'usd:' END || model AS rate_key, count(*) AS n,
 coalesce(CAST(sum(pico) AS DOUBLE) / 1e12, CAST(sum(inp + rd + outp) AS DOUBLE) / 1e6) AS value FROM priced WHERE on_plan GROUP BY 1""", "priced"))
def fit_variables(spark, sf):
    u = D0.priced(spark, sf).where("on_plan")
    priced = F.col("cost_pico").isNotNull()
    tokens = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("output_tokens")
    return u.groupBy(S.fit_key("model", priced).alias("rate_key")).agg(
        F.count("*").alias("n"), F.coalesce(S.usd(S.exact_sum("cost_pico")), S.exact_sum(tokens).cast("double") / 1e6).alias("value"))


@query("scope_models", """SELECT p_partkey, scope, CASE scope WHEN 'all' THEN true WHEN 'opus' THEN p_size % 3 = 0 WHEN 'sonnet' THEN p_size % 3 = 1 ELSE false END AS counted
 FROM part, (VALUES ('all'), ('opus'), ('sonnet'), ('other')) s(scope)""")
def scope_models(spark, sf):
    p = D0.load(spark, sf, "part")
    model = F.concat(F.element_at(F.array(F.lit("Claude-OPUS-"), F.lit("claude-Sonnet-"), F.lit("claude-x-")), (F.col("p_size") % 3 + 1).cast("int")), "p_name")
    rows = p.select("p_partkey", model.alias("model"), F.explode(F.array(*[F.lit(x) for x in ("all", "opus", "sonnet", "other")])).alias("scope"))
    return rows.select("p_partkey", "scope", S.in_scope(F.lit("timed"), "scope", "model").alias("counted"))


@query("range_starts", sql("SELECT event_id, us - us % 86400000000 AS today, us - 7 * 86400000000 AS week, us - 30 * 86400000000 AS month FROM ev", "ev"))
def range_starts(spark, sf):
    n = F.col("us")
    return D0.events(spark, sf).select("event_id", S.range_start("today", n).alias("today"), S.range_start("7d", n).alias("week"),
                                       S.range_start("30d", n).alias("month"))


# -- logs ------------------------------------------------------------------------------------------

def _iso(us: str = "us"):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _lines_a(spark, sf) -> DataFrame:
    """Timed events as layout-A lines: a partial and a final copy of each message; error events are cut short."""
    e = D0.spread(D0.events(spark, sf)).where(F.col("tool") == "timed")
    i = F.col("event_id")

    def line(output, stop):
        use = F.struct((F.col("k") * 100 + 50).alias("input_tokens"), output.alias("output_tokens"), F.col("cents").alias("cache_read_input_tokens"),
                       (i % 7 * 10 + i % 5 * 10).alias("cache_creation_input_tokens"),
                       F.struct((i % 7 * 10).alias("ephemeral_5m_input_tokens"), (i % 5 * 10).alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
                       F.when(i % 10 == 0, "fast").otherwise("standard").alias("speed"))
        return F.to_json(F.struct(F.lit("assistant").alias("type"), _iso().alias("timestamp"), F.col("user_id").cast("string").alias("sessionId"),
                                  F.struct(i.cast("string").alias("id"), F.col("model"), stop.alias("stop_reason"), use.alias("usage")).alias("message")))
    full = i % 11 * 20 + F.col("k")
    whole = line(full, F.lit("end_turn"))
    second = F.when(F.col("event_type") == "error", F.expr("substring(w, 1, length(w) - 9)")).otherwise(F.col("w"))
    pair = e.withColumn("w", whole).withColumn("value", F.explode(F.array(line(F.expr("(event_id % 11 * 20 + k) div 2"), F.lit(None).cast("string")), second)))
    return pair.select("account_id", F.concat(F.lit("d/"), F.col("account_id").cast("string"), F.lit("-"), F.col("day").cast("string"), F.lit(".jsonl")).alias("file"),
                       F.expr("us div 3600000000").alias("block"), (i * 2 + F.when(F.col("value") == F.col("w"), 1).when(F.col("value").endswith("}"), 0).otherwise(1)).alias("seq"),
                       F.lit(NOW).alias("mtime"), "value")


@query("parsed_messages", sql("""SELECT 'claude:' || event_id AS id, account_id, ts, model, on_plan, inp AS input_tokens, rd AS cache_read_tokens,
 w5 AS cache_write_5m_tokens, w1 AS cache_write_1h_tokens, CASE WHEN on_plan THEN outp ELSE outp // 2 END AS output_tokens, speed, pico AS cost_pico
 FROM priced WHERE tool = 'timed'""", "priced"))
def parsed_messages(spark, sf):
    return logs.usage_from_layout_a(_lines_a(spark, sf), D0.prices(spark)).drop("tool", "session_id", "reasoning_tokens")


@query("dropped_messages", sql("""SELECT 'claude:' || event_id AS id, account_id, ts, model, pico AS cost_pico FROM priced
 WHERE tool = 'timed' AND event_id % 4 NOT IN (1, 2)""", "priced"))
def dropped_messages(spark, sf):
    """Lines of which a quarter are of no model and a quarter count no tokens: neither gives a request."""
    kind = F.expr("seq div 2 % 4")
    value = (F.when(kind == 1, F.regexp_replace("value", '"model":"[^"]*"', '"model":"<synthetic>"'))
             .when(kind == 2, F.regexp_replace("value", r'_tokens":\d+', '_tokens":0')).otherwise(F.col("value")))
    lines = _lines_a(spark, sf).withColumn("value", value)
    return logs.usage_from_layout_a(lines, D0.prices(spark)).select("id", "account_id", "ts", "model", "cost_pico")


@query("unparsed_line_gaps", sql(f"""SELECT account_id, day, count(*) AS bad, coalesce((SELECT max(us) FROM ev x WHERE x.account_id = e.account_id AND x.day = e.day
 AND x.event_id <= min(e.event_id)), {NOW}) AS start FROM ev e WHERE tool = 'timed' AND event_type = 'error' GROUP BY account_id, day""", "ev"))
def unparsed_line_gaps(spark, sf):
    g = logs.parse_gaps(_lines_a(spark, sf))
    return g.select("account_id", F.regexp_extract("detail", r"-(\d+)\.", 1).cast("bigint").alias("day"),
                    F.regexp_extract("detail", r": (\d+)$", 1).cast("bigint").alias("bad"), "start")


def _lines_b(spark, sf, totals: bool) -> DataFrame:
    """Linked events as layout-B lines, one file per account and day: the model, then the counters (single use,
    or only the running total)."""
    e = D0.spread(D0.events(spark, sf)).where(F.col("tool") == "linked")
    i = F.col("event_id")
    turn = F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(F.col("model")).alias("payload")))
    cached, write = F.col("cents"), i % 7 * 10
    if totals:
        counts = {"total_token_usage": F.struct((i * 1000).alias("input_tokens"), (i * 300).alias("cached_input_tokens"), (i * 10).alias("output_tokens"))}
    else:
        counts = {"last_token_usage": F.struct((F.col("k") * 100 + 50 + cached + write).alias("input_tokens"), cached.alias("cached_input_tokens"),
                                               write.alias("cache_write_input_tokens"), (i % 11 * 20 + F.col("k")).alias("output_tokens"), (i % 3).alias("reasoning_output_tokens"))}
    limit = lambda minutes, reset: F.struct((F.col("k") * 1.0).alias("used_percent"), F.lit(minutes).alias("window_minutes"),
                                            (F.col(reset) / F.lit(1e6)).alias("resets_at"))
    # Every fifth event reports no limits: its request keeps the links of the line before.
    rl = F.when(i % 5 != 0, F.struct(F.lit("codex").alias("limit_id"), F.col("plan").alias("plan_type"), limit(300, "reset5").alias("primary"),
                                     limit(10080, "reset7").alias("secondary")))
    info = F.struct(*[v.alias(n) for n, v in counts.items()])
    count = F.to_json(F.struct(F.lit("event_msg").alias("type"), _iso().alias("timestamp"),
                               F.struct(F.lit("token_count").alias("type"), info.alias("info"), rl.alias("rate_limits")).alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("user_id").cast("string").alias("id")).alias("payload")))
    rows = e.select("account_id", F.concat_ws("-", F.lit("rollout"), F.col("account_id").cast("string"), F.col("day").cast("string")).alias("file"),
                    F.expr("us div 3600000000").alias("block"), i.alias("n"), F.posexplode(F.array(meta, turn, count)).alias("pos", "value"))
    return rows.select("account_id", "file", "block", (F.col("n") * 3 + F.col("pos")).alias("seq"), F.lit(NOW).alias("mtime"), "value")


_DAYFIRST = "first_value(user_id) OVER (PARTITION BY account_id, day ORDER BY event_id)"


@query("folded_requests", sql(f"""SELECT account_id, ts, model, CAST({_DAYFIRST} AS VARCHAR) AS session_id,
 inp AS input_tokens, rd AS cache_read_tokens, w5 AS cache_write_5m_tokens, outp AS output_tokens, reas AS reasoning_tokens
 FROM usage WHERE tool = 'linked' AND inp + rd + w5 + outp > 0""", "usage"))
def folded_requests(spark, sf):
    t = logs.tables_from_layout_b(_lines_b(spark, sf, False), D0.prices(spark))["usage"]
    return t.select("account_id", "ts", "model", "session_id", "input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "output_tokens", "reasoning_tokens")


@query("request_ids", sql("""SELECT DISTINCT account_id, us AS ts, 'codex:' || substr(sha1('["' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') || '", ['
 || array_to_string([k * 100 + 50 + cents + event_id % 7 * 10, cents, event_id % 7 * 10, event_id % 11 * 20 + k, event_id % 3, 0], ', ') || ']]'), 1, 24) AS id
 FROM ev WHERE tool = 'linked'""", "ev"))
def request_ids(spark, sf):
    """Ids of requests from their own stamp and counters, the same in every copy of a line."""
    lines = _lines_b(spark, sf, False)
    copy = lines.withColumn("file", F.concat(F.lit("copy-"), F.col("file")))
    return logs.tables_from_layout_b(lines.unionByName(copy), D0.prices(spark))["usage"].select("account_id", "ts", "id")


@query("folded_links", sql("""SELECT account_id, ts, win AS "window", resets_at FROM (
 SELECT account_id, us AS ts, last_value(CASE WHEN event_id % 5 <> 0 THEN reset5 END IGNORE NULLS) OVER w AS r5,
  last_value(CASE WHEN event_id % 5 <> 0 THEN reset7 END IGNORE NULLS) OVER w AS r7 FROM ev WHERE tool = 'linked'
 WINDOW w AS (PARTITION BY account_id, day ORDER BY event_id ROWS UNBOUNDED PRECEDING)), LATERAL (VALUES ('five_hour', r5), ('seven_day', r7)) l(win, resets_at)
 WHERE resets_at > ts""", "ev"))
def folded_links(spark, sf):
    folded = logs.requests_of(logs.fold_layout_b(_lines_b(spark, sf, False)))
    return folded.select("account_id", "ts", F.inline("links")).drop("scope")


@query("folded_snapshots", sql("""SELECT account_id, us AS ts, win AS "window", k::DOUBLE AS used_percent, resets_at, plan AS plan_type
 FROM ev, LATERAL (VALUES ('five_hour', reset5), ('seven_day', reset7)) l(win, resets_at) WHERE tool = 'linked' AND event_id % 5 <> 0""", "ev"))
def folded_snapshots(spark, sf):
    t = logs.tables_from_layout_b(_lines_b(spark, sf, False), D0.prices(spark))["snapshots"]
    return t.select("account_id", "ts", "window", "used_percent", "resets_at", "plan_type")


@query("counter_deltas", sql("""SELECT account_id, us AS ts, d * 1000 - d * 300 AS input_tokens, d * 300 AS cache_read_tokens, d * 10 AS output_tokens
 FROM (SELECT *, event_id - coalesce(lag(event_id) OVER (PARTITION BY account_id, day ORDER BY event_id), 0) AS d FROM ev WHERE tool = 'linked') WHERE d > 0""", "ev"))
def counter_deltas(spark, sf):
    folded = logs.requests_of(logs.fold_layout_b(_lines_b(spark, sf, True)))
    return folded.select("account_id", "ts", "input_tokens", "cache_read_tokens", "output_tokens")


@query("upserted_messages", sql("""SELECT id, ts, outp + CASE WHEN on_plan THEN 5 ELSE 0 END AS output_tokens FROM usage""", "usage"))
def upserted_messages(spark, sf):
    u = D0.priced(spark, sf)
    grown = u.withColumn("output_tokens", F.col("output_tokens") + F.when(F.col("on_plan"), 5).otherwise(-5)).withColumn("ts", F.col("ts") + 99)
    return dedup.merge_into_usage(u, grown).select("id", "ts", "output_tokens")


@query("first_arrivals", sql("SELECT account_id, min(us) AS ts, arg_min(event_type, event_id) AS event_type, k FROM ev GROUP BY account_id, k", "ev"))
def first_arrivals(spark, sf):
    e = D0.events(spark, sf).select("account_id", "k", F.col("us").alias("ts"), "event_type", "event_id")
    return dedup.first_wins(e, ["account_id", "k"], ["event_id"]).drop("event_id")


@query("tombstoned_snapshots", sql("""SELECT account_id, win AS "window", coalesce(plan, '-') AS plan_type, count(*) AS n FROM snap
 WHERE NOT coalesce(account_id = 3 AND plan = 'plus' AND ts <= 1706140800000000, false) GROUP BY ALL""", "snap"))
def tombstoned_snapshots(spark, sf):
    rules = spark.createDataFrame([(3, "linked", "plan", "plus", "deleted", 1_706_140_800 * SEC)], M.RULE)
    left = D.drop_deleted(D0.snapshots(spark, sf), rules)
    return left.groupBy("account_id", "window", F.coalesce("plan_type", F.lit("-")).alias("plan_type")).agg(F.count("*").alias("n"))


_FILES = """SELECT o_custkey % 97 AS account_id, 'f' || o_orderkey AS path, CAST(o_totalprice AS BIGINT) AS size, epoch_us(o_orderdate) AS mtime, o_orderkey FROM orders"""


def _files(spark, sf):
    o = D0.load(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("account_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"),
                                            F.round("o_totalprice").cast("bigint").alias("size"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("mtime"), "o_orderkey")
    cursors = o.where(F.col("o_orderkey") % 3 > 0).select("account_id", "path", (F.col("size") + F.col("o_orderkey") % 5 - 3).alias("offset"), (F.col("mtime") - SEC).alias("mtime"))
    return o.select("path", "size", "mtime"), cursors


@query("truncated_files", f"""WITH f AS ({_FILES}) SELECT account_id, mtime - 1000000 AS start, mtime AS "end", path AS detail FROM f
 WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 - 3 > 0""")
def truncated_files(spark, sf):
    return logs.truncation_gaps(*_files(spark, sf), "timed").select("account_id", "start", "end", "detail")


@query("import_coverage", f"""WITH f AS ({_FILES}) SELECT count(*) AS files, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS pending,
 min(mtime) FILTER (WHERE o_orderkey % 3 = 0) AS pending_oldest FROM f""")
def import_coverage(spark, sf):
    return logs.import_coverage(*_files(spark, sf))


@query("retention_gaps", sql(f"""SELECT user_id AS account_id, max(us) AS start, {NOW} - 30 * 86400000000 + 28 * 86400000000 AS "end" FROM ev
 GROUP BY user_id HAVING {NOW} + 28 * 86400000000 - max(us) > 30 * 86400000000""", "ev"))
def retention_gaps(spark, sf):
    last = D0.events(spark, sf).groupBy(F.col("user_id").alias("account_id")).agg(F.first("tool").alias("tool"), F.max("us").alias("ts"))
    return logs.retention_gaps(last, NOW + 28 * DAY).select("account_id", "start", "end")


@query("withdrawn_read_gaps", sql("""SELECT account_id, us AS start, CASE WHEN event_id % 2 = 0 THEN 'read_error' ELSE 'parse_error' END AS kind FROM ev
 WHERE event_type = 'error' AND cents > 20000 AND NOT (event_id % 2 = 0 AND k < 50)""", "ev"))
def withdrawn_read_gaps(spark, sf):
    done = D0.events(spark, sf).where(F.col("k") < 50).select("account_id", "tool", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"))
    return logs.clear_read_gaps(D0.gaps(spark, sf), done).select("account_id", "start", "kind")


# -- responses -------------------------------------------------------------------------------------

def _responses(spark, sf, kind: str) -> DataFrame:
    e = D0.spread(D0.events(spark, sf))
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pct = (F.col("k") * 1.0)
    if kind == "a":
        body = F.struct(F.struct(pct.alias("utilization"), iso("reset5").alias("resets_at")).alias("five_hour"),
                        F.struct((pct / 2).alias("utilization"), iso("reset7").alias("resets_at")).alias("seven_day"),
                        F.when(F.col("k") % 3 == 0, F.struct((pct / 4).alias("utilization"), F.lit(None).cast("string").alias("resets_at"))).alias("seven_day_opus"),
                        F.struct(F.lit(False).alias("is_enabled")).alias("extra_usage"),
                        F.array(F.struct(F.lit("weekly_scoped").alias("kind"), F.lit("weekly").alias("group"), (pct + 1).alias("percent"), iso("reset7").alias("resets_at"),
                                         F.struct(F.struct(F.lit(" Fable ").alias("display_name")).alias("model")).alias("scope"))).alias("limits"))
    else:
        win = lambda p, secs, reset: F.struct(p.alias("used_percent"), F.lit(secs).alias("limit_window_seconds"),
                                              F.when(F.col("k") % 2 == 0, secs).otherwise(100).alias("reset_after_seconds"), (F.col(reset) / F.lit(1e6)).alias("reset_at"))
        body = F.struct(F.col("plan").alias("plan_type"), F.struct(win(F.col("k") % 5, 18_000, "reset5").alias("primary_window"),
                                                                   win(F.col("k") + 1, 604_800, "reset7").alias("secondary_window")).alias("rate_limit"))
    return e.select("account_id", "tool", F.col("us").alias("ts"), F.col("plan").alias("plan_type"), F.to_json(body).alias("body"))


@query("response_snapshots_named", sql("""SELECT account_id, us AS ts, scope, win AS "window", pct AS used_percent, resets_at FROM (
 SELECT account_id, us, unnest([{'scope': 'all', 'win': 'five_hour', 'pct': k::DOUBLE, 'resets_at': reset5}, {'scope': 'all', 'win': 'seven_day', 'pct': k / 2, 'resets_at': reset7},
  {'scope': 'opus', 'win': 'seven_day', 'pct': CASE WHEN k % 3 = 0 THEN k / 4 END, 'resets_at': NULL}, {'scope': 'fable', 'win': 'seven_day', 'pct': k + 1.0, 'resets_at': reset7}], recursive := true)
 FROM ev) WHERE pct IS NOT NULL""", "ev"))
def response_snapshots_named(spark, sf):
    return responses.snapshots_layout_a(_responses(spark, sf, "a")).select("account_id", "ts", "scope", "window", "used_percent", "resets_at")


@query("response_snapshots_ranked", sql("""SELECT account_id, us AS ts, 'five_hour' AS "window", (k % 5)::DOUBLE AS used_percent, reset5 AS resets_at FROM ev WHERE NOT (k % 5 = 0 AND k % 2 = 0)
 UNION ALL SELECT account_id, us, 'seven_day', (k + 1)::DOUBLE, reset7 FROM ev""", "ev"))
def response_snapshots_ranked(spark, sf):
    return responses.snapshots_layout_b(_responses(spark, sf, "b")).select("account_id", "ts", "window", "used_percent", "resets_at")


@query("poll_changes", sql("""SELECT account_id, count(*) AS changes, sum(us) AS moments FROM (
 SELECT *, lag(k) OVER w AS pk, lag(m5) OVER w AS p5, lag(m7) OVER w AS p7 FROM (
  SELECT account_id, us, event_id, k, reset5 // 60000000 AS m5, reset7 // 60000000 AS m7 FROM ev)
  WINDOW w AS (PARTITION BY account_id ORDER BY us)) WHERE pk IS NULL OR (k % 2, m5, m7) IS DISTINCT FROM (pk % 2, p5, p7) GROUP BY account_id""", "ev"))
def poll_changes(spark, sf):
    s = D0.events(spark, sf).select("account_id", "tool", F.col("us").alias("ts"), F.inline(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit("five_hour").alias("window"), (F.col("k") % 2 * 1.0).alias("used_percent"), F.col("reset5").alias("resets_at")),
        F.struct(F.lit("all").alias("scope"), F.lit("seven_day").alias("window"), F.lit(1.0).alias("used_percent"), F.col("reset7").alias("resets_at")))))
    runs = responses.poll_changes(s)
    return runs.groupBy("account_id").agg(F.count("*").alias("changes"), F.sum(F.col("ts").cast("decimal(38,0)")).cast("double").alias("moments"))


ORACLES["poll_changes"] = ORACLES["poll_changes"].replace("sum(us) AS moments", "CAST(sum(us) AS DOUBLE) AS moments")


@query("response_archive", sql("""SELECT account_id, count(*) AS runs, CAST(sum(last_ts - first_ts) AS DOUBLE) AS spans FROM (
 SELECT account_id, run, min(us) AS first_ts, max(us) AS last_ts FROM (
  SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM (
   SELECT *, CASE WHEN k % 4 = lag(k % 4) OVER (PARTITION BY account_id ORDER BY us) THEN 0 ELSE 1 END AS new FROM ev)) GROUP BY account_id, run) GROUP BY account_id""", "ev"))
def response_archive(spark, sf):
    e = D0.events(spark, sf)
    # Identity differs on every poll and key order on every other one; neither makes a new run.
    a = F.to_json(F.struct((F.col("k") % 4).alias("x"), F.struct(F.col("user_id"), F.lit(1).alias("n")).alias("deep"), F.lit("a@b.c").alias("email")))
    b = F.to_json(F.struct(F.struct(F.lit(1).alias("n"), F.col("user_id")).alias("deep"), (F.col("k") % 4).alias("x")))
    r = e.select("account_id", "tool", F.col("us").alias("ts"), F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("body"))
    runs = responses.archive(r)
    return runs.groupBy("account_id").agg(F.count("*").alias("runs"), F.sum((F.col("last_ts") - F.col("first_ts")).cast("decimal(38,0)")).cast("double").alias("spans"))


def _share_bodies(spark, sf) -> DataFrame:
    s = D0.spread(D0.share_readings(spark, sf))
    stamp = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.struct(F.struct(stamp("as_of").alias("as_of"), stamp("window_start").alias("window_started_at"), F.col("rows")).alias(responses.SHARES_KEY))
    return s.select("account_id", "tool", F.col("as_of").alias("ts"), F.to_json(body).alias("body"))


@query("parsed_breakdowns", sql("""SELECT account_id, as_of, wstart AS window_start, 'claude_code:' || CAST(100 - chat - fresh AS BIGINT) || ',chat:' || CAST(chat AS BIGINT)
 || CASE WHEN fresh > 0 THEN ',brand_new:6' ELSE '' END AS shares, 0 AS issues FROM reads""", "reads"))
def parsed_breakdowns(spark, sf):
    b = responses.parse_breakdowns(_share_bodies(spark, sf))
    text = F.array_join(F.transform(F.sort_array("rows", asc=False), lambda r: F.concat(r["key"], F.lit(":"), r["percent"].cast("bigint").cast("string"))), ",")
    return b.select("account_id", "as_of", "window_start", text.alias("shares"), F.size("issues").alias("issues"))


@query("breakdown_issues", sql("""SELECT CASE k % 8 WHEN 0 THEN 'not_object' WHEN 1 THEN 'empty' WHEN 2 THEN 'rows_missing,empty' WHEN 3 THEN 'duplicate_key,sum_mismatch'
 WHEN 4 THEN 'bad_percent' WHEN 5 THEN 'bad_row' WHEN 6 THEN 'sum_mismatch' ELSE '' END AS issues, count(*) AS n FROM ev GROUP BY 1""", "ev"))
def breakdown_issues(spark, sf):
    forms = ['[]', '{"rows":[]}', '{}', '{"rows":[{"key":"a","percent":50},{"key":"a","percent":50}]}', '{"rows":[{"key":"a","percent":"50"}]}',
             '{"rows":[{"percent":3},{"key":"a","percent":100}]}', '{"rows":[{"key":"a","percent":50}]}', '{"rows":[{"key":"a","percent":100}]}']
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("k") % 8 + 1).cast("int"))
    r = D0.events(spark, sf).select("account_id", "tool", F.col("us").alias("ts"), F.concat(F.lit(f'{{"{responses.SHARES_KEY}":'), form, F.lit("}")).alias("body"))
    return responses.parse_breakdowns(r).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count("*").alias("n"))


@query("compacted_breakdowns", sql("SELECT account_id, as_of, last_as_of, wstart AS window_start, chat, fresh FROM brk", "brk"))
def compacted_breakdowns(spark, sf):
    b = D0.breakdowns(spark, sf)
    pct = lambda k: F.aggregate(F.filter("rows", lambda r: r["key"] == k), F.lit(0.0), lambda a, r: a + r["percent"])
    return b.select("account_id", "as_of", "last_as_of", "window_start", pct("chat").alias("chat"), pct("brand_new").alias("fresh"))


@query("rebuilt_breakdowns", sql("SELECT account_id, as_of, last_as_of FROM brk", "brk"))
def rebuilt_breakdowns(spark, sf):
    return responses.rebuild_breakdowns(responses.archive(_share_bodies(spark, sf)), PARAMS).select("account_id", "as_of", "last_as_of")


def _shape_bodies(spark, sf) -> DataFrame:
    """Bodies whose fields come and go: one per event kind, ``new`` from the 12th on, ``old`` until the 20th."""
    e = D0.events(spark, sf)
    body = F.struct(F.struct(F.col("k"), F.when(F.col("day") >= 12, 1).alias("new"), F.when(F.col("day") < 20, F.array(F.struct(F.col("k").alias("q")))).alias("old")).alias("rate"),
                    *[F.when(F.col("event_type") == t, 1).alias(t) for t in ("click", "view")])
    return e.select("account_id", "tool", F.col("us").alias("ts"), F.to_json(body).alias("body"))


_PATHS = """SELECT account_id, us, unnest(['rate', 'rate.k', CASE WHEN day >= 12 THEN 'rate.new' END, CASE WHEN day < 20 THEN 'rate.old[]' END,
 CASE WHEN day < 20 THEN 'rate.old[].q' END, CASE WHEN event_type IN ('click', 'view') THEN event_type END]) AS path FROM ev"""


@query("field_lifetimes", sql(f"""SELECT account_id, path, min(us) AS first_ts, max(us) AS last_ts FROM ({_PATHS}) WHERE path IS NOT NULL GROUP BY account_id, path""", "ev"))
def field_lifetimes(spark, sf):
    return X.field_lifetimes(responses.shape_sightings(_shape_bodies(spark, sf))).select("account_id", "path", "first_ts", "last_ts")


@query("shape_registry", sql("""SELECT account_id, substr(sha1(array_to_string(list_sort(list_filter(['rate', 'rate.k', CASE WHEN day >= 12 THEN 'rate.new' END,
 CASE WHEN day < 20 THEN 'rate.old[]' END, CASE WHEN day < 20 THEN 'rate.old[].q' END, CASE WHEN event_type IN ('click', 'view') THEN event_type END], lambda z: z IS NOT NULL)), '|')), 1, 16) AS fingerprint,
 min(us) AS first_ts, max(us) AS last_ts FROM ev GROUP BY ALL""", "ev"))
def shape_registry(spark, sf):
    s = responses.shape_sightings(_shape_bodies(spark, sf))
    halves = s.where(F.col("first_ts") % 2 == 0).unionByName(s.where(F.col("first_ts") % 2 == 1)).unionByName(s)
    return X.merge_shapes(halves).select("account_id", "fingerprint", "first_ts", "last_ts")


@query("schema_events", sql(f"""WITH p AS (SELECT account_id, path, min(us) AS f, max(us) AS l FROM ({_PATHS}) WHERE path IS NOT NULL GROUP BY account_id, path),
 b AS (SELECT account_id, min(us) AS fa, max(us) AS la FROM ev GROUP BY account_id)
SELECT account_id, min(f) AS ts, 'added' AS change, array_to_string(list_sort(list(path)), ',') AS fields FROM p JOIN b USING (account_id) WHERE f > fa + 86400000000
 GROUP BY account_id, round_even(f / 3600e6, 0)
UNION ALL SELECT account_id, max(l), 'removed', array_to_string(list_sort(list(path)), ',') FROM p JOIN b USING (account_id) WHERE l < la - 2 * 86400000000
 GROUP BY account_id, round_even(l / 3600e6, 0)""", "ev").replace("\nWITH p AS", ",\np AS"))
def schema_events(spark, sf):
    ev = X.schema_events(responses.shape_sightings(_shape_bodies(spark, sf)))
    return ev.select("account_id", "ts", "change", F.array_join("fields", ",").alias("fields"))


# -- windows ---------------------------------------------------------------------------------------

def _out(cols: str) -> str:
    return f'account_id, tool, scope, win AS "window", reset_min, {cols}'


def _digest(spark, sf):
    return _kept(spark, sf, "digest", lambda: cut(W.cycle_digest(D0.snapshots(spark, sf), PARAMS)))


def _windows(spark, sf):
    return _kept(spark, sf, "windows", lambda: tuple(cut(x) for x in W.build_windows(
        D0.snapshots(spark, sf), D0.priced(spark, sf), D0.links(spark, sf), PARAMS, keep=cut)))


@query("quota_cycles", sql(f'SELECT {_out("""reset_max, s AS start, e AS "end", first_seen, last_seen, plan_type, peak AS peak_percent, snapshots, key""")} FROM cyc', "cyc"))
def quota_cycles(spark, sf):
    c = W.cycles(W.cycle_digest(D0.snapshots(spark, sf), PARAMS), PARAMS)
    return c.select(*CYCLE, "reset_max", "start", "end", "first_seen", "last_seen", "plan_type", "peak_percent", "snapshots", "key")


@query("percent_steps", sql(f"SELECT {_out('step_no, ts, prev_ts, pct, dpct, unseg AS unsegmented')} FROM steps", "steps"))
def percent_steps(spark, sf):
    return W.steps(W.cycle_digest(D0.snapshots(spark, sf), PARAMS))


@query("attributed_requests", sql(f"SELECT {_out('id, step_no')} FROM att", "att"))
def attributed_requests(spark, sf):
    d = cut(W.cycle_digest(D0.snapshots(spark, sf), PARAMS))
    segs = W.segments(W.cycles(d, PARAMS), W.steps(d))
    return W.attribute(D0.priced(spark, sf), D0.links(spark, sf), segs, PARAMS).select(*CYCLE, "id", "step_no")


@query("segment_spend", sql(f"SELECT {_out('step_no, rate_key, val AS value, unpriced AS unpriced_requests')} FROM spend", "spend"))
def segment_spend(spark, sf):
    d = cut(W.cycle_digest(D0.snapshots(spark, sf), PARAMS))
    segs = W.segments(W.cycles(d, PARAMS), W.steps(d))
    s = W.segment_spend(W.attribute(D0.priced(spark, sf), D0.links(spark, sf), segs, PARAMS))
    return s.select(*CYCLE, "step_no", "rate_key", "value", "unpriced_requests")


@query("window_vectors", sql(f"SELECT {_out('rate_key, val AS value')} FROM vec", "vec"))
def window_vectors(spark, sf):
    return W.window_vector(_windows(spark, sf)[2])


@query("built_windows", sql(f"""SELECT {_out('''s AS start, e AS "end", plan_key, used AS used_percent, cost_at AS cost_at_snapshot, cost_far AS cost_so_far,
 unpriced AS unpriced_requests, active, unseg_pct AS unsegmented_pct''')} FROM win""", "win"))
def built_windows(spark, sf):
    w, _, _ = W.build_windows(D0.snapshots(spark, sf), D0.priced(spark, sf), D0.links(spark, sf), PARAMS, keep=cut)
    return w.select(*CYCLE, "start", "end", "plan_key", "used_percent", "cost_at_snapshot", "cost_so_far", "unpriced_requests", "active", "unsegmented_pct")


@query("filled_plans", sql(f"SELECT {_out('plan_key AS plan_type')} FROM plans", "plans"))
def filled_plans(spark, sf):
    return W.fill_plans(W.cycles(_digest(spark, sf), PARAMS)).select(*CYCLE, "plan_type")


@query("monotone_points", sql(f"SELECT {_out('ts, pct')} FROM points", "points"))
def monotone_points(spark, sf):
    w, st, _ = _windows(spark, sf)
    return W.snapshot_points(D0.snapshots(spark, sf), w, st, PARAMS)


@query("spend_at_snapshots", sql(f"""SELECT {_out('ts, pct, coalesce(CAST(pico AS DOUBLE) / 1e12, 0) AS cost')} FROM points p ASOF LEFT JOIN (
 SELECT account_id, tool, scope, win, reset_min, ts AS at, sum(pico) OVER (PARTITION BY account_id, tool, scope, win, reset_min ORDER BY ts) AS pico FROM att) a
 ON a.account_id = p.account_id AND a.tool = p.tool AND a.scope = p.scope AND a.win = p.win AND a.reset_min = p.reset_min AND a.at <= p.ts""", "points", "att")
       .replace("account_id, tool, scope, win AS", "p.account_id, p.tool, p.scope, p.win AS").replace(", reset_min, ts, pct, coalesce", ", p.reset_min, p.ts, pct, coalesce"))
def spend_at_snapshots(spark, sf):
    w, st, _ = _windows(spark, sf)
    pts = W.snapshot_points(D0.snapshots(spark, sf), w, st, PARAMS)
    att = W.attribute(D0.priced(spark, sf), D0.links(spark, sf), W.segments(w, st), PARAMS)
    return W.spend_at_snapshots(pts, att)


@query("percent_at_hours", sql("""SELECT c.account_id, c.tool, c.scope, c.win AS "window", c.reset_min, c.t, p.pct FROM
 (SELECT *, unnest([s0 + 3600000000, s0 + 2 * 3600000000, s0 + 4 * 3600000000]) AS t FROM cyc) c
 ASOF LEFT JOIN points p ON p.account_id = c.account_id AND p.tool = c.tool AND p.scope = c.scope AND p.win = c.win AND p.reset_min = c.reset_min AND p.ts <= c.t""", "cyc", "points"))
def percent_at_hours(spark, sf):
    w, st, _ = _windows(spark, sf)
    s0 = F.col("reset_min") - F.col("window_seconds") * SEC
    hours = w.select(*CYCLE, F.explode(F.array(*[s0 + h * M.HOUR for h in (1, 2, 4)])).alias("t"))
    return W.percent_at(hours, w, st)


# -- evidence --------------------------------------------------------------------------------------

def _matched(spark, sf):
    w, _, _ = _windows(spark, sf)
    return V.week_breakdowns(w.where(F.col("tool") == "timed"), V.source_shares(D0.breakdowns(spark, sf).where(F.col("tool") == "timed")), PARAMS)


def _until(spark, sf):
    return _windows(spark, sf)[0].withColumn("until", F.least("end", "last_seen"))


@query("source_shares", sql("""SELECT account_id, as_of, 100 - chat - fresh AS code, chat AS known, fresh AS unknown, chat + 0.5 AS known_hi,
 fresh + CASE WHEN fresh > 0 THEN 0.5 ELSE 0 END AS unknown_hi, noncode, noncode_err, false AS invalid FROM brk""", "brk"))
def source_shares(spark, sf):
    s = V.source_shares(D0.breakdowns(spark, sf))
    return s.select("account_id", "as_of", "code", "known", "unknown", "known_hi", "unknown_hi", "noncode", "noncode_err", "invalid")


@query("week_breakdowns", sql(f"SELECT {_out('as_of, noncode')} FROM wbrk", "wbrk"))
def week_breakdowns(spark, sf):
    return _matched(spark, sf).select(*CYCLE, "as_of", "noncode")


@query("latest_breakdowns", sql(f"SELECT {_out('as_of, noncode')} FROM lbrk", "lbrk"))
def latest_breakdowns(spark, sf):
    return V.latest_breakdown(_matched(spark, sf), PARAMS).select(*CYCLE, "b.as_of", "b.noncode")


@query("noncode_spans", sql(f"SELECT {_out('span_start, span_end, kind')} FROM noncode", "noncode"))
def noncode_spans(spark, sf):
    w, st, _ = _windows(spark, sf)
    return V.noncode_intervals(_matched(spark, sf), w, st)


@query("noncode_in_windows", sql(f"SELECT {_out('flagged, ambiguous, located')} FROM fivenon", "fivenon"))
def noncode_in_windows(spark, sf):
    w, st, _ = _windows(spark, sf)
    five = _until(spark, sf).where((F.col("tool") == "timed") & (F.col("window") == "five_hour"))
    return V.noncode_in_windows(five, V.noncode_intervals(_matched(spark, sf), w, st))


@query("gap_kinds", sql(f"SELECT {_out('''array_to_string(kinds, ',') AS kinds''')} FROM gapk", "gapk"))
def gap_kinds(spark, sf):
    return V.gap_kinds(_until(spark, sf), D0.gaps(spark, sf)).select(*CYCLE, F.array_join("gap_kinds", ",").alias("kinds"))


@query("login_changes", sql("SELECT account_id, tool, ts, login FROM logins", "logins"))
def login_changes(spark, sf):
    return D0.logins(spark, sf)


@query("window_logins", sql(f"SELECT {_out('login_n, login')} FROM wlog", "wlog"))
def window_logins(spark, sf):
    return V.window_logins(_windows(spark, sf)[0], D0.logins(spark, sf), PARAMS)


@query("claim_checks", sql(f"SELECT {_out('why AS claim_why, why IS NULL AS claimed')} FROM claimw", "claimw"))
def claim_checks(spark, sf):
    return V.claim_check(_until(spark, sf), D0.claims(spark, sf), D0.logins(spark, sf), PARAMS)


@query("claim_spans", sql("""SELECT account_id, tool, us AS start, nxt AS "end" FROM (SELECT *, lead(us) OVER (PARTITION BY account_id, tool ORDER BY us) AS nxt FROM (
 SELECT *, lag(cents > 10000) OVER (PARTITION BY account_id, tool ORDER BY us) AS p FROM ev WHERE event_type = 'purchase' AND cents > 5000)
 WHERE p IS DISTINCT FROM (cents > 10000)) WHERE cents > 10000""", "ev"))
def claim_spans(spark, sf):
    return V.claim_spans(D0.switches(spark, sf)).select("account_id", "tool", "start", "end")


@query("coverage_status", sql("""SELECT l.account_id, l.tool, true AS account_known, c.cs IS NOT NULL AND c.ce IS NULL AND c.login = l.cur AS on,
 c.cs IS NOT NULL AND c.ce IS NULL AND c.login <> l.cur AS other_account, CASE WHEN c.ce IS NULL THEN c.cs END AS since, CASE WHEN c.cs IS NULL THEN 0 ELSE 1 END AS claims
 FROM (SELECT account_id, tool, arg_max(login, ts) AS cur FROM logins GROUP BY ALL) l LEFT JOIN claims c USING (account_id, tool)""", "logins", "claims"))
def coverage_status(spark, sf):
    return V.coverage_status(D0.logins(spark, sf), D0.claims(spark, sf))


@query("claim_history", sql("""SELECT c.account_id, c.tool, cs AS start, ce AS "end", c.login = l.cur AS current_account FROM claims c
 JOIN (SELECT account_id, tool, arg_max(login, ts) AS cur FROM logins GROUP BY ALL) l USING (account_id, tool)""", "claims", "logins"))
def claim_history(spark, sf):
    return V.claim_history(D0.logins(spark, sf), D0.claims(spark, sf))


@query("weekly_samples", sql(f"SELECT account_id, tool, t, week, as_of, w, {_rounded('pp err')} FROM samples", "samples"))
def weekly_samples(spark, sf):
    w, st, _ = _windows(spark, sf)
    return r9(_samples(spark, sf, w, st), "pp", "err")


def _samples(spark, sf, w, st, matched=None):
    weekly = (F.col("window") == "seven_day") & (F.col("scope") == "all") & (F.col("tool") == "timed")
    pts = W.snapshot_points(D0.snapshots(spark, sf).where(weekly), w.where(weekly), st, PARAMS)
    return E.weekly_samples(_matched(spark, sf) if matched is None else matched, pts, w, st, PARAMS)


@query("window_splits", sql(f"SELECT {_out(_rounded('code code_low code_high') + ', round(dw, 9) AS weekly_delta, round(dn, 9) AS noncode_delta, t0, t1')} FROM split", "split"))
def window_splits(spark, sf):
    w, st, _ = _windows(spark, sf)
    s = E.split_windows(w, _samples(spark, sf, w, st), st, PARAMS)
    return r9(s.select(*CYCLE, "split.code", "split.code_low", "split.code_high", "split.weekly_delta", "split.noncode_delta",
                       F.col("split.from").alias("t0"), F.col("split.to").alias("t1")), "code", "code_low", "code_high", "weekly_delta", "noncode_delta")


@query("merged_gap_spans", sql("""SELECT account_id, min(us) AS start, max(us) + 3600000000 AS "end" FROM (
 SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM (
  SELECT *, CASE WHEN us <= lag(us) OVER (PARTITION BY account_id ORDER BY us, event_id) + 3600000000 THEN 0 ELSE 1 END AS new FROM ev WHERE event_type = 'error'))
 GROUP BY account_id, isle""", "ev"))
def merged_gap_spans(spark, sf):
    e = D0.events(spark, sf).where(F.col("event_type") == "error")
    return temporal.merge_spans(e.select("account_id", F.col("us").alias("start"), (F.col("us") + M.HOUR).alias("end")), ["account_id"])


# -- unexplained rises, quality, estimates ---------------------------------------------------------

def _no_fits(spark):
    return spark.createDataFrame([], R.FIT_SCHEMA)


def _judged(spark, sf):
    """Windows judged by their own local rates only (no group fit), with estimates."""
    def build():
        w, st, spend = _windows(spark, sf)
        w = T.fit_members(D.mark_excluded(w, D0.rules(spark, sf)), PARAMS)
        ev, matched = V.gather(w, st, D0.breakdowns(spark, sf), D0.gaps(spark, sf), D0.logins(spark, sf), D0.claims(spark, sf), PARAMS, keep=cut)
        split = E.split_windows(w, _samples(spark, sf, w, st, matched), st, PARAMS)
        known = cut(w.join(ev, CYCLE, "left").join(split, CYCLE, "left"))
        flagged, shown = R.flag_external(known, st, spend, _no_fits(spark), PARAMS, keep=cut)
        return cut(E.estimate(E.capacity(V.assess(flagged, PARAMS)), PARAMS)), cut(shown)
    return _kept(spark, sf, "judged", build)


@query("local_rates", sql(f"SELECT {_out('round(lrate, 9) AS local_rate')} FROM lrate", "lrate"))
def local_rates(spark, sf):
    _, st, spend = _windows(spark, sf)
    local = spend.where(F.col("step_no") > 0).groupBy(*CYCLE, "step_no").agg(F.sum("value").alias("local"))
    return r9(R.local_rate(st.join(local, [*CYCLE, "step_no"])), "local_rate")


@query("external_steps", sql(f"SELECT {_out('step_no, dpct, round(expected, 9) AS expected, round(external, 9) AS external, round(usd, 9) AS local_usd')} FROM ext", "ext"))
def external_steps(spark, sf):
    return r9(_judged(spark, sf)[1].select(*CYCLE, "step_no", "dpct", "expected", "external", "local_usd"), "expected", "external", "local_usd")


@query("external_windows", sql(f"SELECT {_out('round(ext_pct, 9) AS external_pct, contaminated, late AS late_external')} FROM winx", "winx"))
def external_windows(spark, sf):
    return r9(_judged(spark, sf)[0].select(*CYCLE, "external_pct", "contaminated", "late_external"), "external_pct")


@query("window_quality", sql(f"SELECT {_out('''quality, array_to_string(codes, ',') AS codes, why IS NULL AS claimed''')} FROM quality", "quality"))
def window_quality(spark, sf):
    return _judged(spark, sf)[0].select(*CYCLE, "quality", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"), "claimed")


@query("window_capacity", sql(f"""SELECT {_out(_rounded('cap cap_low cap_high') + ', confidence')} FROM (SELECT *, CASE WHEN ok THEN cost_at / (used / 100) END AS cap,
 CASE WHEN ok THEN cost_at / ((used + 0.5) / 100) END AS cap_low, CASE WHEN ok THEN cost_at / ((used - 0.5) / 100) END AS cap_high,
 CASE WHEN ok THEN CASE WHEN used >= 20 THEN 'high' WHEN used >= 5 THEN 'medium' ELSE 'low' END END AS confidence
 FROM (SELECT *, quality = 'conditional' AND used >= 1 AND cost_at > 0 AS ok FROM quality))""", "quality"))
def window_capacity(spark, sf):
    return r9(_judged(spark, sf)[0].select(*CYCLE, "cap", "cap_low", "cap_high", "confidence"), "cap", "cap_low", "cap_high")


@query("window_estimates", sql(f"SELECT {_out(_rounded('total cap cap_low cap_high conflict') + ', why_e AS est_why')} FROM est", "est"))
def window_estimates(spark, sf):
    w = _judged(spark, sf)[0]
    e = w.select(*CYCLE, "estimate.total", "estimate.cap", "estimate.cap_low", "estimate.cap_high", F.col("estimate.conflict_pct").alias("conflict"), "est_why")
    return r9(e, "total", "cap", "cap_low", "cap_high", "conflict")


@query("range_too_wide", sql(f"""SELECT {_out('''coalesce(cap_high > cap_low * 1.5, false) OR coalesce(tool = 'timed' AND win = 'five_hour' AND dw < 5, false) AS too_wide''')} FROM est
 WHERE why_e IS NULL""", "est"))
def range_too_wide(spark, sf):
    w = _judged(spark, sf)[0].where(F.col("estimate").isNotNull())
    e = F.col("estimate")
    return w.select(*CYCLE, views.range_too_wide(e["cap_low"], e["cap_high"], e["basis"], e["weekly_delta"]).alias("too_wide"))


# -- rates -----------------------------------------------------------------------------------------

def _one_regressor(spark, sf):
    w, _, spend = _windows(spark, sf)
    v = W.window_vector(spend).where(F.col("rate_key").startswith("usd:"))
    one = v.groupBy(*CYCLE).agg(F.sum("value").alias("value")).withColumn("rate_key", F.lit("usd:any"))
    return one.join(w.select(*CYCLE, "plan_key", "used_percent"), CYCLE).withColumn("basis", F.lit("observed"))


_ONE = f"""SELECT {GROUP_COLS}, sum(x * y) / sum(x * x) AS rate, count(*) AS n FROM (
 SELECT w.*, v.x, w.used AS y FROM win w JOIN (SELECT account_id, tool, scope, win, reset_min, sum(val) AS x FROM vec WHERE rate_key LIKE 'usd:%' GROUP BY ALL) v
 USING (account_id, tool, scope, win, reset_min)) GROUP BY {GROUP_COLS} HAVING count(*) > 1"""


@query("single_rate_fit", sql(f'SELECT account_id, tool, scope, win AS "window", plan_key, round(rate, 9) AS rate, n AS fit_windows FROM ({_ONE})', "win", "vec"))
def single_rate_fit(spark, sf):
    f = R.fit_rates(_one_regressor(spark, sf))
    return f.select(*GROUP, F.round(F.col("rates")[0]["rate"], 9).alias("rate"), "fit_windows")


@query("expected_rises", sql(f"""SELECT w.account_id, w.tool, w.scope, w.win AS "window", w.reset_min, round(v.x * f.rate, 9) AS expected FROM win w
 JOIN (SELECT account_id, tool, scope, win, reset_min, sum(val) AS x FROM vec WHERE rate_key LIKE 'usd:%' GROUP BY ALL) v USING (account_id, tool, scope, win, reset_min)
 JOIN ({_ONE}) f ON f.account_id = w.account_id AND f.tool = w.tool AND f.scope = w.scope AND f.win = w.win AND f.plan_key = w.plan_key""", "win", "vec"))
def expected_rises(spark, sf):
    v = _one_regressor(spark, sf)
    return r9(R.explain_vector(v, R.fit_rates(v), CYCLE).select(*CYCLE, "expected"), "expected")


#: Least squares of two regressors: where one would be negative it is none, and the other stands alone.
_TWO = f"""SELECT *, CASE WHEN a0 < 0 THEN 0 WHEN b0 < 0 THEN xt / xx ELSE a0 END AS a, CASE WHEN b0 < 0 THEN 0 WHEN a0 < 0 THEN yt / yy ELSE b0 END AS b FROM (
 SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS a0, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS b0 FROM (
  SELECT {GROUP_COLS}, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * used) AS xt, sum(y * used) AS yt, count(*) AS n, sum(nx) AS xn, sum(ny) AS yn
  FROM two GROUP BY {GROUP_COLS} HAVING sum(nx) > 1 AND sum(ny) > 1))"""


_TWO_CTES = f"""WITH two AS (SELECT w.*, v.x, v.y, v.nx, v.ny FROM win w JOIN (
  SELECT account_id, tool, scope, win, reset_min, coalesce(sum(val) FILTER (WHERE rate_key LIKE '%-click'), 0) AS x, coalesce(sum(val) FILTER (WHERE rate_key NOT LIKE '%-click'), 0) AS y,
   max((rate_key LIKE '%-click')::INT) AS nx, max((rate_key NOT LIKE '%-click')::INT) AS ny FROM vec WHERE rate_key LIKE 'usd:%' GROUP BY ALL) v
  USING (account_id, tool, scope, win, reset_min)), fit AS ({_TWO})"""


def _two_regressors(spark, sf) -> DataFrame:
    w, _, spend = _windows(spark, sf)
    v = W.window_vector(spend).where(F.col("rate_key").startswith("usd:"))
    kind = F.when(F.col("rate_key").endswith("-click"), "usd:click").otherwise("usd:other")
    two = v.groupBy(*CYCLE, kind.alias("rate_key")).agg(F.sum("value").alias("value"))
    return two.join(w.select(*CYCLE, "plan_key", "used_percent"), CYCLE).withColumn("basis", F.lit("observed"))


@query("two_rate_fit", sql(f"""{_TWO_CTES}
SELECT f.account_id, f.tool, f.scope, f.win AS "window", f.plan_key, any_value(round(f.a, 6)) AS click_rate, any_value(round(f.b, 6)) AS other_rate, any_value(f.n) AS fit_windows,
 any_value(f.xn)::BIGINT AS click_windows, any_value(f.yn)::BIGINT AS other_windows, round(median(abs(t.x * f.a + t.y * f.b - t.used) / t.used) FILTER (WHERE t.used > 0), 6) AS median_error
FROM fit f JOIN two t USING ({GROUP_COLS}) GROUP BY f.account_id, f.tool, f.scope, f.win, f.plan_key""", "win", "vec").replace("\nWITH two AS", ",\ntwo AS"))
def two_rate_fit(spark, sf):
    """Rates of two kinds of models, by the sums of their products."""
    f = R.fit_rates(_two_regressors(spark, sf)).where(F.size("rates") == 2)
    click, other = F.col("rates")[0], F.col("rates")[1]
    return f.select(*GROUP, F.round(click["rate"], 6).alias("click_rate"), F.round(other["rate"], 6).alias("other_rate"), "fit_windows",
                    click["windows"].alias("click_windows"), other["windows"].alias("other_windows"), F.round("median_error", 6).alias("median_error"))


@query("fitted_external", sql(f"""WITH f AS ({_ONE}),
x AS (SELECT w.*, f.rate, s.step_no, s.ts, CASE WHEN s.unseg THEN 0 WHEN s.usd <= 0 THEN CASE WHEN s.dpct >= 2 THEN s.dpct ELSE 0 END
   WHEN s.dpct >= 3 AND s.dpct >= 3 * f.rate * s.usd + 2 THEN s.dpct - f.rate * s.usd ELSE 0 END AS rise
  FROM win w JOIN f USING ({GROUP_COLS}) LEFT JOIN stspend s USING (account_id, tool, scope, win, reset_min)),
t AS (SELECT account_id, tool, scope, win, reset_min, used, coalesce(sum(rise), 0) AS raw, coalesce(bool_or(rise > 0 AND last_seen - ts <= 600000000), false) AS late, any_value(rate) AS rate
  FROM x GROUP BY account_id, tool, scope, win, reset_min, used),
g AS (SELECT t.*, greatest(0, used - coalesce(v.usd, 0) * rate) AS excess FROM t LEFT JOIN (SELECT account_id, tool, scope, win, reset_min, sum(val) AS usd FROM spend
  WHERE rate_key LIKE 'usd:%' AND step_no >= 0 GROUP BY ALL) v USING (account_id, tool, scope, win, reset_min))
SELECT account_id, tool, scope, win AS "window", reset_min, round(least(raw, excess, used), 6) AS external_pct, used > 0 AND least(raw, excess, used) / nullif(used, 0) >= 0.15 AS contaminated,
 late AND (raw <= excess OR excess > 0) AS late_external FROM g""", "win", "vec", "spend", "stspend").replace("\nWITH f AS", ",\nf AS"))
def fitted_external(spark, sf):
    """Rises that a fitted rate leaves unexplained, never more than the whole window leaves."""
    w, st, spend = _windows(spark, sf)
    usd = (spend.where(F.col("rate_key").startswith("usd:")).groupBy(*CYCLE, "step_no").agg(F.sum("value").alias("value"))
           .withColumn("rate_key", F.lit("usd:any")))
    fits = cut(R.fit_rates(_one_regressor(spark, sf)))
    flagged = R.flag_external(w, st, usd, fits, PARAMS)[0].join(fits.select(*GROUP), GROUP, "left_semi")
    return flagged.select(*CYCLE, F.round("external_pct", 6).alias("external_pct"), "contaminated", "late_external")


@query("normalised_values", sql(f"""{_TWO_CTES},
r AS (SELECT {GROUP_COLS}, sum(x) AS sx, sum(y) AS sy FROM two JOIN (SELECT account_id, tool, scope, win, reset_min FROM trend WHERE in_span AND NOT contaminated) USING (account_id, tool, scope, win, reset_min)
  GROUP BY {GROUP_COLS}),
m AS (SELECT *, CASE WHEN a > 0 AND sx > 0 AND (b <= 0 OR sx >= sy) THEN 'click' WHEN b > 0 AND sy > 0 THEN 'other' END AS ref FROM fit JOIN r USING ({GROUP_COLS})),
v AS (SELECT t.*, m.ref, CASE WHEN t.cap IS NOT NULL THEN CASE WHEN m.ref IS NULL THEN t.cap WHEN two.x + two.y > 0 AND two.x * m.a + two.y * m.b > 0
   THEN t.cap * ((two.x * m.a + two.y * m.b) / CASE m.ref WHEN 'click' THEN m.a ELSE m.b END) / (two.x + two.y) END END AS value
  FROM trend t LEFT JOIN m ON m.account_id = t.account_id AND m.tool = t.tool AND m.scope = t.scope AND m.win = t.win AND m.plan_key = t.plan_key
  LEFT JOIN two ON two.account_id = t.account_id AND two.tool = t.tool AND two.scope = t.scope AND two.win = t.win AND two.reset_min = t.reset_min)
SELECT account_id, tool, scope, win AS "window", reset_min, ref AS ref_model, round(value, 6) AS value, value IS NOT NULL AND NOT excluded AND conflict = 0 AND used >= 10 AND in_fit AS in_trend
FROM v""", "win", "vec", "trend").replace("\nWITH two AS", ",\ntwo AS"))
def normalised_values(spark, sf):
    """Estimates as if all had been spent on the kind of models that took the most."""
    two = cut(_two_regressors(spark, sf))
    fits = cut(R.fit_rates(two).where(F.size("rates") == 2))
    valued = T.comparable_values(_judged(spark, sf)[0], two.select(*CYCLE, "plan_key", "rate_key", "value"), fits, PARAMS)
    return valued.select(*CYCLE, "ref_model", F.round("value", 6).alias("value"), "in_trend")


@query("model_rates")
def model_rates(spark, sf):
    w, _, spend = _windows(spark, sf)
    v = W.window_vector(spend).join(w.select(*CYCLE, "plan_key", "used_percent"), CYCLE).withColumn("basis", F.lit("conditional"))
    return R.rate_rows(R.fit_rates(v)).orderBy(*GROUP, F.desc("windows"), "model")


@query("dearest_models", sql(f"""SELECT account_id, tool, scope, win AS "window", plan_key, arg_min(substr(rate_key, 5), (-v, rate_key)) AS ref_model FROM (
 SELECT {GROUP_COLS}, rate_key, sum(val) AS v FROM win JOIN vec USING (account_id, tool, scope, win, reset_min) WHERE rate_key LIKE 'usd:%' GROUP BY ALL) GROUP BY {GROUP_COLS}""", "win", "vec"))
def dearest_models(spark, sf):
    w, _, spend = _windows(spark, sf)
    v = W.window_vector(spend).join(w.select(*CYCLE, "plan_key"), CYCLE)
    flat = v.select(*GROUP, "rate_key").distinct().groupBy(*GROUP).agg(F.collect_list(F.struct("rate_key", F.lit(1.0).alias("rate"), F.lit(2).cast("bigint").alias("windows"))).alias("rates"))
    return R.reference_model(v, flat).drop("ref_rate")


# -- trend -----------------------------------------------------------------------------------------

def _verdicts(spark, sf):
    def build():
        w, _ = _judged(spark, sf)
        vec = W.window_vector(_windows(spark, sf)[2]).join(w.select(*CYCLE, "plan_key"), CYCLE)
        valued = cut(T.comparable_values(w, vec, _no_fits(spark), PARAMS))
        roles, v = T.compare(valued, vec, PARAMS)
        return cut(roles), cut(v)
    return _kept(spark, sf, "verdicts", build)


@query("fit_members", sql(f"SELECT {_out('in_span, in_span OR anchor AS in_fit')} FROM fitm", "fitm"))
def fit_members(spark, sf):
    w = D.mark_excluded(_windows(spark, sf)[0], D0.rules(spark, sf))
    return T.fit_members(w, PARAMS).select(*CYCLE, "in_span", "in_fit")


@query("trend_roles", sql(f"SELECT {_out('in_trend, role')} FROM roles", "roles"))
def trend_roles(spark, sf):
    return _verdicts(spark, sf)[0].select(*CYCLE, "in_trend", "role")


@query("trend_spread", sql('SELECT account_id, tool, scope, win AS "window", plan_key, round(spread, 9) AS spread FROM spread', "spread"))
def trend_spread(spark, sf):
    base = _verdicts(spark, sf)[0].where(F.col("role") == "baseline")
    return r9(T.robust_spread(base, GROUP, "value", PARAMS.default_spread), "spread")


@query("model_shift", sql('SELECT account_id, tool, scope, win AS "window", plan_key, round(ov, 9) AS model_overlap, before AS model_before, after AS model_after FROM overlap', "overlap"))
def model_shift(spark, sf):
    w = _verdicts(spark, sf)[0]
    vec = W.window_vector(_windows(spark, sf)[2])
    return r9(T.model_overlap(w.where(F.col("role").isNotNull()).select(*CYCLE, "plan_key", "role"), vec, PARAMS), "model_overlap")


@query("change_verdicts", sql("""SELECT account_id, tool, scope, win AS "window", plan_key, rn::BIGINT AS recent_n, bn::BIGINT AS baseline_n, cross_gap, bfrom AS baseline_from, bto AS baseline_to,
 round(rmed, 9) AS recent_median, round(bmed, 9) AS baseline_median, round(rmed / bmed, 9) AS ratio, CASE WHEN rmed IS NOT NULL AND bmed IS NOT NULL THEN round(thr, 9) END AS threshold, status FROM verdict""", "verdict"))
def change_verdicts(spark, sf):
    v = _verdicts(spark, sf)[1].select(*GROUP, "recent_n", "baseline_n", "cross_gap", "baseline_from", "baseline_to", "recent_median", "baseline_median", "ratio", "threshold", "status")
    return r9(v, "recent_median", "baseline_median", "ratio", "threshold")


@query("eligible_groups", sql(f"""SELECT account_id, tool, scope, win AS "window", plan_key, v.status IN ('stable', 'tighter', 'looser') AS eligible,
 v.status IN ('stable', 'tighter', 'looser') AND coalesce(r.dec, true) AS declared FROM verdict v LEFT JOIN (
 SELECT {GROUP_COLS}, bool_and(quality = 'conditional') FILTER (WHERE role IS NOT NULL) AS dec FROM roles GROUP BY {GROUP_COLS}) r USING ({GROUP_COLS})""", "verdict", "roles"))
def eligible_groups(spark, sf):
    w, v = _verdicts(spark, sf)
    return T.eligibility(w, v, PARAMS).select(*GROUP, "eligible", "declared")


@query("blocked_reasons", sql(f"""SELECT v.account_id, v.tool, v.scope, v.win AS "window", v.plan_key, v.shown AS status, x.code, x.n FROM shown v
 LEFT JOIN (SELECT {GROUP_COLS}, code, count(*) AS n FROM cand WHERE stuck GROUP BY {GROUP_COLS}, code) x
 ON v.status = 'insufficient' AND x.account_id = v.account_id AND x.tool = v.tool AND x.scope = v.scope AND x.win = v.win AND x.plan_key = v.plan_key""", "shown"))
def blocked_reasons(spark, sf):
    w, v = _verdicts(spark, sf)
    return T.eligibility(w, v, PARAMS).select(*GROUP, "status", F.explode_outer("blocked").alias("code", "n"))


@query("group_bounds", sql(f"""SELECT account_id, tool, scope, win AS "window", plan_key, max(last_seen) AS last_seen, max(e) AS latest_end, count(*) AS windows_n,
 count(*) FILTER (WHERE in_trend) AS estimated_n FROM roles GROUP BY {GROUP_COLS}""", "roles"))
def group_bounds(spark, sf):
    w, v = _verdicts(spark, sf)
    return T.group_rows(w, T.eligibility(w, v, PARAMS), _no_fits(spark), PARAMS).select(*GROUP, "last_seen", "latest_end", "windows_n", "estimated_n")


@query("trend_points", sql(f"SELECT {_out('key, round(cap, 9) AS value, in_trend, role, excluded')} FROM roles WHERE cap IS NOT NULL AND (e >= {NOW} - 60 * 86400000000 OR role = 'baseline')", "roles"))
def trend_points(spark, sf):
    return r9(T.trend_rows(_verdicts(spark, sf)[0], PARAMS).select(*CYCLE, "key", "value", "in_trend", "role", "excluded"), "value")


@query("trend_in_view", sql(f"""SELECT account_id, tool, scope, win AS "window", reset_min FROM (
 SELECT *, greatest(0, min(ref) OVER g * 0.75) AS lo, max(ref) OVER g * 1.25 AS hi FROM (
  SELECT *, CASE WHEN bool_or(in_trend) OVER g THEN CASE WHEN in_trend THEN v END ELSE v END AS ref FROM (SELECT *, round(cap, 2) AS v FROM roles WHERE cap IS NOT NULL AND (e >= {NOW} - 60 * 86400000000 OR role = 'baseline'))
  WINDOW g AS (PARTITION BY {GROUP_COLS})) WINDOW g AS (PARTITION BY {GROUP_COLS})) WHERE in_trend OR v BETWEEN lo AND hi""", "roles"))
def trend_in_view(spark, sf):
    return views.trend_in_view(T.trend_rows(_verdicts(spark, sf)[0], PARAMS)).select(*CYCLE)


@query("folded_trend_axis", sql(f"""SELECT {_out('round(pause / 86400e6, 9) AS pause_days, round(last_seen - coalesce(sum(pause - width) OVER (PARTITION BY account_id, tool, scope, win, plan_key ORDER BY last_seen), 0), 0) AS folded')} FROM (
 SELECT *, greatest(lim / 3.0, (max(last_seen) OVER g - min(last_seen) OVER g - coalesce(sum(pause) OVER g, 0)) * 0.06) AS width FROM (
  SELECT *, CASE WHEN gap > lim THEN gap END AS pause FROM (SELECT *, 6 * 3600000000 AS lim, last_seen - lag(last_seen) OVER (PARTITION BY {GROUP_COLS} ORDER BY last_seen) AS gap
   FROM roles WHERE cap IS NOT NULL AND (e >= {NOW} - 60 * 86400000000 OR role = 'baseline')))
 WINDOW g AS (PARTITION BY {GROUP_COLS}))""", "roles"))
def folded_trend_axis(spark, sf):
    t = views.fold_time(T.trend_rows(_verdicts(spark, sf)[0], PARAMS), 6 * M.HOUR, 6 * M.HOUR)
    return t.select(*CYCLE, F.round("pause_days", 9).alias("pause_days"), F.round("folded", 0).alias("folded"))


# -- events, alerts, views -------------------------------------------------------------------------

def _cycles(spark, sf):
    return W.cycles(_digest(spark, sf), PARAMS)


_PLAN_EV = """SELECT account_id, us AS ts, p AS plan_from, plan AS plan_to FROM (SELECT *, lag(plan) OVER (PARTITION BY account_id ORDER BY us) AS p FROM ev WHERE plan IS NOT NULL) WHERE p <> plan"""
_RESET_EV = """SELECT account_id, win, nfs AS ts, peak AS pct, reset_max AS due FROM (SELECT *, lead(first_seen) OVER (PARTITION BY account_id, tool, scope, win ORDER BY first_seen) AS nfs FROM cyc)
 WHERE nfs < reset_max - 600000000 AND last_seen <= nfs + 60000000"""


@query("plan_events", sql(_PLAN_EV, "ev"))
def plan_events(spark, sf):
    return X.plan_events(D0.snapshots(spark, sf)).select("account_id", "ts", "plan_from", "plan_to")


@query("window_events", sql("""SELECT account_id, scope, min(us) AS ts FROM (SELECT account_id, 'k' || k AS scope, us, min(us) OVER (PARTITION BY account_id) AS f FROM ev)
 GROUP BY account_id, scope, f HAVING min(us) > f + 86400000000""", "ev"))
def window_events(spark, sf):
    s = D0.snapshots(spark, sf).join(D0.events(spark, sf).select("account_id", F.col("us").alias("ts"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("sc")), ["account_id", "ts"])
    return X.window_events(s.where(F.col("window") == "five_hour").withColumn("scope", F.col("sc"))).select("account_id", "scope", "ts")


@query("early_resets", sql(f'SELECT account_id, win AS "window", ts, pct, due FROM ({_RESET_EV})', "cyc"))
def early_resets(spark, sf):
    return X.early_resets(_cycles(spark, sf)).select("account_id", "window", "ts", "pct", "due")


@query("recent_events", sql(f"""SELECT account_id, kind, ts FROM (SELECT account_id, 'plan' AS kind, ts FROM ({_PLAN_EV}) UNION ALL SELECT account_id, 'reset', ts FROM ({_RESET_EV}))
 WHERE ts >= {NOW} - 14 * 86400000000""", "ev", "cyc"))
def recent_events(spark, sf):
    shapes = spark.createDataFrame([], M.SHAPE)
    return X.all_events(D0.snapshots(spark, sf), _cycles(spark, sf), shapes, NOW, 14).select("account_id", "kind", "ts")


@query("latest_events", sql(f"""WITH p AS (SELECT account_id, path, min(us) AS f, max(us) AS l FROM ({_PATHS}) WHERE path IS NOT NULL GROUP BY account_id, path),
 b AS (SELECT account_id, min(us) AS fa, max(us) AS la FROM ev GROUP BY account_id),
 x AS (SELECT account_id, 'schema' AS kind, min(f) AS ts FROM p JOIN b USING (account_id) WHERE f > fa + 86400000000 GROUP BY account_id, round_even(f / 3600e6, 0)
 UNION ALL SELECT account_id, 'schema', max(l) FROM p JOIN b USING (account_id) WHERE l < la - 2 * 86400000000 GROUP BY account_id, round_even(l / 3600e6, 0)
 UNION ALL SELECT account_id, 'plan', ts FROM ({_PLAN_EV}) UNION ALL SELECT account_id, 'reset', ts FROM ({_RESET_EV})
 UNION ALL SELECT account_id, 'window', ts FROM (SELECT account_id, tool, min(ts) AS ts, min(min(ts)) OVER (PARTITION BY account_id, tool) AS f0 FROM snap
  GROUP BY account_id, tool, scope, win) WHERE ts > f0 + 86400000000)
SELECT account_id, kind, ts FROM x WHERE ts >= {NOW} - 30 * 86400000000 ORDER BY ts DESC, account_id, kind LIMIT 10""", "ev", "cyc", "snap").replace("\nWITH p AS", ",\np AS"))
def latest_events(spark, sf):
    """The newest ten events of all kinds; the view's fifty would be all of them here."""
    shapes = responses.shape_sightings(_shape_bodies(spark, sf))
    return X.all_events(D0.snapshots(spark, sf), _cycles(spark, sf), shapes, NOW, 30, 10).select("account_id", "kind", "ts")


@query("annotated_trend", sql(f"""SELECT g.account_id, g.tool, g.scope, g.win AS "window", g.plan_key, v.kind AS event_kind, v.ts AS event_ts FROM (
 SELECT {GROUP_COLS}, min(last_seen) AS f FROM roles WHERE cap IS NOT NULL AND (e >= {NOW} - 60 * 86400000000 OR role = 'baseline') GROUP BY {GROUP_COLS}) g
 JOIN (SELECT account_id, NULL AS ew, 'plan' AS kind, ts FROM ({_PLAN_EV}) UNION ALL SELECT account_id, win, 'reset', ts FROM ({_RESET_EV})) v
 ON v.account_id = g.account_id AND (v.ew IS NULL OR v.ew = g.win) AND v.ts >= g.f""", "roles", "ev", "cyc"))
def annotated_trend(spark, sf):
    ev = X.plan_events(D0.snapshots(spark, sf)).unionByName(X.early_resets(_cycles(spark, sf)))
    return views.annotate_trend(T.trend_rows(_verdicts(spark, sf)[0], PARAMS), ev).select(*GROUP, "event_kind", "event_ts")


@query("current_windows", sql("""SELECT account_id, tool, scope, win AS "window", reset_min, plan_key FROM (
 SELECT *, arg_max(plan_key, last_seen) OVER (PARTITION BY account_id, tool) AS cur FROM (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY account_id, tool, scope, win ORDER BY last_seen DESC, s) = 1))
 WHERE plan_key = cur""", "win"))
def current_windows(spark, sf):
    return views.current_windows(_windows(spark, sf)[0]).select(*CYCLE, "plan_key")


@query("pace_forecasts", sql(f"""SELECT {_out('''CASE WHEN ok THEN round(used / el, 9) END AS projected, CASE WHEN ok THEN round(s + (n - s) * (100 / used), 0)::BIGINT END AS exhausted_at,
 CASE WHEN ok THEN s + (n - s) * (100 / used) >= e END AS will_last''')} FROM (SELECT *, used >= 2 AND el >= 0.1 AS ok FROM (
 SELECT *, least(1, greatest(0, (n - s) / nullif(e - s, 0))) AS el FROM (SELECT *, 1705276800000000 AS n FROM win)))""", "win"))
def pace_forecasts(spark, sf):
    w = views.pace(_windows(spark, sf)[0], 1_705_276_800 * SEC)
    return w.select(*CYCLE, F.round("projected", 9).alias("projected"), "exhausted_at", "will_last")


@query("pending_spend", sql(f"SELECT {_out('round(greatest(0, cost_far - cost_at), 9) AS pending_usd')} FROM win", "win"))
def pending_spend(spark, sf):
    return r9(views.pending_spend(_windows(spark, sf)[0]).select(*CYCLE, "pending_usd"), "pending_usd")


@query("latest_windows", sql(f"""SELECT {_out('e AS "end"')} FROM win ORDER BY e DESC, account_id, tool, scope, win, reset_min LIMIT 150""", "win"))
def latest_windows(spark, sf):
    return views.latest_windows(_windows(spark, sf)[0]).select(*CYCLE, "end")


@query("live_groups", sql(f"""SELECT account_id, tool, scope, win AS "window", plan_key FROM win GROUP BY {GROUP_COLS} HAVING max(last_seen) > {NOW} - 14 * 86400000000
 AND NOT (account_id = 3 AND plan_key = 'plus')""", "win"))
def live_groups(spark, sf):
    w, v = _verdicts(spark, sf)
    g = D.mark_ignored(T.group_rows(w, T.eligibility(w, v, PARAMS), _no_fits(spark), PARAMS), D0.rules(spark, sf))
    return views.live_groups(g, NOW).select(*GROUP)


_CURRENT = """SELECT * FROM (SELECT *, arg_max(plan_key, last_seen) OVER (PARTITION BY account_id, tool) AS cur FROM (
 SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY account_id, tool, scope, win ORDER BY last_seen DESC, s) = 1)) WHERE plan_key = cur"""


@query("current_verdicts", sql(f"""SELECT w.account_id, w.tool, w.scope, w.win AS "window", w.reset_min, w.used AS used_percent, v.shown AS status, round(v.rmed / v.bmed, 9) AS ratio,
 v.status IN ('stable', 'tighter', 'looser') AS eligible FROM ({_CURRENT}) w LEFT JOIN shown v USING ({GROUP_COLS})""", "win", "shown"))
def current_verdicts(spark, sf):
    """Windows in use with the verdict of their limit and plan, in the columns that a report shows."""
    w, v = _verdicts(spark, sf)
    g = T.group_rows(w, T.eligibility(w, v, PARAMS), _no_fits(spark), PARAMS)
    shown = views.public_columns(views.with_group(views.current_windows(w), g))
    return r9(shown.select(*CYCLE, "used_percent", "status", "ratio", "eligible"), "ratio")


def _rated_groups(spark, sf) -> DataFrame:
    """Groups with the rate of all spend together, as of windows that all count."""
    w, v = _verdicts(spark, sf)
    fits = R.fit_rates(_one_regressor(spark, sf).withColumn("basis", F.lit("conditional")))
    return T.group_rows(w, T.eligibility(w, v, PARAMS), fits, PARAMS)


@query("remaining_dollars", sql(f"""SELECT w.account_id, w.tool, w.scope, w.win AS "window", w.reset_min, 'any' AS model, round(greatest(0, 100 - w.used) / f.rate, 9) AS usd,
 f.n >= 4 AS reliable FROM ({_CURRENT}) w JOIN ({_ONE}) f USING ({GROUP_COLS}) WHERE w.active AND w.used >= 5 AND f.rate > 1e-9""", "win", "vec"))
def remaining_dollars(spark, sf):
    """Dollars left in the windows in use, all with five percent or more taken for covered."""
    now = views.current_windows(_verdicts(spark, sf)[0]).withColumn("quality", F.when(F.col("used_percent") >= 5, "conditional").otherwise("waiting"))
    left = views.remaining_by_model(now, _rated_groups(spark, sf))
    return r9(left.select(*CYCLE, "model", "usd", "reliable"), "usd")


@query("live_rates", sql(f"""SELECT account_id, tool, scope, win AS "window", plan_key, 'any' AS model, 'usd' AS unit, n AS windows, round(100 / rate, 9) AS cap_if_only
 FROM ({_ONE}) JOIN (SELECT {GROUP_COLS} FROM win GROUP BY {GROUP_COLS} HAVING max(last_seen) > {NOW} - 14 * 86400000000) USING ({GROUP_COLS}) WHERE rate > 1e-9""", "win", "vec"))
def live_rates(spark, sf):
    rates = views.shown_rates(_rated_groups(spark, sf), NOW)
    return r9(rates.select(*GROUP, "model", "unit", "windows", "cap_if_only"), "cap_if_only")


@query("window_steps_detail", sql(f"""SELECT s.account_id, s.tool, s.scope, s.win AS "window", s.reset_min, step_no, dpct FROM ext s JOIN
 (SELECT * FROM win WHERE account_id = 0 AND win = 'seven_day' AND abs(e - 1705536000000000) < 10000000000) w USING (account_id, tool, scope, win, reset_min)""", "ext", "win"))
def window_steps_detail(spark, sf):
    w, shown = _judged(spark, sf)
    end = w.where((F.col("account_id") == 0) & (F.col("window") == "seven_day") & (F.abs(F.col("end") - 1_705_536_000 * SEC) < 10_000 * SEC)).agg(F.max("end").alias("e")).first()["e"]
    return views.window_detail(w, 0, "timed", "all", "seven_day", end or 0, shown).select(*CYCLE, "step_no", "dpct")


@query("alert_candidates")
def alert_candidates(spark, sf):
    w, v = _verdicts(spark, sf)
    g = T.group_rows(w, T.eligibility(w, v, PARAMS), _no_fits(spark), PARAMS)
    return A.latest_alerts(A.new_alerts(g, spark.createDataFrame([], M.ALERT), NOW))


@query("alerts_after_cooldown", sql(f"""SELECT user_id AS account_id, event_type AS "window", 'tighter' AS direction FROM ev GROUP BY user_id, event_type
 HAVING max(us) <= {NOW} - 86400000000 * 5""", "ev"))
def alerts_after_cooldown(spark, sf):
    e = D0.events(spark, sf)
    g = e.select(F.col("user_id").alias("account_id"), "tool", F.lit("").alias("scope"), F.col("event_type").alias("window"), F.lit("").alias("plan_key")).distinct()
    g = (g.withColumn("status", F.lit("tighter")).withColumn("eligible", F.lit(True)).withColumn("declared", F.lit(True)).withColumn("analysis_version", F.lit(M.ANALYSIS_VERSION))
         .withColumns({c: F.lit(0.5) for c in ("ratio", "recent_median", "baseline_median")}).withColumns({c: F.lit(4) for c in ("recent_n", "baseline_n")})
         .withColumn("ref_model", F.lit("m")).withColumn("cross_gap", F.lit(False)).withColumn("baseline_to", F.lit(NOW)))
    past = e.select(F.col("user_id").alias("account_id"), "tool", F.concat(F.lit(":"), "event_type", F.lit(":")).alias("window"), F.lit("tighter").alias("direction"), F.col("us").alias("ts"))
    out = A.new_alerts(g, past, NOW, 5 * DAY)
    return out.select("account_id", F.replace("window", F.lit(":"), F.lit("")).alias("window"), "direction")


#: Groups of users and kinds of events with verdicts made up from their sums, as tables of the report have them.
_VERDICT_ROWS = f"""SELECT *, CASE WHEN c % 3 = 0 THEN 'tighter' WHEN c % 3 = 1 THEN 'looser' ELSE 'stable' END AS status, n % 4 <> 0 AS eligible, c % 5 <> 0 AS declared,
 CASE WHEN n % 7 = 0 THEN 0 ELSE {M.ANALYSIS_VERSION} END AS version, CASE WHEN c % 3 = 0 THEN 0.5 ELSE 1.5 END AS ratio, c % 1000 + 0.3 AS recent, c % 700 + 0.7 AS baseline
 FROM (SELECT user_id, tool, event_type, count(*) AS n, sum(cents)::BIGINT AS c, max(us) AS last FROM ev GROUP BY ALL)"""


def _report_groups(spark, sf) -> DataFrame:
    g = D0.events(spark, sf).groupBy("user_id", "tool", "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("c"), F.max("us").alias("last"))
    kind = F.col("c") % 3
    return g.select(F.col("user_id").alias("account_id"), "tool", F.lit("").alias("scope"), F.col("event_type").alias("window"), F.lit("").alias("plan_key"),
                    F.when(kind == 0, "tighter").when(kind == 1, "looser").otherwise("stable").alias("status"), (F.col("n") % 4 != 0).alias("eligible"),
                    (F.col("c") % 5 != 0).alias("declared"), F.when(F.col("n") % 7 == 0, 0).otherwise(M.ANALYSIS_VERSION).alias("analysis_version"),
                    F.when(kind == 0, 0.5).otherwise(1.5).alias("ratio"), (F.col("c") % 1000 + 0.3).alias("recent_median"), (F.col("c") % 700 + 0.7).alias("baseline_median"),
                    (F.col("n") % 4 + 3).cast("int").alias("recent_n"), F.lit(5).alias("baseline_n"), F.lit("m").alias("ref_model"),
                    (F.col("n") % 3 == 0).alias("cross_gap"), F.col("last").alias("baseline_to"), F.col("last").alias("last_seen"))


@query("announced_alerts", sql(f"""SELECT user_id AS account_id, tool, ':' || event_type || ':' AS "window", status AS direction, {NOW} AS ts, ratio,
 printf('50%%; last %d windows m about $%.1f, before that 5 windows about $%.1f', n % 4 + 3, recent::DOUBLE, baseline::DOUBLE)
  || CASE WHEN n % 3 = 0 THEN '; compared with windows before ' || strftime(make_timestamp(last), '%m-%d') ELSE '' END AS detail, version AS analysis_version
 FROM ({_VERDICT_ROWS}) WHERE status <> 'stable' AND eligible AND declared AND version > 0 ORDER BY account_id, tool, "window" LIMIT 20""", "ev"))
def announced_alerts(spark, sf):
    """The latest 20 alerts of verdicts that may be announced, with their texts."""
    return A.latest_alerts(A.new_alerts(_report_groups(spark, sf), spark.createDataFrame([], M.ALERT), NOW))


@query("banner_rows", sql(f"""SELECT user_id AS account_id, tool, '' AS scope, event_type AS "window", '' AS plan_key, status, ratio, declared
 FROM ({_VERDICT_ROWS}) WHERE last > {NOW} - 14 * 86400000000 AND eligible AND status <> 'stable'""", "ev"))
def banner_rows(spark, sf):
    return views.banner_groups(_report_groups(spark, sf), NOW).select(*GROUP, "status", "ratio", "declared")


@query("data_overview", sql("""SELECT account_id, tool, plan_key, min(s) AS first, max(last_seen) AS last, count(*) AS windows, count(*) FILTER (WHERE excluded) AS ignored_windows,
 CASE WHEN account_id = 3 AND plan_key = 'plus' THEN 'ignore' ELSE 'keep' END AS mode FROM win GROUP BY account_id, tool, plan_key""", "win"))
def data_overview(spark, sf):
    w = D.mark_excluded(_windows(spark, sf)[0], D0.rules(spark, sf))
    return D.data_overview(w, D0.rules(spark, sf)).drop("deleted_at")


@query("upserted_rules", sql("""SELECT account_id, tool, 'k' || k AS target, arg_max(event_type, event_id) AS mode FROM ev GROUP BY account_id, tool, k
 HAVING arg_max(event_type, event_id) <> 'error'""", "ev"))
def upserted_rules(spark, sf):
    ch = D0.events(spark, sf).select("account_id", "tool", F.lit("window").alias("kind"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("target"),
                                     F.when(F.col("event_type") != "error", F.col("event_type")).alias("mode"), F.lit(None).cast("bigint").alias("until"), F.col("event_id").alias("seq"))
    base = ch.select(*M.RULE.fieldNames()).where(F.col("mode").isNotNull()).dropDuplicates(["account_id", "tool", "kind", "target"])
    return D.upsert_rules(base, ch).select("account_id", "tool", "target", "mode")


@query("plan_deletion", sql("""WITH g AS (SELECT * FROM win WHERE plan_key = 'basic' AND plan_type IS NOT NULL OR plan_key = 'basic')
SELECT 'snapshots' AS what, account_id, count(*) AS n FROM snap s WHERE NOT coalesce(s.plan = 'basic', false) AND NOT (s.plan IS NULL AND EXISTS (SELECT 1 FROM g WHERE g.account_id = s.account_id
  AND g.tool = s.tool AND g.scope = s.scope AND g.win = s.win AND s.resets_at BETWEEN g.reset_min - 1000000 AND g.reset_max + 1000000)) GROUP BY account_id
UNION ALL SELECT 'links', account_id, count(*) FROM lnk s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.account_id = s.account_id
  AND g.tool = s.tool AND g.scope = s.scope AND g.win = s.win AND s.resets_at BETWEEN g.reset_min - 1000000 AND g.reset_max + 1000000) GROUP BY account_id
UNION ALL SELECT 'usage', account_id, count(*) FROM usage u WHERE tool = 'timed' OR EXISTS (SELECT 1 FROM lnk s WHERE s.id = u.id AND NOT EXISTS (SELECT 1 FROM g WHERE g.account_id = s.account_id
  AND g.tool = s.tool AND g.scope = s.scope AND g.win = s.win AND s.resets_at BETWEEN g.reset_min - 1000000 AND g.reset_max + 1000000)) GROUP BY account_id""",
                            "win", "snap", "lnk", "usage").replace("\nWITH g AS", ",\ng AS"))
def plan_deletion(spark, sf):
    w = _windows(spark, sf)[0]
    u, s, k, _ = D.delete_plan(D0.usage(spark, sf), D0.snapshots(spark, sf), D0.links(spark, sf), w, D0.rules(spark, sf), "basic", NOW)
    n = lambda df, what: df.groupBy("account_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return n(s, "snapshots").unionByName(n(k, "links")).unionByName(n(u, "usage"))


# -- the full chain --------------------------------------------------------------------------------

def _analysis(spark, sf) -> Result:
    return _kept(spark, sf, "analysis", lambda: analyze(D0.inputs(spark, sf), PARAMS))


@query("analysis_windows")
def analysis_windows(spark, sf):
    return views.public_columns(_analysis(spark, sf).windows)


@query("analysis_groups")
def analysis_groups(spark, sf):
    return _analysis(spark, sf).groups


@query("analysis_trend")
def analysis_trend(spark, sf):
    return _analysis(spark, sf).trend


@query("remaining_by_model")
def remaining_by_model(spark, sf):
    r = _analysis(spark, sf)
    return views.remaining_by_model(views.current_windows(r.windows), r.groups)


@query("current_with_verdicts")
def current_with_verdicts(spark, sf):
    r = _analysis(spark, sf)
    return views.public_columns(views.with_group(views.current_windows(r.windows), r.groups))


@query("shown_rates")
def shown_rates(spark, sf):
    return views.shown_rates(_analysis(spark, sf).groups, NOW)


@query("banner_groups")
def banner_groups(spark, sf):
    return views.banner_groups(_analysis(spark, sf).groups, NOW).select(*GROUP, "status", "ratio", "declared")


# -- streams ---------------------------------------------------------------------------------------

def _arriving(df: DataFrame, turn: Column, batches: int, files: int = 4) -> DataFrame:
    """A stream of the rows of ``df`` in ``batches`` batches, by their ``turn`` (from 0); a file source goes by modification time.

    Rows are laid out by turn first, so that each batch is read once; a batch has as many files as there are cores, at least ``files``.
    """
    spark, home = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/arriving-{uuid.uuid4().hex}"
    files = max(files, spark.sparkContext.defaultParallelism)
    df.withColumn("turn", turn.cast("int")).write.partitionBy("turn").parquet(f"{home}-dealt")
    dealt = spark.read.schema(T_.StructType([*df.schema, T_.StructField("turn", T_.IntegerType())])).parquet(f"{home}-dealt")
    for k in range(batches):
        dealt.where(F.col("turn") == k).drop("turn").repartition(files).write.mode("append").parquet(home)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(home)


#: Rows of a stream by time arrive up to this much out of order.
LATE = 300 * SEC
#: Span of the driver's events, and an instant long after it.
FIRST, LAST, MUCH_LATER = 1_704_067_200 * SEC, 1_706_745_600 * SEC, 2_000_000_000 * SEC


def _by_time(df: DataFrame, batches: int, closing: dict) -> DataFrame:
    """Rows by event time, shuffled within ``LATE``, then one row of no account long after them, so that the watermark passes all."""
    late = F.col("ts") + F.pmod(F.xxhash64(*df.columns), F.lit(LATE))
    turn = F.least(F.lit(batches - 1), F.greatest(F.lit(0), F.floor((late - FIRST) * batches / F.lit(LAST - FIRST))))
    end = df.sparkSession.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    rows = df.unionByName(end)
    return _arriving(rows, F.when(F.col("ts") == MUCH_LATER, batches).otherwise(turn).cast("int"), batches + 1)


_CLOSING = dict(account_id=-1, tool="timed", scope="all", window="five_hour", direction="tighter", ts=MUCH_LATER, used_percent=0.0, resets_at=MUCH_LATER,
                window_seconds=18_000)


def _stream(spark, sf, name: str, source: Callable[[], DataFrame] | DataFrame, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a streaming job to its end over a stream, or over a table that is written as files and read back a few at a time."""
    stream = source
    if callable(source):
        src = cut(source())
        files = src.inputFiles()[0].rsplit("/", 1)[0]
        stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(files)
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    out = f"{checkpoint_dir(spark)}/stream-{table}"

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again overwrites what it wrote before.
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")
    df = job(stream)
    state.start(df, mode, write, f"{out}/cp", {"availableNow": True}).awaitTermination()
    schema = T_.StructType([*df.schema, T_.StructField("batch", T_.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


@query("streamed_hourly_rollup", sql("""SELECT us - us % 3600000000 AS bucket, account_id, tool, count(*) AS requests, CAST(sum(output_tokens) AS BIGINT) AS output_tokens
 FROM (SELECT ts AS us, account_id, tool, outp AS output_tokens FROM usage) GROUP BY 1, 2, 3""", "usage"))
def streamed_hourly_rollup(spark, sf):
    """Update mode: the last update of each bucket is its total."""
    rows = _stream(spark, sf, "rollup", lambda: D0.priced(spark, sf), lambda s: jobs.rollup(s, delay="60 days"), "update")
    last = rows.groupBy("bucket", "account_id", "tool").agg(F.max_by(F.struct("requests", "output_tokens"), "batch").alias("r"))
    return last.select("bucket", "account_id", "tool", "r.*")


@query("streamed_first_requests", sql("SELECT id, ts, model FROM usage", "usage"))
def streamed_first_requests(spark, sf):
    """Every request sent twice; one copy of each comes out."""
    twice = lambda: D0.priced(spark, sf).select("id", "ts", "model").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    rows = _stream(spark, sf, "first", twice, lambda s: jobs.drop_repeats(s, ["id"], "60 days"), "append")
    return rows.select("id", "ts", "model")


def _growing(lines: DataFrame, batches: int) -> DataFrame:
    """A stream of log lines in which every file grows from batch to batch; files and messages break off anywhere."""
    place = F.row_number().over(Window.partitionBy("account_id", "file").orderBy("block", "seq"))
    count = F.count("*").over(Window.partitionBy("account_id", "file"))
    return _arriving(lines, F.floor((place - 1) * batches / count), batches)


@query("streamed_layout_a", ORACLES["parsed_messages"])
def streamed_layout_a(spark, sf):
    """Log lines that arrive bit by bit give the requests of one import of them all."""
    out = f"{checkpoint_dir(spark)}/messages-{uuid.uuid4().hex}"
    jobs.ingest_messages(_growing(_lines_a(spark, sf), 4), f"{out}/rows", f"{out}/cp", {"availableNow": True}).awaitTermination()
    return jobs.message_usage(spark, f"{out}/rows", D0.prices(spark)).drop("tool", "session_id", "reasoning_tokens")


@query("streamed_layout_b", ORACLES["folded_requests"])
def streamed_layout_b(spark, sf):
    """Session files that grow from batch to batch keep their model, session and counters."""
    out = f"{checkpoint_dir(spark)}/sessions-{uuid.uuid4().hex}"
    jobs.ingest_sessions(_growing(_lines_b(spark, sf, False), 4), f"{out}/rows", f"{out}/cp", {"availableNow": True}).awaitTermination()
    t = jobs.session_tables(spark, f"{out}/rows", D0.prices(spark))["usage"]
    return t.select("account_id", "ts", "model", "session_id", "input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "output_tokens", "reasoning_tokens")


@query("streamed_live_windows", sql("""SELECT account_id, tool, scope, win AS "window", reset_min, reset_max, first_seen, last_seen, peak AS used_percent FROM cyc
 QUALIFY row_number() OVER (PARTITION BY account_id, tool, scope, win ORDER BY reset_min DESC) = 1""", "cyc"))
def streamed_live_windows(spark, sf):
    """After all batches the state of each limit is its newest cycle."""
    rows = _stream(spark, sf, "live", lambda: D0.snapshots(spark, sf), lambda s: state.live_windows(s, delay="60 days"), "update")
    cols = [c for c in state.LIVE.names[:9] if c not in LIMIT]
    return rows.where("not final").groupBy(*LIMIT).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*LIMIT, "r.*")


@query("streamed_ended_windows", sql("""SELECT account_id, tool, scope, win AS "window", reset_min, reset_max, first_seen, last_seen, used AS used_percent,
 round(cost_at, 9) AS cost_at_snapshot, round(cost_far, 9) AS cost_so_far, CAST(unpriced AS BIGINT) AS unpriced_requests FROM win""", "win"))
def streamed_ended_windows(spark, sf):
    """Readings and requests as two streams, out of order: the last row of every window, spend included, as by a rebuild of everything."""
    spend = state.spend_rows(D0.priced(spark, sf), D0.links(spark, sf), [("all", "five_hour"), ("all", "seven_day")])
    readings, requests = (_by_time(df, 4, _CLOSING) for df in (D0.snapshots(spark, sf), spend))
    rows = _stream(spark, sf, "ended", readings, lambda s: state.live_windows(s, requests, delay="20 minutes"), "update")
    return r9(rows.where("final and account_id >= 0").drop("batch", "final"), "cost_at_snapshot", "cost_so_far")


@query("streamed_visible_changes", sql("""SELECT account_id, tool, scope, win AS "window", ts, pct AS used_percent, reset FROM (
  SELECT *, lag((pct, reset)) OVER (PARTITION BY account_id, tool, scope, win ORDER BY ts, pct, reset) AS prev FROM (
    SELECT *, CAST(round_even(resets_at / 60e6, 0) AS BIGINT) * 60 AS reset FROM snap))
 WHERE prev IS NULL OR prev <> (pct, reset)""", "snap"))
def streamed_visible_changes(spark, sf):
    """Readings that come out of order: every change of a limit's percent or reset minute, in order."""
    rows = _stream(spark, sf, "changes", _by_time(D0.snapshots(spark, sf), 4, _CLOSING), lambda s: state.visible_changes(s, "20 minutes"), "append")
    return rows.where("account_id >= 0").drop("batch")


_COOL = 24 * 3600 * SEC


def _verdict_rows(spark, sf) -> DataFrame:
    """Purchases as announcements of verdicts."""
    e = D0.events(spark, sf).where(F.col("event_type") == "purchase")
    return e.select("account_id", "tool", F.col("scope").alias("window"), F.when(F.col("cents") > 5_000, "looser").otherwise("tighter").alias("direction"),
                    F.col("us").alias("ts"), (F.col("event_id") * 1.0).alias("ratio"))


@query("streamed_cooled_alerts", sql(f"""SELECT account_id, tool, "window", direction, ts, ratio FROM (
  WITH RECURSIVE a AS (
    SELECT account_id, tool, scope AS "window", CASE WHEN cents > 5000 THEN 'looser' ELSE 'tighter' END AS direction, us AS ts, CAST(event_id AS DOUBLE) AS ratio
    FROM ev WHERE event_type = 'purchase'),
  kept AS (
    SELECT account_id, tool, "window", direction, min(ts) AS ts FROM a GROUP BY ALL
    UNION ALL
    SELECT k.account_id, k.tool, k."window", k.direction, n.ts FROM kept k,
      LATERAL (SELECT min(a.ts) AS ts FROM a WHERE a.account_id = k.account_id AND a.tool = k.tool AND a."window" = k."window"
        AND a.direction = k.direction AND a.ts >= k.ts + {_COOL}) n WHERE n.ts IS NOT NULL)
  SELECT kept.*, (SELECT min(a.ratio) FROM a WHERE a.account_id = kept.account_id AND a.tool = kept.tool AND a."window" = kept."window"
    AND a.direction = kept.direction AND a.ts = kept.ts) AS ratio FROM kept)""", "ev"))
def streamed_cooled_alerts(spark, sf):
    """Alerts that come out of order: at most one a day for each limit and direction."""
    rows = _stream(spark, sf, "cooled", _by_time(_verdict_rows(spark, sf), 4, _CLOSING), lambda s: state.cooled_alerts(s, _COOL, "20 minutes"), "append")
    return rows.where("account_id >= 0").drop("batch")


@query("streamed_alignment", sql("""SELECT s.account_id, s.tool, s.scope, s.win AS "window", s.ts, s.pct AS used_percent, u.id AS usage_id, u.ts AS usage_ts,
 CAST(u.pico AS DOUBLE) AS cost_pico
FROM snap s LEFT JOIN priced u ON u.account_id = s.account_id AND u.tool = s.tool AND u.user_id % 3 = 0 AND u.ts BETWEEN s.ts - 600000000 AND s.ts + 600000000
WHERE s.win = 'five_hour' """, "snap", "priced"))
def streamed_alignment(spark, sf):
    """Five-hour readings and the requests of some sessions as two streams, out of order: each reading with the requests ten minutes around it, or alone.

    What meets is written by bucket; the pairs, many more, are made as the result is read.
    """
    used = D0.priced(spark, sf).where(F.col("session_id").cast("bigint") % 3 == 0).select("id", "account_id", "tool", "ts", "cost_pico")
    readings = _by_time(D0.snapshots(spark, sf).where(F.col("window") == "five_hour"), 4, _CLOSING)
    requests = _by_time(used, 4, _CLOSING)
    rows = _stream(spark, sf, "aligned", readings, lambda s: state.met_by_bucket(s, requests, delay="20 minutes"), "append")
    met = rows.where("account_id >= 0").repartition(8 * spark.sparkContext.defaultParallelism)  # small to read, much to make of it
    return _plain(state.pairs_of_buckets(met))


@query("streamed_window_refresh", sql(f"SELECT {_out('used AS used_percent, cost_at AS cost_at_snapshot, cost_far AS cost_so_far')} FROM win", "win"))
def streamed_window_refresh(spark, sf):
    """Readings and requests in two batches, one row in eight late, of all accounts: windows kept current batch by batch, as by a rebuild of everything."""
    home = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    turn = lambda df: F.when(F.pmod(F.xxhash64(*df.columns), F.lit(8)) == 0, 1).otherwise(0)
    requests = jobs.linked_requests(D0.priced(spark, sf), D0.links(spark, sf))
    a, b = (_arriving(df, turn(df), 2) for df in (D0.snapshots(spark, sf), requests))
    jobs.maintain_windows(a, b, home, PARAMS, f"{home}/cp", {"availableNow": True}).awaitTermination()
    return jobs.WindowStore(spark, home, PARAMS).windows().select(*CYCLE, "used_percent", "cost_at_snapshot", "cost_so_far")


@query("streamed_upserts", sql("""SELECT account_id, tool, id, ts, model, input_tokens, output_tokens, reasoning_tokens, pico AS cost_pico FROM (
  SELECT account_id, tool, id, ts, model, inp AS input_tokens, outp * 3 + 3 AS output_tokens, reas * 3 AS reasoning_tokens, pico * 3 AS pico FROM priced)""", "priced"))
def streamed_upserts(spark, sf):
    """Each request comes three times, with more output each time but in any order, over 18 batches: one row each, with the most it had."""
    home = f"{checkpoint_dir(spark)}/upserts-{uuid.uuid4().hex}"
    u = D0.priced(spark, sf).withColumn("n", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    for c in ("output_tokens", "reasoning_tokens", "cost_pico"):
        u = u.withColumn(c, ((F.col(c) + (1 if c == "output_tokens" else 0)) * F.col("n")).cast("bigint"))
    u = u.drop("n").select(*M.USAGE.fieldNames())
    stream = _arriving(u, F.pmod(F.xxhash64(*u.columns), F.lit(18)).cast("int"), 18, files=2)
    jobs.upsert_usage(stream, home, f"{home}-cp", {"availableNow": True}).awaitTermination()
    return jobs.upserted_usage(spark, home).select("account_id", "tool", "id", "ts", "model", "input_tokens", "output_tokens", "reasoning_tokens", "cost_pico")
