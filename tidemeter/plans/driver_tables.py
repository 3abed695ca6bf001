"""The driver's ``events`` table seen as metering data (accounts, requests, percent readings, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter import model as M
from tidemeter.model import SEC, Params
from tidemeter.operators.evidence import compact_breakdowns, login_changes
from tidemeter.operators.pricing import price_usage
from tidemeter.plans.analysis import Inputs
from tidemeter.session import cut

NOW = 1_706_659_200 * SEC          # 2024-01-31 00:00 UTC
SHIFT_DAY = 1_705_708_800 * SEC    # 2024-01-20: five-hour resets move by two hours from here on
FIVE, WEEK = 18_000 * SEC, 604_800 * SEC
PARAMS = Params(now=NOW)
#: Rows of a task that does costly work on each.
ROWS = 100_000

# (kind, input, output, cache read, cache write, 1 h write, tier, fast) in micro-dollars per million tokens.
PRICES = [
    ("click", 2_000_000, 10_000_000, 200_000, None, None, (8_000, 4_000_000, 15_000_000), None),
    ("view", 4_000_000, 20_000_000, 400_000, 5_000_000, None, None, (8_000_000, 40_000_000, 800_000, 10_000_000)),
    ("purchase", 1_000_000, 5_000_000, None, None, None, None, None),
    ("signup", 3_000_000, 15_000_000, 300_000, 3_750_000, 6_000_000, None, None),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan before costly per-row work: a task for every ``ROWS`` rows, at least one a core; a scan of so many splits stays as it is."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def prices(spark: SparkSession) -> DataFrame:
    rows = []
    for head, kinds in (("claude", 4), ("gpt", 3)):
        for kind, i, o, r, w, w1, tier, fast in PRICES[:kinds]:
            rows.append((f"{head}-{kind}", i, o, r, w, w1, [(tier[0], tier[1], tier[2], None, None, None)] if tier else None,
                         (*fast, None) if fast else None, "catalog", None))
    return spark.createDataFrame(rows, M.PRICE)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = F.col("user_id") % 2 == 0
    e = e.select("event_id", (F.col("user_id") % 4).alias("account_id"), "user_id", "event_type", us.alias("us"),
                 F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
                 F.round(F.col("value") * 100).cast("bigint").alias("cents"),
                 F.when(timed, "timed").otherwise("linked").alias("tool"),
                 F.when(timed, "all").otherwise("codex").alias("scope"), F.dayofmonth("ts").alias("day"))
    off = F.when(F.col("us") >= SHIFT_DAY, 7_200 * SEC).otherwise(0)
    return (e.withColumn("start5", F.col("us") - (F.col("us") - off) % FIVE).withColumn("start7", F.col("us") - F.col("us") % WEEK)
            .withColumn("reset5", F.col("start5") + FIVE + F.col("event_id") % 3 * SEC)
            .withColumn("reset7", F.col("start7") + WEEK + F.col("event_id") % 3 * SEC)
            .withColumn("model", F.when(F.col("event_type") == "error", "vendor/error").otherwise(
                F.concat(F.when(timed, "claude-").otherwise("gpt-"), "event_type")))
            .withColumn("plan", F.when(F.col("day") == 10, F.lit(None)).when(F.col("day") < 16, "basic").otherwise("plus")))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id"), F.col("k")
    return events(spark, sf_dir).select(
        F.concat(F.lit("e"), i.cast("string")).alias("id"), "account_id", "tool", F.col("us").alias("ts"), "model",
        (F.col("event_type") != "error").alias("on_plan"), F.col("user_id").cast("string").alias("session_id"),
        (k * 100 + 50).alias("input_tokens"), F.col("cents").alias("cache_read_tokens"),
        (i % 7 * 10).alias("cache_write_5m_tokens"), (i % 5 * 10).alias("cache_write_1h_tokens"),
        (i % 11 * 20 + k).alias("output_tokens"), (i % 3).alias("reasoning_tokens"),
        F.when(i % 10 == 0, "fast").otherwise("standard").alias("speed"))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_usage(usage(spark, sf_dir), prices(spark))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One five-hour and one weekly reading per event; the percent follows elapsed time, with dips and jumps.

    From the 28th on account 1 burns its five-hour quota half again as fast.
    """
    def reading(window: str, start: str, reset: str, span: int, rate: Column, noise: int) -> Column:
        pct = (F.col("us") - F.col(start)) * rate / F.lit(span)
        noisy = F.floor(pct).cast("bigint") + F.col("k") % noise - F.when(F.col("event_id") % 13 == 0, 6).otherwise(0)
        return F.struct(F.lit(window).alias("window"), F.least(F.lit(100), F.greatest(F.lit(0), noisy)).cast("double").alias("used_percent"),
                        F.col(reset).alias("resets_at"), F.lit(span // SEC).cast("bigint").alias("window_seconds"))
    return events(spark, sf_dir).select(
        "account_id", "tool", "scope", F.col("us").alias("ts"), F.col("plan").alias("plan_type"), F.lit("log").alias("source"),
        F.inline(F.array(
            reading("five_hour", "start5", "reset5", FIVE, F.when((F.col("account_id") == 1) & (F.col("day") >= 28), 45).otherwise(30), 3),
            reading("seven_day", "start7", "reset7", WEEK, F.lit(100), 7))),
    ).select(*M.SNAPSHOT.fieldNames())


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("tool") == "linked")
    return e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("usage_id"), "account_id", "tool", "scope",
                    F.inline(F.array(F.struct(F.lit("five_hour").alias("window"), F.col("reset5").alias("resets_at")),
                                     F.struct(F.lit("seven_day").alias("window"), F.col("reset7").alias("resets_at")))))


def shares(e: DataFrame) -> DataFrame:
    """Weekly source shares of view events: chat drifts every six hours, a new product shows up some days."""
    chat = F.expr("us div 21600000000 % 9").cast("double")
    fresh = F.when(F.expr("us div 86400000000 % 7 = 3"), 6.0).otherwise(0.0)
    row = lambda key, pct: F.struct(F.lit(key).alias("key"), F.lit(key).alias("display_name"), pct.alias("percent"))
    rows = F.filter(F.array(row("brand_new", fresh), row("chat", chat), row("claude_code", 100 - chat - fresh)),
                    lambda r: (r["key"] != "brand_new") | (r["percent"] > 0))
    return e.where(F.col("event_type") == "view").select(
        "account_id", "tool", F.lit("seven_day").alias("window"), F.col("us").alias("as_of"),
        (F.col("start7") + F.col("event_id") % 3 * SEC).alias("window_start"), rows.alias("rows"),
        F.array().cast("array<string>").alias("issues"))


def share_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(events(spark, sf_dir))


def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_breakdowns(share_readings(spark, sf_dir), PARAMS, keep=cut)


def login_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when((F.col("account_id") == 2) & (F.col("day") >= 12), "b").otherwise("a")
    return events(spark, sf_dir).where(F.col("event_type") == "click").select(
        "account_id", "tool", F.col("us").alias("ts"), F.concat(F.lit("L"), F.col("account_id").cast("string"), half).alias("login"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return login_changes(login_sightings(spark, sf_dir))


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage switches from purchases: above 100 dollars on, above 50 off."""
    e = events(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.col("cents") > 5_000))
    return e.select("account_id", "tool", F.col("us").alias("ts"),
                    F.concat(F.lit("L"), F.col("account_id").cast("string"), F.lit("a")).alias("login"), (F.col("cents") > 10_000).alias("on"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts 0-2 claim full coverage from their first click on; account 1 stops on its first click after the 25th."""
    e = login_sightings(spark, sf_dir).where(F.col("account_id") < 3)
    stop = F.min(F.when((F.col("account_id") == 1) & (F.col("ts") >= 1_706_140_800 * SEC), F.col("ts")))
    return e.groupBy("account_id", "tool").agg(F.min("login").alias("login"), F.min("ts").alias("start"), stop.alias("end"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where((F.col("event_type") == "error") & (F.col("cents") > 20_000))
    return e.select("account_id", "tool", F.col("us").alias("start"), (F.col("us") + 600 * SEC).alias("end"),
                    F.when(F.col("event_id") % 2 == 0, "read_error").otherwise("parse_error").alias("kind"),
                    F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(": x")).alias("detail"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored windows from dear purchases; the plus plan of account 3 is ignored."""
    e = events(spark, sf_dir).where((F.col("event_type") == "purchase") & (F.col("cents") > 25_000))
    w = e.select("account_id", "tool", F.lit("window").alias("kind"),
                 F.concat_ws(":", "scope", F.lit("five_hour"), ((F.col("start5") + FIVE) / SEC).cast("bigint").cast("string")).alias("target"),
                 F.lit("ignore").alias("mode"), F.lit(None).cast("bigint").alias("until")).distinct()
    plan = spark.createDataFrame([(3, "linked", "plan", "plus", "ignore", None)], M.RULE)
    return w.unionByName(plan)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    a = (spark, sf_dir)
    return Inputs(spark, usage=priced(*a), snapshots=snapshots(*a), links=links(*a), breakdowns=breakdowns(*a),
                  claims=claims(*a), logins=logins(*a), gaps=gaps(*a), rules=rules(*a))
