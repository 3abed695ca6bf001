"""Price catalogue from nested provider JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.model import PRICE, PRICE_FIELDS

# Providers whose models are priced.
PROVIDERS = ["anthropic", "openai"]

_COST_T = ",".join(f"{f}:double" for f in PRICE_FIELDS)
_TIERED = f"struct<{_COST_T},tiers:array<struct<tier:struct<type:string,size:bigint>,{_COST_T}>>>"
_FAST = f"struct<modes:struct<fast:struct<cost:struct<{_COST_T}>>>>"
PROVIDER_SCHEMA = f"map<string,struct<models:map<string,struct<cost:{_TIERED},experimental:{_FAST}>>>>"
ENTRY_SCHEMA = f"struct<{_COST_T},tiers:array<struct<size:bigint,{_COST_T}>>,fast:struct<{_COST_T}>,same_as:string>"


def _micro(at: str | Column) -> list[Column]:
    get = (lambda f: F.col(f"{at}.{f}")) if isinstance(at, str) else (lambda f: at[f])
    return [F.round(get(f) * 1_000_000).cast("bigint").alias(f) for f in PRICE_FIELDS]


def read_provider_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue file whose keys are providers and models."""
    return provider_catalog(spark.read.text(path, wholetext=True))


def provider_catalog(bodies: DataFrame) -> DataFrame:
    """Catalogue rows from provider JSON text (``value``): context tiers and fast mode included."""
    raw = bodies.select(F.explode(F.from_json("value", PROVIDER_SCHEMA)).alias("provider", "p")).where(F.col("provider").isin(PROVIDERS))
    m = raw.select(F.explode("p.models").alias("model", "m")).where(
        F.col("m.cost.input").isNotNull() & F.col("m.cost.output").isNotNull())
    context = F.filter("m.cost.tiers", lambda t: t["tier"]["type"] == "context")
    tiers = F.transform(context, lambda t: F.struct(t["tier"]["size"].alias("size"), *_micro(t)))
    fast = F.col("m.experimental.modes.fast.cost")
    return m.select(F.lower("model").alias("model"), *_micro("m.cost"),
                    F.when(F.size(tiers) > 0, tiers).alias("tiers"), F.when(fast.isNotNull(), F.struct(*_micro(fast))).alias("fast"),
                    F.lit("catalog").alias("source"), F.lit(None).cast("string").alias("alias_of")).select(*PRICE.fieldNames())


def read_price_file(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(price rows, alias rows) of a ``{"models": {name: entry}}`` file."""
    return price_entries(spark.read.text(path, wholetext=True), source)


def price_entries(bodies: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(price rows, alias rows) of ``{"models": {name: entry}}`` JSON text.

    An entry is a price or ``{"same_as": name}``; entries that are neither are left out when layers merge.
    """
    rows = bodies.select(F.explode(F.from_json("value", f"struct<models:map<string,{ENTRY_SCHEMA}>>")["models"]).alias("model", "e"))
    tiers = F.transform("e.tiers", lambda t: F.struct(t["size"].alias("size"), *_micro(t)))
    prices = rows.where(F.col("e.same_as").isNull()).select(
        "model", *_micro("e"), tiers.alias("tiers"), F.when(F.col("e.fast").isNotNull(), F.struct(*_micro("e.fast"))).alias("fast"),
        F.lit(source).alias("source"), F.lit(None).cast("string").alias("alias_of")).select(*PRICE.fieldNames())
    return prices, rows.where(F.col("e.same_as").isNotNull()).select("model", F.col("e.same_as").alias("same_as"))
