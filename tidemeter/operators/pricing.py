"""Price catalogue and request cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemeter.functions.scalars import base_name, undated, without_effort
from tidemeter.model import PRICE_FIELDS
from tidemeter.session import at_most

# A price list is a vendor catalogue; past this many names the lookups become ordinary shuffled joins.
CATALOG_BROADCAST_ROWS = 20_000

_TOKENS = ["input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens"]


def merge_layers(layers: list[DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """Price layers, later ones winning; rows without input or output are dropped.

    ``aliases`` (model, same_as) belong to the last layer: each takes the price of the first candidate
    name found among the other rows, and is dropped if none is.
    """
    ranked = reduce(DataFrame.unionByName, [df.withColumn("__layer", F.lit(i)) for i, df in enumerate(layers)])
    ranked = (ranked.where(F.col("input").isNotNull() & F.col("output").isNotNull())
              .withColumn("model", F.lower("model")))
    cols = layers[0].columns
    merged = (ranked.groupBy("model").agg(F.max_by(F.struct(*[c for c in cols if c != "model"]), "__layer").alias("p"))
              .select("model", "p.*").select(*cols))
    if aliases is None:
        return merged
    found = lookup(aliases.select(F.lower("model").alias("name"), F.col("same_as")), merged, "same_as")
    renamed = found.where(F.col("price").isNotNull()).select(
        F.col("name").alias("model"), *[F.col(f"price.{c}").alias(c) for c in cols if c not in ("model", "source", "alias_of")],
        F.lit("override").alias("source"), F.col("same_as").alias("alias_of"))
    return merged.join(renamed.select("model"), "model", "left_anti").select(*cols).unionByName(renamed.select(*cols))


def catalog_version(prices: DataFrame) -> DataFrame:
    """Content hash of the catalogue, whatever its row order: 32-bit slices of the row hashes, summed."""
    rows = prices.select(F.sha2(F.to_json(F.struct("model", *PRICE_FIELDS, "tiers", "fast", "alias_of")), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return rows.agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), *parts)).alias("version"))


def lookup(df: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Add ``price_key`` and ``price`` of the first lookup candidate that the catalogue has.

    One pass over the rows, one probe of the (counted, broadcast) catalogue per candidate; the looser
    names are only worked out for rows that the stricter ones left without a price.
    """
    fits = at_most(prices, CATALOG_BROADCAST_ROWS)
    out = df.withColumn("__name", base_name(model))
    missed = lambda *ps: reduce(lambda a, b: a & b, [F.col(p).isNull() for p in ps])
    names = [F.col("__name"), F.when(missed("__p0"), undated(F.col("__name"))),
             F.when(missed("__p0", "__p1"), without_effort(undated(F.col("__name"))))]
    for i, name in enumerate(names):
        side = prices.select(F.col("model").alias(f"__k{i}"), F.struct(*prices.columns).alias(f"__p{i}"))
        out = out.join(F.broadcast(side) if fits else side, name == F.col(f"__k{i}"), "left")
    return out.select(*df.columns, F.coalesce("__k0", "__k1", "__k2").alias("price_key"),
                      F.coalesce("__p0", "__p1", "__p2").alias("price"))


def cost_pico(price: str = "price", speed: str = "speed") -> Column:
    """Request cost in pico-dollars; NULL without a price.

    A fast request uses the fast price where there is one.  Otherwise each context tier whose size is
    strictly below the prompt replaces the fields it has, larger tiers last.  Missing cache prices
    fall back to input (read), 1.25 x input (5-minute write) and 2 x input (1-hour write).
    """
    prompt = reduce(lambda a, b: a + b, [F.col(c) for c in _TOKENS[:4]])
    fast = (F.col(speed) == "fast") & F.col(f"{price}.fast").isNotNull()
    hit = F.array_sort(F.filter(F.col(f"{price}.tiers"), lambda t: prompt > t["size"]))

    def rate(field: str) -> Column:
        base = F.col(f"{price}.{field}")
        own = F.filter(F.transform(hit, lambda t: t[field]), lambda v: v.isNotNull())
        # try_element_at gives NULL for an empty list, where element_at would fail.
        tiered = F.coalesce(F.try_element_at(own, F.lit(-1)), base)
        plain = F.when(F.size(F.col(f"{price}.tiers")) > 0, tiered).otherwise(base)
        return F.when(fast, F.coalesce(F.col(f"{price}.fast.{field}"), base)).otherwise(plain)

    inp = rate("input")
    read = F.coalesce(rate("cache_read"), inp)
    write = F.coalesce(rate("cache_write"), (inp * 5 / 4).cast("bigint"))
    write_1h = F.coalesce(rate("cache_write_1h"), inp * 2)
    rates = [inp, read, write, write_1h, rate("output")]
    return reduce(lambda a, b: a + b, [F.col(t) * r for t, r in zip(_TOKENS, rates)])


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(Re)price every request from the catalogue."""
    return (lookup(usage.drop("cost_pico", "price_key", "price"), prices)
            .withColumn("cost_pico", cost_pico()).drop("price", "price_key"))


def reprice_if_changed(usage: DataFrame, prices: DataFrame, stored_version: str | None) -> tuple[DataFrame, str]:
    """Recompute all cost when the catalogue's content hash differs from the stored one."""
    version = catalog_version(prices).first()["version"]  # one scalar
    return (usage if version == stored_version else price_usage(usage, prices)), version


def used_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Models in use with request counts, last use and the price they resolve to."""
    used = usage.groupBy("tool", "model", "on_plan").agg(F.count("*").alias("requests"), F.max("ts").alias("last_used"))
    return lookup(used, prices)


def unpriced_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """On-plan models in use that have no price at all."""
    return used_models(usage, prices).where(F.col("on_plan") & F.col("price_key").isNull()).drop("price", "price_key")


def catalog_requests(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Every catalogue entry with the requests priced by it."""
    used = (used_models(usage, prices).where(F.col("price_key").isNotNull())
            .groupBy(F.col("price_key").alias("model")).agg(F.sum("requests").alias("requests")))
    return prices.join(used, "model", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))


def price_display(used: DataFrame) -> DataFrame:
    """Display fields of :func:`used_models` rows: shown prices and what they rest on."""
    dollars = lambda f: F.col(f"price.{f}") / F.lit(1e6)
    known = F.col("price").isNotNull()
    hour = F.coalesce(dollars("cache_write_1h"), F.when(F.lower("model").startswith("claude-"), dollars("input") * 2))
    return used.where("on_plan").select(
        "tool", "model", "requests",
        dollars("input").alias("input"), dollars("output").alias("output"), dollars("cache_read").alias("cache_read"),
        dollars("cache_write").alias("cache_write"),
        F.when(dollars("cache_write").isNotNull(), hour).alias("cache_write_1h"),
        F.when(known & (F.col("price_key") != F.col("model")), F.col("price_key")).alias("priced_as"),
        F.col("price.alias_of").alias("alias_of"),
        F.when(F.size("price.tiers") > 0, F.col("price.tiers")[0]["size"]).alias("tier_size"),
        (known & F.col("price.fast").isNotNull()).alias("has_fast"),
        F.when(F.col("price.source") != "catalog", F.col("price.source")).alias("source"),
        (~known).alias("no_price"))
