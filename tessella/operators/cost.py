"""Usage and prices (J11, M7, M8, A18, A20, W10, F23, X7). Prices are a table: (model, input_rate, output_rate) in USD per
million tokens. Sums stay binary64, as the figures they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_WRITE, CACHE_READ = 1.25, 0.10
COUNTERS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def model_key(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """the price row of a model as named, else of its name without a date of eight digits. The price table has a row per
    model, so it is small; the planner broadcasts it by its size."""
    named = calls.withColumn("_name", F.trim("model"))
    exact = prices.select(F.col("model").alias("_a"), F.col("input_rate").alias("_ai"), F.col("output_rate").alias("_ao"))
    short = prices.select(F.col("model").alias("_b"), F.col("input_rate").alias("_bi"), F.col("output_rate").alias("_bo"))
    both = named.join(exact, F.col("_name") == F.col("_a"), "left").join(short, F.regexp_replace("_name", "-[0-9]{8}$", "") == F.col("_b"), "left")
    return both.withColumns({"model_key": F.coalesce("_a", "_b", "_name"), "input_rate": F.coalesce("_ai", "_bi"), "output_rate": F.coalesce("_ao", "_bo")}).drop("_name", "_a", "_b", "_ai", "_ao", "_bi", "_bo")


def cost() -> Column:
    """M7."""
    n = [F.coalesce(c, F.lit(0)) for c in COUNTERS]
    total = n[0] * F.col("input_rate") + n[1] * F.col("output_rate") + n[2] * F.col("input_rate") * CACHE_WRITE + n[3] * F.col("input_rate") * CACHE_READ
    return F.coalesce(total / 1e6, F.lit(0.0))


def price(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with ``model_key``, ``priced`` and ``cost_usd`` (0 where the model has no price)."""
    return model_key(calls, prices).withColumn("priced", F.col("input_rate").isNotNull()).withColumn("cost_usd", cost())


def session_totals(priced: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, cost and unpriced calls per session."""
    return priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS], F.sum("cost_usd").alias("cost_usd"), F.count_if(~F.col("priced")).alias("unpriced_calls"))


def running_totals(priced: DataFrame, session: str, order: str) -> DataFrame:
    """Cost and tokens so far within a session."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tokens = sum((F.coalesce(c, F.lit(0)) for c in COUNTERS), F.lit(0))
    return priced.withColumn("cost_so_far", F.sum("cost_usd").over(w)).withColumn("tokens_so_far", F.sum(tokens).over(w))


def estimate_tokens(*texts: Column | str) -> Column:
    """Characters of all parts, by four."""
    return F.floor(sum((F.length(F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit(""))) for t in texts), F.lit(0)) / 4)


def input_cost(tokens: Column | str) -> Column:
    """M8: null without a price."""
    return (F.col(tokens) if isinstance(tokens, str) else tokens) * F.col("input_rate") / 1e6
