"""Cost of token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.models import price_name
from daybook.functions.tokens import round4, zero_if_null
from daybook.session import is_small


def price_turns(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """turns with cost_usd and pricing_version. A price is looked up by the model's name, then by its
    plain name; an unpriced model costs NULL but keeps the version of its agent's list."""
    rate = F.struct("price_in", "price_out", "write_mult", "write_1h_mult", "read_mult")
    rates = prices.select("agent", "model", rate.alias("_r"))
    by_name = rates.select("agent", "model", F.col("_r").alias("_exact"))
    by_plain = rates.select("agent", F.col("model").alias("_plain"), F.col("_r").alias("_near"))
    versions = prices.groupBy("agent").agg(F.max("version").alias("_version"))
    # One check covers the three tables: none is longer than the price list.
    side = F.broadcast if is_small(prices) else (lambda df: df)
    found = (
        turns.drop("cost_usd", "pricing_version")
        .withColumn("_plain", price_name(F.col("model")))
        .join(side(by_name), ["agent", "model"], "left")
        .join(side(by_plain), ["agent", "_plain"], "left")
        .join(side(versions), "agent", "left")
        .withColumn("_r", F.coalesce("_exact", "_near"))
    )
    write = zero_if_null("cache_create")
    hour = F.least(zero_if_null("cache_create_1h"), write)
    price_in = F.col("_r.price_in")
    usd = (
        zero_if_null("input") * price_in
        + zero_if_null("output") * F.col("_r.price_out")
        + (write - hour) * price_in * F.col("_r.write_mult")
        + hour * price_in * F.col("_r.write_1h_mult")
        + zero_if_null("cache_read") * price_in * F.col("_r.read_mult")
    ) / F.lit(1000000.0)
    keep = [c for c in turns.columns if c not in ("cost_usd", "pricing_version")]
    return found.select(*keep, round4(usd).alias("cost_usd"), F.col("_version").alias("pricing_version"))
