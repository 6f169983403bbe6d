"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.tokens import round_half_up


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, n: str, width: int) -> DataFrame:
    """keys, median from one row per (keys, value) with its count n; value is a whole number.

    Running counts over buckets of `width` values find the buckets holding the middle ranks; only
    those buckets are then searched value by value. Windows see buckets or one bucket, never a group.
    """
    keys = list(keys)
    bucketed = counts.withColumn("_bucket", F.floor(F.col(value) / width).cast("bigint"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    middle = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum(n).alias("_in_bucket"))
        .withColumn("_below", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_in_bucket").over(W.partitionBy(*keys)))
        .withColumn("_low", F.floor((F.col("_all") + 1) / 2))
        .withColumn("_high", F.floor((F.col("_all") + 2) / 2))
        .where("(_below < _low and _low <= _below + _in_bucket) or (_below < _high and _high <= _below + _in_bucket)")
        .select(*keys, "_bucket", "_below", "_low", "_high")
    )
    within = W.partitionBy(*keys, "_bucket").orderBy(value)
    ranked = bucketed.join(middle, [*keys, "_bucket"]).withColumn(
        "_to", F.col("_below") + F.sum(n).over(within.rowsBetween(W.unboundedPreceding, 0))
    )

    def at(rank: str):
        return F.max(F.when((F.col("_to") - F.col(n) < F.col(rank)) & (F.col(rank) <= F.col("_to")), F.col(value)))

    return (
        ranked.groupBy(*keys)
        .agg(at("_low").alias("_lo"), at("_high").alias("_hi"))
        .select(*keys, round_half_up((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
    )
