"""Token vectors and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = ("input", "output", "cache_create", "cache_create_1h", "cache_read", "reasoning")
# Fields that make a vector non-zero; the 1 h share is part of cache_create.
COUNTED = ("input", "output", "cache_create", "cache_read", "reasoning")
BILLED = ("input", "output", "cache_create", "cache_read")


def zero_if_null(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(0).cast("bigint"))


def any_tokens() -> Column:
    return F.greatest(*[zero_if_null(t) for t in COUNTED]) > 0


def billed_tokens() -> Column:
    return sum((zero_if_null(t) for t in BILLED[1:]), zero_if_null(BILLED[0]))


def token_sums(names: tuple[str, ...] = TOKENS) -> list[Column]:
    return [F.sum(zero_if_null(t)).alias(t) for t in names]


def round_half_up(col: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(col + F.lit(0.5)).cast("bigint")


def round4(col: Column) -> Column:
    return F.floor(col * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)


def money_sum(col: Column | str) -> Column:
    """Exact sum of amounts kept at 4 decimals, independent of row order; NULL if all are NULL."""
    value = F.col(col) if isinstance(col, str) else col
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def cache_hit_ratio() -> Column:
    side = F.col("input") + F.col("cache_read") + F.col("cache_create")
    return F.when(side > 0, F.col("cache_read") / side).otherwise(F.lit(0.0))
