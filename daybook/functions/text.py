"""Display formats and text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.tokens import round_half_up

NOT_AVAILABLE = "—"


def duration_label(ms: Column) -> Column:
    """1h05 from one hour on, else 5min."""
    minutes = round_half_up(ms / F.lit(60000.0))
    hours = F.floor(minutes / 60).cast("bigint")
    rest = F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), rest)).otherwise(
        F.concat(minutes.cast("string"), F.lit("min"))
    )


def count_label(n: Column) -> Column:
    """3.4M, 1.2k or the number itself; one decimal, halves up."""

    def tenths(unit: int) -> Column:
        t = F.floor((n + unit // 20) / (unit // 10)).cast("bigint")
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    return (
        F.when(n >= 1_000_000, F.concat(tenths(1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(tenths(1_000), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, 0 for an empty whole."""
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def share_label(part: Column, whole: Column) -> Column:
    return F.when(
        whole > 0, F.concat(round_half_up(part / whole * 100).cast("string"), F.lit("% of time"))
    ).otherwise(F.lit(NOT_AVAILABLE))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def line_breaks(text: Column) -> Column:
    """Lines an inserted text adds."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
