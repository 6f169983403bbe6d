"""Rolling periods ending now. Each row falls in one age band; aggregates per band are small, and
periods are formed from them, so the log is read once and no row is repeated per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.when import DAY_MS, epoch_ms, instant

# Periods with their days, from narrow to wide; "all" starts at the epoch.
PERIODS = ("day", "week", "month", "all")
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30}
BAND = "band"


def band_of(ts: Column, now) -> Column:
    """Index of the narrowest period holding ts; NULL before the epoch or without a valid time."""
    moment = instant(now)
    band = F.when(F.lit(False), F.lit(0))
    for i, period in enumerate(PERIODS[:-1]):
        start = moment - F.make_dt_interval(F.lit(PERIOD_DAYS[period]))
        band = band.when(ts >= start, F.lit(i))
    return band.when(ts >= F.timestamp_seconds(F.lit(0)), F.lit(len(PERIODS) - 1))


def since_ms(period: Column, now) -> Column:
    """Start of a period; 0, the epoch, for all time."""
    end = epoch_ms(instant(now))
    start = F.lit(0).cast("bigint")
    for name, days in PERIOD_DAYS.items():
        start = F.when(period == name, end - F.lit(days * DAY_MS)).otherwise(start)
    return start


def in_scope(log: DataFrame, now) -> DataFrame:
    return log.withColumn(BAND, band_of(F.col("ts"), now)).where(F.col(BAND).isNotNull())


def per_period(
    bands: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    minima: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """keys, period and the combined measures from one row per (keys, band). Every key gets all
    periods; a period without bands has NULL measures."""
    options = ", ".join(f"named_struct('period', '{p}', 'rank', {i})" for i, p in enumerate(PERIODS))
    spread = bands.selectExpr("*", f"inline(array({options}))")
    inside = f"{BAND} <= rank"
    aggs = [
        F.expr(f"{how}(if({inside}, {c}, null)) as {c}")
        for how, names in (("sum", sums), ("max", maxima), ("min", minima))
        for c in names
    ]
    aggs += [agg.alias(n) for n, agg in (extra or {}).items()]
    aggs.append(F.expr(f"count_if({inside}) as _bands"))
    return spread.groupBy(*keys, "period").agg(*aggs)
