"""Time columns. Days, hours and weekdays are those of spark.sql.session.timeZone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def weekday(ts: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(ts) - 1


def instant(now: str | dt.datetime | Column) -> Column:
    if isinstance(now, Column):
        return now.cast("timestamp")
    return F.lit(now).cast("timestamp")
