"""Corrections: late or repaired rows change past days, which are computed again from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.when import day_key
from daybook.operators.calendar import daily_cells
from daybook.session import remove


def refresh_daily_cells(log: DataFrame, changed: DataFrame, target: str) -> None:
    """Compute the days touched by the changed rows (ts) from the whole log again, and replace just these days of the
    table of daily cells; a day without any event left goes. With a log partitioned by day only the touched days are
    read. The driver holds the touched days, one value each."""
    spark = log.sparkSession
    touched = changed.where(F.col("ts").isNotNull()).select(day_key(F.col("ts")).alias("day")).distinct()
    days = [r.day for r in touched.collect()]
    day = F.col("day") if "day" in log.columns else day_key(F.col("ts"))
    (
        daily_cells(log.where(day.isin(days)).drop("day"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(target)
    )
    left = {r.day for r in log.where(day.isin(days)).select(day.alias("day")).distinct().collect()}
    for gone in sorted(set(days) - left):
        remove(spark, f"{target}/date={gone}")
