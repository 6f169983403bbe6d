"""Rollups from daily parts: what a day adds to every measure is computed once and kept, so that a rollup reads one row per
project and day instead of the log, and a correction computes its days again.

target/additive/date=…    per project: sums, counts, longest session, first and last diagnostics
target/files/date=…       per project: the files edited
target/durations/date=…   per project: how many sessions of each length
target/cells/date=…       per project: the daily cells

Periods are rolling, so they begin within a day. The days that a boundary cuts, three at most, are taken from the log; all
others lie in one period band as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.when import day_key, instant
from daybook.operators.calendar import daily_cells
from daybook.operators.periods import BAND, PERIOD_DAYS, band_of, in_scope
from daybook.operators.rollup import (
    additive_parts,
    combined_additive,
    combined_files,
    combined_medians,
    duration_parts,
    file_parts,
    joined_periods,
)
from daybook.schema import as_log
from daybook.session import names_in, remove

DATE = "date"


def _in_time(log: DataFrame) -> DataFrame:
    """Rows that a rollup takes: from the epoch on, with a time."""
    return log.where(F.col("ts") >= F.timestamp_seconds(F.lit(0))).withColumn(DATE, day_key(F.col("ts")))


PARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "additive": lambda log: additive_parts(_in_time(as_log(log)), DATE),
    "files": lambda log: file_parts(_in_time(log), DATE),
    "durations": lambda log: duration_parts(_in_time(log), DATE),
    "cells": daily_cells,
}


def write_partials(log: DataFrame, target: str) -> None:
    """The parts of all days of a log."""
    for name, make in PARTS.items():
        make(log).write.mode("overwrite").partitionBy(DATE).parquet(f"{target}/{name}")


def _day_of(log: DataFrame) -> Column:
    return F.col("day") if "day" in log.columns else day_key(F.col("ts"))


def refresh_partials(log: DataFrame, changed: DataFrame, target: str) -> None:
    """Compute the days of the changed rows again, from the log as it is now, and replace just these; what a day does not have any
    more goes. With a log partitioned by day only the touched days are read. The driver holds the touched days, one value each."""
    touched = changed.where(F.col("ts").isNotNull()).select(day_key(F.col("ts")).alias("day")).distinct()
    days = sorted(r.day for r in touched.collect())
    rows = log.where(_day_of(log).isin(days)).drop("day")
    for name, make in PARTS.items():
        part = f"{target}/{name}"
        made = make(rows)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(part)
        if names_in(log.sparkSession, part):
            left = {r[0] for r in made.select(DATE).distinct().collect()}
            for gone in sorted(set(days) - left):
                remove(log.sparkSession, f"{part}/{DATE}={gone}")


def _read(spark: SparkSession, target: str, name: str, like: DataFrame) -> DataFrame:
    """A table of parts; filters on date choose folders."""
    schema = PARTS[name](like.limit(0)).schema
    return spark.read.schema(schema).parquet(f"{target}/{name}")


def read_cells(log: DataFrame, target: str) -> DataFrame:
    return _read(log.sparkSession, target, "cells", log)


def cut_days(spark: SparkSession, now) -> list[str]:
    """The days in which a period begins."""
    starts = [day_key(instant(now) - F.make_dt_interval(F.lit(n))) for n in PERIOD_DAYS.values()]
    return sorted(set(spark.range(1).select(*starts).first()))


def rollup_from_partials(log: DataFrame, target: str, now) -> DataFrame:
    """`rollup_periods` of the log, from the parts of its days; of the log itself only the days are read in which a period
    begins."""
    spark, cut = log.sparkSession, cut_days(log.sparkSession, now)
    edge = in_scope(as_log(log.where(_day_of(log).isin(cut))), now)
    begin = F.greatest(F.col(DATE).cast("timestamp"), F.timestamp_seconds(F.lit(0)))

    def bands(name: str, edges: DataFrame) -> DataFrame:
        days = _read(spark, target, name, log).where(~F.col(DATE).isin(cut)).withColumn(BAND, band_of(begin, now)).drop(DATE)
        return days.unionByName(edges)

    additive = combined_additive(bands("additive", additive_parts(edge, BAND)))
    files = combined_files(bands("files", file_parts(edge, BAND)))
    medians = combined_medians(bands("durations", duration_parts(edge, BAND)))
    return joined_periods(additive, files, medians, now)
