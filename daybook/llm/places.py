"""Places of rows in an order, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables
from daybook.session import small_side


def placed(rows: DataFrame, keys: list[str], order: list[Column], tables: Tables, label: str) -> DataFrame:
    """rows with `place`, from 0 within `keys`, in ascending `order`, nulls first; rows that agree in all of it stand in
    the order of the table, which should be a staged one.

    The rows are dealt by ranges of (keys, order), so a key of any size spreads over many tasks. Every task numbers what it
    has sorted; what stands before a task is a running sum over the tasks of a key.
    """
    columns = rows.columns
    by = [F.asc_nulls_first(k) for k in keys] + [c.asc_nulls_first() for c in order] + [F.col("_row")]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    # The number of a task and the place in it are stable only once they are written.
    spread = tables.write(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), f"{label}-sorted")
    spread = spread.withColumn("_task", F.shiftright("_at", 33))
    tasks = spread.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tables.write(tasks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), f"{label}-tasks", few=True)
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return spread.join(small_side(tasks), [*keys, "_task"]).select(*columns, place.alias("place"))
