"""Days, weeks and months per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.tokens import money_sum, zero_if_null
from daybook.functions.when import day_key, instant, weekday
from daybook.schema import CLAUDE, as_log

MEASURES = (
    "duration_ms", "interaction_ms", "agent_only_ms", "claude_tokens", "codex_tokens", "cost_usd", "commits",
    "lines_added", "lines_removed", "sessions",
)
LEVELS = 4  # Fixed value: intensity levels above zero.


def daily_cells(log: DataFrame) -> DataFrame:
    """One row per project and day with any event."""
    kind = F.col("type")

    def summed(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    session, turn, commit = kind == "session", kind == "agent_turn", kind == "commit"
    changed = kind.isin("commit", "file_edit")
    used = zero_if_null("input") + zero_if_null("output")
    claude = F.coalesce(F.col("agent") == CLAUDE, F.lit(False))
    added = F.when(commit, zero_if_null("insertions")).otherwise(zero_if_null("lines_added"))
    removed = F.when(commit, zero_if_null("deletions")).otherwise(zero_if_null("lines_removed"))
    return (
        as_log(log)
        .where(F.col("ts").isNotNull())
        .groupBy("project", day_key(F.col("ts")).alias("date"))
        .agg(
            summed(session, zero_if_null("duration_ms")).alias("duration_ms"),
            summed(session, zero_if_null("interaction_ms")).alias("interaction_ms"),
            summed(session, zero_if_null("agent_only_ms")).alias("agent_only_ms"),
            summed(turn & claude, used).alias("claude_tokens"),
            summed(turn & ~claude, used).alias("codex_tokens"),
            F.coalesce(money_sum(F.when(turn, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
            summed(commit, F.lit(1)).alias("commits"),
            summed(changed, added).alias("lines_added"),
            summed(changed, removed).alias("lines_removed"),
            summed(session, F.lit(1)).alias("sessions"),
        )
    )


def _fill(days: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells for the given (project, date) rows; zeros where there was no event."""
    joined = days.join(cells, ["project", "date"], "left")
    return joined.fillna(0, list(MEASURES))


def daily_series(cells: DataFrame, end, days: int) -> DataFrame:
    """The last `days` days up to end for every project."""
    last = F.to_date(instant(end))
    spine = F.explode(F.sequence(F.date_sub(last, days - 1), last))
    projects = cells.select("project").distinct()
    days = projects.select("project", spine.alias("_day")).select("project", day_key(F.col("_day")).alias("date"))
    return _fill(days, cells)


def collapse_gaps(series: DataFrame) -> DataFrame:
    """Runs of days without work become one point: its first day, is_gap if longer than a day."""
    by_day = W.partitionBy("project").orderBy("date")
    worked = F.col("duration_ms") > 0
    starts = worked | F.coalesce(F.lag("duration_ms").over(by_day) > 0, F.lit(True))
    runs = series.withColumn("_starts", starts).withColumn(
        "_run", F.sum(F.col("_starts").cast("int")).over(by_day.rowsBetween(W.unboundedPreceding, 0))
    )
    span = F.count("*").over(W.partitionBy("project", "_run"))
    return (
        runs.withColumn("span_days", span)
        .where("_starts")
        .withColumn("is_gap", F.col("span_days") > 1)
        .drop("_starts", "_run")
    )


def _grid(bounds: DataFrame, cells: DataFrame, shown: Column) -> DataFrame:
    """bounds: project, first, last and what `shown` needs. Whole weeks from the Sunday on or before
    first to the Saturday on or after last; days not shown carry no cell."""
    first, last = F.col("first"), F.col("last")
    start = F.date_sub(first, weekday(first))
    end = F.date_add(last, F.lit(6) - weekday(last))
    days = (
        bounds.where(last >= start)
        .withColumn("_start", start)
        .withColumn("_day", F.explode(F.sequence(start, end)))
        .withColumn("shown", shown & (F.col("_day") <= last))
        .select(
            "project",
            F.floor(F.datediff("_day", "_start") / 7).cast("int").alias("week"),
            weekday(F.col("_day")).alias("weekday"),
            F.when(F.col("shown"), day_key(F.col("_day"))).alias("date"),
        )
    )
    joined = days.join(cells, ["project", "date"], "left")
    filled = {m: F.when(F.col("date").isNotNull(), F.coalesce(m, F.lit(0))) for m in MEASURES}
    filled["cost_usd"] = F.when(F.col("date").isNotNull(), F.coalesce("cost_usd", F.lit(0.0)))
    longest = F.max("duration_ms").over(W.partitionBy("project"))
    return joined.withColumns(filled).withColumn("max_duration_ms", F.coalesce(longest, F.lit(0)))


def calendar_grid(cells: DataFrame, end, start=None) -> DataFrame:
    """Weeks up to end. Without start they begin with the first day that has data, and days before
    it carry no cell."""
    last = F.to_date(instant(end))
    first_data = F.to_date(F.min("date"))
    bounds = cells.groupBy("project").agg(first_data.alias("_data")).withColumn("last", last)
    if start is None:
        return _grid(bounds.withColumn("first", F.col("_data")), cells, F.col("_day") >= F.col("_data"))
    return _grid(bounds.withColumn("first", F.to_date(instant(start))), cells, F.lit(True))


def month_grid(cells: DataFrame, year: int, month: int) -> DataFrame:
    """The weeks of one civil month; days of other months carry no cell."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    bounds = cells.select("project").distinct().withColumns({"first": first, "last": F.last_day(first)})
    return _grid(bounds, cells, F.col("_day") >= F.col("first"))


def available_months(cells: DataFrame, now) -> DataFrame:
    """Months with data and the month of now, newest first by place; month counts from 0."""
    day = F.to_date("date")
    covered = cells.select("project", F.year(day).alias("year"), (F.month(day) - 1).alias("month"))
    moment = instant(now)
    current = cells.select("project").distinct().select(
        "project", F.year(moment).alias("year"), (F.month(moment) - 1).alias("month")
    )
    newest = W.partitionBy("project").orderBy(F.desc("year"), F.desc("month"))
    return covered.union(current).distinct().withColumn("place", F.row_number().over(newest))


def schedule_heatmap(log: DataFrame) -> DataFrame:
    """Minutes per weekday and hour, with margins (hour or weekday NULL) and the largest cell. A
    session counts wholly at its own time."""
    sessions = log.where((F.col("type") == "session") & F.col("ts").isNotNull())
    worked = sessions.groupBy("project", weekday(F.col("ts")).alias("weekday"), F.hour("ts").alias("hour")).agg(
        F.sum(zero_if_null("duration_ms")).alias("ms")
    )
    slots = (
        log.select("project")
        .distinct()
        .withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
        .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    )
    whole = slots.join(worked, ["project", "weekday", "hour"], "left").fillna(0, ["ms"])
    keys = [F.col(c) for c in ("project", "weekday", "hour")]
    project, day, hour = keys
    sums = whole.groupingSets([[project, day, hour], [project, day], [project, hour]], *keys).agg(
        (F.sum("ms") / F.lit(60000.0)).alias("minutes")
    )
    cell = F.col("weekday").isNotNull() & F.col("hour").isNotNull()
    largest = F.max(F.when(cell, F.col("minutes"))).over(W.partitionBy("project"))
    return sums.withColumn("max_minutes", largest)


def day_segments(series: DataFrame) -> DataFrame:
    """Stacked parts of a day: hours typing, agent alone, waiting; tokens in millions."""
    hour, million = F.lit(3600000.0), F.lit(1000000.0)
    waiting = F.col("duration_ms") - F.col("interaction_ms") - F.col("agent_only_ms")
    return series.select(
        "project",
        "date",
        (F.col("interaction_ms") / hour).alias("user_hours"),
        (F.greatest(F.lit(0), F.col("agent_only_ms")) / hour).alias("agent_hours"),
        (F.greatest(F.lit(0), waiting) / hour).alias("waiting_hours"),
        (F.col("claude_tokens") / million).alias("claude_mtok"),
        (F.col("codex_tokens") / million).alias("codex_mtok"),
    )


def intensity_levels(cells: DataFrame) -> DataFrame:
    """Level 0 to 4 of each day against the project's longest day."""
    longest = F.greatest(F.max("duration_ms").over(W.partitionBy("project")), F.lit(1))
    share = F.least(F.lit(1.0), F.sqrt(F.col("duration_ms") / F.col("_max")))
    level = F.lit(1) + F.least(F.lit(LEVELS - 1), F.floor(share * LEVELS))
    return cells.withColumn("_max", longest).select(
        "project",
        "date",
        "duration_ms",
        F.when(F.col("duration_ms") <= 0, F.lit(0)).otherwise(level).cast("int").alias("level"),
    )


def schedule_intensity(heatmap: DataFrame) -> DataFrame:
    """Strength of each weekday × hour cell: 0 when empty, else between 0.22 and 1."""
    cells = heatmap.where(F.col("weekday").isNotNull() & F.col("hour").isNotNull())
    share = F.sqrt(F.col("minutes") / F.greatest("max_minutes", F.lit(1.0)))
    return cells.select(
        "project",
        "weekday",
        "hour",
        F.when(F.col("minutes") <= 0, F.lit(0.0)).otherwise(F.lit(0.22) + share * F.lit(0.78)).alias("intensity"),
    )
