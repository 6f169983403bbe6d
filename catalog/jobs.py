"""Registered jobs that run in several passes: streams, appended logs, versions, refreshed cells, a second repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import standins as S
from catalog import transcripts as X
from catalog.queries import ms, query
from daybook.functions.tokens import TOKENS
from daybook.operators import activity, agents, calendar, repair
from daybook.plans import partials
from daybook.plans.incremental import ingest_new
from daybook.plans.refresh import refresh_daily_cells
from daybook.session import make_folder, names_in, remove, rename, staging_path
from daybook.sources import event_log, log_table, ranges, transcripts
from daybook.sources.prices import shipped_prices
from daybook.streaming import tables
from daybook.streaming.ingest import read_ingested, stream_ingest

PASSES = 3


def _pass_of(key: Column) -> Column:
    """Passes that do not follow the order of the rows."""
    return F.pmod(F.xxhash64(key), F.lit(PASSES))


def _streamed(spark: SparkSession, rows: DataFrame, key: str, start: Callable[[DataFrame, str, str], object]) -> str:
    """Land rows in passes, every fifth again in the next one, and run the stream after each; its target."""
    source, target, checkpoint = (staging_path(spark, part) for part in ("landed", "target", "offsets"))
    parts = rows.withColumn("_pass", _pass_of(F.col(key)))
    for n in range(PASSES):
        again = (F.col("_pass") == n - 1) & (F.xxhash64(key) % 5 == 0)
        parts.where((F.col("_pass") == n) | again).drop("_pass").write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source), target, checkpoint).awaitTermination()
    return target


@query
def stream_log(spark, sf):
    """Log lines that land in passes out of order, some again later with another project: the first stays."""
    source, target, checkpoint = (staging_path(spark, part) for part in ("lines", "log", "offsets"))
    lines = X.log_lines(spark, sf).withColumn("_pass", F.pmod(F.floor(F.col("ingest_seq") / 10), F.lit(PASSES)))
    for n in range(PASSES):
        now = lines.where(F.col("_pass") == n).select("value")
        if n == PASSES - 1:
            late = lines.where(F.col("_pass") < n).select(F.regexp_replace("value", '"project":"p', '"project":"late ').alias("value"))
            now.write.mode("append").text(source)
            stream_ingest(spark, source, target, checkpoint).awaitTermination()
            now = late
        now.write.mode("append").text(source)
        stream_ingest(spark, source, target, checkpoint).awaitTermination()
    return read_ingested(spark, target).select("type", "event_id", "project", ms("ts"))


@query
def stream_sessions(spark, sf):
    writes = S.signals(spark, sf).where("event_type = 'purchase'").select("project", "ts", "id").withColumn("is_write", F.lit(True))
    rows = S.ticks(spark, sf).withColumn("is_write", F.lit(False)).unionByName(writes, allowMissingColumns=True)

    def start(stream: DataFrame, target: str, checkpoint: str):
        return tables.stream_sessions(stream, target, checkpoint, writes_by_id=True)

    target = _streamed(spark, rows, "id", start)
    found = tables.read_sessions(spark, target)
    return found.select("project", ms("started_at"), ms("ended_at"), "is_closed", *activity.DIMENSIONS)


@query
def stream_deltas(spark, sf):
    target = _streamed(spark, S.running_usage(spark, sf), "byte_offset", tables.stream_deltas)
    return tables.read_deltas(spark, target).select(*agents.SESSION, "byte_offset", "is_cumulative", *TOKENS)


@query
def stream_diagnostics(spark, sf):
    target = _streamed(spark, S.diagnostics(spark, sf), "id", tables.stream_diagnostics)
    return tables.read_diagnostics(spark, target).select("project", "id", "errors", "warnings")


@query
def stream_edits(spark, sf):
    """Edits that land out of order and partly again: each window as all of its edits give it."""
    target = _streamed(spark, S.edits(spark, sf), "id", tables.stream_edits)
    found = tables.read_edits(spark, target)
    return found.select("project", ms("window.start", "window_ms"), "file", "language", "lines_added", "lines_removed")


@query
def append_log(spark, sf):
    """The signal log appended as JSON lines in two parts and read back."""
    path = staging_path(spark, "appended")
    log = S.union_log(S.signal_log(spark, sf))
    for odd in (0, 1):
        event_log.append_events(log.where(F.col("ingest_seq") % 2 == odd), path)
    rows = event_log.read_log(spark, path)
    return rows.select("type", "event_id", "project", ms("ts"), "file", "lines_added", "errors", "passed", "name", "ok")


@query
def log_versions(spark, sf):
    """Repaired history becomes a version of the log, signals are appended twice, and compaction makes the next version."""
    root = staging_path(spark, "versions")
    repaired = repair.migrate_history(X.stored_log(spark, sf), X.reparsed(spark, sf), shipped_prices(spark))
    log_table.write_version(repaired, root)
    signals = S.signal_log(spark, sf)
    log_table.append_rows(signals, root)
    log_table.append_rows(signals.withColumn("project", F.lit("again")), root)
    log_table.compact(spark, root)
    rows = event_log.first_per_event(S.union_log(log_table.read_current(spark, root)), stored=True)
    return rows.select("type", "event_id", "project", ms("ts"), F.col("ingest_seq").isNotNull().alias("numbered"))


@query
def refreshed_cells(spark, sf):
    """Daily cells of an older log, which lacks some events and has one on a day of its own, brought up to date."""
    root, target = staging_path(spark, "days"), staging_path(spark, "cells")
    log = S.event_log(spark, sf)
    missing = F.pmod(F.xxhash64("event_id"), F.lit(7)) == 0
    stray = log.where("type = 'session'").orderBy("event_id").limit(1).withColumn("ts", F.lit("2024-03-09 12:00:00").cast("timestamp"))
    older = log.where(~missing).unionByName(stray)
    calendar.daily_cells(older).write.partitionBy("date").parquet(target)
    log_table.write_version(log, root)
    changed = log.where(missing).unionByName(stray)
    refresh_daily_cells(log_table.read_current(spark, root), changed, target)
    cells = calendar.daily_cells(log.limit(0))
    return spark.read.schema(cells.schema).parquet(target).select(*cells.columns)


@query
def rollup_partials(spark, sf):
    """Rollups from daily parts of an older log, which lacks some events and has one on a day of its own, brought up to date."""
    root, target = staging_path(spark, "days"), staging_path(spark, "parts")
    log = S.event_log(spark, sf)
    missing = F.pmod(F.xxhash64("event_id"), F.lit(7)) == 0
    stray = log.where("type = 'session'").orderBy("event_id").limit(1).withColumn("ts", F.lit("2024-03-09 12:00:00").cast("timestamp"))
    partials.write_partials(log.where(~missing).unionByName(stray), target)
    log_table.write_version(log, root)
    now = log_table.read_current(spark, root)
    partials.refresh_partials(now, log.where(missing).unionByName(stray), target)
    return partials.rollup_from_partials(now, target, S.NOW)


@query
def migrate_twice(spark, sf):
    """The repair of repaired history changes nothing more."""
    log, again, prices = X.stored_log(spark, sf), X.reparsed(spark, sf), shipped_prices(spark)
    once = event_log.numbered(repair.migrate_history(log, again, prices))
    rows = repair.migrate_history(S.stage(once, "once"), again, prices)
    return rows.select(
        "event_id", ms("ts"), "project", "session_id", "type", "agent", "session_uuid", "model", "turns", *TOKENS,
        "cost_usd", "pricing_version", "calc_version", "unparsed_lines",
    )


@query
def fallback_time(spark, sf):
    """Usage rows by agent, and those that take their file's time because their line has none."""
    rows = X.usage(spark, sf, "claude").withColumn("agent", F.lit("claude")).unionByName(
        X.usage(spark, sf, "codex").withColumn("agent", F.lit("codex"))
    )
    without = F.col("ts") == F.lit(X.FILE_TIME).cast("timestamp")
    return rows.groupBy("agent").agg(F.count("*").alias("rows"), F.count_if(without).alias("without_time"))


# Conversations in one transcript file of the first job below, and the lines of their first state.
EACH, FIRST_LINES = 16, 40


def _numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.lines(spark, sf).withColumn("_n", F.regexp_extract("source_file", r"c(\d+)\.jsonl$", 1).cast("bigint"))
    return lines.withColumn("later", F.col("place") >= FIRST_LINES)


def _land(rows: DataFrame, name: str, into: str | None = None) -> str:
    """One transcript file per value of `file`, a path below the folder; `into` a folder whose files it replaces."""
    spark, root = rows.sparkSession, staging_path(rows.sparkSession, name)
    into = into or root
    if ranges.reaches(into):
        rows = rows.withColumn("file", F.concat("file", F.lit(".jsonl"))).repartition("file")
        ranges.write_lines(rows.sortWithinPartitions("file", "later", "source_file", "place"), into)
        return into
    # In other stores Spark writes the files and the driver gives them their names.
    rows = rows.withColumn("file", F.replace("file", F.lit("/"), F.lit("+")))
    ordered = rows.repartition("file").sortWithinPartitions("file", "later", "source_file", "place")
    ordered.select("file", "line").write.partitionBy("file").text(root)
    for folder in (n for n in names_in(spark, root) if n.startswith("file=")):
        path = folder.split("=")[1].replace("+", "/")
        make_folder(spark, f"{into}/{path}".rsplit("/", 1)[0])
        remove(spark, f"{into}/{path}.jsonl")
        for part in names_in(spark, f"{root}/{folder}"):
            rename(spark, f"{root}/{folder}/{part}", f"{into}/{path}.jsonl")
    return into


@query
def transcript_passes(spark, sf):
    """Transcripts in nested folders, found and read, then read on from their cursors after they have grown."""
    lines = _numbered_lines(spark, sf)
    bucket = F.floor(F.col("_n") / EACH).cast("string")
    lines = lines.select(F.concat(F.lit("bucket"), bucket, F.lit("/b"), bucket).alias("file"), "later", "source_file", "place", "line")
    lines = S.stage(lines, "lines")

    def counted(rows: DataFrame, number: int) -> DataFrame:
        name = F.regexp_extract("source_file", r"(b\d+)\.jsonl$", 1)
        return rows.groupBy(name.alias("file"), F.lit(number).alias("pass")).agg(
            F.count("*").alias("lines"), F.min("byte_offset").alias("from_offset"), F.max("next_offset").alias("next_offset")
        )

    first, grown = _land(lines.where("not later"), "first"), _land(lines, "grown")
    before = transcripts.read_transcript_lines(spark, first, extract=lambda read: read.drop("line"))
    cursors = transcripts.advance_cursors(before).withColumn("source_file", F.replace("source_file", F.lit(first), F.lit(grown)))
    after = transcripts.read_new_lines(spark, grown, cursors)
    return counted(before, 1).unionByName(counted(after, 2))


@query
def ingest_passes(spark, sf):
    """Transcripts of one agent, a file per conversation, ingested, and again after they have grown: each pass reads new bytes only. Per
    session what its turns of both passes add up to, and what the last summary says."""
    lines = _numbered_lines(spark, sf).where("agent = 'claude'")
    path = F.concat(F.lit("work-p"), F.col("_n") % 5, F.lit("/c"), F.col("_n"))
    lines = lines.select(path.alias("file"), "later", "source_file", "place", "line")
    roots = [(f"p{k}", f"/work/p{k}") for k in range(5)]
    projects, prices = spark.createDataFrame(roots, "project string, root string"), shipped_prices(spark)
    root, state = _land(lines.where("not later"), "early"), staging_path(spark, "state")
    passes = []
    for n in range(2):
        if n:
            _land(lines, "late", root)
        done = ingest_new(spark, root, "claude", projects, prices, state)
        done.commit()
        passes.append(done.rows)
    rows = passes[0].unionByName(passes[1])
    turns = rows.where("type = 'agent_turn'").groupBy("session_uuid", "project").agg(
        F.countDistinct("event_id").alias("turns"), F.sum("input").alias("input"), F.sum("output").alias("output")
    )
    last = rows.where("type = 'agent_session'").groupBy("session_uuid").agg(
        F.max("turns").alias("summary_turns"), F.max("input").alias("summary_input"), F.max("unparsed_lines").alias("unparsed_lines")
    )
    return turns.join(last, "session_uuid")
