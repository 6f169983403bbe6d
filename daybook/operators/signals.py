"""Editor signals: start/end pairs, edit windows, diagnostics, file-system events, test runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.paths import disk_language_of, is_noise
from daybook.functions.testlog import is_test_command, test_summaries
from daybook.functions.tokens import zero_if_null
from daybook.functions.when import epoch_ms
from daybook.operators.ordered import OrderedRows, previous

# Edit window, diagnostics window.
EDIT_WINDOW, DIAGNOSTICS_WINDOW = "60 seconds", "30 seconds"


def pair_intervals(starts: DataFrame, ends: DataFrame, keys: Sequence[str], chunks: int | None = None) -> DataFrame:
    """ends (keys, ts, id, …) with started_at and duration_ms. An end takes the start just before it:
    a later start replaces an earlier one and an end uses its start up; without start it lasts 0 ms."""
    both = ends.withColumn("_start", F.lit(False)).unionByName(
        starts.select(*keys, "ts", "id").withColumn("_start", F.lit(True)), allowMissingColumns=True
    )
    rows = OrderedRows(both, keys, ["ts", "_start", "id"], chunks, "pairs")
    before = rows.carry(_before=previous(F.struct("_start", "ts"))).where("not _start")
    started = F.when(F.col("_before._start"), F.col("_before.ts"))
    lasted = epoch_ms(F.col("ts")) - epoch_ms(F.col("started_at"))
    return (
        before.withColumn("started_at", started)
        .withColumn("duration_ms", F.coalesce(lasted, F.lit(0)).cast("bigint"))
        .drop("_start", "_before", "_chunk")
    )


def aggregate_edits(edits: DataFrame, width: str = EDIT_WINDOW) -> DataFrame:
    """Lines per file and window; the language is the first seen, windows without change are dropped.
    The same expression runs on a stream with a watermark."""
    return (
        edits.groupBy("project", F.window("ts", width), "file")
        .agg(
            F.min_by("language", F.struct("ts", "id")).alias("language"),
            F.sum(zero_if_null("lines_added")).alias("lines_added"),
            F.sum(zero_if_null("lines_removed")).alias("lines_removed"),
        )
        .where("lines_added <> 0 or lines_removed <> 0")
    )


def diagnostics_by_language(problems: DataFrame) -> DataFrame:
    """problems (snapshot, path, severity) counted per snapshot and extension, upper case folded."""
    extension = F.coalesce(F.lower(F.substring_index("path", ".", -1)), F.lit("unknown"))
    return problems.groupBy("snapshot", extension.alias("language")).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).where("errors + warnings > 0")


def sample_diagnostics(snapshots: DataFrame, width: str = DIAGNOSTICS_WINDOW) -> DataFrame:
    """The last snapshot (project, ts, id, errors, warnings) of each window."""
    last = F.max_by(F.struct("ts", "id", "errors", "warnings"), F.struct("ts", "id"))
    return snapshots.groupBy("project", F.window("ts", width).alias("_w")).agg(last.alias("_s")).select(
        "project", "_s.*"
    )


def detect_changes(snapshots: DataFrame, chunks: int | None = None) -> DataFrame:
    """Snapshots whose number of errors and warnings differs from the one before."""
    total = F.col("errors") + F.col("warnings")
    rows = OrderedRows(snapshots, ["project"], ["ts", "id"], chunks, "diagnostics")
    changed = rows.carry(_before=previous(total)).where(~total.eqNullSafe(F.col("_before")))
    return changed.select(*snapshots.columns)


def filter_fs_events(fs: DataFrame) -> DataFrame:
    """Created and deleted files outside build and dependency folders, with their language."""
    kept = fs.where((F.col("kind") != "change") & ~is_noise(F.col("file")))
    return kept.withColumn("language", disk_language_of(F.col("file")))


def extract_test_runs(terminal: DataFrame) -> DataFrame:
    """terminal (…, command, output) to test runs: test commands whose output ends in a known summary."""
    tests = terminal.where(is_test_command(F.col("command")))
    return test_summaries(tests, "output").withColumn("source", F.lit("terminal")).drop("output")
