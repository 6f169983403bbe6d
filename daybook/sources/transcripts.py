"""Agent transcripts: JSON lines with their byte offsets, files of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.paths import transcript_uuid
from daybook.operators.ordered import OrderedRows, total
from daybook.session import small_side, stage
from daybook.sources import ranges


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def folders_share_tasks(spark: SparkSession) -> Iterator[None]:
    """Scans made inside list folders in eight tasks a core at most: by default each folder is a task of its own."""
    usual = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(usual), 8 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, usual)


def list_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, size, mtime of every *.jsonl below path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    with folders_share_tasks(spark):
        files = reader.load(path)
    return files.select(
        F.col("path").alias("source_file"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def source_index(files: DataFrame, agent: str) -> DataFrame:
    return files.select(
        F.lit(agent).alias("agent"), transcript_uuid(F.col("source_file")).alias("session_uuid"), "source_file"
    )


def grown_files(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files with bytes past their cursor; files without cursor are new."""
    known = cursors.select("source_file", F.col("next_offset").alias("from_offset"))
    return (
        files.join(small_side(known), "source_file", "left")
        .withColumn("from_offset", F.coalesce("from_offset", F.lit(0).cast("bigint")))
        .where("size > from_offset")
    )


def read_transcript_lines(
    spark: SparkSession,
    path: str | list[str],
    cursors: DataFrame | None = None,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """source_file, byte_offset, next_offset, mtime, line; the unterminated last line is left for a
    later pass, and lines before a file's cursor are skipped.

    Spark cuts a large file into blocks. A line's offset is the bytes of earlier lines in its block
    plus the bytes of earlier blocks, so no task holds more than one block. extract may replace the
    column line by narrow columns; these are staged, so that texts are scanned once and never shuffled.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    with folders_share_tasks(spark):
        texts = reader.option("lineSep", "\n").text(path)
    raw = (
        texts.select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_size").alias("_size"),
            F.col("_metadata.file_modification_time").alias("mtime"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("_metadata.file_block_length").alias("_block_length"),
        )
        .withColumn("_bytes", line_bytes())
    )
    numbered = raw.withColumn("_place", F.monotonically_increasing_id())
    numbered = numbered.withColumn("line", F.regexp_replace("line", r"\r$", ""))
    if extract:
        numbered = raw = stage(extract(numbered), "lines")
    block_starts = (
        raw.where("_block_length < _size")
        .groupBy("source_file", "_block")
        .agg(F.sum("_bytes").alias("_n"))
        .select(
            "source_file",
            "_block",
            F.sum("_n")
            .over(W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
            .alias("_before_block"),
        )
    )
    earlier = (
        W.partitionBy("source_file", "_block").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    )
    located = (
        numbered.withColumn("_in_block", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)))
        .join(block_starts, ["source_file", "_block"], "left")
        .withColumn("byte_offset", F.col("_in_block") + F.coalesce("_before_block", F.lit(0)))
        .withColumn("next_offset", F.col("byte_offset") + F.col("_bytes"))
        .where("next_offset <= _size")
    )
    if cursors is not None:
        known = cursors.select("source_file", F.col("next_offset").alias("_from"))
        located = (
            located.join(small_side(known), "source_file", "left")
            .where(F.col("byte_offset") >= F.coalesce("_from", F.lit(0)))
            .drop("_from")
        )
    return located.drop("_size", "_block", "_block_length", "_bytes", "_place", "_in_block", "_before_block")


def read_new_lines(
    spark: SparkSession,
    path: str | list[str] | DataFrame,
    cursors: DataFrame | None = None,
    extract: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Lines past the cursors of the files that grew, below `path` or given as `grown_files`; None if none did. Tasks open a file
    at its cursor and read what follows. In a store that only Spark reads, grown files are scanned whole."""
    grown = path if isinstance(path, DataFrame) else stage(grown_files(list_transcripts(spark, path), cursors), "grown")
    first = grown.select("source_file").head()
    if first is None:
        return None
    if ranges.reaches(first.source_file):
        lines = ranges.read_ranges(grown)
        return extract(lines) if extract else lines
    known = grown.select("source_file", F.col("from_offset").alias("next_offset"))
    return read_transcript_lines(spark, names_to_open(grown), known, extract)


def names_to_open(files: DataFrame) -> list[str]:
    """Names of the files a scan opens. The driver holds the names of a scan's files in any case."""
    return [r.source_file for r in files.select("source_file").toLocalIterator()]


def line_bytes(line: str = "line") -> Column:
    """Bytes a line takes in its file, with its line break."""
    return F.octet_length(line).cast("bigint") + 1


def locate_lines(sized: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Byte offsets of lines already held in a table, in the given order within source_file. Column
    bytes is their line_bytes; the texts themselves need not come along."""
    ordered = OrderedRows(sized, ["source_file"], order, chunks, "lines")
    return (
        ordered.carry(byte_offset=total(F.col("bytes")))
        .withColumn("next_offset", F.col("byte_offset") + F.col("bytes"))
        .drop("bytes", "_chunk")
    )


def advance_cursors(lines: DataFrame) -> DataFrame:
    """A file's cursor behind its last line; staged, as a pass looks at the cursors more than once and the lines are a scan."""
    return stage(lines.groupBy("source_file").agg(F.max("next_offset").alias("next_offset")), "cursors")
