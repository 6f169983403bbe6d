"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from daybook.schema import as_log
from daybook.session import staging
from daybook.sources.event_log import decode_placed, first_per_event, placed_lines
from daybook.sources.log_table import read_days, write_days

# A batch's rows follow those of earlier batches; a batch has fewer rows than this.
BATCH_ROWS = 1 << 40


def stream_log_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of log files as they land, with the file and block they stand in. Landed files do not change; grown files
    are for read_new_lines."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True)
    return placed_lines(reader.option("lineSep", "\n").text(path))


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Decode landed lines, number them in log order and append them to the table `target`.

    Every event is appended, however old its time: nothing waits for a watermark and there is no state to grow. An event
    that lands again is appended again; `read_ingested` and compaction keep the first. A batch run again after a failure
    replaces itself.
    """

    def append(batch: DataFrame, number: int) -> None:
        with staging(spark):
            rows = decode_placed(batch, after=number * BATCH_ROWS - 1)
            write_days(rows, f"{target}/batch={number}", "overwrite")

    return (
        stream_log_lines(spark, source)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The streamed log: the first row of each event."""
    return first_per_event(as_log(read_days(spark, target)), stored=True)
