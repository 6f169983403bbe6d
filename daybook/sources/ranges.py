"""Byte ranges of files, read in tasks: a file that grew by a hundredth is read for that hundredth."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a range, and of what is read and handed on at a time.
RANGE, PIECE = 32 << 20, 1 << 20
# Tasks of one pass at most.
TASKS = 100_000
# Stores whose files tasks can open at an offset; others are scanned by Spark.
SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def reaches(uri: str) -> bool:
    return urlsplit(uri).scheme in SCHEMES


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    scheme = urlsplit(uri).scheme
    if SCHEMES[scheme] == "file":
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES[scheme] + uri[len(scheme) :])


def open_file(uri: str) -> BinaryIO:
    store, path = _place(uri)
    return store.open_input_file(path)


def write_lines(rows: DataFrame, root: str) -> None:
    """rows (file, line), sorted so that the lines of a file follow each other in one partition: tasks write each file below `root`
    under a name of their own and then give it its name, so a task that runs again replaces what it wrote. One line at a time is held
    of a batch, and the driver learns no names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _place(root)
        name = out = part = None

        def close() -> None:
            out.close()
            store.move(part, f"{folder}/{name}")

        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if file != name:
                    if out is not None:
                        close()
                    name, part = file, f"{folder}/{file}.{uuid4().hex}"
                    store.create_dir(part.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(part, buffer_size=PIECE)
                out.write((line or "").encode() + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    rows.select("file", "line").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def lines_of(file: BinaryIO, start: int, end: int, begin: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every line that starts in [start, end), without its line feed. Lines start at `begin` and behind line
    feeds; a line that does not end before `size` is left out."""
    at, held = start, b""
    skipping = start > begin
    if skipping:
        # The line that ends in front of `start` shows whether a line starts there.
        at -= 1
    file.seek(at)
    read = at
    while at < end or skipping:
        cut = held.find(b"\n")
        if cut >= 0:
            if skipping:
                skipping = False
            else:
                yield at, held[:cut]
            at, held = at + cut + 1, held[cut + 1 :]
            continue
        piece = file.read(min(PIECE, size - read))
        if not piece:
            return
        read += len(piece)
        # Whole lines of a piece are cut at once; what is behind the last feed waits for the next one.
        parts = (held + piece).split(b"\n")
        held = parts.pop()
        for line in parts:
            if skipping:
                skipping = False
            elif at < end:
                yield at, line
            else:
                return
            at += len(line) + 1


def read_ranges(files: DataFrame) -> DataFrame:
    """files (source_file, from_offset, size, mtime) -> source_file, mtime, byte_offset, next_offset, line of every whole line
    from from_offset on. A task holds a piece of a range and one line. Names stay in the table; the driver learns the number of
    bytes only."""
    # Opening a file counts as a piece, so that many small files share a task.
    total = files.agg(F.ceil(F.sum(F.col("size") - F.col("from_offset") + PIECE) / RANGE)).first()[0] or 0
    starts = F.sequence(F.col("from_offset"), F.col("size") - 1, F.lit(RANGE).cast("bigint"))
    ranges = files.where("size > from_offset").select("source_file", "mtime", "size", "from_offset", F.explode(starts).alias("start"))
    ranges = ranges.repartition(max(1, min(int(total), TASKS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["source_file"]) as file:
                    at, lines, held = [], [], 0
                    found = lines_of(file, row["start"], min(row["start"] + RANGE, row["size"]), row["from_offset"], row["size"])
                    for offset, line in found:
                        at.append(offset)
                        lines.append(line)
                        held += len(line)
                        if held > PIECE or len(at) >= 1_000:
                            yield _rows(row, at, lines)
                            at, lines, held = [], [], 0
                    if at:
                        yield _rows(row, at, lines)

    mtime = dict(files.dtypes)["mtime"]
    rows = ranges.mapInArrow(read, f"source_file string, mtime {mtime}, byte_offset bigint, next_offset bigint, raw binary")
    # As text that Spark reads itself: bytes as they are, without the carriage return of a line.
    return rows.withColumn("line", F.regexp_replace(F.col("raw").cast("string"), r"\r$", "")).drop("raw")


def _rows(row: dict, at: list[int], lines: list[bytes]) -> pa.RecordBatch:
    n = len(at)
    columns = {
        "source_file": pa.array([row["source_file"]] * n, pa.string()),
        "mtime": pa.array([row["mtime"]] * n, pa.timestamp("us", "UTC")),
        "byte_offset": pa.array(at, pa.int64()),
        "next_offset": pa.array([a + len(line) + 1 for a, line in zip(at, lines, strict=True)], pa.int64()),
        "raw": pa.array(lines, pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)
