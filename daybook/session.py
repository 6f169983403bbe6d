"""Shared folder, staged tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has been read and found to be at most this long, in rows and in bytes of its JSON.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on local masters an own one if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="daybook-")
    return _own_folder[app]


# The tables written since each open `staging` block began, innermost last.
_owned: list[list[str]] = []
_goes_at_exit: set[str] = set()


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path for a staged table. All of an application's tables go when it ends, those of a `staging` block earlier."""
    folder = f"{shared_folder(spark)}/daybook/{spark.sparkContext.applicationId}"
    if folder not in _goes_at_exit:
        path, files = _files(spark, folder)
        files.deleteOnExit(path)
        _goes_at_exit.add(folder)
    staged = f"{folder}/{label}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(staged)
    return staged


def _files(spark: SparkSession, path: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in any store that Spark reaches."""
    place, files = _files(spark, path)
    files.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    place, files = _files(spark, path)
    files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(to))


def make_folder(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.mkdirs(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    place, files = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns the tables staged inside: they are deleted at the end, so results must be written before."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            remove(spark, path)


def stage(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors,
    and fixes values that a recomputation could change (such as partition numbers). Filters on the columns `by` then
    choose folders."""
    path = staging_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def present(df: DataFrame, row: Column) -> DataFrame:
    """df with the fields of the struct `row`, without the rows where it is NULL. Unlike a filter this
    is not pushed below the projections that compute the struct, which are thus evaluated once."""
    return df.select("*", F.inline(F.array_compact(F.array(row))))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, length = df.limit(rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return n <= rows and length <= BROADCAST_BYTES


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted and few; otherwise df, left to a shuffle join
    whose hot partitions adaptive execution splits. For inputs that are cheap to count: where the side
    is itself a large aggregate, a plain join lets adaptive execution decide by its measured size."""
    return F.broadcast(df) if is_small(df, rows) else df
