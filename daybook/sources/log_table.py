"""The log as a table of versions and appended batches, partitioned by type and day.

root/rows/part=v000001/type=.../day=.../   a version
root/rows/part=b3/type=.../day=.../        an appended batch
root/holds/v000001/3             the appended batches that the version has taken in, an empty file each
root/current/v000001             an empty file that makes the version current
root/claims/3                    an empty file that gives a writer the number of its batch
root/appended/3                  an empty file that makes the batch readable

Appends never touch a version, and compaction never waits for appends: it takes in the batches that were readable when it began
and notes which, before the new version is marked current. A reader takes the current version and all readable batches that the
version does not hold, so a row appended between any two steps is read exactly once. A batch's number gives its rows
numbers of their own, so two writers never take the same ones. Only one compaction or repair may run at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.when import day_key
from daybook.operators.dedup import least_by
from daybook.schema import as_log
from daybook.session import _files, names_in, remove, stage
from daybook.sources.event_log import first_per_event, numbered, numbered_by_time

NO_DAY = "none"


def with_day(log: DataFrame) -> DataFrame:
    """Log rows with the day of their time, by which tables are partitioned."""
    return as_log(log).withColumn("day", F.coalesce(day_key(F.col("ts")), F.lit(NO_DAY)))


def write_days(log: DataFrame, path: str, mode: str = "append", by_time: bool = False) -> None:
    """`by_time` says that the rows are range-partitioned by time."""
    # One file per task, type and day at most: hot days are spread, small ones are not scattered. By time a task has few days already.
    rows = with_day(log)
    spread = rows if by_time else rows.hint("rebalance", F.col("type"), F.col("day"))
    spread.write.mode(mode).partitionBy("type", "day").parquet(path)


def read_days(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """The rows with their column day; filters on type and day choose folders. Several paths lie below `base`."""
    schema = as_log(spark.range(0)).schema.add("day", "string")
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the current version, 0 before the first."""
    return max((int(name[1:]) for name in names_in(spark, f"{root}/current")), default=0)


def version_path(root: str, version: int) -> str:
    return f"{root}/rows/part=v{version:06d}"


def batch_path(root: str, number: int) -> str:
    return f"{root}/rows/part=b{number}"


# A batch has fewer rows than this.
BATCH_ROWS = 1 << 40


def _touch(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    place, files = _files(spark, path)
    if files.exists(place):
        return False
    try:
        files.create(place, False).close()
    except Py4JJavaError as taken:
        if "AlreadyExists" not in taken.java_exception.getClass().getName():
            raise
        return False
    return True


def _claim(spark: SparkSession, root: str) -> int:
    """A batch number that no other writer has."""
    n = max((int(x) for x in names_in(spark, f"{root}/claims")), default=0) + 1
    while not _touch(spark, f"{root}/claims/{n}"):
        n += 1
    return n


def _held(spark: SparkSession, root: str, version: int) -> set[int]:
    return {int(x) for x in names_in(spark, f"{root}/holds/v{version:06d}")}


def _readable(spark: SparkSession, root: str) -> set[int]:
    return {int(x) for x in names_in(spark, f"{root}/appended")}


@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: a version and the batches appended since."""

    root: str
    version: int
    batches: tuple[int, ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        """The rows with their column day; filters on type and day choose folders."""
        version = [version_path(self.root, self.version)] if self.version else []
        return read_days(spark, *version, *(batch_path(self.root, n) for n in self.batches), base=f"{self.root}/rows")


def snapshot(spark: SparkSession, root: str) -> Snapshot:
    """The version is looked up first: what it does not hold is still in its batch."""
    version = current_version(spark, root)
    return Snapshot(root, version, tuple(sorted(_readable(spark, root) - _held(spark, root, version))))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return snapshot(spark, root).rows(spark)


def append_rows(rows: DataFrame, root: str) -> int:
    """Rows enter the log as a batch of their own, after all batches claimed before; the number of the batch."""
    spark = rows.sparkSession
    n = _claim(spark, root)
    write_days(numbered_by_time(rows, n * BATCH_ROWS, BATCH_ROWS), batch_path(root, n), "errorifexists", True)
    _touch(spark, f"{root}/appended/{n}")
    return n


def write_version(rows: DataFrame, root: str, made_of: Snapshot | None = None) -> int:
    """Number the rows, write them as the next version and make it current. The version stands for the snapshot that it was made
    of; batches appended since, and without a snapshot all batches, are read beside it."""
    return _write(numbered(rows), root, made_of)


def _write(rows: DataFrame, root: str, made_of: Snapshot | None) -> int:
    spark = rows.sparkSession
    old = current_version(spark, root)
    version = old + 1
    for left in (version_path(root, version), f"{root}/holds/v{version:06d}"):  # by a failed write
        remove(spark, left)
    write_days(rows, version_path(root, version), "errorifexists")
    held = _held(spark, root, made_of.version) | set(made_of.batches) if made_of else set()
    for n in sorted(held & _readable(spark, root)):
        _touch(spark, f"{root}/holds/v{version:06d}/{n}")
    _touch(spark, f"{root}/current/v{version:06d}")
    return version


def compact(spark: SparkSession, root: str) -> int:
    """What is readable now as the next version, without repeats."""
    seen = snapshot(spark, root)
    return _write(_without_repeats(seen.rows(spark)), root, seen)


def _without_repeats(rows: DataFrame) -> DataFrame:
    """`first_per_event` of a snapshot's rows. What stays is found on narrow columns and counted per folder: folders that lose nothing
    are read as they are, and only the rows of those that lose some are looked up. A part that loses all its rows is not read."""
    if "part" not in rows.columns or not rows.where("ingest_seq IS NULL").select("ingest_seq").isEmpty():
        return first_per_event(as_log(rows), stored=True)
    folder, row = ["part", "type", "day"], ["type", "event_id", "ingest_seq"]
    narrow = rows.select(*folder, "event_id", "ingest_seq")
    first = stage(least_by(narrow, ["type", "event_id"], F.col("ingest_seq")), "first-rows")
    counts = narrow.withColumn("_n", F.lit(-1)).unionByName(first.withColumn("_n", F.lit(1)))
    folders = counts.groupBy(*folder).agg(F.sum("_n").alias("_lost"), F.count_if(F.col("_n") > 0).alias("_kept"))
    folders = stage(folders.where("_kept > 0"), "folders")

    def of(df: DataFrame, lost: str) -> DataFrame:
        # As many rows as the listing of the table has folders.
        chosen = folders.where(lost)
        parts = [r.part for r in chosen.select("part").distinct().collect()]
        return _semi(df.where(F.col("part").isin(parts)), F.broadcast(chosen), folder)

    whole = as_log(of(rows, "_lost = 0"))
    if folders.where("_lost < 0").isEmpty():
        return whole
    return whole.unionByName(as_log(_semi(of(rows, "_lost < 0"), of(first, "_lost < 0").hint("shuffle_hash"), row)))


def _semi(df: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Rows of df whose columns `names`, which may be NULL, are found in `other`."""
    other = other.select(*(F.col(c).alias(f"_{c}") for c in names))
    return df.join(other, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)), "left_semi")


def drop_taken_in(spark: SparkSession, root: str) -> None:
    """Delete old versions and the batches that the current one holds. For times when nobody reads an older version."""
    version = current_version(spark, root)
    for n in sorted(_held(spark, root, version)):
        remove(spark, f"{root}/appended/{n}")
        remove(spark, batch_path(root, n))
    for old in range(1, version):
        remove(spark, version_path(root, old))
        remove(spark, f"{root}/holds/v{old:06d}")
