"""Whole texts, words and staged tables, as all operators of this package take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.session import staging_path

# Words are separated by space, tab, line feed, vertical tab, form feed and carriage return only. Python's
# bytes.split() separates at exactly these, and bytes.lower() changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
FEW_FILES = 4
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
_BATCH_SIZE, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def training_part(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


class Memory(dict):
    """A dict that computes what it lacks and forgets what has not been asked for in the last `room` new entries or so:
    entries are kept in two generations of that size, and a use moves one to the newer."""

    room = 100_000

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.compute(key)
        if len(self) >= self.room:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: unless the session says otherwise, send fewer of them, and fewer bytes, to Python at a time than by
    default."""
    for name, most in ((_BATCH, BATCH_ROWS), (_BATCH_SIZE, BATCH_BYTES)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(most))


class Tables:
    """Tables that one call writes to the shared folder and reads back: they cut lineage, survive lost
    executors and fix what a recomputation could change. `drop` removes those that no result reads."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.label = label

    def write(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """With few, in at most FEW_FILES files, and made by as many tasks: for tables of a row per source or bin."""
        df = df.coalesce(FEW_FILES) if few else df
        path = staging_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.staged_at = path
        return table

    def drop(self, table: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
