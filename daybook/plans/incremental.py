"""New bytes of grown transcripts to log rows.

What lies before a file's cursor is not read again. What it says about later lines is kept per file: the last running total, the
last meta line, the response ids seen, and sums of its turns for the session summary. So a pass reads the new bytes, the
stored rows of the files in the touched buckets, and nothing else, and yields what a pass over whole files yields.

state/files/bucket=b/pass=n       one row per file of the bucket: cursor, totals, meta line, sums
state/responses/bucket=b/pass=n   response ids first seen in pass n
state/done/pass=n                 marks pass n as complete
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.functions.paths import transcript_uuid
from daybook.functions.tokens import TOKENS
from daybook.operators.dedup import one_per_response
from daybook.operators.usage import file_quality, read_usage, session_metas, to_deltas, usage_rows
from daybook.plans.ingest import Transcripts, attribute_transcripts, session_summaries, turn_events
from daybook.schema import as_log
from daybook.session import names_in, remove, stage
from daybook.sources.transcripts import grown_files, list_transcripts, read_new_lines

BUCKETS = 64
_TOKENS = ", ".join(f"{t}: bigint" for t in TOKENS)
_FILE = (
    "agent string, source_file string, next_offset bigint, unparsed_lines bigint, "
    "meta struct<byte_offset: bigint, cwd: string, model: string, cli_version: string>, "
    f"total struct<byte_offset: bigint, tokens: struct<{_TOKENS}>>, "
    f"turns bigint, started_at timestamp, last struct<ts: timestamp, byte_offset: bigint, model: string>, sums struct<{_TOKENS}>"
)
_RESPONSE = "agent string, source_file string, message_id string"


def _bucket():
    return F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class State:
    """The stored state of one agent's transcripts."""

    spark: SparkSession
    path: str

    def passes(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{self.path}/done"))

    def _newest(self, part: str, buckets: list[int] | None) -> list[str]:
        """Folders of the newest complete pass of each bucket, or for responses of all of them."""
        done, root, found = set(self.passes()), f"{self.path}/{part}", []
        there = [int(n.split("=")[1]) for n in names_in(self.spark, root) if n.startswith("bucket=")]
        for b in there if buckets is None else set(there) & set(buckets):
            passes = sorted(int(n.split("=")[1]) for n in names_in(self.spark, f"{root}/bucket={b}"))
            passes = [n for n in passes if n in done]
            found += [f"{root}/bucket={b}/pass={n}" for n in (passes[-1:] if part == "files" else passes)]
        return found

    def _read(self, part: str, schema: str, buckets: list[int] | None) -> DataFrame:
        paths = self._newest(part, buckets)
        kind = StructType.fromDDL(schema)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def files(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read("files", _FILE, buckets)

    def responses(self, buckets: list[int]) -> DataFrame:
        return self._read("responses", _RESPONSE, buckets)

    def cursors(self) -> DataFrame:
        """source_file and next_offset of every file: what a listing is compared with."""
        return self.files().select("source_file", "next_offset")


@dataclass(frozen=True)
class Pass:
    """Log rows of one pass. Once they are stored, commit() makes the next pass begin behind them; a pass that is not committed
    is repeated and gives the same rows."""

    rows: DataFrame
    state: State
    number: int

    def commit(self) -> None:
        state, spark = self.state, self.state.spark
        done = f"{state.path}/done/pass={self.number}"
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(done)
        # Rows of files that a newer complete pass has written.
        for bucket in (n for n in names_in(spark, f"{state.path}/files") if n.startswith("bucket=")):
            passes = sorted(int(n.split("=")[1]) for n in names_in(spark, f"{state.path}/files/{bucket}"))
            for old in [n for n in passes if n < self.number][:-1]:
                remove(spark, f"{state.path}/files/{bucket}/pass={old}")


def ingest_new(spark: SparkSession, path: str, agent: str, projects: DataFrame, prices: DataFrame, state: str, session_id: str = "bf_agents") -> Pass | None:
    """The log rows of what was added to the transcripts below `path` since the last committed pass, None if nothing was."""
    store = State(spark, state)
    grown = stage(grown_files(list_transcripts(spark, path), store.cursors()), "grown")
    lines = read_new_lines(spark, grown, extract=lambda x: read_usage(x.withColumn("agent", F.lit(agent))))
    if lines is None:
        return None
    number = max(store.passes(), default=-1) + 1
    read = stage(lines, "new-lines")
    buckets = [r.bucket for r in grown.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
    names = grown.select("source_file")
    before = stage(store.files(buckets).join(names, "source_file", "left_semi"), "state-before")

    # The last meta line of a file, from before the cursor if there is no new one.
    old_metas = before.where("meta IS NOT NULL").select("source_file", "meta.*")
    new_metas = read.where("meta IS NOT NULL").select("source_file", "byte_offset", "meta.cwd", "meta.model", "meta.cli_version")
    metas = old_metas.unionByName(new_metas).groupBy("source_file").agg(F.max_by(F.struct("byte_offset", "cwd", "model", "cli_version"), "byte_offset").alias("meta"))
    metas = stage(metas, "metas")
    rows = usage_rows(read, metas.select("source_file", "meta.*")).withColumn("session_uuid", transcript_uuid(F.col("source_file")))
    seen = store.responses(buckets).select("source_file", "message_id")
    rows = stage(one_per_response(rows).join(seen, ["source_file", "message_id"], "left_anti"), "new-usage")

    # The last running total of a file stands in front of its new rows.
    totals = before.where("total IS NOT NULL").select(
        "source_file", transcript_uuid(F.col("source_file")).alias("session_uuid"), F.lit(agent).alias("agent"),
        F.col("total.byte_offset").alias("byte_offset"), F.lit(True).alias("is_cumulative"), "total.tokens.*",
    )
    known = rows.withColumn("_new", F.lit(True)).unionByName(totals, allowMissingColumns=True)
    turns = to_deltas(known).where("_new").drop("_new", "is_cumulative")
    turns = stage(turns, "new-turns")

    last_total = rows.where("is_cumulative").groupBy("source_file").agg(F.max_by(F.struct("byte_offset", F.struct(*TOKENS).alias("tokens")), "byte_offset").alias("_total"))
    at = F.struct("ts", "byte_offset")
    added = turns.groupBy("source_file").agg(
        F.count("*").alias("_turns"),
        F.min("ts").alias("_start"),
        F.max_by(F.struct("ts", "byte_offset", "model"), at).alias("_last"),
        F.struct(*(F.sum(t).cast("bigint").alias(t) for t in TOKENS)).alias("_sums"),
    )
    quality = file_quality(read).withColumnsRenamed({"unparsed_lines": "_unparsed", "next_offset": "_next"})
    # A longer last line may hold back a file that grew: it is not in quality and stays as it is.
    after = quality.join(before.drop("meta"), "source_file", "left").join(metas, "source_file", "left").join(last_total, "source_file", "left").join(added, "source_file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    order = lambda c: F.struct(F.col(f"{c}.ts"), F.col(f"{c}.byte_offset"))
    newer = F.when(F.col("_last").isNull() | (order("last") > order("_last")), F.col("last")).otherwise(F.col("_last"))
    after = after.select(
        F.lit(agent).alias("agent"),
        "source_file",
        F.col("_next").alias("next_offset"),
        (zero("unparsed_lines") + F.col("_unparsed")).cast("bigint").alias("unparsed_lines"),
        "meta",
        F.coalesce("_total", "total").alias("total"),
        (zero("turns") + zero("_turns")).cast("bigint").alias("turns"),
        F.least("started_at", "_start").alias("started_at"),
        F.coalesce(newer, "_last").alias("last"),
        F.struct(*((zero(f"sums.{t}") + zero(f"_sums.{t}")).cast("bigint").alias(t) for t in TOKENS)).alias("sums"),
    )
    after = stage(after, "state-after")
    kept = store.files(buckets).join(after.select("source_file"), "source_file", "left_anti")
    _put(store, "files", after.unionByName(kept.select(*after.columns)), number)
    _put(store, "responses", rows.where("message_id IS NOT NULL").select(F.lit(agent).alias("agent"), "source_file", "message_id"), number)

    found = Transcripts(turns, metas.select("source_file", "meta.cwd"), after.select("source_file", "unparsed_lines", "next_offset"))
    owners = stage(attribute_transcripts(found, projects, agent), "owners")
    summaries = after.where("turns > 0").select(
        F.lit(agent).alias("agent"), transcript_uuid(F.col("source_file")).alias("session_uuid"),
        "started_at", F.col("last.ts").alias("ended_at"), "turns", "sums.*", F.col("last.model").alias("model"),
    )
    sessions = session_summaries(summaries, found, owners, prices)
    rows = as_log(turn_events(found, owners, prices)).unionByName(as_log(sessions)).withColumn("session_id", F.lit(session_id))
    return Pass(stage(rows, "log-rows"), store, number)


def _put(store: State, part: str, rows: DataFrame, number: int) -> None:
    root = f"{store.path}/{part}"
    for bucket in names_in(store.spark, root):  # left by a pass that was not committed
        if f"pass={number}" in names_in(store.spark, f"{root}/{bucket}"):
            remove(store.spark, f"{root}/{bucket}/pass={number}")
    spread = rows.withColumns({"bucket": _bucket(), "pass": F.lit(number)})
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "pass").parquet(root)
