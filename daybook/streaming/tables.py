"""Streams of rows whose results depend on earlier rows: work sessions, usage from running totals, changes of diagnostics,
edit windows.

A row that comes late changes what follows it, and a project may hold a third of all rows. So no state is kept per key in
one task. Each micro-batch is stored, the batch operator runs again from the last place that the new rows cannot change, and
its rows replace those from there on. After any number of batches, in any order, the result is that of the batch operator
over all rows.

What a batch reads does not grow with what is stored. Rows and results lie by slice of their place (a day, some bytes) and bucket of
their key; a batch opens the slices from its place of recomputation on, which for rows in order is the open session or window. It finds
that place in a small table of heads: per key the last place from which a recomputation can start. A batch writes the heads of
the buckets it touches only. For rows that are too late for it, the place is looked up in the slices before them, nearest first.

target/rows/slice=s/bucket=b/batch=n      the rows of micro-batch n
target/results/slice=s/bucket=b/batch=n   what batch n computed
target/heads/bucket=b/batch=n             where later batches can start
target/since/batch=n                      keys and the place from which batch n computed again; written last, it makes the batch valid

A batch that runs again after a failure writes the same parts again; readers take valid batches only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daybook.functions.tokens import TOKENS, zero_if_null
from daybook.functions.when import epoch_ms
from daybook.operators.activity import GRACE_MS, IDLE_MS, MIN_SESSION_MS, sessionize_ticks
from daybook.operators.ordered import CHUNK, OrderedRows, highest
from daybook.operators.signals import DIAGNOSTICS_WINDOW, EDIT_WINDOW, aggregate_edits, detect_changes, sample_diagnostics
from daybook.operators.usage import to_deltas
from daybook.session import names_in, remove, stage, staging

BUCKETS = 16
DAY_MS = 86_400_000
# Offsets of a transcript in one slice.
OFFSETS = 1 << 24
PLACE = ["place_0", "place_1"]
_LEAST = -(1 << 62)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The values of a partition column in a folder."""
    return sorted(int(x.split("=")[1]) for x in names_in(spark, path) if x.startswith(f"{name}="))


@dataclass
class _Store:
    """Parts of a stream's tables, by slice of the first place and bucket of the keys."""

    spark: SparkSession
    target: str
    keys: Sequence[str]
    width: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def slice_of(self, place: Column) -> Column:
        return F.floor(place / self.width)

    def put(self, part: str, rows: DataFrame, number: int) -> None:
        spread = rows.withColumns({"slice": self.slice_of(F.col(PLACE[0])), "bucket": self.bucket(), "batch": F.lit(number)})
        writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("slice", "bucket", "batch").parquet(f"{self.target}/{part}")

    def slices(self, part: str) -> list[int]:
        return _numbers(self.spark, f"{self.target}/{part}", "slice")

    def get(self, part: str, wanted: dict[int, tuple[int, int | None]], upto: int) -> DataFrame | None:
        """Rows of batches up to `upto` in the slices wanted of each bucket, from and to, with their batch; None if there are none."""
        root, paths = f"{self.target}/{part}", []
        for s in self.slices(part):
            buckets = [b for b, (low, high) in wanted.items() if low <= s and (high is None or s <= high)]
            if buckets:
                there = set(_numbers(self.spark, f"{root}/slice={s}", "bucket"))
                paths += [f"{root}/slice={s}/bucket={b}" for b in buckets if b in there]
        if not paths:
            return None
        return self.spark.read.option("basePath", root).parquet(*paths).where(F.col("batch") <= upto).drop("slice", "bucket")

    def parts(self, part: str, wanted: set[tuple[int, int]], upto: int) -> DataFrame:
        """Rows of batches up to `upto` in the given slices and buckets, which exist."""
        root = f"{self.target}/{part}"
        paths = [f"{root}/slice={s}/bucket={b}" for s, b in sorted(wanted)]
        return self.spark.read.option("basePath", root).parquet(*paths).where(F.col("batch") <= upto).drop("slice", "bucket")

    def heads(self, buckets: Sequence[int], before: int) -> DataFrame | None:
        root, paths = f"{self.target}/heads", []
        for b in buckets:
            earlier = [n for n in _numbers(self.spark, f"{root}/bucket={b}", "batch") if n < before]
            paths += [f"{root}/bucket={b}/batch={earlier[-1]}"] if earlier else []
        return self.spark.read.parquet(*paths) if paths else None

    def put_heads(self, heads: DataFrame, number: int, buckets: Sequence[int]) -> None:
        writer = heads.withColumns({"bucket": self.bucket(), "batch": F.lit(number)}).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.target}/heads")
        for b in buckets:
            # The batch before may have to run again; what is older is not asked for any more.
            for n in [n for n in _numbers(self.spark, f"{self.target}/heads/bucket={b}", "batch") if n < number][:-1]:
                remove(self.spark, f"{self.target}/heads/bucket={b}/batch={n}")


def _valid(spark: SparkSession, target: str) -> int:
    """The last batch that is complete; -1 if there is none."""
    return max(_numbers(spark, f"{target}/since", "batch"), default=-1)


def _since(spark: SparkSession, target: str, upto: int) -> DataFrame:
    path = f"{target}/since"
    batches = [n for n in _numbers(spark, path, "batch") if n <= upto]
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in batches))


def _newest(results: DataFrame, since: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results that no later batch has computed again: in the order of their places, those of a batch no older than any that
    started before."""
    marks = since.select(*keys, *PLACE, F.col("batch").alias("_mark"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_row"))
    rows = results.withColumns({"_side": F.lit(1), "_row": F.monotonically_increasing_id(), "_mark": F.lit(None).cast("int")})
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_at", F.coalesce("_row", F.col("_mark").cast("long")))
    ordered = OrderedRows(both, keys, [*PLACE, "_side", "_at"], label="newest")
    again = ordered.carry(_again=highest(F.col("_mark"))).where("_side = 1 AND batch >= coalesce(_again, -1)")
    return again.drop(CHUNK, "batch", "_again", "_mark", "_side", "_row", "_at")


def _read(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame | None:
    upto = _valid(spark, target)
    if upto < 0 or not names_in(spark, f"{target}/results"):
        return None
    rows = spark.read.parquet(f"{target}/results").drop("slice", "bucket").where(F.col("batch") <= upto)
    return _newest(rows, _since(spark, target, upto), keys).drop(*PLACE)


@dataclass
class _Fold:
    """A stream that computes again from a start per key.

    points(rows or results) are the places a batch can start from, each with the `limit` beyond which its first row must be.
    from_results: they are among the results and computed again; otherwise they are among the rows, and results are replaced from the
    first new place on. compute(rows) gets the rows from `margin` before the start on, each with base_0, base_1 (the start; null: the
    beginning) and first_0 (the first new place), and gives results with their places. With carry, a head keeps the row to
    start from, and new rows that follow all others of their key need no stored ones.
    """

    target: str
    checkpoint: str
    keys: list[str]
    width: int
    compute: Callable[[DataFrame], DataFrame]
    points: Callable[[DataFrame], DataFrame]
    from_results: bool = False
    margin: int = 0
    carry: bool = False

    def start(self, rows: DataFrame) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(self.fold).option("checkpointLocation", self.checkpoint)
        return writer.trigger(availableNow=True).start()

    def fold(self, batch: DataFrame, number: int) -> None:
        store = _Store(batch.sparkSession, self.target, self.keys, self.width)
        with staging(store.spark):
            new = stage(batch.dropna(subset=[*self.keys, *PLACE]), "new")
            store.put("rows", new, number)
            starts = stage(self._starts(store, new, number), "starts")
            rows = self._rows(store, starts, new, number)
            results = stage(self.compute(rows), "results")
            store.put("results", results, number)
            self._put_heads(store, starts, results if self.from_results else rows, number)
            again = [F.coalesce(f"from_{k}", F.lit(_LEAST if k == 0 else 0)).cast("long").alias(p) for k, p in enumerate(PLACE)]
            starts.select(*self.keys, *again).write.mode("overwrite").parquet(f"{self.target}/since/batch={number}")

    def _starts(self, store: _Store, new: DataFrame, number: int) -> DataFrame:
        """Per key: first_0 and last_0 of the new rows; base_0 and base_1 to start from; from_0 and from_1 from which results are
        replaced; low, the first slice whose rows are asked for; in_order if none are; begin, before and point of the head."""
        first = new.groupBy(*self.keys).agg(F.min(PLACE[0]).alias("first_0"), F.max(PLACE[0]).alias("last_0"))
        first = first.withColumn("bucket", store.bucket())
        heads = store.heads(_buckets(first), number)
        if heads is None:
            row = f", row: {new.schema.simpleString()}" if self.carry else ""
            kinds = {"begin": "bigint", "before": "bigint", "point": f"struct<place_0: bigint, place_1: bigint, limit: bigint{row}>"}
            rows = first.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})
        else:
            rows = first.join(heads.drop("bucket", "batch"), self.keys, "left")
        rows = stage(rows, "heads-of")
        late = rows.where("point.limit >= first_0").select(*self.keys, "bucket", "first_0")
        found = self._searched(store, late, number)
        known = F.when(F.col("point.limit") < F.col("first_0"), F.struct(*(F.col(f"point.{p}") for p in PLACE)))
        if found is None:
            rows = rows.withColumn("start", known)
        else:
            rows = rows.join(found, self.keys, "left").withColumn("start", F.coalesce(known, "found")).drop("found")
        rows = rows.withColumns({f"base_{k}": F.col(f"start.{p}") for k, p in enumerate(PLACE)}).drop("start")
        least = F.coalesce("base_0", F.least("begin", "first_0")) - self.margin
        ahead = F.coalesce(F.col("first_0") > F.col("before"), F.lit(True))
        origin = {"from_0": "base_0", "from_1": "base_1"} if self.from_results else {"from_0": "first_0"}
        rows = rows.withColumns({"low": store.slice_of(least), "in_order": ahead if self.carry else F.lit(False), "from_1": F.lit(0).cast("long")})
        return rows.withColumns({to: F.col(c) for to, c in origin.items()})

    def _searched(self, store: _Store, late: DataFrame, number: int) -> DataFrame | None:
        """(keys, found): the last start before each late key's first row. The slices before it are opened from the nearest one on,
        twice as many each time, until every key has one or has no slice left."""
        part = "results" if self.from_results else "rows"
        high = {r.bucket: r.high for r in late.groupBy("bucket").agg(F.max(store.slice_of(F.col("first_0"))).alias("high")).collect()}
        if not high:
            return None
        slices, found, left, many = store.slices(part), None, late, 1
        while high:
            below = {b: [s for s in slices if s <= h][-many:] for b, h in high.items()}
            below = {b: s for b, s in below.items() if s}
            rows = store.get(part, {b: (s[0], s[-1]) for b, s in below.items()}, number - 1)
            if rows is not None:
                rows = rows.join(left.select(*self.keys, "first_0"), self.keys)
                if self.from_results:
                    marks = _since(store.spark, self.target, number - 1).join(left.select(*self.keys), self.keys, "left_semi")
                    rows = _newest(rows, marks, self.keys)
                best = self.points(rows).where("limit < first_0").groupBy(*self.keys).agg(F.max(F.struct(*PLACE)).alias("found"))
                best = stage(best, "found")
                found = best if found is None else found.unionByName(best)
                left = stage(left.join(best, self.keys, "left_anti"), "left")
            rest = _buckets(left)
            high = {b: s[0] - 1 for b, s in below.items() if b in rest}
            many *= 2
        return found

    def _rows(self, store: _Store, starts: DataFrame, new: DataFrame, number: int) -> DataFrame:
        own = starts.select(*self.keys, "base_0", "base_1", "first_0", "in_order")
        rows = new.join(own.where("in_order"), self.keys)
        if self.carry:
            kept = starts.where("in_order AND base_0 IS NOT NULL").select("point.row.*", "base_0", "base_1", "first_0", "in_order")
            rows = rows.unionByName(kept)
        low = starts.where("NOT in_order").groupBy("bucket").agg(F.min("low").alias("low")).collect()  # at most BUCKETS
        stored = store.get("rows", {r.bucket: (r.low, None) for r in low}, number)
        if stored is not None:
            stored = stored.drop("batch").join(own.where("NOT in_order"), self.keys)
            rows = rows.unionByName(stored.select(*rows.columns))
        return rows.where((F.col(PLACE[0]) >= F.col("base_0") - self.margin) | F.col("base_0").isNull()).drop("in_order")

    def _top(self, source: DataFrame) -> DataFrame:
        """(keys, point): the last place of each key to start from."""
        point = F.struct(*PLACE, "limit", *(["row"] if self.carry else []))
        return self.points(source).groupBy(*self.keys).agg(F.max_by(point, F.struct(*PLACE)).alias("point"))

    def _put_heads(self, store: _Store, starts: DataFrame, source: DataFrame, number: int) -> None:
        top = self._top(source).withColumnRenamed("point", "top")
        # A start before the place of recomputation still holds.
        origin = F.struct(*(F.coalesce(f"from_{k}", F.lit(_LEAST if k == 0 else 0)).alias(p) for k, p in enumerate(PLACE)))
        holds = F.when(F.struct(*(F.col(f"point.{p}") for p in PLACE)) < origin, F.col("point"))
        touched = starts.join(top, self.keys, "left").select(
            *self.keys,
            F.least("begin", "first_0").alias("begin"),
            F.greatest("before", "last_0").alias("before"),
            F.coalesce("top", holds).alias("point"),
        )
        buckets = _buckets(starts)
        old = store.heads(buckets, number)
        if old is not None:
            touched = touched.unionByName(old.drop("bucket", "batch").join(starts.select(*self.keys), self.keys, "left_anti"))
        store.put_heads(touched, number, buckets)


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets in rows, BUCKETS at most."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


_PROJECT = ["project"]


def stream_sessions(
    ticks: DataFrame,
    target: str,
    checkpoint: str,
    idle_ms: int = IDLE_MS,
    grace_ms: int = GRACE_MS,
    min_session_ms: int = MIN_SESSION_MS,
    writes_by_id: bool = False,
) -> StreamingQuery:
    """Sessions from a stream of ticks (project, ts, id, interaction, focused) and agent writes (the same with is_write
    true). A write counts for all ticks of its millisecond; with writes_by_id for those from its instant and id on. A batch computes again from the start of the last session that closed before its first row."""
    rows = ticks.select("project", "ts", "id", "interaction", "focused", F.coalesce("is_write", F.lit(False)).alias("is_write"))
    rows = rows.withColumns({"place_0": epoch_ms(F.col("ts")), "place_1": F.col("id").cast("long")})

    def compute(rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates(["project", "ts", "id", "is_write"])
        base = F.coalesce("base_0", F.lit(_LEAST))
        after = F.struct(*PLACE) >= F.struct(base, F.coalesce("base_1", F.lit(0)))
        tick_rows = rows.where(~F.col("is_write") & after).select("project", "ts", "id", "interaction", "focused")
        writes = rows.where(F.col("is_write") & (F.col("place_0") > base - grace_ms)).select("project", "ts", *(["id"] if writes_by_id else []))
        found = sessionize_ticks(tick_rows, writes, idle_ms, grace_ms, min_session_ms)
        # Time and id of the tick that opened a session, from its id.
        parts = F.split("session_id", "_")
        return found.withColumns({"place_0": F.get(parts, F.size(parts) - 2).cast("long"), "place_1": F.get(parts, F.size(parts) - 1).cast("long")})

    def closed(sessions: DataFrame) -> DataFrame:
        return sessions.where("is_closed").withColumn("limit", epoch_ms(F.col("ended_at")))

    return _Fold(target, checkpoint, _PROJECT, DAY_MS, compute, closed, from_results=True, margin=grace_ms).start(rows)


def read_sessions(spark: SparkSession, target: str) -> DataFrame | None:
    """The sessions of a stream so far. One that was open at its project's last tick has is_closed false and ends there,
    so nothing is lost if no further tick comes."""
    return _read(spark, target, _PROJECT)


_SESSION = ["agent", "session_uuid"]


def stream_deltas(usage: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Per-turn usage from a stream of usage rows. A batch computes again from its first row on, with the last running
    total before it, which the head of its session keeps."""
    rows = usage.withColumns({t: zero_if_null(t) for t in TOKENS})
    rows = rows.withColumns({"place_0": F.col("byte_offset").cast("long"), "place_1": F.lit(0).cast("long")})
    shown = [c for c in rows.columns]

    def compute(rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates([*_SESSION, "byte_offset"])
        return to_deltas(rows).where("place_0 >= first_0").drop("base_0", "base_1", "first_0")

    def totals(rows: DataFrame) -> DataFrame:
        return rows.where("is_cumulative").withColumns({"limit": F.col("place_0"), "row": F.struct(*shown)})

    return _Fold(target, checkpoint, _SESSION, OFFSETS, compute, totals, carry=True).start(rows)


def read_deltas(spark: SparkSession, target: str) -> DataFrame | None:
    return _read(spark, target, _SESSION)


def stream_diagnostics(snapshots: DataFrame, target: str, checkpoint: str, width: str = DIAGNOSTICS_WINDOW) -> StreamingQuery:
    """Changes of diagnostics from a stream of snapshots (project, ts, id, errors, warnings): the last one of each window, if
    its numbers differ from the one before. A batch computes again from the window of its first row, with the one before."""
    begin = F.unix_millis(F.window("ts", width)["start"])
    rows = snapshots.select("project", "ts", "id", "errors", "warnings").withColumns({"place_0": begin, "place_1": F.lit(0).cast("long")})

    def compute(rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates(["project", "ts", "id"])
        first = rows.select("project", "first_0").distinct()
        changed = detect_changes(sample_diagnostics(rows.select("project", "ts", "id", "errors", "warnings"), width))
        changed = changed.withColumns({"place_0": begin, "place_1": F.lit(0).cast("long")})
        return changed.join(first, "project").where("place_0 >= first_0").drop("first_0")

    def windows(rows: DataFrame) -> DataFrame:
        return rows.withColumn("limit", F.col("place_0"))

    return _Fold(target, checkpoint, _PROJECT, DAY_MS, compute, windows).start(rows)


def read_diagnostics(spark: SparkSession, target: str) -> DataFrame | None:
    return _read(spark, target, _PROJECT)


def stream_edits(edits: DataFrame, target: str, checkpoint: str, width: str = EDIT_WINDOW) -> StreamingQuery:
    """Edit windows from a stream of edits (project, ts, id, file, language, lines_added, lines_removed), whatever their order. A
    batch reads the days it touches and computes the windows it touches again; an edit that comes twice counts once."""
    begin = F.unix_millis(F.window("ts", width)["start"])
    rows = edits.withColumns({"place_0": begin, "place_1": F.lit(0).cast("long")})

    def fold(batch: DataFrame, number: int) -> None:
        store = _Store(batch.sparkSession, target, _PROJECT, DAY_MS)
        with staging(store.spark):
            new = stage(batch.dropna(subset=["project", "place_0"]), "new")
            store.put("rows", new, number)
            windows = stage(new.select("project", *PLACE).distinct().withColumns({"bucket": store.bucket(), "slice": store.slice_of(F.col("place_0"))}), "windows")
            touched = {(r.slice, r.bucket) for r in windows.select("slice", "bucket").distinct().collect()}  # days and buckets of one batch
            every = store.parts("rows", touched, number)
            every = every.drop("batch").join(windows.select("project", "place_0"), ["project", "place_0"], "left_semi")
            found = aggregate_edits(every.dropDuplicates(["project", "ts", "id"]), width)
            found = found.withColumns({"place_0": F.unix_millis("window.start"), "place_1": F.lit(0).cast("long")})
            store.put("results", found, number)
            windows.select("project", *PLACE).write.mode("overwrite").parquet(f"{target}/since/batch={number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edits(spark: SparkSession, target: str) -> DataFrame | None:
    """The edit windows of a stream so far: of each window what the last batch that touched it computed."""
    upto = _valid(spark, target)
    if upto < 0 or not names_in(spark, f"{target}/results"):
        return None
    last = _since(spark, target, upto).groupBy("project", "place_0").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{target}/results").drop("slice", "bucket")
    return rows.join(last, ["project", "place_0", "batch"], "left_semi").drop("batch", *PLACE)
