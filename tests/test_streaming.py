import os
import random
import subprocess
import sys
import tempfile
import textwrap

from pyspark.sql import functions as F

from daybook.functions.tokens import TOKENS
from daybook.operators.activity import DIMENSIONS, sessionize_ticks
from daybook.operators.signals import aggregate_edits, detect_changes, sample_diagnostics
from daybook.operators.usage import to_deltas
from daybook.schema import as_log
from daybook.session import names_in
from daybook.sources.event_log import append_events, first_per_event, read_log
from daybook.streaming import tables
from daybook.streaming.ingest import read_ingested, stream_ingest, stream_log_lines


def folder():
    return tempfile.mkdtemp(prefix="daybook-test-")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def changes(spark, days):
    """One diagnostics row per (number, day or None), its text telling the number."""
    data = [(f"diagnostics:d:{n}", d and f"2024-{d} 08:00:00", n) for n, d in days]
    df = spark.createDataFrame(data, "event_id string, at string, errors long").withColumn("ts", F.try_to_timestamp("at"))
    return as_log(df.withColumns({"project": F.lit("p"), "session_id": F.lit("d"), "type": F.lit("diagnostics")}))


def test_streamed_log_equals_the_batch_log(spark):
    """Old, late, repeated and unreadable times over three passes: nothing is lost, and the order is that of the log."""
    source, target, checkpoint = folder(), folder() + "/log", folder()
    passes = [
        [(n, "06-11") for n in range(40)],
        [(50, "01-02"), (51, "02-03"), (3, "01-01"), (52, "06-30"), (53, None)],
        [(60, "01-01"), (50, "12-31"), (53, "05-05"), (61, "06-11")],
    ]
    for number, days in enumerate(passes):
        append_events(changes(spark, days).coalesce(1), source)
        with open(f"{source}/broken-{number}", "w") as f:
            f.write("{ not json\n")
        stream_ingest(spark, source, target, checkpoint).awaitTermination()
    batch = first_per_event(read_log(spark, source))
    streamed = read_ingested(spark, target)
    shown = ["event_id", "ts", "errors"]
    assert rows(streamed, *shown) == rows(batch, *shown) and streamed.count() == 40 + 5 - 1 + 2
    in_order = [r.event_id for r in streamed.orderBy("ingest_seq").collect()]
    assert in_order == [r.event_id for r in batch.orderBy("ingest_seq").collect()]
    assert in_order[:40] == [f"diagnostics:d:{n}" for n in range(40)]


def test_a_batch_that_runs_again_replaces_itself(spark):
    source, target = folder(), folder() + "/log"
    append_events(changes(spark, [(1, "03-03"), (2, "03-04")]), source)
    for _ in range(2):
        stream_ingest(spark, source, target, folder()).awaitTermination()
    assert names_in(spark, target) == ["batch=0"]
    assert spark.read.parquet(f"{target}/batch=0").count() == 2


def passes(df, key, seed, source, start):
    """Write df in shuffled parts, some rows twice, and run the stream after each."""
    parts = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(3)))
    for part in range(3):
        now = parts.where((F.col("_part") == part) | (F.col("_part") == part - 1) & (F.xxhash64(key) % 5 == 0))
        now.drop("_part").write.mode("append").parquet(source)
        start().awaitTermination()


def test_deltas_in_any_order_equal_the_batch_deltas(spark):
    rng = random.Random(31)
    data, total = [], 0
    for i in range(90):
        total = 0 if i % 23 == 22 else total + rng.randint(0, 70)
        data.append(("codex", f"run{i % 2}", i, i % 4 != 1, total, total // 3, 0, 0, 2 * total, 0))
    schema = "agent string, session_uuid string, byte_offset long, is_cumulative boolean, " + ", ".join(f"{t} long" for t in TOKENS)
    whole = spark.createDataFrame(data, schema)
    source, target, checkpoint = folder(), folder(), folder()

    def start():
        return tables.stream_deltas(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint)

    passes(whole, "byte_offset", 1, source, start)
    columns = ["session_uuid", "byte_offset", *TOKENS]
    assert rows(tables.read_deltas(spark, target), *columns) == rows(to_deltas(whole, chunks=5), *columns)


def signals(spark, n=400, seed=8):
    rng = random.Random(seed)
    data, t = [], 1_711_000_000_000
    for i in range(n):
        t += rng.choice([0, 20_000, 20_000, 90_000, 240_000, 800_000])
        is_write = rng.random() < 0.2
        data.append((f"site{i % 2}", t, i, rng.random() < 0.3, rng.random() < 0.6, is_write))
    df = spark.createDataFrame(data, "project string, ms long, id long, interaction boolean, focused boolean, is_write boolean")
    return df.withColumn("ts", F.timestamp_millis("ms"))


def batch_sessions(whole):
    ticks, writes = whole.where("not is_write").drop("is_write"), whole.where("is_write").select("project", "ts")
    return sessionize_ticks(ticks, writes, chunks=6)


SHOWN = ["session_id", "started_at", "ended_at", "is_closed", *DIMENSIONS]


def test_late_ticks_give_the_batch_sessions(spark):
    whole = signals(spark)
    source, target, checkpoint = folder(), folder(), folder()

    def start():
        return tables.stream_sessions(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint)

    passes(whole, "id", 2, source, start)
    assert rows(tables.read_sessions(spark, target), *SHOWN) == rows(batch_sessions(whole), *SHOWN)


def test_sessions_in_order_and_an_open_one(spark):
    """After each pass the sessions are those of the rows so far; the last one is kept as it was at its last tick."""
    whole = signals(spark, 120, 4)
    source, target, checkpoint = folder(), folder(), folder()
    for low, high in ((0, 50), (50, 51), (51, 120)):
        whole.where(f"id >= {low} and id < {high}").write.mode("append").parquet(source)
        tables.stream_sessions(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint).awaitTermination()
        assert rows(tables.read_sessions(spark, target), *SHOWN) == rows(batch_sessions(whole.where(f"id < {high}")), *SHOWN)


def test_a_tick_between_two_earlier_ones(spark):
    base = 1_711_000_000_000
    schema = "project string, ms long, id long, interaction boolean, focused boolean, is_write boolean"
    source, target, checkpoint = folder(), folder(), folder()
    for seconds in ([0, 100, 200], [150], [300]):
        part = spark.createDataFrame([("p", base + s * 1000, s, True, True, False) for s in seconds], schema)
        part.withColumn("ts", F.timestamp_millis("ms")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        tables.stream_sessions(stream, target, checkpoint).awaitTermination()
    [found] = tables.read_sessions(spark, target).collect()
    assert found.duration_ms == 300_000 and not found.is_closed


def test_late_snapshots_give_the_batch_changes(spark):
    rng, t, data = random.Random(6), 1_711_000_000, []
    for i in range(80):
        t += rng.choice([5, 12, 40, 90])
        data.append((f"site{i % 2}", t, i, rng.randint(0, 2), rng.randint(0, 1)))
    whole = spark.createDataFrame(data, "project string, s long, id long, errors long, warnings long").withColumn("ts", F.timestamp_seconds("s"))
    source, target, checkpoint = folder(), folder(), folder()

    def start():
        return tables.stream_diagnostics(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint)

    passes(whole, "id", 3, source, start)
    columns = ["project", "id", "errors", "warnings"]
    batch = detect_changes(sample_diagnostics(whole.select("project", "ts", "id", "errors", "warnings")))
    assert rows(tables.read_diagnostics(spark, target), *columns) == rows(batch, *columns)


EDITS = "project string, s long, id long, file string, language string, lines_added long, lines_removed long"


def edits(spark, rows):
    return spark.createDataFrame(rows, EDITS).withColumn("ts", F.timestamp_seconds("s"))


def test_late_and_repeated_edits_give_the_batch_windows(spark):
    rng = random.Random(3)
    whole = edits(spark, [(f"p{i % 3 // 2}", 1_711_000_000 + rng.randint(0, 40_000), i, f"m{i % 3}", f"l{i % 4}", i % 5, i % 2) for i in range(300)])
    source, target, checkpoint = folder(), folder(), folder()

    def start():
        return tables.stream_edits(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint)

    assert tables.read_edits(spark, target) is None
    passes(whole, "id", 4, source, start)
    columns = ["project", "window.start", "file", "language", "lines_added", "lines_removed"]
    assert rows(tables.read_edits(spark, target), *columns) == rows(aggregate_edits(whole), *columns)


def test_a_late_edit_can_empty_a_window(spark):
    """Lines that a late edit takes back leave a window without change, which goes."""
    source, target, checkpoint = folder(), folder(), folder()
    for part in ([("p", 1_711_000_005, 1, "f", "x", 3, 0)], [("p", 1_711_900_000, 2, "f", "x", 1, 0)], [("p", 1_711_000_006, 3, "f", "x", -3, 0)]):
        edits(spark, part).write.mode("append").parquet(source)
        tables.stream_edits(spark.readStream.schema(edits(spark, part).schema).parquet(source), target, checkpoint).awaitTermination()
    assert [r.lines_added for r in tables.read_edits(spark, target).collect()] == [1]


def counted_reads(monkeypatch):
    """Stored rows and heads that each batch reads."""
    reads = {}
    get, heads = tables._Store.get, tables._Store.heads

    def counted(name, plain):
        def run(self, *args):
            found = plain(self, *args)
            number = args[-1] - (name == "late")
            reads[number] = reads.get(number, 0) + (0 if found is None else found.count())
            return found

        return run

    monkeypatch.setattr(tables._Store, "get", counted("rows", get))
    monkeypatch.setattr(tables._Store, "heads", counted("heads", heads))
    return reads


def test_what_a_batch_reads_stays_level(spark, monkeypatch):
    """Ten batches in order, a day each, whose sessions close in the evening: the last ones read no more than the first ones, and the
    sessions are those of all rows."""
    reads = counted_reads(monkeypatch)
    day, parts = 86_400_000, []
    for n in range(10):
        at = 1_711_000_000_000 + n * day
        live = [(f"p{k % 3}", at + k * 45_000, n * 1_000 + k, k % 7 != 0, k % 5 != 0, k % 11 == 0, n) for k in range(57)]
        parts += live + [(f"p{k % 3}", at + 10_000_000, n * 1_000 + k, False, False, False, n) for k in range(57, 60)]
    whole = spark.createDataFrame(parts, "project string, ms long, id long, interaction boolean, focused boolean, is_write boolean, part long")
    whole = whole.withColumn("ts", F.timestamp_millis("ms"))
    source, target, checkpoint = folder(), folder(), folder()
    for n in range(10):
        whole.where(f"part = {n}").drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(whole.drop("part").schema).parquet(source)
    tables.stream_sessions(stream, target, checkpoint).awaitTermination()
    per_batch = [reads[n] for n in sorted(reads)]
    assert len(per_batch) == 10 and max(per_batch[5:]) <= 1.2 * max(per_batch[1:5])
    assert rows(tables.read_sessions(spark, target), *SHOWN) == rows(batch_sessions(whole), *SHOWN)


def test_a_batch_of_deltas_reads_heads_only(spark, monkeypatch):
    source, target, checkpoint = folder(), folder(), folder()
    schema = "agent string, session_uuid string, byte_offset long, is_cumulative boolean, " + ", ".join(f"{t} long" for t in TOKENS)
    data = [("codex", f"s{i % 2}", i, i % 3 > 0, 10 * i, i, 0, 0, 11 * i, 0) for i in range(60)]
    reads = counted_reads(monkeypatch)
    for n in range(4):
        spark.createDataFrame(data[15 * n : 15 * n + 15], schema).write.mode("append").parquet(source)
        tables.stream_deltas(spark.readStream.schema(schema).parquet(source), target, checkpoint).awaitTermination()
    assert max(reads.values()) <= 4  # a head per session, read twice
    columns = ["session_uuid", "byte_offset", *TOKENS]
    assert rows(tables.read_deltas(spark, target), *columns) == rows(to_deltas(spark.createDataFrame(data, schema)), *columns)


def test_rows_without_time_or_project_change_nothing(spark):
    whole = signals(spark, 60, 9)
    odd = whole.limit(2).withColumn("ts", F.lit(None).cast("timestamp")).unionByName(whole.limit(1).withColumn("project", F.lit(None).cast("string")))
    source, target, checkpoint = folder(), folder(), folder()
    whole.unionByName(odd).write.mode("append").parquet(source)
    tables.stream_sessions(spark.readStream.schema(whole.schema).parquet(source), target, checkpoint).awaitTermination()
    assert rows(tables.read_sessions(spark, target), *SHOWN) == rows(batch_sessions(whole), *SHOWN)


def test_a_batch_that_did_not_end_is_not_read(spark):
    """Its parts are there, but not the mark that comes last; when it runs again it writes them again."""
    whole = signals(spark, 90, 12)
    source, target = folder(), folder()
    first, second = whole.where("id < 60"), whole.where("id >= 60")
    first.write.mode("append").parquet(source)
    tables.stream_sessions(spark.readStream.schema(whole.schema).parquet(source), target, folder()).awaitTermination()
    shown = rows(tables.read_sessions(spark, target), *SHOWN)
    fold = tables._Fold(target, "", ["project"], tables.DAY_MS, None, None, from_results=True)
    placed = second.withColumns({"place_0": F.col("ms"), "place_1": F.col("id")})
    tables._Store(spark, target, fold.keys, fold.width).put("rows", placed, 1)
    assert rows(tables.read_sessions(spark, target), *SHOWN) == shown


def test_lines_are_read_with_their_place(spark):
    assert stream_log_lines(spark, folder()).columns == ["value", "_mtime", "_file", "_block"]


def test_streams_run_from_any_folder():
    """After ship() Python workers find the package although the session was started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession, functions as F
        from daybook.shipping import ship
        from daybook.streaming import tables
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        ship(spark)
        rows = [("p", 1711000000000 + 60000 * k, k, True, True, False) for k in range(5)]
        df = spark.createDataFrame(rows, "project string, ms long, id long, interaction boolean, focused boolean, is_write boolean")
        df = df.withColumn("ts", F.timestamp_millis("ms"))
        df.write.parquet("in")
        tables.stream_sessions(spark.readStream.schema(df.schema).parquet("in"), "out", "check").awaitTermination()
        assert tables.read_sessions(spark, "out").first().duration_ms == 240000
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=folder(), env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_streamed_writes_by_id_stand_in_the_order_of_the_ticks(spark):
    """Of one instant, a write counts for ticks from its id on, as in the batch operator; without the choice for all of them."""
    base = 1_711_000_000_000
    data = [("p", base, 0, False), ("p", base + 60_000, 1, False), ("p", base + 60_000, 2, True), ("p", base + 120_000, 3, False)]
    whole = spark.createDataFrame(data, "project string, ms long, id long, is_write boolean")
    whole = whole.withColumns({"ts": F.timestamp_millis("ms"), "interaction": F.lit(False), "focused": F.lit(True)}).drop("ms")
    for by_id, present in ((True, 60_000), (False, 120_000)):
        source, target, checkpoint = folder(), folder(), folder()
        whole.write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        tables.stream_sessions(stream, target, checkpoint, writes_by_id=by_id).awaitTermination()
        [found] = tables.read_sessions(spark, target).collect()
        assert (found.duration_ms, found.agent_present_ms) == (120_000, present)
