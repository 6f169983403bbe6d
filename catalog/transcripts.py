"""Raw JSON lines and stored history derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import standins as S
from daybook.operators.repair import Reparsed
from daybook.operators.usage import read_usage, session_metas, usage_rows
from daybook.schema import union_log
from daybook.session import stage
from daybook.sources.event_log import encode_events
from daybook.sources.transcripts import line_bytes, locate_lines

FILE_TIME = "2024-02-01 00:00:00"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines: one file per conversation, one line per message with its whole text, plus a
    meta line, repeated blocks and broken lines. place orders the lines of a file."""
    n, content, stamp = F.col("n"), F.col("content"), F.col("stamp")
    turn, conv = F.col("turn"), F.col("conv_id")
    plain = F.regexp_replace("text", r'[\x00-\x1F"\\]', " ")
    when = _text('"timestamp":"2024-01-', F.lpad((conv % 28 + 1).cast("string"), 2, "0"), "T10:0", turn % 10, ':00.000Z"')
    said = _text('{"type":"user",', stamp, ',"message":{"content":"', content, '"}}')
    response = F.when(turn % 11 == 9, F.lit("")).otherwise(_text('"id":"msg', turn, '",'))
    claude = _text(
        '{"type":"assistant",', stamp, ',"requestId":"r', turn, '","message":{', response, '"model":"',
        S.pick(S.MODELS, conv), '","content":"', content, '","usage":{"input_tokens":', n % 97,
        ',"output_tokens":', n, ',"cache_creation_input_tokens":', n * 2, ',"cache_read_input_tokens":', n * 3,
        ',"cache_creation":{"ephemeral_1h_input_tokens":', n, '},"output_tokens_details":{"thinking_tokens":"', n, '"}}}}',
    )
    silent = _text('{"type":"assistant","message":{"model":"<synthetic>","content":"', content, '","usage":{"input_tokens":1}}}')
    counts = _text(
        '{"input_tokens":', n + 10, ',"cached_input_tokens":', n % 50, ',"output_tokens":', n, ',"total_tokens":', n + 7, "}"
    )
    wrap = (
        _text('{"payload":{"info":{"total_token_usage":', counts, "}},", stamp, ',"content":"', content, '"}'),
        _text('{"info":{"last_token_usage":', counts, ',"total_token_usage":null},', stamp, ',"content":"', content, '"}'),
        _text('{"last_token_usage":{"note":1},"token_usage":', counts, ',"content":"', content, '"}'),
    )
    codex = F.element_at(F.array(*wrap), ((turn + conv) % 3).cast("int") + 1)
    is_claude, is_reply = conv % 2 == 0, F.col("role") == "assistant"
    usage = F.when(is_claude, F.when(turn % 13 == 7, silent).otherwise(claude)).otherwise(codex)
    main = F.when(is_reply, usage).otherwise(said)
    meta = _text(
        '{"type":"session_meta","payload":{"cwd":"/work/p', conv % 5, '","model":"', S.pick(S.MODELS, conv),
        '","cli_version":"', turn, '"}}',
    )

    def extra(condition: Column, k: int, line: Column) -> Column:
        return F.when(condition, F.struct(F.lit(k).alias("k"), line.alias("line")))

    parts = F.array_compact(
        F.array(
            extra(~is_claude & (turn % 4 == 0), 0, meta),
            F.struct(F.lit(1).alias("k"), F.col("main").alias("line")),
            extra(is_claude & is_reply & (n % 3 == 0), 2, F.col("main")),
            extra((n + turn) % 17 == 0, 3, F.lit("{ bad")),
            extra(n % 19 == 0, 4, F.lit("")),
        )
    )
    name = F.when(is_claude, _text("/t/claude/proj/c", conv, ".jsonl")).otherwise(
        _text("/t/codex/2024/rollout-2024-c", conv, ".jsonl")
    )
    return (
        S.table(spark, sf_dir, "conversations")
        .withColumns({"n": F.length("text").cast("bigint"), "content": plain, "stamp": when})
        .withColumn("main", main)
        .select(
            F.when(is_claude, F.lit("claude")).otherwise(F.lit("codex")).alias("agent"),
            name.alias("source_file"),
            turn.alias("_turn"),
            F.explode(parts).alias("_p"),
        )
        .select(
            "agent",
            "source_file",
            (F.col("_turn") * 10 + F.col("_p.k")).alias("place"),
            F.col("_p.line").alias("line"),
            F.lit(FILE_TIME).cast("timestamp").alias("mtime"),
        )
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = lines(spark, sf_dir).withColumn("bytes", line_bytes()).drop("line")
    return locate_lines(sized, ["place"])


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files was never read, a third up to turn 2, a third to the end."""
    number = F.regexp_extract("source_file", r"c(\d+)\.jsonl$", 1).cast("bigint")
    rows = located(spark, sf_dir).withColumn("_n", number % 3)
    read = rows.where((F.col("_n") == 2) | ((F.col("_n") == 1) & (F.col("place") < 20)))
    return read.groupBy("source_file").agg(F.max("next_offset").alias("next_offset"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage fields first, offsets by place: whole texts stay in the scan."""
    return read_usage(lines(spark, sf_dir)).withColumn("byte_offset", F.col("place"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).groupBy("agent", "source_file").agg(
        F.count("*").alias("lines"), F.count_if("unparsed").alias("unparsed_lines"), F.count("usage").alias("usage_lines")
    )


def usage(spark: SparkSession, sf_dir: str, agent: str) -> DataFrame:
    return usage_rows(_read(spark, sf_dir).where(F.col("agent") == agent))


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_metas(_read(spark, sf_dir))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal log as JSON lines; every 10th line is written twice, every 17th followed by a broken
    or anonymous one."""
    log = union_log(S.signal_log(spark, sf_dir).withColumn("ingest_seq", F.col("ingest_seq") * 10))
    text = encode_events(log, "ingest_seq")
    seq = F.col("ingest_seq")
    number = F.floor(seq / 10)
    parts = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("k"), F.col("value").alias("line")),
            F.when(number % 10 == 0, F.struct(F.lit(1).alias("k"), F.concat(F.lit("  "), "value").alias("line"))),
            F.when(number % 17 == 0, F.struct(F.lit(2).alias("k"), F.lit("{ bad").alias("line"))),
            F.when(number % 17 == 1, F.struct(F.lit(3).alias("k"), F.lit('{"eventId":7,"type":"session"}').alias("line"))),
        )
    )
    return text.select("ingest_seq", F.explode(parts).alias("p")).select(
        F.col("p.line").alias("value"), (F.col("ingest_seq") + F.col("p.k")).alias("ingest_seq")
    )


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of an earlier calculation: turns stored up to three times at neighbouring offsets, and
    two versions of each session's summary."""
    turns = S.agent_turns(spark, sf_dir)
    copies = F.explode(F.sequence(F.lit(0), (F.col("conv_id") % 3).cast("int")))
    version = F.when(F.col("conv_id") % 4 == 3, F.lit(2)).cast("int")
    old = turns.withColumn("copy", copies)
    turn_rows = old.select(
        F.concat_ws(":", "agent", "session_uuid", (F.col("byte_offset") + F.col("copy")).cast("string")).alias("event_id"),
        "ts",
        "project",
        F.lit("main").alias("branch"),
        F.concat(F.lit("live_"), "session_uuid").alias("session_id"),
        F.lit("agent_turn").alias("type"),
        (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("copy")).alias("ingest_seq"),
        "agent", "session_uuid", "model", "input", "output", "cache_create",
        F.lit(None).cast("bigint").alias("cache_create_1h"), "cache_read", "reasoning",
        F.lit(999.0).alias("cost_usd"), F.lit("old").alias("pricing_version"), version.alias("calc_version"),
    )
    conversations = S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("rows"))
    agent = F.when(F.col("conv_id") % 2 == 0, F.lit("claude")).otherwise(F.lit("codex"))
    uuid = F.concat(F.lit("c"), "conv_id")
    summary = conversations.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    sessions = summary.select(
        F.concat_ws(":", agent, uuid, (F.col("copy") * 50000).cast("string")).alias("event_id"),
        S.shifted(F.col("conv_id") % 28, F.col("conv_id") % 24, F.lit(30) + F.col("copy")).alias("ts"),
        S.project_of("conv_id").alias("project"),
        F.lit("main").alias("branch"),
        F.concat(F.lit("flush_"), uuid).alias("session_id"),
        F.lit("agent_session").alias("type"),
        (F.col("conv_id") * 1000 + 900 + F.col("copy")).alias("ingest_seq"),
        agent.alias("agent"),
        uuid.alias("session_uuid"),
        F.lit("x").alias("model"),
        F.lit("/work").alias("cwd"),
        F.lit(99).alias("turns"),
        F.lit(999.0).alias("cost_usd"),
        F.lit("old").alias("pricing_version"),
        (F.col("rows") % 3 + F.col("copy")).alias("unparsed_lines"),
        version.alias("calc_version"),
    )
    commits = S.commit_log(spark, sf_dir)
    return stage(union_log(turn_rows, sessions, commits), "stored")


def reparsed(spark: SparkSession, sf_dir: str) -> Reparsed:
    """The transcript of every third session still exists."""
    turns = S.agent_turns(spark, sf_dir).where(F.col("conv_id") % 3 == 0)
    message_id = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("msg"), "turn"))
    conversations = S.table(spark, sf_dir, "conversations").where(F.col("conv_id") % 3 == 0)
    agent = F.when(F.col("conv_id") % 2 == 0, F.lit("claude")).otherwise(F.lit("codex"))
    files = conversations.groupBy("conv_id").agg(
        F.sum(F.length("text") + 1).cast("bigint").alias("next_offset"), F.count("*").alias("rows")
    )
    return Reparsed(
        turns.withColumn("message_id", message_id).drop("project"),
        files.select(
            agent.alias("agent"),
            F.concat(F.lit("c"), "conv_id").alias("session_uuid"),
            "next_offset",
            (F.col("rows") % 2).alias("unparsed_lines"),
        ),
    )
