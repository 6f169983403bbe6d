"""From transcripts on disk to log rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.ids import offset_event_id, turn_event_id
from daybook.functions.paths import file_name, transcript_uuid
from daybook.operators.agents import price_sessions, summarize_agent_sessions
from daybook.operators.attribution import attribute_by_folder, attribute_by_slug
from daybook.operators.dedup import one_per_response
from daybook.operators.pricing import price_turns
from daybook.operators.usage import file_quality, read_usage, session_metas, to_deltas, usage_rows
from daybook.schema import CALC_VERSION, CODEX, as_log
from daybook.session import small_side, stage
from daybook.sources.transcripts import grown_files, list_transcripts, names_to_open, read_transcript_lines


@dataclass(frozen=True)
class Transcripts:
    """What a pass over transcripts yields; staged, so the files are read once."""

    turns: DataFrame
    metas: DataFrame
    quality: DataFrame


def read_transcripts(
    spark: SparkSession, path: str | list[str], agent: str, chunks: int | None = None
) -> Transcripts:
    """Turns, meta lines and quality counts of whole transcript files of one agent. Only usage fields
    leave the scan; message texts are never shuffled."""

    def usage_only(lines: DataFrame) -> DataFrame:
        return read_usage(lines.withColumn("agent", F.lit(agent)))

    read = stage(read_transcript_lines(spark, path, extract=usage_only), "transcripts")
    rows = usage_rows(read).withColumn("session_uuid", transcript_uuid(F.col("source_file")))
    turns = to_deltas(one_per_response(rows), chunks=chunks)
    return Transcripts(turns.drop("is_cumulative"), session_metas(read), file_quality(read))


def attribute_transcripts(found: Transcripts, projects: DataFrame, agent: str) -> DataFrame:
    """source_file, project, cwd. claude files lie in a folder named after the project's root; codex
    files name their working folder in the meta line."""
    if agent == CODEX:
        files = found.metas.where(F.coalesce("cwd", F.lit("")) != "").select("source_file", "cwd")
        return attribute_by_folder(files, projects).select("source_file", "project", "cwd")
    folder = F.lower(file_name(F.regexp_replace("source_file", "/[^/]*$", "")))
    files = found.quality.select("source_file", folder.alias("folder"))
    return attribute_by_slug(files, projects).select("source_file", "project", F.col("root").alias("cwd"))


def turn_events(found: Transcripts, owners: DataFrame, prices: DataFrame) -> DataFrame:
    owned = found.turns.join(small_side(owners.select("source_file", "project")), "source_file")
    priced = price_turns(owned, prices)
    ident = turn_event_id(F.col("agent"), F.col("session_uuid"), F.col("message_id"), F.col("byte_offset"))
    return priced.withColumns(
        {"event_id": ident, "type": F.lit("agent_turn"), "calc_version": F.lit(CALC_VERSION)}
    )


def session_events(turns: DataFrame, found: Transcripts, owners: DataFrame, prices: DataFrame) -> DataFrame:
    """One summary per file that has a turn."""
    return session_summaries(summarize_agent_sessions(turns), found, owners, prices)


def session_summaries(summaries: DataFrame, found: Transcripts, owners: DataFrame, prices: DataFrame) -> DataFrame:
    """Log rows of summaries (agent, session_uuid, started_at, ended_at, turns, tokens, model)."""
    summaries = price_sessions(summaries, prices)
    files = found.quality.withColumn("session_uuid", transcript_uuid(F.col("source_file")))
    owned = files.join(owners, "source_file").select(
        "session_uuid", "project", "cwd", "next_offset", "unparsed_lines"
    )
    ident = offset_event_id(F.col("agent"), F.col("session_uuid"), F.col("next_offset"))
    return summaries.join(owned, "session_uuid").withColumns(
        {
            "event_id": ident,
            "ts": F.col("ended_at"),
            "type": F.lit("agent_session"),
            "calc_version": F.lit(CALC_VERSION),
        }
    )


def ingest(
    spark: SparkSession,
    path: str,
    agent: str,
    projects: DataFrame,
    prices: DataFrame,
    cursors: DataFrame,
    session_id: str = "bf_agents",
) -> tuple[DataFrame, DataFrame] | None:
    """New log rows and the advanced cursors (source_file, next_offset), or None if no file grew.

    A grown file is read whole: running totals and repeated responses reach back before the cursor.
    Only turns past the cursor become rows, and ids are deterministic, so a repeated pass is harmless.
    """
    grown = stage(grown_files(list_transcripts(spark, path), cursors), "grown")
    names = names_to_open(grown)
    if not names:
        return None
    found = read_transcripts(spark, names, agent)
    owners = stage(attribute_transcripts(found, projects, agent), "owners")
    turns = stage(turn_events(found, owners, prices), "turns")
    start = grown.select("source_file", "from_offset")
    fresh = turns.join(small_side(start), "source_file").where("byte_offset >= from_offset")
    grown_turns = turns.join(small_side(start.select("source_file")), "source_file", "left_semi")
    sessions = session_events(grown_turns, found, owners, prices)
    rows = as_log(fresh).unionByName(as_log(sessions)).withColumn("session_id", F.lit(session_id))
    after = found.quality.join(start.select("source_file"), "source_file", "left_semi")
    return rows, after.select("source_file", "next_offset")
