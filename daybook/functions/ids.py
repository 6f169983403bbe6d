"""Deterministic event ids: the same source row always gets the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_event_id(agent: Column, uuid: Column, offset: Column) -> Column:
    return F.concat_ws(":", agent, uuid, offset.cast("string"))


def turn_event_id(agent: Column, uuid: Column, message_id: Column, offset: Column) -> Column:
    """By API response where it has an id (agent claude), else by byte offset."""
    by_response = (agent == "claude") & (F.coalesce(message_id, F.lit("")) != "")
    return F.when(by_response, F.concat_ws(":", agent, uuid, F.lit("m"), message_id)).otherwise(
        offset_event_id(agent, uuid, offset)
    )


def commit_event_id(commit_hash: Column) -> Column:
    return F.concat(F.lit("commit:"), commit_hash)


def sequence_event_id(event_type: Column, session_id: Column, seq: Column) -> Column:
    return F.concat_ws(":", event_type, session_id, seq.cast("string"))


def offset_in(event_id: Column) -> Column:
    """Number after the last colon; 0 if there is none."""
    last = F.substring_index(event_id, ":", -1)
    numeric = F.rlike(last, F.lit(r"^[0-9.eE+-]+$"))
    return F.coalesce(F.when(numeric, last.try_cast("double")), F.lit(0.0))


def idle_session_id(ms: Column) -> Column:
    return F.concat(F.lit("idle_"), F.floor(ms / 60000).cast("bigint").cast("string"))
