"""The event log: one wide row per event, payload fields as nullable columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Agents, calculation version, model assumed for a codex session that names none.
CLAUDE, CODEX = "claude", "codex"
CALC_VERSION = 2
DEFAULT_CODEX_MODEL = "gpt-5-codex"
UNKNOWN_MODEL = "unknown"

ENVELOPE = {
    "event_id": "string",
    "ts": "timestamp",
    "project": "string",
    "branch": "string",
    "session_id": "string",
    "type": "string",
    "ingest_seq": "bigint",
}

_TOKENS = ["input", "output", "cache_create", "cache_create_1h", "cache_read", "reasoning"]
_COST = ["cost_usd", "pricing_version", "calc_version"]

# Payload columns of each event type.
PAYLOADS = {
    "session": [
        "duration_ms", "focus_ms", "interaction_ms", "agent_present_ms", "agent_only_ms",
        "focus_only_ms", "idle_ms", "estimated",
    ],
    "commit": ["hash", "message", "author", "commit_branch", "insertions", "deletions", "files_changed"],
    "test_run": ["passed", "failed", "skipped", "duration_ms", "source", "command", "exit_code"],
    "task_run": ["name", "ok", "duration_ms"],
    "debug_session": ["name", "duration_ms"],
    "agent_session": [
        "agent", "session_uuid", "model", "cwd", "started_at", "ended_at", "turns", *_TOKENS, *_COST,
        "unparsed_lines",
    ],
    "agent_turn": ["agent", "session_uuid", "model", *_TOKENS, *_COST],
    "file_edit": ["file", "language", "lines_added", "lines_removed"],
    "file_fs": ["file", "language", "kind"],
    "diagnostics": ["errors", "warnings", "by_language"],
}

# Column -> (key in the JSON payload, type). The JSON keys.
FIELDS = {
    "duration_ms": ("durationMs", "bigint"),
    "focus_ms": ("focusMs", "bigint"),
    "interaction_ms": ("interactionMs", "bigint"),
    "agent_present_ms": ("agentPresentMs", "bigint"),
    "agent_only_ms": ("agentOnlyMs", "bigint"),
    "focus_only_ms": ("focusOnlyMs", "bigint"),
    "idle_ms": ("idleMs", "bigint"),
    "estimated": ("estimated", "boolean"),
    "hash": ("hash", "string"),
    "message": ("message", "string"),
    "author": ("author", "string"),
    "commit_branch": ("branch", "string"),
    "insertions": ("insertions", "bigint"),
    "deletions": ("deletions", "bigint"),
    "files_changed": ("filesChanged", "bigint"),
    "passed": ("passed", "bigint"),
    "failed": ("failed", "bigint"),
    "skipped": ("skipped", "bigint"),
    "source": ("source", "string"),
    "command": ("command", "string"),
    "exit_code": ("exitCode", "int"),
    "name": ("name", "string"),
    "ok": ("ok", "boolean"),
    "agent": ("agent", "string"),
    "session_uuid": ("sessionUuid", "string"),
    "model": ("model", "string"),
    "cwd": ("cwd", "string"),
    "started_at": ("startedAt", "timestamp"),
    "ended_at": ("endedAt", "timestamp"),
    "turns": ("turns", "bigint"),
    "input": ("input", "bigint"),
    "output": ("output", "bigint"),
    "cache_create": ("cacheCreate", "bigint"),
    "cache_create_1h": ("cacheCreate1h", "bigint"),
    "cache_read": ("cacheRead", "bigint"),
    "reasoning": ("reasoning", "bigint"),
    "cost_usd": ("costEstimateUSD", "double"),
    "pricing_version": ("pricingVersion", "string"),
    "calc_version": ("calcVersion", "int"),
    "unparsed_lines": ("unparsedLines", "bigint"),
    "file": ("file", "string"),
    "language": ("language", "string"),
    "lines_added": ("linesAdded", "bigint"),
    "lines_removed": ("linesRemoved", "bigint"),
    "kind": ("kind", "string"),
    "errors": ("errors", "bigint"),
    "warnings": ("warnings", "bigint"),
    "by_language": ("byLanguage", "map<string,struct<errors:bigint,warnings:bigint>>"),
}

LOG_COLUMNS = {**ENVELOPE, **{name: kind for name, (_, kind) in FIELDS.items()}}


def log_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in LOG_COLUMNS.items()))


def as_log(df: DataFrame) -> DataFrame:
    """df with exactly the log's columns; missing ones are NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *[f"cast({n if n in present else 'null'} as {k}) as {n}" for n, k in LOG_COLUMNS.items()]
    )


def union_log(*parts: DataFrame) -> DataFrame:
    whole = as_log(parts[0])
    for part in parts[1:]:
        whole = whole.unionByName(as_log(part))
    return whole


def variant_of(log: DataFrame, event_type: str) -> DataFrame:
    """The typed table of one event type."""
    return log.where(F.col("type") == event_type).select(*ENVELOPE, *PAYLOADS[event_type])
