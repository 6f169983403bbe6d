"""Repair of stored agent history after a change of the calculation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.ids import offset_event_id, offset_in, turn_event_id
from daybook.functions.tokens import BILLED, TOKENS, money_sum, round4, token_sums, zero_if_null
from daybook.operators.agents import SESSION
from daybook.operators.dedup import agent_sessions_in, drop_repeats, number_in_rank, summary_rank
from daybook.operators.pricing import price_turns
from daybook.schema import CALC_VERSION, CLAUDE, UNKNOWN_MODEL, as_log
from daybook.session import small_side, stage

AGENT_TYPES = ("agent_turn", "agent_session")


def _is_agent_event():
    return F.col("type").isin(*AGENT_TYPES)


def _is_stale():
    return F.coalesce("calc_version", F.lit(1)) < CALC_VERSION


def stale_events(log: DataFrame) -> DataFrame:
    """Agent events of an earlier calculation."""
    return log.where(_is_agent_event() & _is_stale())


def has_stale_events(log: DataFrame) -> bool:
    return not stale_events(log).isEmpty()


def upgrade_stored_turns(turns: DataFrame, chunks: int | None = None) -> DataFrame:
    """Turns brought to the current calculation without their source. claude: repeats of the same
    response in file order go, and all cache writes count as 1 h. codex: cached tokens leave input.
    Turns already current stay as they are."""
    current = turns.where(~_is_stale())
    stale = turns.where(_is_stale()).withColumns({t: zero_if_null(t) for t in TOKENS})
    claude = F.col("agent") == CLAUDE
    placed = stale.where(claude).withColumn("_offset", offset_in(F.col("event_id")))
    kept = drop_repeats(placed, SESSION, ["_offset", "ingest_seq"], list(BILLED), chunks).drop("_offset")
    kept = kept.withColumn("cache_create_1h", F.col("cache_create"))
    fresh = F.col("input") - F.col("cache_read") - F.col("cache_create")
    net = stale.where(~claude).withColumn("input", F.greatest(F.lit(0), fresh).cast("bigint"))
    upgraded = kept.unionByName(net).withColumn("calc_version", F.lit(CALC_VERSION))
    return upgraded.unionByName(current)


def reprice(turns: DataFrame, prices: DataFrame) -> DataFrame:
    return price_turns(turns, prices)


@dataclass(frozen=True)
class Reparsed:
    """Sessions whose transcript still exists.

    turns: agent, session_uuid, byte_offset, message_id, ts, model, tokens (per turn)
    files: agent, session_uuid, next_offset, unparsed_lines
    """

    turns: DataFrame
    files: DataFrame


_ENVELOPE = ("project", "branch", "session_id", "ts")
_SUMMARY = ("event_id", "model", "cwd", "started_at", "ended_at", "unparsed_lines")


def _agent_events(log: DataFrame) -> DataFrame:
    """The agent events of a log, staged with a number that orders them as the log does; rows without a number come last."""
    rows = log.where(_is_agent_event()).withColumn("_row", F.monotonically_increasing_id())
    return stage(rows.withColumn("_n", F.coalesce("ingest_seq", F.lit(1 << 62) + F.col("_row"))).drop("_row"), "agent-events")


def _stored_sessions(events: DataFrame) -> DataFrame:
    """One row per agent session: _ref (project, branch, session id and time of its first stored turn, else of its latest stored
    summary) and _meta (fields of that summary). The numbers of these two rows are found first, then the rows are looked up."""
    is_turn, is_summary = F.col("type") == "agent_turn", F.col("type") == "agent_session"
    numbers = events.groupBy(*SESSION).agg(
        F.min(F.when(is_turn, F.col("_n"))).alias("_turn"), F.min(F.when(is_summary, summary_rank(F.col("_n")))).alias("_rank")
    )
    picks = F.array(
        F.struct(F.lit("agent_turn").alias("_type"), F.col("_turn").alias("_at")),
        F.struct(F.lit("agent_session").alias("_type"), number_in_rank(F.col("_rank")).alias("_at")),
    )
    numbers = numbers.select(*(F.col(c).alias(f"_{c}") for c in SESSION), F.inline(picks)).where("_at IS NOT NULL").hint("shuffle_hash")
    rows = events.select("_n", "type", *SESSION, F.struct(*_ENVELOPE).alias("_envelope"), F.struct(*_SUMMARY).alias("_meta"))
    same = (F.col("_n") == F.col("_at")) & (F.col("type") == F.col("_type"))
    for c in SESSION:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = rows.join(numbers, same, "left_semi")
    found = found.groupBy(*SESSION).agg(
        F.max(F.when(is_turn, F.col("_envelope"))).alias("_first"),
        F.max(F.when(is_summary, F.col("_envelope"))).alias("_latest"),
        F.max(F.when(is_summary, F.col("_meta"))).alias("_meta"),
    )
    listed = events.select(*SESSION).distinct()
    return listed.join(found, SESSION, "left").select(*SESSION, F.coalesce("_first", "_latest").alias("_ref"), "_meta")


def _reparsed_turns(sessions: DataFrame, reparsed: Reparsed, prices: DataFrame) -> DataFrame:
    rows = reparsed.turns.join(sessions.select(*SESSION, "_ref"), SESSION).withColumns(
        {
            "event_id": turn_event_id(
                F.col("agent"), F.col("session_uuid"), F.col("message_id"), F.col("byte_offset")
            ),
            "project": F.col("_ref.project"),
            "branch": F.col("_ref.branch"),
            "session_id": F.col("_ref.session_id"),
            "type": F.lit("agent_turn"),
            "calc_version": F.lit(CALC_VERSION),
        }
    )
    return price_turns(rows, prices)


def _turns(events: DataFrame, sessions: DataFrame, reparsed: Reparsed, prices: DataFrame, chunks: int | None) -> DataFrame:
    """Every agent turn after the repair: exact ones where the source exists, upgraded ones elsewhere."""
    exact = _reparsed_turns(sessions, reparsed, prices)
    sources = reparsed.files.select(*SESSION)
    stored = events.where(F.col("type") == "agent_turn").join(sources, SESSION, "left_anti")
    fixed = reprice(upgrade_stored_turns(stored.drop("_n"), chunks), prices)
    return as_log(exact).unionByName(as_log(fixed)).withColumn("_offset", offset_in(F.col("event_id")))


def _summaries(sessions: DataFrame, turns: DataFrame, reparsed: Reparsed, prices: DataFrame) -> DataFrame:
    """Exactly one summary per agent session that has a turn or a stored summary."""
    at = F.struct("ts", "_offset")
    totals = turns.groupBy(*SESSION).agg(
        F.count("*").alias("turns"),
        F.min("ts").alias("_start"),
        F.max("ts").alias("_end"),
        F.max_by("model", at).alias("_model"),
        money_sum("cost_usd").alias("_cost"),
        *token_sums(),
    )
    files = reparsed.files.select(*SESSION, F.struct("next_offset", "unparsed_lines").alias("_file"))
    versions = prices.groupBy("agent").agg(F.max("version").alias("pricing_version"))
    joined = (
        sessions.join(totals, SESSION, "left")
        .join(files, SESSION, "left")
        .join(small_side(versions), "agent", "left")
        .where(F.col("turns").isNotNull() | F.col("_meta").isNotNull())
    )
    agent, uuid, ended = F.col("agent"), F.col("session_uuid"), F.coalesce("_end", "_meta.ended_at", "_ref.ts")
    own_id = F.coalesce(F.col("_meta.event_id"), offset_event_id(agent, uuid, F.lit(0)))
    return joined.select(
        F.when(F.col("_file").isNotNull(), offset_event_id(agent, uuid, F.col("_file.next_offset")))
        .otherwise(own_id)
        .alias("event_id"),
        ended.alias("ts"),
        F.col("_ref.project").alias("project"),
        F.col("_ref.branch").alias("branch"),
        F.col("_ref.session_id").alias("session_id"),
        F.lit("agent_session").alias("type"),
        *SESSION,
        F.coalesce("_model", "_meta.model", F.lit(UNKNOWN_MODEL)).alias("model"),
        F.coalesce("_meta.cwd", F.lit("")).alias("cwd"),
        F.coalesce("_start", "_meta.started_at", "_ref.ts").alias("started_at"),
        ended.alias("ended_at"),
        zero_if_null("turns").alias("turns"),
        *[zero_if_null(t).alias(t) for t in TOKENS],
        round4(F.col("_cost")).alias("cost_usd"),
        "pricing_version",
        F.coalesce("_file.unparsed_lines", "_meta.unparsed_lines", F.lit(0)).alias("unparsed_lines"),
        F.lit(CALC_VERSION).alias("calc_version"),
    )


def migrate_history(log: DataFrame, reparsed: Reparsed, prices: DataFrame, chunks: int | None = None) -> DataFrame:
    """The log with all agent events repaired; other events unchanged. Migrating twice changes nothing
    more. New rows have no ingest_seq until the compacted log is written.

    The stored agent events, what is known per session and the repaired turns are staged: each is computed once."""
    events = _agent_events(log)
    sessions = stage(_stored_sessions(events), "stored-sessions")
    turns = stage(_turns(events, sessions, reparsed, prices, chunks), "repaired-turns")
    summaries = _summaries(sessions, turns, reparsed, prices)
    others = as_log(log.where(~_is_agent_event()))
    return others.unionByName(turns.drop("_offset")).unionByName(as_log(summaries))


def migration_report(log: DataFrame, migrated: DataFrame, reparsed: Reparsed) -> DataFrame:
    """One row: sessions read again, sessions corrected in place, events dropped."""
    sessions = agent_sessions_in(log).join(
        reparsed.files.select(*SESSION, F.lit(True).alias("_again")), SESSION, "left"
    )
    counts = sessions.agg(
        F.count_if("_again").alias("reparsed_sessions"), F.count_if(F.col("_again").isNull()).alias("upgraded_sessions")
    )
    before = log.where(_is_agent_event()).select(F.lit(1).alias("n"))
    after = migrated.where(_is_agent_event()).select(F.lit(-1).alias("n"))
    change = before.union(after).agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)).alias("dropped_events"))
    return counts.withColumn("_one", F.lit(1)).join(change.withColumn("_one", F.lit(1)), "_one").drop("_one")
