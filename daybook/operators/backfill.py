"""Events rebuilt for projects without measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.tokens import round_half_up
from daybook.functions.when import day_key, epoch_ms, from_epoch_ms, instant
from daybook.schema import union_log
from daybook.sources.commits import commit_events

# Margin before the first signal, longest day, length of a lone signal (ms), the part
# of a day with agent turns that counts as the agent alone, prefix of rebuilt session ids.
MARGIN_MS, LONGEST_MS, LONE_MS = 45 * 60_000, 12 * 3_600_000, 20 * 60_000
AGENT_PART = 0.4
REBUILT = "bf_"


def projects_needing_backfill(log: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects of `projects` without any measured session or turn in the log."""
    measured = log.where(
        F.col("type").isin("session", "agent_turn") & ~F.startswith(F.col("session_id"), F.lit(REBUILT))
    )
    return projects.join(measured.select("project").distinct(), "project", "left_anti")


def estimate_sessions(commits: DataFrame, turns: DataFrame, now) -> DataFrame:
    """One estimated session per project and day from commits and turns (project, ts) up to now."""
    commit_signal = commits.select("project", "ts", F.lit(False).alias("is_turn"))
    signals = commit_signal.unionByName(turns.select("project", "ts", F.lit(True).alias("is_turn")))
    known = F.col("ts") <= instant(now)
    ms = F.when(known, epoch_ms(F.col("ts")))
    days = (
        signals.where(F.col("ts").isNotNull())
        .groupBy("project", day_key(F.col("ts")).alias("day"))
        .agg(
            F.min(ms).alias("first"),
            F.max(ms).alias("last"),
            F.count(ms).alias("signals"),
            F.bool_or("is_turn").alias("has_turn"),
        )
        .where("signals > 0")
    )
    span = F.col("last") - F.col("first") + MARGIN_MS
    duration = F.when(F.col("signals") == 1, F.lit(LONE_MS)).otherwise(F.least(span, F.lit(LONGEST_MS)))
    agent = F.when(F.col("has_turn"), round_half_up(F.col("duration_ms") * F.lit(AGENT_PART))).otherwise(0)
    session_id = F.concat(F.lit(REBUILT), F.col("day"))
    zero = F.lit(0).cast("bigint")
    return (
        days.withColumn("duration_ms", duration.cast("bigint"))
        .withColumn("agent_only_ms", agent.cast("bigint"))
        .select(
            F.concat(F.lit("session:"), session_id, F.lit(":0")).alias("event_id"),
            from_epoch_ms(F.col("last")).alias("ts"),
            "project",
            session_id.alias("session_id"),
            F.lit("session").alias("type"),
            "duration_ms",
            F.col("duration_ms").alias("focus_ms"),
            (F.col("duration_ms") - F.col("agent_only_ms")).alias("interaction_ms"),
            F.col("agent_only_ms").alias("agent_present_ms"),
            "agent_only_ms",
            zero.alias("focus_only_ms"),
            zero.alias("idle_ms"),
            F.lit(True).alias("estimated"),
        )
    )


def backfill_events(stats: DataFrame, agent_events: DataFrame, now) -> DataFrame:
    """The rebuilt log: commits, agent events as they are, and estimated sessions."""
    commits = commit_events(stats).withColumn("session_id", F.lit(REBUILT + "git"))
    turns = agent_events.where("type = 'agent_turn'")
    return union_log(commits, agent_events, estimate_sessions(commits, turns, now))
