"""Commits and their per-file changes, as landed tables.

commits: project, hash, parent, ts, message, author_name, author_email, branch
files:   project, hash, file, insertions, deletions
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.ids import commit_event_id
from daybook.functions.text import first_line
from daybook.functions.tokens import zero_if_null
from daybook.operators.ordered import placed
from daybook.session import small_side


def newest_commits(commits: DataFrame, n: int | None = None) -> DataFrame:
    """Commits by place within their project, the newest first; with n only the n newest."""
    return placed(commits, ["project"], [-F.unix_micros("ts"), F.col("hash")], n)


def fresh_commits(commits: DataFrame, cursors: DataFrame) -> DataFrame:
    """All commits newer than the last seen one of their project; all of a project whose last seen commit is unknown.
    Column place numbers them from oldest to newest."""
    seen = cursors.select("project", F.col("last_hash").alias("hash"))
    cut = commits.join(small_side(seen), ["project", "hash"]).select("project", F.struct("ts", "hash").alias("_cut"))
    fresh = commits.join(small_side(cut), "project", "left").where(
        F.col("_cut").isNull() | (F.struct("ts", "hash") > F.col("_cut"))
    )
    return placed(fresh.drop("_cut"), ["project"], [F.unix_micros("ts"), F.col("hash")])


def commit_stats(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Churn per commit; a root commit has no diff and counts nothing."""
    churn = files.groupBy("hash").agg(
        F.sum(zero_if_null("insertions")).alias("insertions"),
        F.sum(zero_if_null("deletions")).alias("deletions"),
        F.count("*").alias("files_changed"),
    )
    joined = commits.join(churn, "hash", "left")
    return joined.withColumns(
        {
            c: F.when(F.col("parent").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
            for c in ("insertions", "deletions", "files_changed")
        }
    )


def commit_events(stats: DataFrame) -> DataFrame:
    author = F.coalesce("author_name", "author_email", F.lit("unknown"))
    return stats.select(
        commit_event_id(F.col("hash")).alias("event_id"),
        "ts",
        "project",
        "branch",
        F.lit("commit").alias("type"),
        "hash",
        first_line(F.coalesce("message", F.lit(""))).alias("message"),
        author.alias("author"),
        F.coalesce("branch", F.lit("")).alias("commit_branch"),
        "insertions",
        "deletions",
        "files_changed",
    )
