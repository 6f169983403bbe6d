"""Statistics over commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.paths import language_of
from daybook.functions.tokens import zero_if_null
from daybook.operators.ordered import placed
from daybook.operators.rollup import first_languages, with_share
from daybook.sources.commits import newest_commits


def diffed_files(commits: DataFrame, files: DataFrame, max_commits: int | None = None) -> DataFrame:
    """File changes of commits that have a parent, with their project."""
    scanned = newest_commits(commits, max_commits) if max_commits else commits
    with_parent = scanned.where(F.col("parent").isNotNull()).select("hash", "project")
    return files.drop("project").join(with_parent, "hash")


def commits_scanned(commits: DataFrame, max_commits: int | None = None) -> DataFrame:
    scanned = newest_commits(commits, max_commits) if max_commits else commits
    return scanned.groupBy("project").agg(F.count("parent").alias("commits_scanned"))


def git_file_stats(changes: DataFrame, k: int | None = None) -> DataFrame:
    """Files by place within their project, those with most lines touched first, equal ones by name; with k the first
    k only."""
    totals = changes.groupBy("project", "file").agg(
        F.count("*").alias("commits"),
        F.sum(zero_if_null("insertions")).alias("insertions"),
        F.sum(zero_if_null("deletions")).alias("deletions"),
    )
    ranked = placed(totals, ["project"], [-(F.col("insertions") + F.col("deletions")), F.col("file")], k)
    return ranked.withColumn("language", language_of(F.col("file")))


def git_language_stats(changes: DataFrame) -> DataFrame:
    lines = zero_if_null("insertions") + zero_if_null("deletions")
    totals = changes.groupBy("project", language_of(F.col("file")).alias("language")).agg(
        F.sum(lines).alias("lines")
    )
    return with_share(totals, ["project"])


def top_file_languages(files: DataFrame, k: int | None = None) -> DataFrame:
    """Share of each language among listed files (project, language, lines_added, lines_removed);
    nothing for a project without any line."""
    totals = files.groupBy("project", "language").agg(
        F.sum(F.col("lines_added") + F.col("lines_removed")).alias("lines")
    )
    everything = totals.groupBy("project").agg(F.sum("lines").alias("_all")).where("_all > 0")
    shares = with_share(totals.join(everything.drop("_all"), "project"), ["project"])
    return first_languages(shares, ["project"], k)


def first_choice(history: DataFrame, live: DataFrame) -> DataFrame:
    """Rows from history for projects that have any there, else the live rows."""
    known = history.select("project").distinct()
    return history.unionByName(live.join(known, "project", "left_anti"))


def language_composition(git_languages: DataFrame, live_languages: DataFrame, k: int | None = None) -> DataFrame:
    """Languages from the commit history, or from live edits where a project has no history."""
    columns = ["project", "language", "lines", "pct"]
    chosen = first_choice(
        git_languages.select(*columns, F.lit("history").alias("source")),
        live_languages.where("period = 'all'").select(*columns, F.lit("live").alias("source")),
    )
    return first_languages(chosen, ["project"], k)
