"""Rollups per project and rolling period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.paths import OTHER_LANGUAGE
from daybook.functions.tokens import TOKENS, billed_tokens, cache_hit_ratio, zero_if_null
from daybook.operators.median import median_of_counts
from daybook.operators.ordered import placed
from daybook.operators.periods import BAND, PERIODS, in_scope, per_period, since_ms
from daybook.schema import UNKNOWN_MODEL, as_log

TIME = (
    "duration_ms", "focus_ms", "interaction_ms", "agent_present_ms", "agent_only_ms", "focus_only_ms", "idle_ms",
)
MINUTE_MS = 60_000


def _of(event_type: str):
    return F.col("type") == event_type


def _no_nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"coalesce({c}, 0L) as {c}" if c in names else c for c in df.columns])


# ---- additive measures, all in one pass ----

SUMS = (
    *TIME, "sessions", "estimated_ms", "lines_added", "lines_removed", "fs_create", "fs_delete", "fs_change",
    "commits", "insertions", "deletions", "test_runs", "tests_passed", "tests_failed", "task_runs",
    "debug_sessions",
)


def _sums() -> dict[str, str]:
    """What each measure adds up, by SQL condition and value."""
    edit, disk, commit, test = (f"type = '{t}'" for t in ("file_edit", "file_fs", "commit", "test_run"))
    session = "type = 'session'"
    other = "coalesce(kind, '') not in ('create', 'delete')"
    cases = {
        **{c: (session, c) for c in TIME},
        "sessions": (session, "1"),
        "estimated_ms": (f"{session} and estimated", "duration_ms"),
        "lines_added": (edit, "lines_added"),
        "lines_removed": (edit, "lines_removed"),
        "fs_create": (f"{disk} and kind = 'create'", "1"),
        "fs_delete": (f"{disk} and kind = 'delete'", "1"),
        "fs_change": (f"{disk} and {other}", "1"),
        "commits": (commit, "1"),
        "insertions": (commit, "insertions"),
        "deletions": (commit, "deletions"),
        "test_runs": (test, "1"),
        "tests_passed": (test, "passed"),
        "tests_failed": (test, "failed"),
        "task_runs": ("type = 'task_run'", "1"),
        "debug_sessions": ("type = 'debug_session'", "1"),
    }
    return {n: f"cast(sum(if({when}, coalesce({v}, 0), null)) as bigint)" for n, (when, v) in cases.items()}


def additive_parts(rows: DataFrame, by: str) -> DataFrame:
    """Every sum, count and maximum per project and `by` (a band or a day), and the first and last diagnostics in log order.
    Parts of any rows can be combined."""
    seq = F.when(_of("diagnostics"), F.col("ingest_seq"))
    return rows.groupBy("project", by).agg(
        *[F.expr(f"{total} as {n}") for n, total in _sums().items()],
        F.max(F.when(_of("session"), F.col("duration_ms"))).alias("longest_session_ms"),
        F.min(seq).alias("_first_seq"),
        F.max(seq).alias("_last_seq"),
        F.min_by("errors", seq).alias("_first_errors"),
        F.min_by("warnings", seq).alias("_first_warnings"),
        F.max_by("errors", seq).alias("_last_errors"),
        F.max_by("warnings", seq).alias("_last_warnings"),
    )


def combined_additive(bands: DataFrame) -> DataFrame:
    """Periods from additive parts with their band."""
    inside = F.col(BAND) <= F.col("rank")

    def by_seq(pick, value, at):
        return pick(F.when(inside, F.col(value)), F.when(inside, F.col(at)))

    wide = per_period(
        bands,
        ["project"],
        sums=SUMS,
        maxima=["longest_session_ms"],
        extra={
            "first_errors": by_seq(F.min_by, "_first_errors", "_first_seq"),
            "first_warnings": by_seq(F.min_by, "_first_warnings", "_first_seq"),
            "last_errors": by_seq(F.max_by, "_last_errors", "_last_seq"),
            "last_warnings": by_seq(F.max_by, "_last_warnings", "_last_seq"),
        },
    ).drop("_bands")
    return _no_nulls(wide, *SUMS, "longest_session_ms", "last_errors", "last_warnings")


def additive_rollup(log: DataFrame, now) -> DataFrame:
    """Every sum, count and maximum of a rollup, and the first and last diagnostics in log order."""
    return combined_additive(additive_parts(in_scope(as_log(log), now), BAND))


def file_parts(rows: DataFrame, by: str) -> DataFrame:
    """The files edited per project and `by`."""
    return rows.where(_of("file_edit")).select("project", "file", by).distinct()


def combined_files(bands: DataFrame) -> DataFrame:
    """Distinct files edited: each file counts in the narrowest band it appears in and every wider one."""
    files = (
        bands.groupBy("project", "file")
        .agg(F.min(BAND).alias(BAND))
        .groupBy("project", BAND)
        .agg(F.count("*").alias("files_edited"))
    )
    return per_period(files, ["project"], sums=["files_edited"]).select(
        "project", "period", zero_if_null("files_edited").alias("files_edited")
    )


def edited_files(log: DataFrame, now) -> DataFrame:
    return combined_files(in_scope(log.where(_of("file_edit")), now))


def duration_parts(rows: DataFrame, by: str) -> DataFrame:
    """How many sessions of each length a project has per `by`."""
    sessions = rows.where(_of("session"))
    return sessions.groupBy("project", zero_if_null("duration_ms").alias("duration_ms"), by).agg(F.count("*").alias("n"))


def combined_medians(bands: DataFrame) -> DataFrame:
    spread = per_period(bands, ["project", "duration_ms"], sums=["n"]).where("n > 0")
    medians = median_of_counts(spread, ["project", "period"], "duration_ms", "n", MINUTE_MS)
    return medians.withColumnRenamed("median", "median_session_ms")


def median_sessions(log: DataFrame, now) -> DataFrame:
    return combined_medians(duration_parts(in_scope(log.where(_of("session")), now), BAND))


def agent_totals(log: DataFrame, now) -> DataFrame:
    """Per agent and period: tokens and cost of its turns, sessions and quality of its summaries.
    An agent has a row for the periods in which it has an event."""
    turns = (
        in_scope(log.where(_of("agent_turn")), now)
        .groupBy("project", "agent", BAND)
        .agg(
            F.count("*").alias("turns"),
            *[F.sum(zero_if_null(t)).alias(t) for t in TOKENS],
            F.sum(F.col("cost_usd").cast("decimal(18,4)")).alias("cost_usd"),
        )
    )
    # A session counts in its narrowest band; its unparsed lines count in each band it has a summary in.
    per_band = F.array(
        *(
            F.struct(
                F.lit(i).alias(BAND),
                (F.col("_first") == i).cast("bigint").alias("sessions"),
                F.col(f"_unparsed{i}").alias("unparsed_lines"),
            )
            for i in range(len(PERIODS))
        )
    )
    per_session = (
        in_scope(log.where(_of("agent_session")), now)
        .groupBy("project", "agent", "session_uuid")
        .agg(
            F.min(BAND).alias("_first"),
            *(F.max(F.when(F.col(BAND) == i, F.coalesce("unparsed_lines", F.lit(-1)))).alias(f"_unparsed{i}") for i in range(len(PERIODS))),
        )
        .select("project", "agent", F.inline(per_band))
        .where("sessions > 0 OR unparsed_lines IS NOT NULL")
        .groupBy("project", "agent", BAND)
        .agg(F.sum("sessions").alias("sessions"), F.max("unparsed_lines").alias("unparsed_lines"))
        .withColumn("unparsed_lines", F.when(F.col("unparsed_lines") >= 0, F.col("unparsed_lines")))
    )
    bands = turns.unionByName(per_session, allowMissingColumns=True)
    sums = ["turns", *TOKENS, "sessions", "cost_usd"]
    out = per_period(bands, ["project", "agent"], sums, maxima=["unparsed_lines"]).where("_bands > 0")
    out = _no_nulls(out, "turns", *TOKENS, "sessions", "unparsed_lines").withColumn(
        "cost_usd", F.col("cost_usd").cast("double")
    )
    return (
        out.withColumn("total_tokens", billed_tokens())
        .withColumn("cache_hit_ratio", cache_hit_ratio())
        .drop("_bands")
    )


def pricing_versions(log: DataFrame, now) -> DataFrame:
    """Price list versions of an agent's sessions in the order first seen. A project has few versions,
    so the list per agent is short."""
    seen = (
        in_scope(log.where(_of("agent_session") & (F.col("pricing_version") != "")), now)
        .groupBy("project", "agent", "pricing_version", BAND)
        .agg(F.min("ingest_seq").alias("seen"))
    )
    spread = per_period(seen, ["project", "agent", "pricing_version"], minima=["seen"]).where("_bands > 0")
    listed = F.array_sort(F.collect_list(F.struct("seen", "pricing_version")))
    return spread.groupBy("project", "agent", "period").agg(
        F.transform(listed, lambda s: s["pricing_version"]).alias("pricing_versions")
    )


def agent_models(log: DataFrame, now) -> DataFrame:
    """Per-model breakdown; place orders by cost, then by tokens, then by name."""
    model = F.when(F.coalesce("model", F.lit("")) != "", F.col("model")).otherwise(F.lit(UNKNOWN_MODEL))
    bands = (
        in_scope(log.where(_of("agent_turn")), now)
        .withColumn("model", model)
        .groupBy("project", "agent", "model", BAND)
        .agg(
            F.count("*").alias("turns"),
            *[F.sum(zero_if_null(t)).alias(t) for t in TOKENS],
            F.sum(F.col("cost_usd").cast("decimal(18,4)")).alias("cost_usd"),
        )
    )
    out = per_period(bands, ["project", "agent", "model"], ["turns", *TOKENS, "cost_usd"]).where("_bands > 0")
    out = out.withColumn("cost_usd", F.col("cost_usd").cast("double")).withColumn("total_tokens", billed_tokens())
    ranked = W.partitionBy("project", "agent", "period").orderBy(
        F.desc(F.coalesce("cost_usd", F.lit(0.0))), F.desc("total_tokens"), "model"
    )
    return out.withColumn("place", F.row_number().over(ranked)).drop("_bands")


def lines_by_language(log: DataFrame, now) -> DataFrame:
    language = F.when(F.coalesce("language", F.lit("")) != "", F.col("language")).otherwise(
        F.lit(OTHER_LANGUAGE)
    )
    bands = (
        in_scope(log.where(_of("file_edit")), now)
        .groupBy("project", language.alias("language"), BAND)
        .agg(F.sum(zero_if_null("lines_added") + zero_if_null("lines_removed")).alias("lines"))
    )
    out = per_period(bands, ["project", "language"], sums=["lines"]).where("_bands > 0")
    return with_share(out.drop("_bands"), ["project", "period"])


def with_share(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Percentage of lines within keys."""
    everything = lines.groupBy(*keys).agg(F.sum("lines").alias("_all"))
    pct = F.when(F.col("_all") > 0, F.col("lines") / F.col("_all") * 100).otherwise(F.lit(0.0))
    return lines.join(everything, keys).withColumn("pct", pct).drop("_all")


def first_languages(shares: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Languages by place within keys, those with most lines first; with k the first k only."""
    ranked = W.partitionBy(*keys).orderBy(F.desc("lines"), "language")
    places = shares.withColumn("place", F.row_number().over(ranked))
    return places if k is None else places.where(F.col("place") <= k)


def top_files(log: DataFrame, now, k: int | None = None) -> DataFrame:
    """Files by place within project and period, those with most lines touched first, equal ones in order of first
    appearance; with k the first k only."""
    bands = (
        in_scope(log.where(_of("file_edit")), now)
        .groupBy("project", "file", BAND)
        .agg(
            F.sum(zero_if_null("lines_added")).alias("lines_added"),
            F.sum(zero_if_null("lines_removed")).alias("lines_removed"),
            F.min("ingest_seq").alias("first_seen"),
        )
    )
    files = per_period(bands, ["project", "file"], ["lines_added", "lines_removed"], minima=["first_seen"])
    order = [-(F.col("lines_added") + F.col("lines_removed")), F.coalesce("first_seen", F.lit(2**63 - 1)), F.col("file")]
    ranked = placed(files.where("_bands > 0"), ["project", "period"], order, k)
    return ranked.withColumn("active_ms", F.lit(0).cast("bigint")).drop("_bands", "first_seen")


def hours_of_day(log: DataFrame, now) -> DataFrame:
    """Minutes worked per hour of the day, all 24 hours for each project and period."""
    bands = (
        in_scope(log, now)
        .groupBy("project", F.hour("ts").alias("_hour"), BAND)
        .agg(F.sum(F.when(_of("session"), zero_if_null("duration_ms"))).alias("ms"))
    )
    out = per_period(bands, ["project", "_hour"], sums=["ms"])
    per_hour = out.groupBy("project", "period").agg(
        *[F.expr(f"sum(if(_hour = {h}, ms, null)) as h{h}") for h in range(24)]
    )
    minutes = F.expr("array(" + ", ".join(f"coalesce(h{h}, 0) / 60000D" for h in range(24)) + ")")
    return per_hour.select("project", "period", F.posexplode(minutes).alias("hour", "minutes"))


def joined_periods(additive: DataFrame, files: DataFrame, medians: DataFrame, now) -> DataFrame:
    return (
        additive.join(files, ["project", "period"], "left")
        .join(medians, ["project", "period"], "left")
        .fillna(0, ["files_edited", "median_session_ms"])
        .withColumn("since_ms", since_ms(F.col("period"), now))
    )


def rollup_periods(log: DataFrame, now) -> DataFrame:
    """One row per project and period with every single-valued measure."""
    return joined_periods(additive_rollup(log, now), edited_files(log, now), median_sessions(log, now), now)
