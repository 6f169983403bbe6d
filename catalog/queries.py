"""The registered queries: every job of the package over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import standins as S
from catalog import transcripts as X
from daybook.functions import ids, models, paths, text
from daybook.functions.tokens import TOKENS, money_sum
from daybook.functions.when import day_key, epoch_ms
from daybook.operators import activity, agents, attribution, backfill, calendar, dedup, git, repair, rollup
from daybook.operators import signals as G
from daybook.operators.usage import to_deltas
from daybook.plans import reports
from daybook.session import small_side, staging_path
from daybook.sources import commits as C
from daybook.sources import event_log
from daybook.sources.prices import shipped_prices

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SERIES_DAYS = 30
YEAR, MONTH = 2024, 1


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def ms(column: str, name: str | None = None) -> Column:
    return epoch_ms(F.col(column)).alias(name or column)


# ---- agent usage and cost ----


@query
def agent_rollup(spark, sf):
    return rollup.agent_totals(S.agent_log(spark, sf), S.NOW)


@query
def agent_by_model(spark, sf):
    return rollup.agent_models(S.turn_log(spark, sf), S.NOW)


@query
def agent_session_meta(spark, sf):
    log = S.session_log(spark, sf)
    counts = log.groupBy("project", "agent").agg(
        F.count_distinct("session_uuid").alias("sessions"), F.max("unparsed_lines").alias("unparsed_lines")
    )
    versions = rollup.pricing_versions(log, S.NOW).where("period = 'all'")
    listed = versions.select("project", "agent", F.array_join("pricing_versions", ",").alias("pricing_versions"))
    return counts.join(listed, ["project", "agent"])


@query
def turn_cost(spark, sf):
    return S.priced_turns(spark, sf).select(
        "agent", "session_uuid", "byte_offset", "model", "cost_usd", "pricing_version"
    )


@query
def price_dim(spark, sf):
    """Use of the price list: every listed model with the turns and tokens billed at its price."""
    turns = S.priced_turns(spark, sf).withColumn("model", models.price_name(F.col("model")))
    used = turns.groupBy("agent", "model").agg(
        F.count("*").alias("turns"), F.sum("output").alias("output"), money_sum("cost_usd").alias("cost_usd")
    )
    listed = shipped_prices(spark)
    joined = listed.join(used, ["agent", "model"], "left").fillna(0, ["turns", "output"])
    return joined.select(
        "agent", "model", "price_in", "price_out", "write_mult", "write_1h_mult", "read_mult", "turns", "output", "cost_usd"
    )


@query
def model_normalize(spark, sf):
    turns = S.agent_turns(spark, sf)
    return turns.groupBy("model", models.price_name(F.col("model")).alias("price_name")).agg(
        F.count("*").alias("turns")
    )


@query
def model_short(spark, sf):
    turns = S.agent_turns(spark, sf)
    return turns.groupBy("model", models.model_label(F.col("model")).alias("label")).agg(F.count("*").alias("turns"))


@query
def event_ids(spark, sf):
    log = S.event_log(spark, sf).where("type in ('agent_turn', 'agent_session', 'commit')")
    return log.select("type", "event_id", ids.offset_in(F.col("event_id")).alias("offset"))


@query
def agent_sessions(spark, sf):
    sessions = agents.summarize_agent_sessions(S.priced_turns(spark, sf))
    whole = agents.price_sessions(sessions, shipped_prices(spark)).select(
        *agents.SESSION, F.col("cost_usd").alias("whole_cost_usd")
    )
    return sessions.join(whole, agents.SESSION).select(
        *agents.SESSION, ms("started_at"), ms("ended_at"), "turns", *TOKENS, "model", "cost_usd", "whole_cost_usd"
    )


@query
def agent_session_running(spark, sf):
    rows = agents.running_agent_sessions(S.agent_turns(spark, sf), shipped_prices(spark))
    return rows.select(
        *agents.SESSION, "byte_offset", "model", ms("started_at"), ms("ended_at"), "turns", *TOKENS, "cost_usd"
    )


@query
def cumulative_delta(spark, sf):
    return to_deltas(S.running_usage(spark, sf)).select(*agents.SESSION, "byte_offset", "is_cumulative", *TOKENS)


# ---- JSON lines ----


@query
def line_offsets(spark, sf):
    return X.located(spark, sf).select("source_file", "place", "byte_offset", "next_offset")


@query
def incremental_scan(spark, sf):
    """Lines past each file's cursor and the cursor after them."""
    lines, cursors = X.located(spark, sf), X.cursors(spark, sf)
    known = cursors.select("source_file", F.col("next_offset").alias("_from"))
    new = lines.join(small_side(known), "source_file", "left").where(
        F.col("byte_offset") >= F.coalesce("_from", F.lit(0))
    )
    return new.groupBy("source_file").agg(
        F.count("*").alias("lines"), F.min("byte_offset").alias("from_offset"), F.max("next_offset").alias("next_offset")
    )


@query
def unparsed_lines(spark, sf):
    return X.quality(spark, sf)


@query
def usage_a(spark, sf):
    return X.usage(spark, sf, "claude").select(
        "source_file", "place", "message_id", "model", ms("ts"), *TOKENS
    )


@query
def usage_b(spark, sf):
    return X.usage(spark, sf, "codex").select(
        "source_file", "place", "is_cumulative", "model", ms("ts"), *TOKENS
    )


@query
def session_meta(spark, sf):
    return X.metas(spark, sf)


@query
def response_dedup(spark, sf):
    rows = X.usage(spark, sf, "claude")
    return dedup.one_per_response(rows).select("source_file", "message_id", "place", "input", "output")


@query
def source_index(spark, sf):
    files = X.lines(spark, sf).groupBy("source_file").agg(F.count("*").alias("lines"))
    return files.select("source_file", paths.transcript_uuid(F.col("source_file")).alias("session_uuid"), "lines")


@query
def log_scan(spark, sf):
    log = event_log.decode_events(X.log_lines(spark, sf))
    return log.select(
        "event_id", ms("ts"), "project", "session_id", "type", "ingest_seq", "file", "language", "lines_added",
        "lines_removed", "kind", "errors", "warnings", "passed", "failed", "skipped", "name", "ok",
    )


@query
def dedup_events(spark, sf):
    first = event_log.first_per_event(event_log.decode_events(X.log_lines(spark, sf)))
    return first.select("type", "event_id", "ingest_seq", "project")


@query
def compact_log(spark, sf):
    """The deduplicated first half of the log plus everything appended after it."""
    log = event_log.decode_events(X.log_lines(spark, sf))
    snapshot = log.agg(F.floor(F.max("ingest_seq") / 2).cast("bigint").alias("cut"))
    cut = snapshot.first()["cut"]
    compacted = event_log.first_per_event(log.where(F.col("ingest_seq") <= cut))
    return event_log.compact_log(log, compacted, cut).select("type", "event_id", "ingest_seq")


# ---- paths ----


@query
def path_slug(spark, sf):
    rows = S.folders(spark, sf)
    return rows.select("page_id", paths.path_slug(F.col("cwd")).alias("slug"))


@query
def path_norm(spark, sf):
    rows = S.folders(spark, sf)
    return rows.select("page_id", paths.comparable_path(F.col("cwd")).alias("path"))


@query
def path_relative(spark, sf):
    host = F.upper(F.substring_index(F.replace("cwd", F.lit("\\"), F.lit("/")), "/", 1))
    rows = S.folders(spark, sf).withColumn("root", host)
    return rows.select("page_id", paths.relative_path(F.col("root"), F.col("cwd")).alias("path"))


@query
def path_language(spark, sf):
    files = S.commit_files(spark, sf).select("file").distinct()
    return files.groupBy(
        paths.language_of(F.col("file")).alias("language"), paths.disk_language_of(F.col("file")).alias("disk_language")
    ).agg(F.count("*").alias("files"))


@query
def fs_noise_filter(spark, sf):
    return G.filter_fs_events(S.fs_events(spark, sf)).select("page_id", "project", "file", "kind", "language")


@query
def cwd_attribution(spark, sf):
    found = attribution.attribute_by_folder(S.folders(spark, sf), S.folder_roots(spark, sf))
    return found.select("page_id", "project", "root")


@query
def cwd_attribution_filtered(spark, sf):
    """The same where the roots are taken for too many to broadcast: folders above a working folder pass a filter first."""
    found = attribution.attribute_by_folder(S.folders(spark, sf), S.folder_roots(spark, sf), small=False)
    return found.select("page_id", "project", "root")


@query
def repository_match(spark, sf):
    """Folders as repositories against the roots, in either direction."""
    repositories = S.folders(spark, sf).select(F.col("page_id").alias("repository"), F.col("cwd").alias("folder"))
    deep = S.folder_roots(spark, sf).withColumn("root", F.concat("root", F.lit("/deep")))
    projects = S.folder_roots(spark, sf).union(deep.select("root", "project"))
    return attribution.match_repositories(repositories, projects)


@query
def slug_attribution(spark, sf):
    files = S.folders(spark, sf).select("page_id", paths.path_slug(F.col("cwd")).alias("folder"))
    roots = S.folders(spark, sf).select(F.lower("cwd").alias("root"), F.concat(F.lit("w"), "page_id").alias("project"))
    return attribution.attribute_by_slug(files, roots).select("page_id", "project", "folder")


# ---- commits ----


@query
def commit_churn(spark, sf):
    stats = C.commit_stats(S.commits(spark, sf), S.commit_files(spark, sf))
    return stats.select("hash", "project", "insertions", "deletions", "files_changed")


@query
def commit_events(spark, sf):
    events = C.commit_events(C.commit_stats(S.commits(spark, sf), S.commit_files(spark, sf)))
    return events.select("event_id", ms("ts"), "project", "message", "author", "commit_branch", "insertions", "files_changed")


@query
def newest_commits(spark, sf):
    return C.newest_commits(S.commits(spark, sf)).select("project", "hash", ms("ts"), "place")


@query
def fresh_commits(spark, sf):
    """Cursors: the 50th newest commit for p0 and p1, the oldest for p2, none for the others."""
    rows = S.commits(spark, sf)
    newest = C.newest_commits(rows.where("project in ('p0', 'p1')"), 50).where("place = 50").select(
        "project", F.col("hash").alias("last_hash")
    )
    old = rows.where("project = 'p2'").groupBy("project").agg(F.min_by("hash", F.struct("ts", "hash")).alias("last_hash"))
    return C.fresh_commits(rows, newest.union(old)).select("project", "hash", "place")


@query
def git_file_stats(spark, sf):
    changes = git.diffed_files(S.commits(spark, sf), S.commit_files(spark, sf))
    return git.git_file_stats(changes)


@query
def git_language_stats(spark, sf):
    changes = git.diffed_files(S.commits(spark, sf), S.commit_files(spark, sf))
    scanned = git.commits_scanned(S.commits(spark, sf))
    return git.git_language_stats(changes).join(scanned, "project")


@query
def top_file_language_share(spark, sf):
    changes = git.diffed_files(S.commits(spark, sf), S.commit_files(spark, sf))
    files = git.git_file_stats(changes).withColumnsRenamed({"insertions": "lines_added", "deletions": "lines_removed"})
    return git.top_file_languages(files)


@query
def language_composition(spark, sf):
    """Live edits fall into seven projects, of which p5 and p6 have no history."""
    changes = git.diffed_files(S.commits(spark, sf), S.commit_files(spark, sf))
    user = F.substring("session_id", 2, 20).cast("bigint")
    live_log = S.signal_log(spark, sf).withColumn("project", F.concat(F.lit("p"), user % 7))
    live = rollup.lines_by_language(live_log, S.NOW)
    return git.language_composition(git.git_language_stats(changes), live)


# ---- signals ----


@query
def agent_active_asof(spark, sf):
    found = attribution.with_last_write(S.ticks(spark, sf), S.agent_writes(spark, sf), activity.GRACE_MS)
    return found.select("project", "id", ms("last_write", "last_write_ms"), "agent_active")


@query
def sessionize_ticks(spark, sf):
    rows = activity.sessionize_ticks(S.ticks(spark, sf), S.agent_writes(spark, sf))
    return rows.select("project", ms("started_at"), ms("ended_at"), "is_closed", *activity.DIMENSIONS)


@query
def task_runs(spark, sf):
    starts, ends = S.task_marks(spark, sf, "signup", "purchase")
    runs = G.pair_intervals(starts, ends, ["project", "user_id"])
    return runs.select("project", "user_id", "id", ms("started_at"), "duration_ms", (F.col("k") % 2 == 0).alias("ok"))


@query
def debug_sessions(spark, sf):
    starts, ends = S.task_marks(spark, sf, "view", "error")
    runs = G.pair_intervals(starts, ends, ["project", "user_id"])
    return runs.groupBy("project", "user_id").agg(
        F.count("*").alias("runs"), F.count("started_at").alias("paired"), F.sum("duration_ms").alias("duration_ms")
    )


@query
def event_session_attribution(spark, sf):
    sessions = S.gap_sessions(spark, sf)
    events = S.signals(spark, sf).select("project", "ts", "id")
    return attribution.attribute_events(events, sessions).select("project", "id", "session_id")


def overlapping_sessions(spark, sf):
    """Each session, and one that begins 45 minutes earlier and ends 20 minutes later."""
    own = S.gap_sessions(spark, sf).select("project", "session_id", "started_at", "ended_at")
    wide = own.select(
        "project",
        F.concat("session_id", F.lit(":wide")).alias("session_id"),
        (F.col("started_at") - F.expr("interval 45 minutes")).alias("started_at"),
        (F.col("ended_at") + F.expr("interval 20 minutes")).alias("ended_at"),
    )
    return own.unionByName(wide)


@query
def events_in_intervals(spark, sf):
    """Every session that is open at an event, of sessions that overlap."""
    events = S.signals(spark, sf).select("project", "ts", "id")
    found = attribution.within_intervals(events, overlapping_sessions(spark, sf))
    return found.select("project", "id", "interval.session_id")


@query
def overlapping_attribution(spark, sf):
    events = S.signals(spark, sf).select("project", "ts", "id")
    return attribution.attribute_overlapping(events, overlapping_sessions(spark, sf)).select("project", "id", "session_id")


@query
def edit_windows(spark, sf):
    windows = G.aggregate_edits(S.edits(spark, sf))
    return windows.select("project", ms("window.start", "window_ms"), "file", "language", "lines_added", "lines_removed")


@query
def diagnostics_changes(spark, sf):
    changed = G.detect_changes(G.sample_diagnostics(S.diagnostics(spark, sf)))
    return changed.select("project", "id", "errors", "warnings")


@query
def diagnostics_by_language(spark, sf):
    severity = S.pick(("error", "warning", "info"), F.col("l_linenumber") + F.col("l_partkey"))
    suffix = S.pick((".TS", ".py", "", ".Rs"), F.col("l_partkey"))
    problems = S.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("snapshot"),
        F.concat(F.lit("f"), F.col("l_partkey") % 9, suffix).alias("path"),
        severity.alias("severity"),
    )
    return G.diagnostics_by_language(problems)


@query
def text_line_delta(spark, sf):
    rows = S.table(spark, sf, "documents")
    added = text.line_breaks(F.col("text")).cast("bigint")
    return rows.select("doc_id", added.alias("lines_added"), text.first_line(F.col("text")).alias("first_line"))


@query
def test_runs(spark, sf):
    return G.extract_test_runs(S.terminal_log(spark, sf)).select("id", "command", "passed", "failed", "skipped", "source")


# ---- rollups ----


@query
def time_rollup(spark, sf):
    rows = rollup.additive_rollup(S.work_log(spark, sf), S.NOW)
    share = text.percent(F.col("estimated_ms"), F.col("duration_ms"))
    return rows.select(
        "project", "period", *rollup.TIME, "sessions", "estimated_ms", "longest_session_ms", share.alias("estimated_pct")
    )


@query
def median_session(spark, sf):
    return rollup.median_sessions(S.work_log(spark, sf), S.NOW)


@query
def heatmap_by_hour(spark, sf):
    return rollup.hours_of_day(S.work_log(spark, sf), S.NOW).withColumn("minutes", F.round("minutes", 6))


@query
def editor_rollup(spark, sf):
    log = S.signal_log(spark, sf)
    rows = rollup.additive_rollup(log, S.NOW).join(rollup.edited_files(log, S.NOW), ["project", "period"])
    return rows.select(
        "project", "period", "lines_added", "lines_removed", "files_edited", "fs_create", "fs_delete", "fs_change"
    )


@query
def lines_by_language(spark, sf):
    return rollup.lines_by_language(S.signal_log(spark, sf), S.NOW)


@query
def language_lines(spark, sf):
    return reports.language_lines(rollup.lines_by_language(S.signal_log(spark, sf), S.NOW))


@query
def top_files(spark, sf):
    return rollup.top_files(S.signal_log(spark, sf), S.NOW).select(
        "project", "period", "place", "file", "lines_added", "lines_removed", "active_ms"
    )


@query
def git_rollup(spark, sf):
    rows = rollup.additive_rollup(S.commit_log(spark, sf), S.NOW)
    return rows.select("project", "period", "commits", "insertions", "deletions")


@query
def activity_counts(spark, sf):
    rows = rollup.additive_rollup(S.signal_log(spark, sf), S.NOW)
    return rows.select(
        "project", "period", "test_runs", "tests_passed", "tests_failed", "task_runs", "debug_sessions"
    )


@query
def quality_delta(spark, sf):
    rows = rollup.additive_rollup(S.signal_log(spark, sf), S.NOW)
    return rows.select("project", "period", "first_errors", "first_warnings", "last_errors", "last_warnings")


@query
def multi_period_rollup(spark, sf):
    return rollup.rollup_periods(S.event_log(spark, sf), S.NOW)


@query
def rollup_nested(spark, sf):
    """The nested export, read back field by field."""
    nested = reports.rollup_nested(S.event_log(spark, sf), S.NOW)
    return nested.selectExpr(
        "project",
        "period",
        "time.duration_ms",
        "time.median_session_ms",
        "editor.files_edited",
        "git.commits",
        "quality.last_errors",
        "counts.test_runs",
        "array_join(transform(editor.by_language, l -> concat(l.language, ':', l.lines)), ',') as languages",
        "array_join(transform(editor.top_files, f -> concat(f.file, ':', f.lines_added)), ',') as files",
        "array_join(array_sort(map_keys(agents)), ',') as agents",
        "agents['claude'].total_tokens as claude_tokens",
        "array_join(agents['claude'].pricing_versions, ',') as claude_versions",
        "array_join(transform(agents['codex'].by_model, m -> m.model), ',') as codex_models",
        "cast(round(aggregate(heatmap_by_hour, 0D, (a, x) -> a + x) * 60000) as bigint) as worked_ms",
        "size(heatmap_by_hour) as hours",
    )


@query
def rollup_nested_parts(spark, sf):
    """The nested export in parts of four items, written, read back and told by number, first and last item."""
    path = staging_path(spark, "nested")
    reports.write_nested(reports.nested_parts(S.event_log(spark, sf), S.NOW, 4), path)
    parts = spark.read.schema("project string, period string, section string, of string, part int, json string").json(path)
    item = lambda at: F.coalesce(*(F.expr(f"get_json_object(json, concat('$[', {at}, '].{c}'))") for c in ("file", "language", "model")))
    return parts.select(
        "project", "period", "section", "of", "part", F.json_array_length("json").alias("items"),
        F.coalesce(item("0"), F.get_json_object("json", "$.time.duration_ms")).alias("first_item"), item("json_array_length(json) - 1").alias("last_item"),
    )


def _rollup_and_agents(spark, sf):
    log = S.event_log(spark, sf)
    return rollup.rollup_periods(log, S.NOW), rollup.agent_totals(log, S.NOW)


@query
def csv_export(spark, sf):
    return reports.csv_export(*_rollup_and_agents(spark, sf))


@query
def kpis(spark, sf):
    return reports.kpis(*_rollup_and_agents(spark, sf))


@query
def period_summary(spark, sf):
    return reports.period_summary(*_rollup_and_agents(spark, sf))


@query
def today_line(spark, sf):
    return reports.today_line(*_rollup_and_agents(spark, sf))


@query
def summary_rows(spark, sf):
    return reports.summary_rows(rollup.rollup_periods(S.event_log(spark, sf), S.NOW))


@query
def agent_lines(spark, sf):
    log = S.agent_log(spark, sf)
    return reports.agent_lines(rollup.agent_totals(log, S.NOW), rollup.pricing_versions(log, S.NOW))


@query
def model_lines(spark, sf):
    return reports.model_lines(rollup.agent_models(S.turn_log(spark, sf), S.NOW))


@query
def format_columns(spark, sf):
    n = F.col("o_orderkey") * F.col("o_custkey")
    length, whole = F.col("o_orderkey") * 1000, F.col("o_custkey") * 1000
    return S.table(spark, sf, "orders").select(
        "o_orderkey",
        text.count_label(n).alias("n_label"),
        text.duration_label(length).alias("time_label"),
        text.share_label(length, whole).alias("share_label"),
    )


# ---- calendar ----


def _cells(spark, sf):
    return calendar.daily_cells(S.event_log(spark, sf))


@query
def daily_cells(spark, sf):
    return _cells(spark, sf)


@query
def daily_series(spark, sf):
    return calendar.daily_series(_cells(spark, sf), S.NOW, SERIES_DAYS)


@query
def daily_series_nonlinear(spark, sf):
    """Two months, of which the first has no work yet."""
    points = calendar.collapse_gaps(calendar.daily_series(_cells(spark, sf), S.NOW, 2 * SERIES_DAYS))
    return points.select("project", "date", "is_gap", "span_days", "duration_ms", "commits")


@query
def calendar_grid(spark, sf):
    return calendar.calendar_grid(_cells(spark, sf), S.NOW)


@query
def calendar_month_grid(spark, sf):
    return calendar.month_grid(_cells(spark, sf), YEAR, MONTH)


@query
def available_months(spark, sf):
    """Months of the commit history and of now."""
    log = S.commits(spark, sf).select("project", day_key(F.col("ts")).alias("date")).distinct()
    return calendar.available_months(log, S.NOW)


@query
def schedule_heatmap(spark, sf):
    return calendar.schedule_heatmap(S.work_log(spark, sf)).withColumns(
        {"minutes": F.round("minutes", 6), "max_minutes": F.round("max_minutes", 6)}
    )


@query
def schedule_intensity(spark, sf):
    rows = calendar.schedule_intensity(calendar.schedule_heatmap(S.work_log(spark, sf)))
    return rows.withColumn("intensity", F.round("intensity", 6))


@query
def day_segments(spark, sf):
    rows = calendar.day_segments(calendar.daily_series(_cells(spark, sf), S.NOW, SERIES_DAYS))
    hours = ["user_hours", "agent_hours", "waiting_hours", "claude_mtok", "codex_mtok"]
    return rows.select("project", "date", *[F.round(c, 6).alias(c) for c in hours])


@query
def intensity_levels(spark, sf):
    return calendar.intensity_levels(_cells(spark, sf))


# ---- backfill ----


@query
def estimated_sessions(spark, sf):
    rows = backfill.estimate_sessions(S.spread_commits(spark, sf), S.agent_turns(spark, sf), S.NOW)
    return rows.select(
        "event_id", ms("ts"), "project", "session_id", "duration_ms", "interaction_ms", "agent_only_ms", "estimated"
    )


@query
def needs_backfill(spark, sf):
    """Commit authors and session ids as projects: only ids of turns and work sessions are measured."""
    log = S.event_log(spark, sf).withColumn("project", F.coalesce("author", "session_id"))
    return backfill.projects_needing_backfill(log, log.select("project").distinct())


@query
def backfill_events(spark, sf):
    turns = S.turn_log(spark, sf).withColumn("session_id", F.lit("bf_agents"))
    rows = backfill.backfill_events(S.spread_commits(spark, sf), turns, S.NOW)
    return rows.select(
        "event_id", ms("ts"), "project", "session_id", "type", "duration_ms", "agent_only_ms", "insertions", "input", "cost_usd"
    )


# ---- repair ----


@query
def stale_events(spark, sf):
    rows = repair.stale_events(X.stored_log(spark, sf))
    return rows.groupBy("agent", "session_uuid", "type").agg(F.count("*").alias("stale"))


@query
def agent_sessions_in_log(spark, sf):
    return dedup.agent_sessions_in(X.stored_log(spark, sf))


@query
def latest_agent_session(spark, sf):
    rows = dedup.latest_agent_session(X.stored_log(spark, sf))
    return rows.select("agent", "session_uuid", "event_id", "unparsed_lines")


@query
def consecutive_dedup(spark, sf):
    turns = X.stored_log(spark, sf).where("type = 'agent_turn'")
    placed = turns.withColumn("offset", ids.offset_in(F.col("event_id")))
    kept = dedup.drop_repeats(placed, agents.SESSION, ["offset", "ingest_seq"], list(repair.BILLED))
    return kept.select("agent", "session_uuid", "event_id", "input", "output", "cache_create", "cache_read")


@query
def upgrade_turns(spark, sf):
    turns = X.stored_log(spark, sf).where("type = 'agent_turn'")
    rows = repair.upgrade_stored_turns(turns)
    return rows.select("event_id", "agent", "input", "output", "cache_create", "cache_create_1h", "cache_read", "calc_version")


@query
def reprice(spark, sf):
    turns = X.stored_log(spark, sf).where("type = 'agent_turn'")
    rows = repair.reprice(repair.upgrade_stored_turns(turns), shipped_prices(spark))
    return rows.select("event_id", "agent", "model", "cost_usd", "pricing_version")


@query
def migrate_history(spark, sf):
    rows = repair.migrate_history(X.stored_log(spark, sf), X.reparsed(spark, sf), shipped_prices(spark))
    return rows.select(
        "event_id", ms("ts"), "project", "session_id", "type", "agent", "session_uuid", "model", "turns", *TOKENS,
        "cost_usd", "pricing_version", "calc_version", "unparsed_lines",
    )


@query
def migration_report(spark, sf):
    log, again = X.stored_log(spark, sf), X.reparsed(spark, sf)
    return repair.migration_report(log, repair.migrate_history(log, again, shipped_prices(spark)), again)
