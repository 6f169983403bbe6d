"""Reports formed from rollups. Inputs have one row per project and period (and agent, model, …)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.models import model_label
from daybook.functions.text import NOT_AVAILABLE, count_label, duration_label, share_label
from daybook.functions.tokens import round_half_up
from daybook.operators import rollup as R
from daybook.operators.ordered import placed
from daybook.schema import CLAUDE, CODEX

# Columns of the CSV report in order, with the rollup columns they show.
CSV_COLUMNS = {
    "durationMs": "duration_ms",
    "interactionMs": "interaction_ms",
    "agentPresentMs": "agent_present_ms",
    "agentOnlyMs": "agent_only_ms",
    "idleMs": "idle_ms",
    "sessions": "sessions",
    "longestSessionMs": "longest_session_ms",
    "commits": "commits",
    "insertions": "insertions",
    "deletions": "deletions",
    "linesAdded": "lines_added",
    "linesRemoved": "lines_removed",
    "fsCreate": "fs_create",
    "fsDelete": "fs_delete",
    "testRuns": "test_runs",
    "testsPassed": "tests_passed",
    "testsFailed": "tests_failed",
    "taskRuns": "task_runs",
    "debugSessions": "debug_sessions",
}


def money_label(usd: Column) -> Column:
    """$1.25; NULL for NULL."""
    label = F.concat(F.lit("$"), F.format_string("%.2f", F.floor(usd * 100 + 0.5) / 100))
    return F.when(usd.isNotNull(), label)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def csv_export(rollup: DataFrame, agents: DataFrame) -> DataFrame:
    """One row per project and period with the agents side by side; write with header for CSV."""

    def of(agent: str, column: str) -> Column:
        return F.max(F.when(F.col("agent") == agent, F.col(column)))

    wide = agents.groupBy("project", "period").agg(
        *[
            of(a, c).alias(a + name)
            for a in (CLAUDE, CODEX)
            for c, name in (("input", "TokensIn"), ("output", "TokensOut"), ("cost_usd", "CostUSD"))
        ]
    )
    tokens = [a + n for a in (CLAUDE, CODEX) for n in ("TokensIn", "TokensOut")]
    return (
        rollup.join(wide, ["project", "period"], "left")
        .fillna(0, tokens)
        .select(
            "project",
            "period",
            *[F.col(c).alias(n) for n, c in CSV_COLUMNS.items()],
            *[a + n for a in (CLAUDE, CODEX) for n in ("TokensIn", "TokensOut", "CostUSD")],
        )
    )


def write_csv(export: DataFrame, path: str) -> None:
    export.write.option("header", True).csv(path)


def _agent_sums(agents: DataFrame) -> DataFrame:
    return agents.groupBy("project", "period").agg(
        F.sum("total_tokens").alias("ai_tokens"),
        F.sum(F.col("input") + F.col("output")).alias("plain_tokens"),
        F.sum(F.col("cost_usd").cast("decimal(18,4)")).cast("double").alias("ai_cost"),
        F.count("*").alias("agents"),
        F.sum("turns").alias("ai_turns"),
    )


def period_summary(rollup: DataFrame, agents: DataFrame) -> DataFrame:
    """Time, AI tokens and AI cost (NULL without a priced agent), with their labels."""
    joined = rollup.join(_agent_sums(agents), ["project", "period"], "left")
    tokens = F.coalesce("ai_tokens", F.lit(0))
    return joined.select(
        "project",
        "period",
        "duration_ms",
        tokens.alias("ai_tokens"),
        "ai_cost",
        F.coalesce("ai_turns", F.lit(0)).alias("ai_turns"),
        duration_label(F.col("duration_ms")).alias("time_label"),
        F.when(tokens > 0, count_label(tokens)).otherwise(F.lit(NOT_AVAILABLE)).alias("tokens_label"),
        F.coalesce(money_label(F.col("ai_cost")), F.lit(NOT_AVAILABLE)).alias("cost_label"),
    )


def today_line(rollup: DataFrame, agents: DataFrame) -> DataFrame:
    """The day at a glance: time and turns, then tokens, passed tests and added lines where present."""
    day = rollup.where("period = 'day'").join(
        _agent_sums(agents.where("period = 'day'")), ["project", "period"], "left"
    )
    turns, tokens = F.coalesce("ai_turns", F.lit(0)), F.coalesce("ai_tokens", F.lit(0))
    parts = F.array_compact(
        F.array(
            duration_label(F.col("duration_ms")),
            _text(turns, " turns"),
            F.when(tokens > 0, _text(count_label(tokens), " tok")),
            F.when(F.col("tests_passed") + F.col("tests_failed") > 0, _text(F.col("tests_passed"), " passed")),
            F.when(F.col("lines_added") > 0, _text(F.col("lines_added"), " lines")),
        )
    )
    return day.select("project", F.array_join(parts, " · ").alias("today"))


def kpis(rollup: DataFrame, agents: DataFrame) -> DataFrame:
    """Key figures per project: (metric, value, detail); figures without data are left out."""
    week = rollup.where("period = 'week'").select(
        "project", F.struct(*[c for c in rollup.columns if c != "project"]).alias("w")
    )
    whole = rollup.where("period = 'all'").select(
        "project", F.struct("duration_ms", "longest_session_ms").alias("a")
    )
    used = _agent_sums(agents.where("period = 'all'")).drop("period")
    row = week.join(whole, "project").join(used, "project", "left")
    w, a = (lambda c: F.col(f"w.{c}")), (lambda c: F.col(f"a.{c}"))
    tokens = F.coalesce("plain_tokens", F.lit(0))
    always = F.lit(True)
    figures = [
        (always, "time_week", duration_label(w("duration_ms")), _text(w("sessions"), " sessions")),
        (always, "time_total", duration_label(a("duration_ms")), _text("longest ", duration_label(a("longest_session_ms")))),
        (
            always,
            "agent_alone_week",
            duration_label(w("agent_only_ms")),
            share_label(w("agent_only_ms"), w("duration_ms")),
        ),
        (always, "commits_week", w("commits").cast("string"), _text("+", w("insertions"), " / −", w("deletions"))),
        (tokens > 0, "tokens_total", count_label(tokens), _text(F.col("agents"), " agent(s)")),
        (tokens > 0, "cost_total", money_label(F.coalesce("ai_cost", F.lit(0.0))), F.lit("estimate")),
        (
            w("test_runs") > 0,
            "tests_week",
            _text(w("tests_passed"), "✓ ", w("tests_failed"), "✗"),
            _text(w("test_runs"), " runs"),
        ),
        (
            w("lines_added") + w("lines_removed") > 0,
            "lines_week",
            _text("+", w("lines_added")),
            _text("−", w("lines_removed"), " · ", w("files_edited"), " files"),
        ),
    ]
    items = [
        F.when(shown, F.struct(F.lit(m).alias("metric"), v.alias("value"), d.alias("detail")))
        for shown, m, v, d in figures
    ]
    return row.select("project", F.explode(F.array_compact(F.array(*items))).alias("f")).select("project", "f.*")


def summary_rows(rollup: DataFrame) -> DataFrame:
    """The summary report as (project, period, metric, value)."""
    c = F.col
    estimated = F.when(
        c("estimated_ms") > 0, _text(" (", duration_label(c("estimated_ms")), " estimated)")
    ).otherwise(F.lit(""))
    values = {
        "time": _text(duration_label(c("duration_ms")), estimated),
        "interaction": duration_label(c("interaction_ms")),
        "agent_present": duration_label(c("agent_present_ms")),
        "agent_alone": duration_label(c("agent_only_ms")),
        "focus_only": duration_label(c("focus_only_ms")),
        "sessions": c("sessions").cast("string"),
        "longest_session": duration_label(c("longest_session_ms")),
        "median_session": duration_label(c("median_session_ms")),
        "commits": _text(c("commits"), " (+", c("insertions"), " / −", c("deletions"), ")"),
        "lines": _text("+", c("lines_added"), " / −", c("lines_removed")),
        "files_on_disk": _text(c("fs_create"), " / ", c("fs_delete")),
        "tests": _text(c("tests_passed"), " ✓ / ", c("tests_failed"), " ✗ / ", c("test_runs")),
        "tasks_and_debug": _text(c("task_runs"), " / ", c("debug_sessions")),
        "errors": F.when(c("first_errors").isNotNull(), _text(c("first_errors"), " → ", c("last_errors"))),
    }
    wide = rollup.select("project", "period", *[v.alias(m) for m, v in values.items()])
    return wide.unpivot(["project", "period"], list(values), "metric", "value").where("value is not null")


def agent_lines(agents: DataFrame, versions: DataFrame) -> DataFrame:
    """One line of text per agent and period."""
    joined = agents.join(versions, ["project", "agent", "period"], "left")
    cost = F.coalesce(money_label(F.col("cost_usd")), F.lit("cost n/a"))
    lists = F.coalesce(F.nullif(F.array_join("pricing_versions", ", "), F.lit("")), F.lit("n/a"))
    line = _text(
        F.col("sessions"), " sessions · ", F.col("turns"), " turns · ", count_label(F.col("total_tokens")),
        " tokens · cache hit ", round_half_up(F.col("cache_hit_ratio") * 100), "% · ", cost, " (pricing ", lists, ")",
    )
    return joined.select("project", "period", "agent", line.alias("line"), "unparsed_lines")


def model_lines(models: DataFrame) -> DataFrame:
    """The per-model table with labels."""
    numbers = ("input", "output", "cache_create", "cache_read", "total_tokens")
    return models.select(
        "project",
        "period",
        "agent",
        "place",
        model_label(F.col("model")).alias("model"),
        "turns",
        *[count_label(F.col(n)).alias(n) for n in numbers],
        F.coalesce(money_label(F.col("cost_usd")), F.lit(NOT_AVAILABLE)).alias("cost"),
    )


def language_lines(languages: DataFrame, k: int | None = None) -> DataFrame:
    return R.first_languages(languages, ["project", "period"], k)


_GROUPS = {
    "time": [*R.TIME, "sessions", "longest_session_ms", "median_session_ms", "estimated_ms"],
    "editor": ["lines_added", "lines_removed", "files_edited", "fs_create", "fs_delete", "fs_change"],
    "quality": ["first_errors", "first_warnings", "last_errors", "last_warnings"],
    "git": ["commits", "insertions", "deletions"],
    "counts": ["test_runs", "tests_passed", "tests_failed", "task_runs", "debug_sessions"],
}


def rollup_nested(log: DataFrame, now, files: int | None = None) -> DataFrame:
    """The JSON export: one nested row per project and period. Arrays hold its models, languages and hours, and its
    files, with `files` only the first of them: a nested row is as long as what it lists."""
    keys = ["project", "period"]
    flat = R.rollup_periods(log, now)
    totals = R.agent_totals(log, now).join(R.pricing_versions(log, now), ["project", "agent", "period"], "left")
    models = R.agent_models(log, now)
    by_model = models.groupBy("project", "agent", "period").agg(
        F.array_sort(
            F.collect_list(
                F.struct("place", *[c for c in models.columns if c not in ("project", "agent", "period", "place")])
            )
        ).alias("by_model")
    )
    agents = (
        totals.join(by_model, ["project", "agent", "period"], "left")
        .groupBy(*keys)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        "agent",
                        F.struct(*[c for c in totals.columns if c not in (*keys, "agent")], "by_model").alias("totals"),
                    )
                )
            ).alias("agents")
        )
    )

    def listed(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, order)]
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    # Most lines first.
    languages = listed(R.lines_by_language(log, now).withColumn("_less", -F.col("lines")), "_less", "by_language")
    by_language = languages.withColumn("by_language", F.transform("by_language", lambda s: s.dropFields("_less")))
    hours = listed(R.hours_of_day(log, now), "hour", "hours")
    out = flat
    for part in (
        agents,
        by_language,
        listed(R.top_files(log, now, files), "place", "top_files"),
        hours.withColumn("hours", F.transform("hours", lambda h: h["minutes"])),
    ):
        out = out.join(part, keys, "left")
    groups = _GROUPS | {"editor": [*_GROUPS["editor"], "by_language", "top_files"]}
    return out.select(
        *keys, *[F.struct(*cols).alias(name) for name, cols in groups.items()], "agents", F.col("hours").alias("heatmap_by_hour")
    )


# Items of a list in one part of the export.
PART = 10_000


def nested_parts(log: DataFrame, now, size: int = PART) -> DataFrame:
    """The JSON export in parts of bounded length: (project, period, section, of, part, json). Section head has the single values, the
    hours and the totals by agent; sections by_model (of an agent), by_language and top_files have arrays of `size` items at most, part
    by part in their order. Items are numbered by ranges, so a project of any number of files is never gathered."""
    keys = ["project", "period"]
    totals = R.agent_totals(log, now).join(R.pricing_versions(log, now), ["project", "agent", "period"], "left")
    # A project has few agents and 24 hours.
    rest = F.struct(*[c for c in totals.columns if c not in (*keys, "agent")])
    agents = totals.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", rest.alias("totals"))))).alias("agents"))
    hours = R.hours_of_day(log, now).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour", "minutes"))).alias("_hours"))
    head = R.rollup_periods(log, now).join(agents, keys, "left").join(hours, keys, "left")
    groups = [F.struct(*cols).alias(name) for name, cols in _GROUPS.items()]
    heat = F.transform("_hours", lambda h: h["minutes"]).alias("heatmap_by_hour")
    none = F.lit(None).cast("string")
    heads = head.select(*keys, F.lit("head").alias("section"), none.alias("of"), F.lit(0).alias("part"), F.to_json(F.struct(*groups, "agents", heat)).alias("json"))

    def cut(items: DataFrame, section: str, of: Column) -> DataFrame:
        """Rows with `place` as arrays of JSON."""
        own = [c for c in items.columns if c not in (*keys, "place", "agent")]
        part = F.floor((F.col("place") - 1) / size).cast("int").alias("part")
        listed = F.array_sort(F.collect_list(F.struct("place", *own)))
        lists = items.groupBy(*keys, of.alias("of"), part).agg(F.to_json(F.transform(listed, lambda x: x.dropFields("place"))).alias("json"))
        return lists.select(*keys, F.lit(section).alias("section"), "of", "part", "json")

    languages = placed(R.lines_by_language(log, now), keys, [-F.col("lines"), F.col("language")])
    parts = [heads, cut(R.agent_models(log, now), "by_model", F.col("agent")), cut(languages, "by_language", none), cut(R.top_files(log, now), "top_files", none)]
    return reduce(DataFrame.unionByName, parts)


def write_nested(parts: DataFrame, path: str) -> None:
    """The parts as JSON lines, ordered by project, period, section and part; no task holds a project as a whole."""
    order = ["project", "period", "section", "of", "part"]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)
