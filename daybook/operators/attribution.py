"""Who a row belongs to: sessions to projects, events to sessions, ticks to the last agent write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.ids import idle_session_id
from daybook.functions.paths import ancestors, comparable_path, path_slug
from daybook.functions.when import epoch_ms
from daybook.operators.ordered import OrderedRows, highest, latest
from daybook.session import is_small, stage


# A filter's bits per root, bits in a block (what bitmap_construct_agg makes), and blocks at most: 16 MB.
_BITS_EACH, _BLOCK_BITS, _MOST_BLOCKS, _PROBES = 16, 32_768, 4_096, 3


def _probe(value: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(k)), F.lit(_BLOCK_BITS))


def folder_filter(folders: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(block, bits) rows of a Bloom filter over a column, and the number of blocks: 4 KB each, sized by the number of values up
    to a bound, so safe to broadcast."""
    n = folders.count()
    blocks = min(max(1, -(-n * _BITS_EACH // _BLOCK_BITS)), _MOST_BLOCKS)
    block = F.pmod(F.xxhash64(column), F.lit(blocks))
    probes = F.explode(F.array(*(_probe(F.col(column), k) for k in range(_PROBES))))
    marks = folders.select(block.alias("block"), probes.alias("bit"))
    return marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), blocks


def maybe_in(rows: DataFrame, column: str, bloom: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose value may be in the filter: all that are, and few others."""
    bits, blocks = bloom
    found = rows.withColumn("block", F.pmod(F.xxhash64(column), F.lit(blocks))).join(F.broadcast(bits), "block")
    # bitmap_construct_agg sets bit n % 8 of byte n / 8.
    byte = "cast(conv(hex(substring(bits, cast(floor(_at / 8) as int) + 1, 1)), 16, 10) as int)"
    for k in range(_PROBES):
        found = found.withColumn("_at", _probe(F.col(column), k)).where(f"shiftright({byte}, cast(_at % 8 as int)) & 1 = 1").drop("_at")
    return found.drop("block", "bits")


def attribute_by_folder(sessions: DataFrame, projects: DataFrame, small: bool | None = None) -> DataFrame:
    """sessions (…, cwd) with the projects (project, root) whose root is cwd or lies above it.

    Every folder above cwd is a join key, so the prefix join becomes an equi-join. Where the roots are
    too many to broadcast, each distinct cwd is matched once and copies join the result. Folders that no root can be, such as
    the top ones that all share, are taken out by a filter before anything is shuffled by folder. `small` tells whether the roots
    are few where the caller knows; otherwise they are counted.
    """
    roots = projects.select("project", "root", comparable_path(F.col("root")).alias("_folder"))
    folder = F.explode(ancestors(F.col("cwd")))
    if is_small(roots) if small is None else small:
        found = sessions.withColumn("_folder", folder).join(F.broadcast(roots), "_folder")
    else:
        places = sessions.select("cwd").distinct().withColumn("_folder", folder)
        places = maybe_in(places, "_folder", folder_filter(roots.where("_folder IS NOT NULL"), "_folder"))
        found = sessions.join(places.join(roots, "_folder"), "cwd")
    return found.select(*sessions.columns, "project", "root")


def match_repositories(repositories: DataFrame, projects: DataFrame) -> DataFrame:
    """repositories (repository, folder) with the projects (project, root) that contain them or lie in
    them: both directions are equi-joins over the folders above one side."""
    inside = attribute_by_folder(repositories.withColumnRenamed("folder", "cwd"), projects).select(
        "repository", "project"
    )
    holders = repositories.select(F.col("repository").alias("project"), F.col("folder").alias("root"))
    members = projects.select(F.col("project").alias("_member"), F.col("root").alias("cwd"))
    around = attribute_by_folder(members, holders).select(
        F.col("project").alias("repository"), F.col("_member").alias("project")
    )
    return inside.union(around).distinct()


def attribute_by_slug(files: DataFrame, projects: DataFrame) -> DataFrame:
    """files (…, folder) with the project whose root has that folder name as its slug."""
    slugs = projects.select("project", "root", path_slug(F.col("root")).alias("folder"))
    return files.join(F.broadcast(slugs) if is_small(slugs) else slugs, "folder")


# The id of a write that has none, in front of all others.
NO_ID = -(1 << 63)


def with_last_write(
    ticks: DataFrame, writes: DataFrame, grace_ms: int, chunks: int | None = None
) -> DataFrame:
    """ticks (project, ts, id, …) with last_write and agent_active: the last write (project, ts) at or
    before the tick is younger than grace_ms. Of one instant, writes with an id stand in front of the ticks from that id on,
    writes without one in front of all."""
    rows = OrderedRows(_with_writes(ticks, writes), ["project"], ["ts", "id", "_side"], chunks, "writes")
    merged = rows.carry(last_write=highest(F.when(F.col("_side") == 0, F.col("ts")))).where("_side = 1")
    age = epoch_ms(F.col("ts")) - epoch_ms(F.col("last_write"))
    return merged.withColumn("agent_active", F.coalesce(age < grace_ms, F.lit(False))).drop("_side", "_chunk")


def _with_writes(ticks: DataFrame, writes: DataFrame) -> DataFrame:
    """Writes of one instant are one row, with the least of their ids: nothing later in that instant changes what ticks see."""
    least = F.lit(NO_ID)
    marks = writes.groupBy("project", "ts").agg(F.min(F.coalesce("id", least)) if "id" in writes.columns else F.first(least))
    marks = marks.toDF("project", "ts", "id")
    return ticks.withColumn("_side", F.lit(1)).unionByName(
        marks.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )


def attribute_events(events: DataFrame, sessions: DataFrame, chunks: int | None = None) -> DataFrame:
    """events (project, ts, id, …) with the session open at that instant, start <= ts < end; without
    one, an idle id per minute. Sessions of a project do not overlap."""
    starts = sessions.select(
        "project",
        F.col("started_at").alias("ts"),
        F.lit(0).cast("bigint").alias("id"),
        F.lit(0).alias("_side"),
        F.struct("session_id", "ended_at").alias("_session"),
    )
    both = events.withColumn("_side", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    rows = OrderedRows(both, ["project"], ["ts", "_side", "id"], chunks, "attribute")
    found = rows.carry(_open=latest(F.col("_session"))).where("_side = 1")
    inside = F.col("ts") < F.col("_open.ended_at")
    return found.withColumn(
        "session_id",
        F.when(inside, F.col("_open.session_id")).otherwise(idle_session_id(epoch_ms(F.col("ts")))),
    ).drop("_side", "_session", "_open", "_chunk")


# Cells are 1, 8, 64, … seconds long; the last level has cells of seventy years.
_CELL, _LEVELS = 8, 11


def _covered(intervals: DataFrame) -> DataFrame:
    """A row per cell (level, cell) of the cells that cover an interval's seconds _lo to _hi. On each level the cells inside the
    interval run from `low` to `end`; taken are those at both ends that the next longer cells don't hold, at most 2 * (_CELL - 1)."""
    parts = []
    for level in range(_LEVELS):
        size, above = _CELL**level, _CELL ** (level + 1)
        low, end = f"cast(ceil(_lo / {size}) as bigint)", f"cast(floor((_hi + 1) / {size}) as bigint)"
        up, down = f"cast(ceil(_lo / {above}) as bigint) * {_CELL}", f"cast(floor((_hi + 1) / {above}) as bigint) * {_CELL}"
        run = "if({0} < {1}, sequence({0}, {1} - 1), array())"
        taken = run.format(low, end) if level == _LEVELS - 1 else (
            f"if({up} >= {down}, {run.format(low, end)}, concat({run.format(low, up)}, {run.format(down, end)}))"
        )
        parts.append(f"transform(cast({taken} as array<bigint>), c -> named_struct('level', {level}, 'cell', c))")
    return intervals.select("*", F.inline(F.expr(f"concat({', '.join(parts)})"))).drop("_lo", "_hi")


def within_intervals(events: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("project",)) -> DataFrame:
    """events (keys, ts, …) with every interval (keys, started_at, ended_at, …) open at that instant, start <= ts < end,
    also where intervals overlap. Columns of the intervals come as a struct `interval`.

    An interval is covered by cells of time: a session of a day by a few dozen. An event is in one cell per level, so the join is on
    equal cells, and a hot project spreads over as many keys as it has cells. Only levels that some interval uses are asked for.
    """
    second = lambda c: F.floor(F.unix_micros(c) / 1_000_000)
    held = intervals.where("started_at < ended_at").select(*keys, F.struct(*(c for c in intervals.columns if c not in keys)).alias("interval"))
    low, last = F.col("interval.started_at"), F.col("interval.ended_at")
    # The last instant before the end.
    high = F.floor((F.unix_micros(last) - 1) / 1_000_000)
    cells = stage(_covered(held.withColumns({"_lo": second(low), "_hi": high})), "cells")
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # at most _LEVELS
    if not levels:
        return events.join(held.limit(0), list(keys))
    of_event = [F.struct(F.lit(n).alias("level"), F.floor(second(F.col("ts")) / _CELL**n).alias("cell")) for n in levels]
    placed = events.select("*", F.inline(F.array(*of_event)))
    found = placed.join(cells, [*keys, "level", "cell"])
    return found.where((F.col("ts") >= low) & (F.col("ts") < last)).drop("level", "cell")


def attribute_overlapping(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """events (project, ts, id, …) with the session open at that instant that was opened last, of equal ones the one with the greatest id;
    without one, an idle id per minute. Sessions of a project may overlap, as those of several windows do."""
    held = within_intervals(events.select("project", "ts", "id"), sessions.select("project", "started_at", "ended_at", "session_id"))
    held = held.select("project", "ts", "id", F.unix_micros("interval.started_at").alias("_at"), F.col("interval.session_id").alias("session_id"))
    last = held.groupBy("project", "ts", "id").agg(F.max(F.struct("_at", "session_id")).alias("_last"))
    found = events.join(last, ["project", "ts", "id"], "left")
    own = F.coalesce("_last.session_id", idle_session_id(epoch_ms(F.col("ts"))))
    return found.withColumn("session_id", own).drop("_last")
