"""Work sessions from signal ticks.

A tick keeps a session alive if there was an interaction, an active agent, or focus less than idle_ms
after the last interaction. Opening counts as an interaction. The first live tick opens a session and
credits nothing; each later one credits the time since the tick before, at most idle_ms, to seven
overlapping dimensions; a tick that is not alive closes it.

A session can be as long as the data, so a project is never folded in one task. Rows lie in chunks of
the (project, time) sequence. What one chunk tells the next is only the open session, or none. Whether
a tick closes depends on two things: the last interaction before it, a carry, and the opening time of
its session. So each chunk of a split project is summed up once as a table "opened at most so late ->
open at the end"; these tables are chained, and then every chunk is cut into sessions on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.when import epoch_ms, from_epoch_ms
from daybook.operators.attribution import NO_ID
from daybook.operators.ordered import CHUNK, OrderedRows, highest, latest
from daybook.session import stage

# Idle timeout, agent grace, shortest session (ms).
IDLE_MS, GRACE_MS, MIN_SESSION_MS = 600_000, 180_000, 30_000

DIMENSIONS = (
    "duration_ms", "focus_ms", "interaction_ms", "agent_present_ms", "agent_only_ms", "focus_only_ms", "idle_ms",
)
_NONE = -1


class _Chunk:
    """The ticks of one project in one chunk, in order."""

    def __init__(self, pdf: pd.DataFrame, idle: int):
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        self.idle = idle
        self.t = pdf["t"].to_numpy()
        self.id = pdf["id"].to_numpy()
        self.flags = pdf
        self.opens = np.flatnonzero(pdf["can_open"].to_numpy())
        self.dead = np.flatnonzero(pdf["dead"].to_numpy())
        self.stale = np.flatnonzero(pdf["stale"].to_numpy())
        self.stale_t = self.t[self.stale]

    def next_open(self, after: int) -> int:
        i = np.searchsorted(self.opens, after, "right")
        return int(self.opens[i]) if i < len(self.opens) else _NONE

    def closing(self, opened: int, after: int) -> int:
        """First row past `after` that closes a session opened at time `opened`."""
        d = np.searchsorted(self.dead, after, "right")
        s = np.searchsorted(self.stale_t, opened + self.idle, "left")
        rows = [int(self.dead[d])] if d < len(self.dead) else []
        if s < len(self.stale):
            rows.append(int(self.stale[s]))
        return min(rows, default=_NONE)

    def sessions(self, opened: int | None) -> Iterator[tuple[int, int]]:
        """(row of opening or _NONE if it came in open, row of closing or _NONE if still open)."""
        row = _NONE
        if opened is None:
            row = self.next_open(_NONE)
            if row == _NONE:
                return
            opened = int(self.t[row])
        while True:
            end = self.closing(opened, row)
            yield row, end
            if end == _NONE:
                return
            row = self.next_open(end)
            if row == _NONE:
                return
            opened = int(self.t[row])

    def table(self) -> tuple[list[int], list[int], list[int]]:
        """What is open at the end of the chunk: entry 0 if nothing came in, entry k if a session came
        in that was opened at limits[k] at the latest. Later openings pass through unclosed."""
        final = {}  # closing row -> opening row of the session open at the end

        def after_closing(end: int) -> int:
            path = []
            while end not in final:
                row = self.next_open(end)
                nxt = self.closing(int(self.t[row]), row) if row != _NONE else _NONE
                path.append(end)
                if nxt == _NONE:
                    final[end] = row
                else:
                    end = nxt
            for seen in path:
                final[seen] = final[end]
            return final[end]

        first = self.next_open(_NONE)
        begin = self.closing(int(self.t[first]), first) if first != _NONE else _NONE
        limits, rows = [0], [first if begin == _NONE else after_closing(begin)]
        if len(self.dead):
            # Whatever came in is closed by the first dead tick at the latest.
            cut = int(self.dead[0])
            early = self.stale[self.stale < cut]
            limits_in = [int(self.t[s]) - self.idle for s in early] + [int(self.t[cut])]
            ends = [int(s) for s in early] + [cut]
        else:
            limits_in = [int(t) - self.idle for t in self.stale_t]
            ends = [int(s) for s in self.stale]
        for limit, end in zip(limits_in, ends):
            limits.append(limit)
            rows.append(after_closing(end))
            if limit >= self.t[0]:
                break
        opened = [int(self.t[r]) if r != _NONE else _NONE for r in rows]
        ids = [int(self.id[r]) if r != _NONE else _NONE for r in rows]
        return limits, opened, ids


_TABLE = "project string, _chunk int, limits array<bigint>, opened array<bigint>, ids array<bigint>"
_INCOMING = "project string, _chunk int, in_t bigint, in_id bigint"
_PIECES = (
    "project string, start_t bigint, start_id bigint, end_t bigint, last_t bigint, ticks bigint, "
    + ", ".join(f"{d} bigint" for d in DIMENSIONS)
)


def _summarize(idle: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        limits, opened, ids = _Chunk(pdf, idle).table()
        return pd.DataFrame(
            {"project": [key[0]], "_chunk": [key[1]], "limits": [limits], "opened": [opened], "ids": [ids]}
        )

    return run


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Incoming session of each chunk of one project, from the chunk tables (one row per chunk)."""
    t, i, out = _NONE, _NONE, []
    for row in pdf.rename(columns={"_chunk": "chunk"}).sort_values("chunk").itertuples():
        out.append((row.project, row.chunk, t, i))
        if t == _NONE:
            t, i = row.opened[0], row.ids[0]
        else:
            k = int(np.searchsorted(np.asarray(row.limits[1:]), t, "left")) + 1
            if k < len(row.limits):
                t, i = row.opened[k], row.ids[k]
    return pd.DataFrame(out, columns=["project", "_chunk", "in_t", "in_id"])


def _cut(idle: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(pdf, idle)
        flags = chunk.flags
        in_t = int(flags["in_t"].iloc[0])
        in_id = int(flags["in_id"].iloc[0])
        spans = list(chunk.sessions(None if in_t == _NONE else in_t))
        n = len(chunk.t)
        if not spans:
            return pd.DataFrame(columns=[c.split()[0] for c in _PIECES.split(", ")])
        first = np.array([a for a, _ in spans])
        last = np.array([b if b != _NONE else n for _, b in spans])
        credit = np.minimum(flags["delta"].to_numpy(), idle)
        focused, typed, agent = (flags[c].to_numpy() for c in ("focused", "interaction", "agent"))
        parts = {
            "duration_ms": credit,
            "focus_ms": credit * focused,
            "interaction_ms": credit * typed,
            "agent_present_ms": credit * agent,
            "agent_only_ms": credit * (agent & ~typed),
            "focus_only_ms": credit * (focused & ~typed & ~agent),
            "idle_ms": credit * (~typed & ~agent),
        }
        out = {
            "project": key[0],
            "start_t": np.where(first == _NONE, in_t, chunk.t[np.maximum(first, 0)]),
            "start_id": np.where(first == _NONE, in_id, chunk.id[np.maximum(first, 0)]),
            "end_t": pd.array([chunk.t[b] if b < n else None for b in last], dtype="Int64"),
            # A session that came in open and closes at the first row has no tick here.
            "last_t": pd.array([chunk.t[b - 1] if b > 0 else None for b in last], dtype="Int64"),
            "ticks": last - np.maximum(first, 0),
        }
        for name, values in parts.items():
            so_far = np.concatenate([[0], np.cumsum(values)])
            # Credits of the rows past the opening and before the closing.
            out[name] = so_far[last] - so_far[first + 1]
        return pd.DataFrame(out)

    return run


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _marks(writes: DataFrame) -> DataFrame:
    """One row per project and millisecond with writes: the place of the first, in front of all ticks there if it has no id."""
    t = epoch_ms(F.col("ts"))
    whole = F.struct((t * 1000).alias("_us"), F.lit(NO_ID).alias("id"))
    place = F.struct(_micros(F.col("ts")).alias("_us"), F.col("id").cast("bigint").alias("id"))
    place = F.when(F.col("id").isNull(), whole).otherwise(place) if "id" in writes.columns else whole
    return writes.groupBy("project", t.alias("t")).agg(F.min(place).alias("_first")).select("project", "t", "_first.*")


def tick_states(
    ticks: DataFrame,
    writes: DataFrame | None,
    idle_ms: int,
    grace_ms: int,
    reopen_on_focus: bool,
    chunks: int | None,
) -> tuple[OrderedRows, DataFrame]:
    """Ticks in sequence with what decides about each: its agent state, the time since the tick
    before, whether it can open, is dead, or closes a session opened long enough ago (stale)."""
    if writes is not None:
        marks = _marks(writes).withColumns({"_side": F.lit(0), "_write": F.col("t")})
        source = ticks.withColumns({"t": epoch_ms(F.col("ts")), "_us": _micros(F.col("ts")), "_side": F.lit(1)})
        source = source.unionByName(marks, allowMissingColumns=True).withColumn("_is_tick", F.col("_side") == 1)
    else:
        write = F.when(F.col("last_write_ms") > 0, F.col("last_write_ms"))
        source = ticks.withColumns({"t": epoch_ms(F.col("ts")), "_us": _micros(F.col("ts")), "_side": F.lit(1), "_write": write})
        source = source.withColumn("_is_tick", F.lit(True))
    source = source.fillna(False, ["interaction", "focused"])
    keep = ["project", "t", "_side", "id", "_us", "_is_tick", "_write", "interaction", "focused"]
    # Order by the millisecond, so that ties here are ties of the machine.
    order = ["t", "_side", "id"]
    rows = OrderedRows(source.select(*keep), ["project"], order, chunks, "ticks")
    earlier = {"_earlier": highest(F.col("_write"))} if writes is not None else {}
    tick_t = F.when(F.col("_is_tick"), F.col("t"))
    seen = rows.carry(**earlier, _prev=latest(tick_t))
    seen = (
        seen.withColumn("delta", F.when(F.col("_is_tick"), F.coalesce(F.col("t") - F.col("_prev"), F.lit(0))))
        # Only an interaction later than the tick before moves the idle window.
        .withColumn("_moves", F.col("interaction") & (F.col("_prev").isNull() | (F.col("delta") > 0)))
        .drop("_prev")
    )
    again = rows.derived(stage(seen, "tick-states"), order)
    moved = {"_typed": highest(F.when(F.col("_is_tick") & F.col("_moves"), F.col("t")))}
    if writes is None:
        marked, known = again.carry(**moved), F.col("_write")
    else:
        # A write row stands in front of its millisecond's ticks, also of those that come before the write in it.
        mark = F.when(~F.col("_is_tick"), F.struct("t", "_us", "id", "_earlier"))
        marked = again.carry(**moved, _mark=latest(mark)).drop("_earlier")
        ahead = F.struct(F.col("_mark._us"), F.col("_mark.id")) > F.struct("_us", "id")
        known = F.when((F.col("_mark.t") == F.col("t")) & ahead, F.col("_mark._earlier")).otherwise(F.col("_mark.t"))
    marked = (
        marked.where("_is_tick")
        .withColumn("agent", F.coalesce(F.col("t") - known < grace_ms, F.lit(False)))
        .withColumn("dead", ~F.col("interaction") & ~F.col("focused") & ~F.col("agent"))
        .withColumn("_soft", F.col("focused") & ~F.col("interaction") & ~F.col("agent"))
    )
    can_open = ~F.col("dead") if reopen_on_focus else ~F.col("dead") & ~F.col("_soft")
    stale = F.col("_soft") & (F.coalesce(F.col("t") - F.col("_typed"), F.lit(idle_ms)) >= idle_ms)
    states = marked.withColumns({"stale": stale, "can_open": can_open})
    states = states.drop("_moves", "_soft", "_typed", "_write", "_side", "_is_tick", "_mark", "_us")
    return again, states


def sessionize_ticks(
    ticks: DataFrame,
    writes: DataFrame | None = None,
    idle_ms: int = IDLE_MS,
    grace_ms: int = GRACE_MS,
    min_session_ms: int = MIN_SESSION_MS,
    reopen_on_focus: bool = True,
    chunks: int | None = None,
) -> DataFrame:
    """Sessions from ticks (project, ts, id, interaction, focused). Agent writes come as a table
    (project, ts), or as a column last_write_ms of the ticks (0: none). Writes with an id count for the ticks from that instant and
    id on, writes without one for all ticks of their millisecond. A session still open at the
    last tick has is_closed false and ends there, never later."""
    rows, states = tick_states(ticks, writes, idle_ms, grace_ms, reopen_on_focus, chunks)
    split = rows.split_keys()
    if split is None:
        whole = states.withColumns({"in_t": F.lit(_NONE).cast("bigint"), "in_id": F.lit(_NONE).cast("bigint")})
        return _sessions(whole, idle_ms, min_session_ms)
    columns = ["project", CHUNK, "t", "id", "can_open", "dead", "stale"]
    tables = (
        states.join(F.broadcast(split), "project", "left_semi")
        .select(*columns)
        .groupBy("project", CHUNK)
        .applyInPandas(_summarize(idle_ms), _TABLE)
    )
    # One row per chunk of a split project: small, and safe to broadcast.
    incoming = tables.groupBy("project").applyInPandas(_chain, _INCOMING)
    continued = states.join(F.broadcast(incoming), ["project", CHUNK], "left").fillna(_NONE, ["in_t", "in_id"])
    return _sessions(continued, idle_ms, min_session_ms)


def _sessions(states: DataFrame, idle_ms: int, min_session_ms: int) -> DataFrame:
    """Sessions from tick states that know the session their chunk begins with."""
    pieces = states.groupBy("project", CHUNK).applyInPandas(_cut(idle_ms), _PIECES)
    whole = pieces.groupBy("project", "start_t", "start_id").agg(
        F.max("end_t").alias("end_t"),
        F.max("last_t").alias("last_t"),
        F.sum("ticks").alias("ticks"),
        *[F.sum(d).alias(d) for d in DIMENSIONS],
    )
    return whole.where(F.col("duration_ms") >= min_session_ms).select(
        "project",
        F.concat(F.lit("s_"), "project", F.lit("_"), "start_t", F.lit("_"), "start_id").alias("session_id"),
        from_epoch_ms(F.col("start_t")).alias("started_at"),
        from_epoch_ms(F.coalesce("end_t", F.greatest("last_t", "start_t"))).alias("ended_at"),
        F.col("end_t").isNotNull().alias("is_closed"),
        *DIMENSIONS,
    )
