import random

import pytest
from pyspark.sql import functions as F

from daybook.operators.activity import DIMENSIONS, GRACE_MS, IDLE_MS, MIN_SESSION_MS, sessionize_ticks
from daybook.operators.attribution import attribute_events, with_last_write
from daybook.operators.median import median_of_counts
from daybook.operators.signals import detect_changes, pair_intervals

MIN = 60_000
COLUMNS = "project string, t long, id long, interaction boolean, focused boolean, last_write_ms long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("ts", F.timestamp_millis("t"))


def found(spark, rows, chunks=None, **options):
    got = sessionize_ticks(frame(spark, rows), chunks=chunks, **options)
    ms = [F.unix_millis(c).alias(c) for c in ("started_at", "ended_at")]
    return sorted(tuple(r) for r in got.select("project", *ms, "is_closed", *DIMENSIONS).collect())


def simulate(rows, idle=IDLE_MS, grace=GRACE_MS, shortest=MIN_SESSION_MS, focus_opens=True):
    """Plain restatement of the rules, tick by tick."""
    out = []
    for project in sorted({r[0] for r in rows}):
        session = None
        for _, now, _, typed, focused, write in sorted((r for r in rows if r[0] == project), key=lambda r: (r[1], r[2])):
            agent = write > 0 and now - write < grace
            in_reach = session is not None and now - session["typed"] < idle
            if session is None:
                if typed or agent or (focused and focus_opens):
                    session = {"start": now, "seen": now, "typed": now, "sums": dict.fromkeys(DIMENSIONS, 0)}
                continue
            if not (typed or agent or (focused and in_reach)):
                out.append((project, session, now, True))
                session = None
                continue
            gap = min(now - session["seen"], idle)
            session["seen"] = now
            if gap <= 0:
                continue
            rules = {
                "duration_ms": True, "focus_ms": focused, "interaction_ms": typed, "agent_present_ms": agent,
                "agent_only_ms": agent and not typed, "focus_only_ms": focused and not typed and not agent,
                "idle_ms": not typed and not agent,
            }
            for name, counts in rules.items():
                session["sums"][name] += gap if counts else 0
            if typed:
                session["typed"] = now
        if session is not None:
            out.append((project, session, session["seen"], False))
    return sorted(
        (p, s["start"], end, closed, *s["sums"].values()) for p, s, end, closed in out if s["sums"]["duration_ms"] >= shortest
    )


def steady(n, start, step, typed, focused, write=lambda now: 0, project="p", first=0):
    return [(project, start + i * step, first + i, typed, focused, write(start + i * step)) for i in range(n)]


def test_agent_work_keeps_a_session_open(spark):
    rows = [("p", 2 * MIN, 0, True, True, 0)]
    rows += steady(27, 3 * MIN, MIN, False, False, lambda now: now - 10_000, first=1)
    [s] = found(spark, rows, chunks=5)
    assert s[3] is False
    sums = dict(zip(DIMENSIONS, s[4:]))
    assert sums["agent_only_ms"] == sums["agent_present_ms"] == 27 * MIN and sums["interaction_ms"] == 0


def test_focus_alone_ends_after_the_idle_time(spark):
    rows = [("p", 3 * MIN, 0, True, True, 0)] + steady(240, 4 * MIN, MIN, False, True, first=1)
    sessions = found(spark, rows, chunks=7)
    assert len(sessions) == 22 and sum(s[4] for s in sessions) == 198 * MIN
    assert max(s[4] for s in sessions) <= IDLE_MS
    assert sessions == simulate(rows)
    once = found(spark, rows, chunks=7, reopen_on_focus=False)
    assert len(once) == 1 and once[0][4] == 9 * MIN


def test_grace_gap_cap_and_shortest_session(spark):
    rows = [("g", 4 * MIN, 0, True, True, 4 * MIN)]
    rows += [("g", (5 + i) * MIN, 1 + i, False, False, 4 * MIN) for i in range(15)]
    rows += [("short", MIN, 0, True, True, 0), ("short", MIN + 10_000, 1, True, True, 0), ("short", 2 * MIN, 2, False, False, 0)]
    sleep = 6 * MIN + 3 * 3_600_000
    rows += [("z", 6 * MIN, 0, True, True, 0), ("z", sleep, 1, False, True, sleep - 5_000)]
    sessions = {s[0]: s for s in found(spark, rows)}
    assert set(sessions) == {"g", "z"}
    assert sessions["g"][2:5] == (7 * MIN, True, 2 * MIN)
    assert sessions["z"][3:5] == (False, IDLE_MS)


@pytest.mark.parametrize("seed", range(4))
def test_any_ticks_in_any_chunks_equal_the_simulation(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 1_000_000
    weights = [(0.3, 0.6, 0.2), (0.01, 0.97, 0.0), (0.02, 0.9, 0.08), (0.15, 0.5, 0.6)][seed]
    steps = [[0, 15_000, 60_000, 700_000], [0, 1, 30_000, 90_000], [15_000, 120_000, 590_000], [0, 100_000, 400_000]][seed]
    write = 0
    for i in range(900):
        t += rng.choice(steps)
        if rng.random() < weights[2]:
            write = t - rng.choice([0, 1_000, 200_000])
        rows.append(("hot" if i % 10 else rng.choice("ab"), t, i, rng.random() < weights[0], rng.random() < weights[1], write))
    expected = simulate(rows)
    assert len(expected) > 3
    for chunks in (1, 11, 60):
        assert found(spark, rows, chunks) == expected
    assert found(spark, rows, 11, reopen_on_focus=False) == simulate(rows, focus_opens=False)


def test_last_write_and_open_session(spark):
    ticks = spark.createDataFrame([("p", t, i) for i, t in enumerate((5, 10, 10 + 180, 400))], "project string, s long, id long")
    ticks = ticks.withColumn("ts", F.timestamp_seconds("s"))
    writes = spark.createDataFrame([("p", 10), ("p", 10), ("q", 1)], "project string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = with_last_write(ticks, writes.drop("s"), GRACE_MS, chunks=4).orderBy("id").collect()
    assert [r.agent_active for r in got] == [False, True, False, False]
    sessions = spark.createDataFrame([("p", "s1", 8, 200), ("p", "s2", 300, 301)], "project string, session_id string, a long, b long")
    sessions = sessions.withColumns({"started_at": F.timestamp_seconds("a"), "ended_at": F.timestamp_seconds("b")})
    found_ = attribute_events(ticks, sessions, chunks=4).orderBy("id").collect()
    assert [r.session_id for r in found_] == ["idle_0", "s1", "s1", "idle_6"]


def test_pairs(spark):
    marks = [("k", 1, "s"), ("k", 2, "s"), ("k", 5, "e"), ("k", 6, "e"), ("k", 7, "s"), ("j", 1, "e")]
    df = spark.createDataFrame([(k, t, i, w) for i, (k, t, w) in enumerate(marks)], "key string, s long, id long, w string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = pair_intervals(df.where("w = 's'").drop("w"), df.where("w = 'e'").drop("w"), ["key"], chunks=3)
    assert sorted((r.key, r.id, r.duration_ms) for r in got.collect()) == [("j", 5, 0), ("k", 2, 3000), ("k", 3, 0)]


def test_changes_look_at_the_total(spark):
    rows = [("p", i, i, e, w) for i, (e, w) in enumerate([(0, 0), (0, 0), (1, 2), (2, 1), (2, 2), (0, 4), (0, 3)])]
    df = spark.createDataFrame(rows, "project string, s long, id long, errors long, warnings long")
    got = detect_changes(df.withColumn("ts", F.timestamp_seconds("s")), chunks=4)
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 6]


def test_medians(spark):
    rng = random.Random(1)
    groups = {"odd": [5, 1, 9], "even": [1, 2], "one": [7], "many": [rng.randint(0, 10**7) for _ in range(1000)], "same": [3] * 10}
    counts = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v long").groupBy("g", "v").count()
    got = {r.g: r["median"] for r in median_of_counts(counts, ["g"], "v", "count", 1000).collect()}

    def middle(values):
        s = sorted(values)
        low, high = s[(len(s) - 1) // 2], s[len(s) // 2]
        return (low + high + 1) // 2

    assert got == {g: middle(vs) for g, vs in groups.items()}


def test_writes_with_an_id_stand_in_the_order_of_the_ticks(spark):
    """Ticks (ms, us past it, id) and writes of one millisecond: only those at or behind the write's instant and id see it."""
    base = 1_711_000_000_000_000
    ticks = [(0, 1), (60_000_100, 2), (60_000_300, 3), (60_000_300, 5), (60_000_500, 4)]
    writes = [(60_000_300, 4), (60_000_400, 1)]
    schema = "project string, us long, id long"
    at = {"ts": F.timestamp_micros("us"), "interaction": F.lit(False), "focused": F.lit(True)}
    ticks = spark.createDataFrame([("p", base + us, i) for us, i in ticks], schema).withColumns(at).drop("us")
    writes = spark.createDataFrame([("p", base + us, i) for us, i in writes], schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
    seen = with_last_write(ticks, writes, GRACE_MS, chunks=2).where("agent_active").select("id").collect()
    assert sorted(r.id for r in seen) == [4, 5]
    for chunks in (1, 3):
        [found_] = sessionize_ticks(ticks, writes, chunks=chunks).collect()
        # The minute is credited to the first tick of the millisecond (id 2), which is in front of both writes.
        assert (found_.duration_ms, found_.agent_present_ms, found_.focus_only_ms) == (60_000, 0, 60_000)
        [found_] = sessionize_ticks(ticks, writes.drop("id"), chunks=chunks).collect()
        assert found_.agent_present_ms == 60_000
