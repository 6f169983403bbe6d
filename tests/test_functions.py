import pytest
from pyspark.sql import functions as F

from daybook.functions import ids, models, paths, testlog, text
from daybook.operators.pricing import price_turns
from daybook.operators.signals import extract_test_runs
from daybook.sources.prices import PRICES, read_prices, shipped_prices


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)])
    width = len(df.columns) - 1
    cols = [F.col(f"_{k + 2}") for k in range(width)]
    return [r.v for r in df.select("_1", make(*cols).alias("v")).orderBy("_1").collect()]


def test_slugs(spark):
    given = ["E:\\harbour", "/srv/teams/kiln/wheel", "F:\\Tide-Tables", "G:\\Parts List\\", "//x  y/z w//", "/", "a:b"]
    expected = ["e--harbour", "srv-teams-kiln-wheel", "f--tide-tables", "g--parts-list", "x--y-z-w", "", "a-b"]
    assert values(spark, given, paths.path_slug) == expected


def test_paths_below_a_root(spark):
    cases = [
        ("E:\\Kiln", "E:\\Kiln"), ("E:\\Kiln", "e:/kiln\\glaze\\blue"), ("E:\\Kiln", "E:\\Kilns"),
        ("E:\\Kiln", "E:\\other\\Kiln"), ("/srv/wheel//", "/srv///wheel/spokes"), ("/srv/wheel", "/srv"),
    ]
    assert values(spark, cases, paths.is_under) == [True, True, False, False, True, False]
    assert values(spark, ["F:\\\\One\\two/", "//Q/r\\/s"], paths.comparable_path) == ["f:/one/two", "/q/r/s"]
    assert values(spark, ["F:\\One\\Two/three"], paths.ancestors) == [["f:", "f:/one", "f:/one/two", "f:/one/two/three"]]
    relative = [("/srv/Kiln", "/SRV/kiln/glaze\\m.py"), ("/srv/kiln", "/tmp\\k"), ("/srv", "/srv"), ("/srv", "/srv\\\\deep/x")]
    assert values(spark, relative, paths.relative_path) == ["glaze/m.py", "/tmp/k", "", "deep/x"]


def test_languages_and_noise(spark):
    given = ["clay/Form.tsx", "fire.ZIG", "Dockerfile", "v1.2/notes", "pot.H", "oven.Yml"]
    assert values(spark, given, paths.language_of) == ["typescriptreact", "zig", "autre", "2/notes", "c", "yaml"]
    assert values(spark, ["pot.H", "Dockerfile", "log.MD"], paths.disk_language_of) == ["h", "dockerfile", "markdown"]
    given = ["build/out.o", "web/dist/app.js", "distance/a", "kiln/.git/HEAD", "coverage", "src/coverage.py", "node_modules", "my_node_modules/x"]
    assert values(spark, given, paths.is_noise) == [True, True, False, True, True, False, True, False]


def test_model_names(spark):
    given = ["apac.anthropic.kestrel-2-20310401", "kestrel-2[500k]", "anthropic.kestrel-2-20310401-v3:1", "box/shelf/heron"]
    assert values(spark, given, models.price_name) == ["kestrel-2"] * 3 + ["box/shelf/heron"]
    assert values(spark, given, models.model_label) == [
        "kestrel-2", "kestrel-2[500k]", "kestrel-2-20310401-v3:1", "local · heron",
    ]


def test_labels(spark):
    assert values(spark, [0, 29_999, 30_000, 3_599_999, 3_600_000, 3_900_000], text.duration_label) == [
        "0min", "0min", "1min", "1h00", "1h00", "1h05",
    ]
    assert values(spark, [0, 999, 1_000, 1_250, 999_999, 3_440_000], text.count_label) == [
        "0", "999", "1.0k", "1.3k", "1000.0k", "3.4M",
    ]
    assert values(spark, [(1, 3), (1, 0)], text.share_label) == ["33% of time", "—"]
    assert values(spark, ["head\nbody\nend", "y" * 9_000, "\nrest", ""], text.first_line) == ["head", "y" * 9_000, "", ""]
    assert values(spark, ["\n\nq\n", "", "q"], text.line_breaks) == [3, 0, 0]


def test_event_ids(spark):
    cases = [("claude", "k-7", "resp4:call9", 310), ("claude", "k-7", None, 310), ("codex", "roll", "resp4", 0)]
    assert values(spark, cases, ids.turn_event_id) == ["claude:k-7:m:resp4:call9", "claude:k-7:310", "codex:roll:0"]
    assert values(spark, ["0f9c"], ids.commit_event_id) == ["commit:0f9c"]
    assert values(spark, [("diagnostics", "day", 18)], ids.sequence_event_id) == ["diagnostics:day:18"]
    assert values(spark, ["k:r:905", "k:r:9z", "k:r:", "33"], ids.offset_in) == [905, 0, 0, 33]
    assert values(spark, [60_000, 359_999], ids.idle_session_id) == ["idle_1", "idle_5"]


def test_test_commands(spark):
    yes = [
        "yarn run test --silent", "bun test", "dotnet test Kiln.sln", "cd wheel && go  test -run Spin", "mocha spec/", "ava",
        "python -m pytest tests/unit", "cargo  test --release", "VITEST=1 vitest --watch=false", "pnpm test",
    ]
    no = ["npm run lint", "cat contest.txt", "go build ./cmd", "make check", "echo protests", "cargo bench"]
    assert values(spark, yes + no, testlog.is_test_command) == [True] * len(yes) + [False] * len(no)
    assert values(spark, ["a\u001b[1;31mred\u001b[0m b\u001b[K"], testlog.without_colours) == ["ared b\u001b[K"]


@pytest.mark.parametrize(
    "output, expected",
    [
        ("noise\n Test Files  8 passed (8)\n      Tests  31 passed | 4 failed | 6 skipped (41)\n", (31, 4, 6)),
        ("Tests:       7 failed, 5 todo, 64 passed, 76 total\nTime: 2 s\n", (64, 7, 5)),
        ("Tests:  9 passed, 9 total\n", (9, 0, 0)),
        ("  118 passing (41ms)\n  9 pending\n  2 failing\n", (118, 2, 9)),
        ("  3 failing\n", (0, 3, 0)),
        ("= 5 failed, 21 passed, 3 skipped, 2 xfailed in 0.94s =\n", (21, 5, 5)),
        ("======== 6 passed, 2 errors, 7 deselected in 12.50s ========", (6, 2, 7)),
        ("--- FAIL: TestGlaze (0.20s)\n--- SKIP: TestFire (0.00s)\n--- PASS: TestPot (1.00s)\n--- SKIP: TestX (0.00s)\n", (1, 1, 2)),
        (" Tests  0 passed (0)\n== 0 passed in 0.1s ==\n  17 passing\n", (17, 0, 0)),
        ("Tests  2 passed (2)\n" + "log line\n" * 150_000, (2, 0, 0)),
        ("Compiled in 3s, 4 warnings\n", None),
        ("", None),
    ],
)
def test_test_summaries(spark, output, expected):
    command = "pytest " + "--opt=1 " * 80
    df = spark.createDataFrame([(command, output), ("make", output)], "command string, output string")
    got = [(r.passed, r.failed, r.skipped, r.command) for r in extract_test_runs(df).collect()]
    assert got == ([(*expected, command)] if expected else [])


PRICE_FILE = """{"version": "2031-03", "models": {
  "kestrel-2": {"in": 4, "out": 12, "cacheWriteMult": 1.5, "cacheReadMult": 0.25},
  "heron-mini": {"in": 0.5, "out": 6}}}"""


def costs(spark, tmp_path, rows):
    (tmp_path / "p.json").write_text(PRICE_FILE)
    prices = read_prices(spark, str(tmp_path / "p.json"), "claude")
    columns = "agent string, model string, input long, output long, cache_create long, cache_create_1h long, cache_read long, reasoning long"
    turns = spark.createDataFrame(rows, columns).coalesce(1)
    return [(r.cost_usd, r.pricing_version) for r in price_turns(turns, prices).collect()]


def test_costs(spark, tmp_path):
    """In millions of tokens: kestrel-2 costs 4 in, 12 out, 6 for a 5 minute write, 8 for a 1 hour write, 1 for a read."""
    m, version = 1_000_000, "2031-03"
    cases = [
        (("claude", "kestrel-2", 2 * m, m // 2, m, None, 3 * m, None), 8 + 6 + 6 + 3.0),
        (("claude", "kestrel-2", 0, 0, 3 * m, m, 0, 0), 2 * 6 + 8.0),
        (("claude", "kestrel-2", 0, 0, m, 4 * m, 0, 0), 8.0),
        (("claude", "kestrel-2", 0, 0, 0, 0, 0, 5 * m), 0.0),
        (("claude", "eu.anthropic.kestrel-2-20310401", m, 0, 0, 0, 0, 0), 4.0),
        (("claude", "heron-mini", m, m, 0, 0, 2 * m, 0), 0.5 + 6 + 0.1),
        (("claude", "nameless", 3, 4, 0, 0, 0, 0), None),
    ]
    got = [costs(spark, tmp_path, [row])[0] for row, _ in cases]
    assert got == [(cost, version) for _, cost in cases]
    assert costs(spark, tmp_path, [("codex", "kestrel-2", m, 0, 0, 0, 0, 0)]) == [(None, None)]


def test_every_shipped_model_has_a_price(spark):
    rows = [(a, m, 1_000_000, 1, 0, 0, 0, 0) for a, listed in PRICES.items() for m in listed]
    rows.append(("claude", "claude-haiku-4-5-20251001", 1_000_000, 1, 0, 0, 0, 0))
    columns = "agent string, model string, input long, output long, cache_create long, cache_create_1h long, cache_read long, reasoning long"
    priced = price_turns(spark.createDataFrame(rows, columns), shipped_prices(spark))
    assert priced.where("cost_usd is null or pricing_version is null").count() == 0
    assert priced.count() == len(rows)
