"""Test commands and the summaries test runners print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: what counts as a test command, and the summary formats of the runners.
TEST_COMMAND = (
    r"(?i)\b(vitest|jest|mocha|pytest|ava|(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?test\b"
    r"|go\s+test\b|cargo\s+test\b|dotnet\s+test\b)"
)
COLOUR_CODES = r"\x1B\[[0-9;]*m"
TESTS_LINE = r"(?im)^\s*Tests(?!\s+Files)\s*:?\s*([\d ,|a-z]+?)(?:\(\d+\)|\btotal\b|$)"
EQUALS_LINE = r"(?i)=+\s*([^=]+?)\s+in\s+[\d.]+s\s*=+"
VERDICT_LINE = r"(?im)^--- %s"


def is_test_command(command: Column) -> Column:
    return F.rlike(command, F.lit(TEST_COMMAND))


def without_colours(text: Column) -> Column:
    return F.regexp_replace(text, COLOUR_CODES, "")


def _number_before(text: Column, word: str) -> Column:
    found = F.regexp_extract(text, rf"(?i)(\d+)\s+{word}", 1)
    # An empty text is not cast: failed casts are slow.
    return F.coalesce(F.when(found != "", found.try_cast("bigint")), F.lit(0).cast("bigint"))


def test_summaries(df: DataFrame, output: str) -> DataFrame:
    """df with passed, failed and skipped from the first known format whose counts are not all 0; rows
    without such a format are dropped."""
    text, tests, equals = F.col("_text"), F.col("_tests"), F.col("_equals")

    def n(segment: Column, *words: str) -> Column:
        return sum((_number_before(segment, w) for w in words[1:]), _number_before(segment, words[0]))

    def verdicts(word: str) -> Column:
        return F.regexp_count(text, F.lit(VERDICT_LINE % word)).cast("bigint")

    def counts(passed: Column, failed: Column, skipped: Column) -> Column:
        return F.struct(passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"))

    formats = F.array(
        counts(n(tests, "passed"), n(tests, "failed"), n(tests, "skipped", "todo")),
        counts(n(text, "passing"), n(text, "failing"), n(text, "pending")),
        counts(n(equals, "passed"), n(equals, "failed", "error"), n(equals, "skipped", "xfailed", "deselected")),
        counts(verdicts("PASS"), verdicts("FAIL"), verdicts("SKIP")),
    )
    found = F.filter(formats, lambda c: c["passed"] + c["failed"] + c["skipped"] > 0)
    return (
        df.withColumn("_text", without_colours(F.col(output)))
        .withColumns(
            {"_tests": F.regexp_extract("_text", TESTS_LINE, 1), "_equals": F.regexp_extract("_text", EQUALS_LINE, 1)}
        )
        .select("*", F.inline(F.slice(found, 1, 1)))
        .drop("_text", "_tests", "_equals")
    )
