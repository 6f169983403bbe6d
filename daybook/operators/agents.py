"""Agent sessions from their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.tokens import TOKENS, money_sum, token_sums, zero_if_null
from daybook.operators.ordered import OrderedRows, highest, total
from daybook.operators.pricing import price_turns

SESSION = ["agent", "session_uuid"]


def summarize_agent_sessions(turns: DataFrame, order: str = "byte_offset") -> DataFrame:
    """One row per session: span, turns, tokens, the last model and the sum of its turns' costs."""
    at = F.struct("ts", order)
    return turns.groupBy(*SESSION).agg(
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("turns"),
        *token_sums(),
        F.max_by("model", at).alias("model"),
        money_sum("cost_usd").alias("cost_usd"),
    )


def price_sessions(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Sessions priced as a whole: all tokens at the rates of the last model."""
    return price_turns(sessions, prices)


def running_agent_sessions(turns: DataFrame, prices: DataFrame, chunks: int | None = None) -> DataFrame:
    """The session as it stood after each turn, priced at that turn's model."""

    def so_far(name: str) -> Column:
        return F.col(f"_{name}") + zero_if_null(name)

    ordered = OrderedRows(turns, SESSION, ["byte_offset"], chunks, "running")
    carries = {f"_{t}": total(zero_if_null(t)) for t in TOKENS}
    rows = ordered.carry(
        **carries, _turns=total(F.lit(1).cast("bigint")), _start=highest(-F.unix_micros("ts")), _end=highest(F.col("ts"))
    )
    started = -F.greatest("_start", -F.unix_micros("ts"))
    versions = rows.select(
        *SESSION,
        "byte_offset",
        "model",
        F.timestamp_micros(started).alias("started_at"),
        F.greatest("_end", "ts").alias("ended_at"),
        (F.col("_turns") + 1).alias("turns"),
        *[so_far(t).cast("bigint").alias(t) for t in TOKENS],
    )
    return price_turns(versions, prices)
