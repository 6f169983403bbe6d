"""First and last rows per key by aggregation, so that copies fold before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.ids import offset_in
from daybook.operators.ordered import OrderedRows, previous


def _pick(df: DataFrame, keys: Sequence[str], best: Column) -> DataFrame:
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*").select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return _pick(df, keys, F.min_by(F.struct(*rest), F.struct(*order)))


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return _pick(df, keys, F.max_by(F.struct(*rest), F.struct(*order)))


def least_by(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """The row with the least rank per key. The rank is a number that no two rows of a key share, so the least one is found on
    keys and rank alone, in hash tables, and the wide rows are then looked up by it: they are shuffled once, as evenly as their
    ranks, and never sorted. df is read twice, so it should be a stored table."""
    ranked = df.withColumn("_rank", rank)
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    best = best.select(*(F.col(k).alias(f"_{k}") for k in keys), "_best").hint("shuffle_hash")
    same = F.col("_rank").eqNullSafe(F.col("_best"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranked.join(best, same, "left_semi").drop("_rank")


def one_per_response(turns: DataFrame) -> DataFrame:
    """The first usage line of each API response in a file; lines without response id all stay."""
    key = F.coalesce("message_id", F.concat(F.lit("\u0000"), F.col("byte_offset").cast("string")))
    keyed = turns.withColumn("_response", key)
    return least_by(keyed, ["source_file", "_response"], F.col("byte_offset")).drop("_response")


_LONG = "9223372036854775807"


def summary_rank(number: Column) -> Column:
    """Orders stored summaries by falling offset, then by their number, in one number."""
    offset = F.coalesce(offset_in(F.col("event_id")), F.lit(-1)).cast("decimal(19,0)")
    wide = F.lit(_LONG).cast("decimal(19,0)")
    return (-offset * wide).cast("decimal(38,0)") + number.cast("decimal(19,0)")


def number_in_rank(rank: Column) -> Column:
    wide = F.lit(_LONG).cast("decimal(19,0)")
    return F.pmod(rank, wide.cast("decimal(38,0)")).cast("bigint")


def latest_agent_session(log: DataFrame) -> DataFrame:
    """Per agent session the stored summary with the greatest offset, the first of equals."""
    stored = log.where(F.col("type") == "agent_session")
    return least_by(stored, ["agent", "session_uuid"], summary_rank(F.col("ingest_seq")))


def agent_sessions_in(log: DataFrame) -> DataFrame:
    """Every agent session named in the log, with where it is first seen."""
    return (
        log.where(F.col("type").isin("agent_turn", "agent_session"))
        .groupBy("agent", "session_uuid")
        .agg(F.min("ingest_seq").alias("first_seen"))
    )


def drop_repeats(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Rows whose `same` columns differ from the row just before within keys."""
    value = F.struct(*same)
    ordered = OrderedRows(df, keys, order, chunks, "repeats")
    kept = ordered.carry(_before=previous(value)).where(~value.eqNullSafe(F.col("_before")))
    return kept.select(*df.columns)
