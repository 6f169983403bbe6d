"""Token usage from transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions import jsonval as J
from daybook.functions.tokens import BILLED, TOKENS, any_tokens, zero_if_null
from daybook.operators.dedup import last_by
from daybook.operators.ordered import OrderedRows, latest
from daybook.schema import CLAUDE, CODEX, DEFAULT_CODEX_MODEL, UNKNOWN_MODEL
from daybook.session import present

# Fixed value: model name of messages made locally, without an API call.
LOCAL_MODEL = "<synthetic>"
# Places of a codex usage record in order of priority; total_* are running totals.
CODEX_PLACES = (
    "payload.info.total_token_usage",
    "info.total_token_usage",
    "payload.total_token_usage",
    "total_token_usage",
    "payload.info.last_token_usage",
    "info.last_token_usage",
    "payload.last_token_usage",
    "last_token_usage",
    "payload.token_usage",
    "token_usage",
)
# Keys of which a usage record has at least one.
CODEX_KEYS = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_output_tokens")


# Keys of the numbers in a usage record (codex: with an older name of the key).
CLAUDE_NUMBERS = {
    "input": "input_tokens",
    "output": "output_tokens",
    "cache_create": "cache_creation_input_tokens",
    "cache_create_1h": "cache_creation.ephemeral_1h_input_tokens",
    "cache_read": "cache_read_input_tokens",
    "reasoning": "output_tokens_details.thinking_tokens",
}
CODEX_NUMBERS = {
    "input": ("input_tokens", None),
    "output": ("output_tokens", None),
    "cache_create": ("cache_write_input_tokens", "cache_creation_input_tokens"),
    "cache_read": ("cached_input_tokens", "cache_read_input_tokens"),
    "reasoning": ("reasoning_output_tokens", None),
}


def _chosen(is_cumulative: bool, fields: str) -> str:
    return f"named_struct('is_cumulative', {str(is_cumulative).lower()}, 'fields', {fields})"


def claude_fields(doc: str) -> str:
    """The usage object of a claude line: in the message, else at the top."""
    nested, top = J.fields(doc, "message.usage"), J.fields(doc, "usage")
    found = f"if({J.given(J.node(doc, 'message.usage'))}, {nested}, {top})"
    return f"if({found} is not null, {_chosen(False, found)}, null)"


def claude_model(doc: str) -> str:
    named = [J.text(J.node(doc, p)) for p in ("message.model", "model")]
    return f"coalesce({', '.join(named)}, '{UNKNOWN_MODEL}')"


def claude_response(doc: str) -> str:
    """Id of the API response a line belongs to; NULL in old transcripts."""
    response = J.text(J.node(doc, "message.id"))
    request = f"coalesce(try_variant_get({doc}, '$.requestId', 'string'), '')"
    return f"if({response} <> '', concat({response}, ':', {request}), null)"


def codex_meta(doc: str) -> str:
    """cwd, model and version of a meta line: by its type, or by having a working folder."""
    is_meta = f"{J.text(J.node(doc, 'type'))} = 'session_meta' or {J.truthy(J.node(doc, 'payload.cwd'))}"
    named = ", ".join(f"'{c}', {J.text(J.node(doc, f'payload.{c}'))}" for c in ("cwd", "model", "cli_version"))
    return f"if({is_meta}, named_struct({named}), null)"


def codex_fields(doc: str) -> str:
    """The usage object of a codex line at the first place that has one."""
    found = []
    for place in CODEX_PLACES:
        fields = J.fields(doc, place)
        chosen = _chosen(place.endswith("total_token_usage"), fields)
        found.append(f"if({J.has_any(fields, CODEX_KEYS)}, {chosen}, null)")
    return f"coalesce({', '.join(found)})"


def _claude_number(token: str) -> str:
    key, _, inner = CLAUDE_NUMBERS[token].partition(".")
    value = f"try_element_at(_use.fields, '{key}')"
    return J.number(J.node(value, inner) if inner else value)


def _codex_number(token: str) -> str:
    if token not in CODEX_NUMBERS:
        return "0L"
    key, other = CODEX_NUMBERS[token]
    value = f"try_element_at(_use.fields, '{key}')"
    if other:
        value = f"if({J.given(value)}, {value}, try_element_at(_use.fields, '{other}'))"
    return J.number(value)


def read_usage(lines: DataFrame) -> DataFrame:
    """lines (agent, line, …) with columns unparsed, usage and meta instead of line. usage is NULL for
    lines without usage object, and for claude also for local messages and all-zero usage."""
    J.accept_repeated_keys(lines.sparkSession)
    kept = [c for c in lines.columns if c != "line"]
    claude, codex, doc = f"agent = '{CLAUDE}'", f"agent = '{CODEX}'", "_doc"
    parsed = lines.selectExpr(*kept, "trim(line) as _line", f"{J.parsed('trim(line)')} as _values")
    parsed = parsed.selectExpr(*kept, "_line", f"{J.single('_values')} as _doc")
    found = parsed.selectExpr(
        *kept,
        "_doc is null and _line <> '' as unparsed",
        f"if({codex}, {codex_meta(doc)}, null) as meta",
        f"case when {claude} then {claude_fields(doc)} when {codex} then {codex_fields(doc)} end as _use",
        f"if({claude}, {claude_model(doc)}, null) as _model",
        f"if({claude}, {claude_response(doc)}, null) as _response",
        f"{J.text(J.node(doc, 'timestamp'))} as _ts",
    )
    numbers = ", ".join(f"'{t}', if({claude}, {_claude_number(t)}, {_codex_number(t)})" for t in TOKENS)
    counted = found.withColumn("_t", F.expr(f"if(_use is null or meta is not null, null, named_struct({numbers}))"))
    billed = " or ".join(f"_t.{c} <> 0" for c in BILLED)
    # A codex record counts cached tokens in its input.
    net = f"if({codex}, greatest(0L, _t.input - _t.cache_read - _t.cache_create), _t.input)"
    usage = (
        "named_struct('ts_text', _ts, 'is_cumulative', _use.is_cumulative, 'model', _model, 'message_id', _response, "
        f"'input', {net}, " + ", ".join(f"'{c}', _t.{c}" for c in TOKENS[1:]) + ")"
    )
    real = f"_t is not null and ({codex} or (_model <> '{LOCAL_MODEL}' and ({billed})))"
    return counted.selectExpr(*kept, "unparsed", "meta", f"if({real}, {usage}, null) as usage")


def usage_rows(read: DataFrame, metas: DataFrame | None = None) -> DataFrame:
    """One row per usage record; codex rows take the model of the file's last meta line (of `metas`, where it is
    known already), rows without timestamp the file time."""
    keep = read.drop("meta", "unparsed")
    rows = (
        present(keep, F.col("usage"))
        .drop("usage")
        .withColumn("ts", F.coalesce(F.try_to_timestamp("ts_text"), F.col("mtime")))
        .drop("ts_text")
    )
    metas = session_metas(read) if metas is None else metas
    metas = metas.select("source_file", F.col("model").alias("_meta_model"))
    named = F.when(
        F.col("agent") == CODEX, F.coalesce("_meta_model", F.lit(DEFAULT_CODEX_MODEL))
    ).otherwise(F.col("model"))
    return rows.join(metas, "source_file", "left").withColumn("model", named).drop("_meta_model")


def session_metas(read: DataFrame) -> DataFrame:
    """The last meta line of each file."""
    metas = present(read.select("source_file", "byte_offset", "meta"), F.col("meta")).drop("meta")
    return last_by(metas, ["source_file"], ["byte_offset"]).drop("byte_offset")


def file_quality(read: DataFrame) -> DataFrame:
    return read.groupBy("source_file").agg(
        F.count_if("unparsed").alias("unparsed_lines"), F.max("next_offset").alias("next_offset")
    )


def to_deltas(
    usage: DataFrame,
    keys: tuple[str, ...] = ("agent", "session_uuid"),
    order: tuple[str, ...] = ("byte_offset",),
    chunks: int | None = None,
) -> DataFrame:
    """Running totals become per-turn usage: the difference to the last running total, never below 0.
    Rows that are already per turn pass through; rows with nothing left are dropped."""
    ordered = OrderedRows(usage, list(keys), list(order), chunks, "deltas")
    snapshot = F.when(F.col("is_cumulative"), F.struct(*TOKENS))
    rows = ordered.carry(_last=latest(snapshot))
    deltas = {
        t: F.when(
            F.col("is_cumulative"),
            F.greatest(F.lit(0), zero_if_null(t) - zero_if_null(f"_last.{t}")),
        )
        .otherwise(zero_if_null(t))
        .cast("bigint")
        for t in TOKENS
    }
    return rows.withColumns(deltas).where(any_tokens()).select(*usage.columns)
