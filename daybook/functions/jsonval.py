"""JSON values with their JSON types: a number is only a number, a string only a string.

These are SQL texts, to be put together and turned into one column with F.expr.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_NUMERIC = "rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"


def accept_repeated_keys(spark: SparkSession) -> None:
    """Let the last of repeated keys win, as JSON readers commonly do."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def listed(line: str) -> str:
    """The line as a JSON list, so that text after a value (two records run together) is an error."""
    return f"concat('[', {line}, ']')"


def parsed(line: str) -> str:
    """The line's values as a variant list, NULL if the line is not JSON."""
    return f"try_parse_json({listed(line)})"


def single(values: str) -> str:
    """The one value of a parsed line, NULL if it has none or several."""
    second = f"try_variant_get({values}, '$[1]', 'variant')"
    return f"if({second} is null, try_variant_get({values}, '$[0]', 'variant'), null)"


def node(doc: str, path: str) -> str:
    return f"try_variant_get({doc}, '$.{path}', 'variant')"


def given(value: str) -> str:
    """Present and not null."""
    return f"({value} is not null and not is_variant_null({value}))"


def fields(doc: str, path: str) -> str:
    """The fields of the object at path as a map, NULL if there is no object."""
    return f"try_variant_get({doc}, '$.{path}', 'map<string,variant>')"


def has_any(fields_: str, names: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"coalesce(arrays_overlap(map_keys({fields_}), array({listed})), false)"


def text(value: str) -> str:
    """The string, NULL for any other type."""
    return f"if(schema_of_variant({value}) = 'STRING', try_variant_get({value}, '$', 'string'), null)"


def number(value: str) -> str:
    """The finite number as BIGINT, 0 for anything else."""
    plain = f"try_cast(try_variant_get({value}, '$', 'double') as bigint)"
    return f"coalesce(if(schema_of_variant({value}) {_NUMERIC}, {plain}, null), 0L)"


def truthy(value: str) -> str:
    kind, plain = f"schema_of_variant({value})", f"try_variant_get({value}, '$', 'string')"
    return (
        f"coalesce(case when {kind} = 'STRING' then {plain} <> '' when {kind} = 'BOOLEAN' then {plain} = 'true' "
        f"when {kind} {_NUMERIC} then try_cast({plain} as double) <> 0 when {kind} = 'VOID' then false "
        f"else {value} is not null end, false)"
    )
