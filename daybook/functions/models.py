"""Model names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decorations removed from a model name before the price lookup, in this order.
PRICE_NAME_DECORATIONS = (r"\[[^\]]*\]$", r"^(us|eu|apac)\.", r"^anthropic\.", r"-v\d+(:\d+)?$", r"-\d{8}$")
# Decorations removed for display, in this order.
LABEL_DECORATIONS = (r"^(us|eu|apac)\.", r"^anthropic\.", r"-\d{8}$")


def _strip(name: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda col, p: F.regexp_replace(col, p, ""), patterns, name)


def price_name(model: Column) -> Column:
    return _strip(model, PRICE_NAME_DECORATIONS)


def model_label(model: Column) -> Column:
    """Short name; a name with slashes is a local model, known by its last part."""
    local = F.concat(F.lit("local · "), F.substring_index(model, "/", -1))
    return F.when(F.contains(model, F.lit("/")), local).otherwise(_strip(model, LABEL_DECORATIONS))
