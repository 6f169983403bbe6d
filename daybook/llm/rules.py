"""Quality rules with thresholds taken from the data: mergeable quantile sketches per language and source.

A sketch counts integers in buckets of 7 leading bits, so a quantile is known to within 1/64 of its value. Counts add
up, so sketches merge exactly, in any order and at any level; a rerun gives the same thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables, whole_text
from daybook.session import small_side

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
LEAST_WORDS = 50
# A group with fewer judged documents takes its language's fences, then those of all documents: ten documents lie beyond each
# quartile of a group of this size.
LEAST_DOCUMENTS = 40
# Measures are whole numbers: parts of 10,000, or hundredths of a character for the word length. A fence stands three
# times the distance of the quartiles outside of them.
_REACH = 3
MEASURES = ("symbols", "upper", "dup_lines", "repeats", "word_length")
_BOTH_SIDES = ("word_length",)
# Most documents repeat nothing, so that their quartiles are 0: these have the quartiles of the documents that do.
_OF_NONZERO = ("dup_lines", "repeats")
# Where most documents of a group have no symbol or the same share of capitals, the quartiles are equal. Such a fence stands one
# occurrence away, as a part of the shortest judged document of the group, which its sketch of sizes tells.
_PER_LETTER = ("symbols", "upper")
SIZE = "size"
_SUBBUCKET_BITS = 7

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, distinct: int, width: int = 3) -> int:
    """Words within windows of `width` words that occur twice or more; ids number the words from 0."""
    if len(ids) <= width:
        return 0
    windows = ids[: len(ids) - width + 1]
    room = distinct
    for k in range(1, width):
        if room > (1 << 62) // max(distinct, 1):
            _, windows = np.unique(windows, return_inverse=True)
            room = len(windows)
        windows = windows * distinct + ids[k : len(ids) - width + 1 + k]
        room *= distinct
    _, place, seen = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(seen[place] > 1)
    covered = np.zeros(len(ids) + 1, np.int32)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def counts_of(raw: bytes) -> tuple[int, ...]:
    """The values of _COUNTS of one text in UTF-8."""
    words = raw.split()
    letters = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    return (
        len(words),
        len(letters.decode("utf-8", "replace")),
        len(letters) - len(letters.translate(None, SYMBOLS)),
        len(letters) - len(letters.translate(None, _UPPER)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            rows = [counts_of(raw) for raw in part.column("raw").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            kept = [part.column(n) for n in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", "lang", "source", *_COUNTS])


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang, source and the counts of each text. Null texts are empty."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        whole_text(text).cast("binary").alias("raw"),
    )
    schema = rows.drop("raw").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    return rows.mapInArrow(_counted, schema)


def _measures() -> dict[str, Column]:
    def part(n: str, of: str, scale: int = 10_000) -> Column:
        return F.expr(f"CASE WHEN {of} > 0 THEN ({n} * {scale}) DIV {of} ELSE 0 END")

    return {
        "symbols": part("n_symbols", "word_chars"),
        "upper": part("n_upper", "word_chars"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "word_length": part("word_chars", "n_words", 100),
        SIZE: F.col("word_chars"),
    }


def sketches(rows: DataFrame, by: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """by..., measure, bucket, n: how many rows of a group have a measure in a bucket, named by its least value."""
    pairs = F.array(*(F.struct(F.lit(name).alias("measure"), m.alias("x")) for name, m in measures.items()))
    rows = rows.select(*by, F.inline(pairs))
    low = F.expr(f"length(bin(x)) - {_SUBBUCKET_BITS}")
    bucket = F.when(low > 0, F.expr(f"shiftleft(shiftright(x, length(bin(x)) - {_SUBBUCKET_BITS}), length(bin(x)) - {_SUBBUCKET_BITS})"))
    return rows.groupBy(*by, "measure", F.coalesce(bucket, "x").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., measure, documents, hi, lo: the highest and the lowest value allowed, from so many documents. Of a measure that
    no document has, nothing is allowed."""
    counts = F.when((F.col("bucket") > 0) | ~F.col("measure").isin(*_OF_NONZERO), F.col("n"))
    group = Window.partitionBy(*by, "measure")
    rows = sketch.withColumns({"upto": F.sum(counts).over(group.orderBy("bucket")), "total": F.sum(counts).over(group)})
    quartile = {k: F.coalesce(F.min(F.when(counts.isNotNull() & (F.col("upto") * 4 >= F.col("total") * k), F.col("bucket"))), F.lit(0)) for k in (1, 3)}
    rows = rows.groupBy(*by, "measure").agg(quartile[1].alias("q1"), quartile[3].alias("q3"), F.sum("n").alias("documents"), F.min("bucket").alias("least"))
    smallest = F.max(F.when(F.col("measure") == SIZE, F.col("least"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("smallest", smallest).filter(F.col("measure") != SIZE)
    # A bucket is named by its least value; the quartile may be its greatest. Quartiles in one bucket are up to its width apart.
    width = F.expr(f"shiftleft(1L, greatest(length(bin(q3)) - {_SUBBUCKET_BITS}, 0))")
    once = F.when(F.col("measure").isin(*_PER_LETTER) & (F.col("smallest") > 0), F.expr("10000 DIV smallest")).otherwise(0)
    reach = F.greatest(_REACH * F.greatest(F.col("q3") - F.col("q1"), width), once)
    hi = F.col("q3") + width - 1 + reach
    return rows.select(*by, "measure", "documents", hi.alias("hi"), (F.col("q1") - reach).alias("lo"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, level, hi_<measure> and for some lo_<measure> for each group of the sketch: from the smallest level with enough
    documents. Levels: 0 the group's own sketch, 1 its language's, 2 that of all documents."""
    groups = sketch.filter(F.col("measure") != SIZE).select("lang", "source", "measure").distinct()
    for n, by in enumerate((["lang", "source"], ["lang"], [])):
        level = fences(merged(sketch, by), by)
        level = level.select(*(F.col(b).alias(f"_{b}") for b in [*by, "measure"]), *(F.col(c).alias(f"{c}{n}") for c in ("documents", "hi", "lo")))
        same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"_{b}")) for b in [*by, "measure"]))
        groups = groups.join(level, same, "left").drop("_lang", "_source", "_measure")

    def chosen(of: Callable[[int], Column]) -> Column:
        pick = of(2)
        for n in (1, 0):
            pick = F.when(F.col(f"documents{n}") >= LEAST_DOCUMENTS, of(n)).otherwise(pick)
        return pick

    def one(side: str, name: str) -> Column:
        return F.max(F.when(F.col("measure") == name, chosen(lambda n: F.col(f"{side}{n}")))).alias(f"{side}_{name}")

    level = F.max(chosen(F.lit)).alias("level")
    return groups.groupBy("lang", "source").agg(level, *(one("hi", m) for m in MEASURES), *(one("lo", m) for m in _BOTH_SIDES))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    A document fails the base rules with fewer than 50 words or with more than half of its words in repeated windows of
    three. The others are sketched per language and source (null is a value of its own) and kept if each measure is
    within its group's fences; small groups take the fences of their language, then of all. The fences come from the
    sketches of the group: the quartiles of all its documents, or for repeated lines and words of those that have any, and its smallest
    document. Null and empty texts have no words and fail. Repeated rows count as often as they stand. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "rules")
    rows = tables.write(measured(docs, text, lang, source, doc_id), "counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    measures = _measures()
    sketch = tables.write(sketches(rows.filter(~F.col("base_failed")), ["lang", "source"], measures), "sketch", few=True)
    limits = tables.write(thresholds(sketch), "fences", few=True).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(small_side(limits), same, "left")
    inside = [measures[name] <= F.col(f"hi_{name}") for name in MEASURES]
    inside += [measures[name] >= F.col(f"lo_{name}") for name in _BOTH_SIDES]
    kept = ~F.col("base_failed") & F.coalesce(reduce(Column.__and__, inside), F.lit(False))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
