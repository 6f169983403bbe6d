"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables, whole_text, word_count
from daybook.session import small_side

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20
# A draw orders the documents of a source by a seeded hash. Its first bits cut a source into this many bins, so that
# only the bin in which the draw ends is ordered row by row.
_DRAW_BITS = 60
_BIN_BITS = 12


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with `target`: `share` of all sizes dealt by weight, at most `epochs` times a
    source's size, the excess dealt again by weight until no source is above its cap.

    Sources take the weights in turn, ordered by code point, null last. The clamped sources are those with the least
    cap per weight, so running sums in that order give the level at which the others stand. This orders one row per
    source. Sources without words get 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn(
        "cap", F.col("source_size") * epochs
    )
    rows = rows.withColumn("reach", F.col("cap") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").isNull(), F.encode("source", "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("clamped"),
        F.sum("weight").over(after).alias("open_weight"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("wanted"),
    )
    rows = rows.withColumn("level", (F.col("wanted") - F.col("clamped")) / F.col("open_weight"))
    # The first source that the level does not lift above its cap; those before it are clamped.
    final = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.lit(float("inf"))))
    return rows.select(*sizes.columns, target.alias("target"))


def _draw_round(rows: DataFrame, tables: Tables) -> DataFrame:
    """rows(name, doc_id, size, draw, want, extra, ...) with more `extra`: of the rows that are not drawn and fit into
    what their source still wants, the first in the order of `draw` whose sizes add up to at most that."""
    drawn = rows.groupBy("name").agg(
        (F.first("want") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("open")
    )
    rows = rows.join(small_side(tables.write(drawn, "open", few=True)), "name").withColumn("bin", F.shiftright("draw", _DRAW_BITS - _BIN_BITS))
    fits = ~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("open"))
    held = rows.filter(fits).groupBy("name", "bin").agg(F.sum("size").alias("held"), F.first("open").alias("room"))
    upto = F.sum("held").over(Window.partitionBy("name").orderBy("bin"))
    held = held.withColumn("upto", upto).filter("upto - held < room")
    held = held.select("name", "bin", "upto", (F.col("upto") - F.col("held")).alias("earlier"))
    rows = rows.join(small_side(tables.write(held, "bins", few=True)), ["name", "bin"], "left").withColumn("fits", fits & F.col("upto").isNotNull())
    in_last = F.col("fits") & (F.col("upto") > F.col("open"))
    order = Window.partitionBy("name", "bin").orderBy("draw", "doc_id", "size")
    last = rows.filter(in_last).withColumn("extra", F.col("earlier") + F.sum("size").over(order) <= F.col("open"))
    rest = rows.filter(~in_last).withColumn("extra", F.col("extra") | F.col("fits"))
    return rest.unionByName(last).drop("bin", "open", "upto", "earlier", "fits")


def _fitting(rows: DataFrame) -> DataFrame:
    """The rows that are not drawn and no larger than what their source still wants, which becomes their `want`."""
    taken = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    left = rows.groupBy("name").agg((F.first("want") - taken).alias("left")).filter("left > 0")
    rows = rows.filter("NOT extra AND size > 0").select("row", "name", "doc_id", "size", "draw", "extra")
    return rows.join(small_side(left), "name").filter("size <= left").withColumnRenamed("left", "want")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, key, size, source_size, target, copies, taken. The key stands for id
    and text.

    A document's size is its number of words; null texts have none and are taken 0 times. Each source repeats all
    documents floor(target / source_size) times; the rest of its target is drawn without replacement, in the order of
    a seeded hash of the id, as long as the sizes fit; further rounds fill what is left until no document fits.
    Documents are taken whole. Null sources are a source of their own. Repeated rows are documents of their own. An
    empty table gives no rows; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "mix")
    name = F.col(source).cast("string")
    # The joins below are on a name that is never null.
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.concat(F.when(name.isNull(), "0").otherwise("1"), F.coalesce(name, F.lit(""))).alias("name"),
        _key(doc_id, text).alias("key"),
        word_count(whole_text(text)).alias("size"),
        _draw(seed, F.col(doc_id)).alias("draw"),
    )
    sized = tables.write(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    known = F.when(F.col("name").startswith("1"), F.substring("name", 2, 1 << 30))
    sizes = sized.groupBy("name").agg(F.sum("size").alias("source_size")).withColumn("source", known)
    targets = water_fill(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    want = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("want", want)
    # Rows stay where they are unless there are very many sources: a source may hold a third of them.
    rows = sized.join(small_side(tables.write(targets, "sources", few=True)), "name").withColumn("extra", F.lit(False))
    rows = tables.write(_draw_round(rows, tables), "round0")
    tables.drop(sized)
    # Further rounds fill what is left from smaller documents; they carry only rows that still fit, of which the first always
    # does.
    rest, late, k = tables.write(_fitting(rows), "open0"), None, 0
    while not rest.isEmpty():
        k += 1
        drawn = tables.write(_draw_round(rest, tables), f"round{k}")
        now = drawn.filter("extra").select("row", F.lit(True).alias("late"))
        late = now if late is None else late.unionByName(now)
        rest = tables.write(_fitting(drawn), f"open{k}")
    if late is not None:
        rows = rows.join(small_side(late), "row", "left").withColumn("extra", F.col("extra") | F.coalesce("late", F.lit(False)))
    copies = F.col("whole") + F.col("extra").cast("int")
    return rows.select(
        "doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as `mix` takes it, with all their columns."""
    key, place, total, rows_of = "__mix_key", "__mix_place", "__mix_copies", "__mix_rows"
    taken = mix(docs, text=text, doc_id=doc_id, **settings)
    taken = taken.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows_of))
    rows = docs.withColumn(key, _key(doc_id, text)).join(taken.filter(F.col(total) > 0), key)
    # Rows with the same id and text share their copies out.
    order = Window.partitionBy(key).orderBy(key)
    rows = rows.withColumn(place, F.row_number().over(order))
    own = F.floor(F.col(total) / F.col(rows_of)) + (F.col(place) <= F.col(total) % F.col(rows_of)).cast("int")
    rows = rows.withColumn(total, own).filter(F.col(total) > 0)
    rows = rows.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(total).cast("int"))))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def _draw(seed: int, doc_id: Column) -> Column:
    """60 bits of a hash; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DRAW_BITS // 4), 16, 10).cast("long")


def _key(doc_id: str, text: str) -> Column:
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(whole_text(text)).cast("string"))
