"""Hard negatives from blocks of vectors along a Hilbert curve.

Candidates are sorted along a Hilbert curve and cut into blocks of BLOCK rows, one Parquet row each. A block's zone map holds
the least and the greatest value of every dimension, from which interval arithmetic bounds the score of an anchor
with any row of the block. A block is read for an anchor only if these bounds meet what the anchor looks for: first the
block with the highest bound that has its label, which gives a score to beat, then the blocks that may hold a better positive,
then those whose scores may fall into the windows that the positives open. Anchors go in groups along the same curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.places import placed
from daybook.llm.text import Tables

BLOCK = 1024
ANCHORS = 256
ZONES = 256
POSITIVES = 5
NEGATIVES = 3
SCALE = 256
# Per cent of the positive's score.
LOW, HIGH = 50, 95
# The curve runs through this many dimensions, those that vary most, with so many bits each: together 60 bits of a key.
CURVE_DIMENSIONS, CURVE_BITS = 20, 3
# Scores, and a hundred times their value, are exact in doubles while no sum of absolute products reaches this.
_EXACT = float(1 << 46)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of `cells` (one column per dimension, values below 2**bits).

    The curve's rule, from the highest bit down: where a dimension's bit is set, the lower bits of the first dimension are
    mirrored, else those that differ between the two dimensions are exchanged; the result is then read as a Gray code.
    """
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        lower = np.uint64((1 << bit) - 1)
        for d in range(n):
            is_set = (x[d] >> np.uint64(bit)) & one == one
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[d]) & lower)
            x[0] ^= np.where(is_set, lower, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(bit)) & one == one, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << one) | ((x[d] >> np.uint64(bit)) & one)
    return key


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, x (components as doubles, scaled and floored) of the rows that take part."""
    parts = F.col(f"`{vector}`").cast("array<double>")
    # From 2**44 on, 256 times a double is whole, and floor() would not fit a long before long.
    x = F.transform(parts, lambda v: F.when(F.abs(v) < F.lit(2.0**44), F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    fine = F.forall(parts, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v * SCALE) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), x.alias("x"), fine.alias("fine"))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND fine").drop("fine")


def _curve(rows: DataFrame) -> tuple[list[int], list[float], list[float], int]:
    """The dimensions that vary most, their means and deviations over all rows, and the number of dimensions."""
    each = rows.select(F.posexplode("x").alias("d", "v"))
    found = each.groupBy("d").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("deviation"))
    widest = found.orderBy(F.desc("deviation"), "d").limit(CURVE_DIMENSIONS).collect()
    dims = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    return [r["d"] for r in widest], [r["mean"] for r in widest], [r["deviation"] for r in widest], max(dims, 1)


def _matrix(lists: list, dims: int) -> np.ndarray:
    """Vectors as rows of one matrix; a shorter vector ends in zeros."""
    out = np.zeros((len(lists), dims))
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def _keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `key`, their place on the curve, and the number of dimensions."""
    chosen, means, deviations, dims = _curve(rows)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x").to_pylist(), dims)[:, chosen]
            spread = np.where(np.array(deviations) > 0, deviations, 1)
            # Cells of equal width, the outer ones open, within two deviations of the mean.
            cells = np.clip(np.floor(((x - means) / spread + 2) / 4 * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1)
            keys = hilbert_keys(cells, CURVE_BITS) if chosen else np.zeros(len(x), np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.astype(np.int64))], names=[*batch.schema.names, "key"])

    return rows.mapInArrow(along, "vec_id long, label long, x array<double>, key long"), dims


_BLOCK = "block long, ids array<long>, labels array<long>, x binary, low array<double>, high array<double>, has array<long>"


def _packed(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """One row per `size` consecutive rows: block, ids, labels, x (a matrix of doubles), its zone map and distinct labels."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        x = _matrix(table.column("x").to_pylist(), dims)
        labels = table.column("label").to_numpy()
        columns = [
            pa.array([table.column("block")[0].as_py()], pa.int64()),
            pa.array([table.column("vec_id").to_numpy()], pa.list_(pa.int64())),
            pa.array([labels], pa.list_(pa.int64())),
            pa.array([x.tobytes()], pa.binary()),
            pa.array([x.min(0)], pa.list_(pa.float64())),
            pa.array([x.max(0)], pa.list_(pa.float64())),
            pa.array([np.unique(labels)], pa.list_(pa.int64())),
        ]
        return pa.table(columns, names=[part.split()[0] for part in _BLOCK.split(", ")])

    return rows.withColumn("block", F.floor(F.col("place") / size)).groupBy("block").applyInArrow(pack, _BLOCK)


def interval_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that an anchor (row) can have with a vector inside a zone (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        # Sums of doubles may be off by this much where they are not exact; sums that overflow bound nothing.
        slack = (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12
        least, most = least - slack, most + slack
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, of integers: doubles where these are exact, else Python integers."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return a @ b.T
    whole = [np.array([int(v) for v in m.ravel()], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def _floats(packed: list, dims: int) -> np.ndarray:
    return np.array(packed, np.float64).reshape(len(packed), dims)


def _chosen(anchors: DataFrame, zones: DataFrame, dims: int, choose, schema: str) -> DataFrame:
    """Every group of anchors meets the zone maps, ZONES at a time: what choose(row, block numbers, labels, least, most)
    yields. Zone maps hold 16 bytes per dimension for BLOCK rows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.float64).reshape(-1, dims)
                zone = row.pop("zones")
                least, most = interval_bounds(x, _floats([z["low"] for z in zone], dims), _floats([z["high"] for z in zone], dims))
                numbers = [z["block"] for z in zone]
                yield pa.RecordBatch.from_pylist(list(choose(row, numbers, [z["has"] for z in zone], least, most)), _arrow(schema))

    return anchors.join(zones, "part").mapInArrow(meet, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    parts = [part.split(" ") for part in schema.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in parts])


_WANTED = "anchors long, block long, who binary"


def _wanted(row: dict, numbers: list[int], wants: np.ndarray) -> Iterator[dict]:
    """A row per block that an anchor of the group wants to read, with marks of those that do."""
    for k in np.flatnonzero(wants.any(0)):
        yield {"anchors": row["anchors"], "block": numbers[k], "who": wants[:, k].tobytes()}


_FLIPPED = str.maketrans("0123456789", "9876543210")


def _text(score) -> str:
    """A score of any size as a text that sorts as scores do: sign, number of digits, digits."""
    digits = str(abs(int(score)))
    text = f"{len(digits):05d}{digits}"
    return "+" + text if score >= 0 else " " + text.translate(_FLIPPED)


def _whole(text: str) -> int:
    return int(text[6:]) if text[0] == "+" else -int(text[6:].translate(_FLIPPED))


def _number(text: str, kind: str) -> Column:
    """The score of such a text; null where it does not fit."""
    flipped = f"concat('-', translate(substr({text}, 7), '0123456789', '9876543210'))"
    return F.expr(f"try_cast(if({text} LIKE '+%', substr({text}, 7), {flipped}) AS {kind})")


def _read(wanted: DataFrame, blocks: DataFrame, anchors: DataFrame, dims: int, find, schema: str) -> DataFrame:
    """The rows that find(scores, row, k) yields for each anchor k and each block it wants."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                who = np.flatnonzero(np.frombuffer(row["who"], bool))
                x = np.frombuffer(row["x"], np.float64).reshape(-1, dims)[who]
                scores = exact_scores(x, np.frombuffer(row["xs"], np.float64).reshape(-1, dims))
                row |= {c: np.array(row[c], np.int64) for c in ("ids", "labels")}
                found = [r for k, s in zip(who, scores, strict=True) for r in find(s, row, k)]
                yield pa.RecordBatch.from_pylist(found, _arrow(schema))

    rows = wanted.join(blocks.select("block", "ids", "labels", F.col("x").alias("xs")), "block")
    return rows.join(anchors, "anchors").mapInArrow(search, schema)


def _best(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, most: int) -> list[int]:
    """The first `most` of those that fit, by descending score, then id."""
    at = np.flatnonzero(fits)
    if len(at) > most and scores.dtype != object:
        at = at[scores[at] >= np.partition(scores[at], len(at) - most)[len(at) - most]]
    return sorted(at, key=lambda i: (-scores[i], ids[i]))[:most]


_FOUND = "anchor_id long, copy long, other_id long, score string"
_WINDOW = "anchor_id long, copy long, place int, positive_id long, positive string, negative_id long, score string"


def _ranked(found: DataFrame, by: list[str], ids: str, most: int) -> DataFrame:
    """The first rows of each window. A task keeps `most` per window and row of a block, so these groups hold as many as
    blocks were read for the anchor; Spark keeps `most` per task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), ids)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id or label, a null vector or a component that is null or not finite take no part. A component x becomes
    floor(256 * x); a score is the inner product. `is_anchor` is an expression over vec_id and label. An anchor's positives are
    the first POSITIVES other rows of its label, by descending score, then vec_id; for each, the first NEGATIVES rows of
    other labels are returned whose score lies between LOW and HIGH per cent of the positive's score, both included.

    A shorter vector counts as ended with zeros. Rows that share an id are rows of their own, and are not positives of each
    other; an anchor id on several rows gives the results of each. Scores are exact; one beyond a long is returned
    as null. An empty table, or one without anchors, gives no rows. Other columns are not read.
    """
    tables = Tables(vectors.sparkSession, "hardneg")
    rows, dims = _keyed(tables.write(usable(vectors, vec_id, vector, label), "usable"))
    rows = tables.write(rows, "keyed")
    along = placed(rows, [], [F.col("key"), F.col("vec_id"), F.col("label"), F.col("x")], tables, "curve")
    blocks = tables.write(_packed(along, block, dims), "blocks")
    zones = blocks.select(F.floor(F.col("block") / ZONES).alias("part"), F.struct("block", "low", "high", "has").alias("zone"))
    zones = tables.write(zones.groupBy("part").agg(F.collect_list("zone").alias("zones")), "zones")
    parts = zones.agg(F.coalesce(F.max("part"), F.lit(-1))).first()[0]

    anchors = placed(tables.write(rows.filter(is_anchor), "anchor-rows"), [], [F.col("key"), F.col("vec_id"), F.col("label"), F.col("x")], tables, "anchor-curve")
    anchors = _packed(anchors, ANCHORS, dims).select(F.col("block").alias("anchors"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), "x")
    anchors = tables.write(anchors, "anchors")
    # A stated set of anchors meets all zone maps, a group and a part at a time.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 0)).cast("long")))

    def holds(row: dict, has: list[list[int]], name: str = "anchor_labels") -> np.ndarray:
        own = np.array(row[name], np.int64)
        return np.array([np.isin(own, labels) for labels in has]).T

    def nearest(row: dict, numbers: list[int], has: list[list[int]], least: np.ndarray, most: np.ndarray) -> Iterator[dict]:
        # Per part the block that may hold the best positive.
        bound = np.where(holds(row, has), most, -np.inf)
        first = np.zeros(bound.shape, bool)
        first[np.arange(len(bound)), bound.argmax(1)] = bound.max(1) > -np.inf
        yield from _wanted(row, numbers, first)

    def positives(scores: np.ndarray, row: dict, k: int) -> Iterator[dict]:
        anchor = row["anchor_ids"][k]
        fits = (row["labels"] == row["anchor_labels"][k]) & (row["ids"] != anchor)
        for i in _best(scores, row["ids"], fits, POSITIVES):
            yield {"anchor_id": anchor, "copy": row["anchors"] * ANCHORS + int(k), "other_id": int(row["ids"][i]), "score": _text(scores[i])}

    first = tables.write(_chosen(anchors.withColumn("part", every), zones, dims, nearest, _WANTED), "first")
    probed = tables.write(_read(first, blocks, anchors, dims, positives, _FOUND), "probed")
    # The score to beat: that of the last positive, if there are enough.
    beaten = _ranked(probed, ["copy"], "other_id", POSITIVES).groupBy("copy").agg(F.count(F.lit(1)).alias("n"), _number("min(score)", "double").alias("least"))
    at = F.floor(F.col("copy") / ANCHORS).alias("anchors")
    beaten = beaten.filter(F.col("n") >= POSITIVES).groupBy(at).agg(F.map_from_entries(F.collect_list(F.struct("copy", "least"))).alias("beaten"))
    asking = anchors.join(beaten, "anchors", "left").withColumn("part", every)

    def better(row: dict, numbers: list[int], has: list[list[int]], least: np.ndarray, most: np.ndarray) -> Iterator[dict]:
        known = dict(row["beaten"] or [])
        floor = np.array([known.get(row["anchors"] * ANCHORS + k, -np.inf) for k in range(len(most))])
        yield from _wanted(row, numbers, holds(row, has) & (most >= floor[:, None]))

    wanted = tables.write(_chosen(asking, zones, dims, better, _WANTED), "better")
    found = _ranked(_read(wanted, blocks, anchors, dims, positives, _FOUND), ["copy"], "other_id", POSITIVES)
    found = tables.write(found.select("anchor_id", "copy", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive")), "positives")

    windows = found.groupBy(at).agg(F.collect_list(F.struct("copy", "place", "positive_id", "positive")).alias("windows"))
    opened = tables.write(anchors.join(windows, "anchors"), "windows")

    def inside(row: dict, numbers: list[int], has: list[list[int]], least: np.ndarray, most: np.ndarray) -> Iterator[dict]:
        wants = np.zeros(most.shape, bool)
        own = np.array(row["anchor_labels"], np.int64)
        other = np.array([[len(labels) > 1 or labels[0] != mine for labels in has] for mine in own.tolist()])
        for window in row["windows"]:
            k, positive = window["copy"] - row["anchors"] * ANCHORS, float(_whole(window["positive"]))
            wants[k] |= (100 * most[k] >= LOW * positive) & (100 * least[k] <= HIGH * positive)
        yield from _wanted(row, numbers, wants & other)

    def negatives(scores: np.ndarray, row: dict, k: int) -> Iterator[dict]:
        anchor, copy = row["anchor_ids"][k], row["anchors"] * ANCHORS + int(k)
        different = row["labels"] != row["anchor_labels"][k]
        for window in row["windows"]:
            if window["copy"] == copy:
                positive = _whole(window["positive"])
                fits = different & (100 * scores >= LOW * positive) & (100 * scores <= HIGH * positive)
                for i in _best(scores, row["ids"], fits.astype(bool), NEGATIVES):
                    same = {c: window[c] for c in ("place", "positive_id", "positive")}
                    yield {"anchor_id": anchor, "copy": copy, "negative_id": int(row["ids"][i]), "score": _text(scores[i])} | same

    wanted = tables.write(_chosen(opened.withColumn("part", every), zones, dims, inside, _WANTED), "inside")
    mined = _read(wanted, blocks, opened, dims, negatives, _WINDOW)
    mined = _ranked(mined, ["copy", "place"], "negative_id", NEGATIVES)
    return mined.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        _number("positive", "bigint").alias("positive_score"), _number("score", "bigint").alias("negative_score"),
    )
