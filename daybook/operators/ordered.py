"""Sequence operators for keys of any size.

A window over a key puts the whole key in one task. Here rows are range-partitioned by (keys, order),
so a key with a third of all rows spreads over a third of the chunks. Each value a row needs from
earlier rows is the value inside its chunk combined with a carry from earlier chunks of the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.session import stage

CHUNK = "_chunk"


@dataclass(frozen=True)
class Carry:
    kind: str
    value: Column


def previous(value: Column) -> Carry:
    """Value of the row just before, NULL for the first row of a key."""
    return Carry("previous", value)


def latest(value: Column) -> Carry:
    """Last non-NULL value of the rows before."""
    return Carry("latest", value)


def total(value: Column) -> Carry:
    """Sum over the rows before, 0 for the first row of a key."""
    return Carry("total", value)


def highest(value: Column) -> Carry:
    """Greatest value of the rows before."""
    return Carry("highest", value)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = None) -> DataFrame:
    """df with `place`, from 1 on within keys, by ascending order (total within keys, not NULL); with k the first k only,
    of which Spark keeps k per key and task before the shuffle."""
    if k is not None:
        ranked = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    names = [f"_by{n}" for n in range(len(order))]
    rows = OrderedRows(df.withColumns(dict(zip(names, order, strict=True))), keys, names, label="places")
    numbered = rows.carry(place=total(F.lit(1).cast("bigint")))
    return numbered.withColumn("place", (F.col("place") + 1).cast("int")).drop(CHUNK, *names)


class OrderedRows:
    """df laid out in (keys, order) sequence; order must be total within keys and not NULL."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        chunks: int | None = None,
        label: str = "ordered",
    ):
        self.keys, self.order = list(keys), list(order)
        by = [*self.keys, *self.order]
        spread = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
        # The chunk number is only stable once written, hence the staged table.
        self.rows = stage(spread.withColumn(CHUNK, F.spark_partition_id()), label)
        self._split: list | None = None

    def derived(self, rows: DataFrame, order: Sequence[str] | None = None) -> OrderedRows:
        """The same chunks over a staged table made from these rows (it keeps the chunk column)."""
        same = object.__new__(OrderedRows)
        same.keys, same.order, same.rows = self.keys, list(order or self.order), rows
        same._split = self._split
        return same

    def split_keys(self) -> DataFrame | None:
        """Keys present in more than one chunk, None if there are none. Such a key is the first or last
        key of each of its chunks, so there are fewer of them than chunks: a list the driver can hold,
        looked up once for all carries, and safe to broadcast."""
        if self._split is None:
            key = F.struct(*self.keys)
            ends = self.rows.groupBy(CHUNK).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
            chunks_of = ends.select(CHUNK, F.explode(F.array("lo", "hi")).alias("k")).distinct().groupBy("k")
            self._split = chunks_of.agg(F.count("*").alias("n")).where("n > 1").select("k.*").collect()
        if not self._split:
            return None
        schema = self.rows.select(*self.keys).schema
        return self.rows.sparkSession.createDataFrame(self._split, schema)

    def _per_chunk(self, carries: dict[str, Carry], split: DataFrame) -> DataFrame:
        at = F.struct(*self.order)
        summaries = []
        for name, c in carries.items():
            if c.kind == "previous":
                summary = F.max_by(F.struct(c.value.alias("v")), at)
            elif c.kind == "latest":
                summary = F.max_by(c.value, F.when(c.value.isNotNull(), at))
            elif c.kind == "total":
                summary = F.sum(c.value)
            else:
                summary = F.max(c.value)
            summaries.append(summary.alias(name))
        continued = self.rows.join(F.broadcast(split), self.keys, "left_semi")
        return continued.groupBy(*self.keys, CHUNK).agg(*summaries)

    def carry(self, rows: DataFrame | None = None, **carries: Carry) -> DataFrame:
        """rows (default: all) with one column per carry, computed from the rows before each row."""
        rows = self.rows if rows is None else rows
        inside = W.partitionBy(*self.keys, CHUNK).orderBy(*self.order)
        before = inside.rowsBetween(W.unboundedPreceding, -1)
        across = W.partitionBy(*self.keys).orderBy(CHUNK)
        earlier = across.rowsBetween(W.unboundedPreceding, -1)

        handed, local = [], {}
        for name, c in carries.items():
            if c.kind == "previous":
                handed.append(F.lag(name).over(across).alias(f"_in_{name}"))
                local[f"_own_{name}"] = F.lag(F.struct(c.value.alias("v"))).over(inside)
            elif c.kind == "latest":
                handed.append(F.last(name, True).over(earlier).alias(f"_in_{name}"))
                local[f"_own_{name}"] = F.last(c.value, True).over(before)
            elif c.kind == "total":
                handed.append(F.sum(name).over(earlier).alias(f"_in_{name}"))
                local[f"_own_{name}"] = F.sum(c.value).over(before)
            else:
                handed.append(F.max(name).over(earlier).alias(f"_in_{name}"))
                local[f"_own_{name}"] = F.max(c.value).over(before)

        out = rows.select("*", *[col.alias(n) for n, col in local.items()])
        split = self.split_keys()
        if split is not None:
            # At most one row per chunk: only its first key can continue from an earlier chunk.
            incoming = (
                self._per_chunk(carries, split)
                .select(*self.keys, CHUNK, F.row_number().over(across).alias("_nth"), *handed)
                .where("_nth > 1")
                .drop("_nth")
            )
            out = out.join(F.broadcast(incoming), [*self.keys, CHUNK], "left")
        results = {}
        for name, c in carries.items():
            own = F.col(f"_own_{name}")
            from_before = F.col(f"_in_{name}") if split is not None else own
            if c.kind == "previous":
                results[name] = F.coalesce(own, from_before)["v"]
            elif c.kind == "latest":
                results[name] = F.coalesce(own, from_before)
            elif c.kind == "total":
                both = F.coalesce(own, F.lit(0)) + F.coalesce(from_before, F.lit(0))
                results[name] = both if split is not None else F.coalesce(own, F.lit(0))
            else:
                results[name] = F.greatest(own, from_before)
        helpers = [f"_{side}_{n}" for n in carries for side in ("own", "in")]
        return out.withColumns(results).drop(*helpers)
