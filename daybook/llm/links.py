"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import Tables


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component) for every node with a link to another one: the smallest node reachable.

    Each round hangs the neighbours of every node below the smallest of them, first the larger neighbours, then the
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of the number of nodes. Minima
    fold before the shuffle, so a node with many links is no group of its own in any task.
    """
    tables = Tables(links.sparkSession, "links")
    edges = tables.write(_downward(links), "0")
    state, rounds = _state(edges), 0
    while True:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = tables.write(_downward(larger), f"{rounds}-larger")
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smaller = tables.write(_downward(smaller.unionByName(least.withColumnRenamed("m", "b"))), f"{rounds}-smaller")
        tables.drop(edges)
        tables.drop(larger)
        edges, before, state = smaller, state, _state(smaller)
        if state == before:
            break
    lowest = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        lowest.select("node", F.col("node").alias("component"))
    )


def _downward(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return links.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
