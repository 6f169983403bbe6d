"""Exact dedup with skew-safe combining: local groups, salted digest groups, then the winners of all salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import SPACES, Tables, whole_text

SALTS = 16
# A rank holds the code points above and the negated id below, so that one maximum finds the winner and the
# aggregation stays a hash aggregation (a struct would turn it into a sort).
_ID_ROOM = "100000000000000000000"
_LARGEST_ID = "9223372036854775808"


def _rank(chars: Column, doc_id: Column) -> Column:
    below = F.coalesce(F.lit(_LARGEST_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0))
    return (chars.cast("decimal(11,0)") * F.lit(_ID_ROOM).cast("decimal(21,0)") + below).cast("decimal(38,0)")


def _rank_id(rank: Column) -> Column:
    below = (rank % F.lit(_ID_ROOM).cast("decimal(21,0)")).cast("decimal(20,0)")
    return F.when(below > 0, (F.lit(_LARGEST_ID).cast("decimal(20,0)") - below).cast("long"))


def _contents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("whole"))
    rows = rows.select(
        "doc_id", F.length("whole").alias("chars"), F.regexp_replace("whole", SPACES, "").alias("content")
    )
    return rows.withColumn("text_sha256", F.sha2("content", 256))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (space, tab to carriage return) is deleted; null counts as
    empty, and empty texts form a group like any other. The row with most code points in its original text stays,
    then the smallest doc_id; null ids come last. Of rows that agree in doc_id and text one stays. An empty table
    gives no rows; other columns of `docs` are not read.

    Groups are made of whole contents, never of digests alone: rows fold in their partition and in salted digest
    groups, and the winners of the salts are combined. A hot group thus reaches the last step as a row per salt.
    Rows find their group by digest where the digest has one content, which the groups prove, else by content.
    """
    rows = _contents(docs, text, doc_id)
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("text_sha256", "salt", "content")
        .agg(F.max(_rank(F.col("chars"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("members"))
    )
    groups = salted.groupBy("text_sha256", "content").agg(
        F.max("best").alias("best"), F.sum("members").alias("group_size")
    )
    tables = Tables(docs.sparkSession, "exact")
    by_digest = groups.groupBy("text_sha256").agg(
        F.max("best").alias("best"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    by_digest = tables.write(by_digest, "digests")
    # Read several times below: white space is deleted and digests are made once more, not each time.
    narrow = tables.write(rows.select("doc_id", "chars", "text_sha256"), "narrow")
    found = narrow.join(by_digest.filter("contents = 1").drop("contents"), "text_sha256")
    shared = by_digest.filter("contents > 1").select("text_sha256")
    if not shared.isEmpty():
        again = rows.join(shared, "text_sha256").join(groups, ["text_sha256", "content"])
        found = found.unionByName(again.select(*found.columns))
    best = _rank(F.col("chars"), F.col("doc_id"))
    found = found.select(
        "doc_id", "group_size", "text_sha256", _rank_id(F.col("best")).alias("keep_id"), (best == F.col("best")).alias("wins")
    )
    # Rows that agree in id and length are the same row repeated: the first of them stays.
    winners = found.filter("wins").groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies"))
    first = winners.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    result = first.withColumn("kept", F.col("copy") == 1).drop("copy", "copies")
    result = result.unionByName(found.filter("not wins").withColumn("kept", F.lit(False)))
    return result.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_unique(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns; of a row repeated as a whole, one."""
    kept = exact_groups(docs, text, doc_id, salts).filter("kept")
    key, chars, place = "__exact_key", "__exact_chars", "__exact_place"
    kept = kept.select(_key(F.col("doc_id"), F.col("text_sha256")).alias(key))
    digest = F.sha2(F.regexp_replace(whole_text(text), SPACES, ""), 256)
    rows = docs.withColumn(key, _key(F.col(doc_id), digest)).withColumn(chars, F.length(whole_text(text)))
    # An id may repeat with other spacing: the longest of its rows is the winner.
    order = Window.partitionBy(key).orderBy(F.desc(chars))
    rows = rows.join(kept, key, "left_semi").withColumn(place, F.row_number().over(order))
    return rows.filter(F.col(place) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def _key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), digest)
