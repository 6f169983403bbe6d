"""The corpus pipeline: documents of low quality go, then copies, then near copies; sources are mixed to their target
weights, and the mix is encoded.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an empty table and extra columns of any name;
what each gives is stated below. All but the last return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import exact, mixing, neardup, pieces, quality
from daybook.llm.text import Tables, small_batches
from daybook.shipping import ship

# The classifier and the search for near copies are beyond SQL.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier learnt from labels.quality does not reject. Null and empty texts are judged like any other; rows
    that are repeated are judged each."""
    _ready(spark)
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with most characters, then the smallest id. Null and empty texts are equal
    to each other; of a row that is repeated as a whole one stays."""
    _ready(spark)
    return exact.exact_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one with the smallest id. Texts without words and rows
    without id are linked with nothing and stay; rows that share an id are one document."""
    _ready(spark)
    return neardup.without_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for; a document taken twice is two rows. Null is a source of its own;
    texts without words have no size and are not taken."""
    _ready(spark)
    return mixing.mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, round_trip and ids of every row; null and empty texts have no ids."""
    _ready(spark)
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written as Parquet and read again by the next."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        done = tables.write(stage(spark, docs, sf_dir), f"stage{n}")
        if n:
            tables.drop(docs)
        docs = done
    return docs
