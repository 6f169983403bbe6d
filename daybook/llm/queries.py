"""The queries opN_<name>: each applies an operator of this package to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import chat, exact, hardneg, hmm, jaccard, lines, merkle, mixing, neardup, pieces, quality, rules, secrets
from daybook.llm.text import small_batches, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = secrets.secret_spans(docs)
    rows = docs.select("doc_id", secrets.text_key("doc_id", whole_text()).alias("key")).join(found, "key", "left")
    spans = F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType))
    rows = rows.select("doc_id", spans.alias("spans"))

    def joined(chosen: F.Column) -> F.Column:
        return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["place"] < len(secrets.BASE))
    return rows.select(
        "doc_id",
        *(counted(r.kind) for r in secrets.BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # A conversation whose texts look like the template.
    said = F.lit(f"{chat.END}{chat.START}assistant ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat.digests(chat.format_paths(chat.as_trees(rows.unionByName(own))))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicated(_documents(spark, sf_dir))
    return rows.withColumn("text_sha256", F.sha2("text", 256)).withColumn("n_chars", F.length("text").cast("long")).drop("text")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_scores(_documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model)


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_documents(spark, sf_dir)).drop("lang", "source")


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # A copy of the table in which some texts were tampered with.
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate(f, upper, upper.lower()) if f == "text" else F.col(f) for f in merkle.FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.manifest(docs, F.when(touched, merkle.leaf_digest(*changed)), proofs=False)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "place", "n_siblings")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_model": op4_language_model,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_near_copies": op7_near_copies,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing_sources": op10_mixing_sources,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
