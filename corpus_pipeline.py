"""Training-corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

In all stages null and empty texts are rows like others, rows that repeat count each, a table without rows gives a table without rows, and columns beside
doc_id and text are handed on as they are, but for n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm import bpe, common, decontam, linededup, neardup, quality

#: Words a shingle and per cent of similarity of the near-duplicate stage: those of op4_minhash_near_dedup. What is similar by five words is so by four.
SHINGLE_WORDS, SIMILAR_PERCENT = 4, 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one, so that none clashes with an operator's results."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_others"))


def _unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the present text."""
    return df.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c if c in ("doc_id", "text") else f"_others.`{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labelled documents outside the held-out fold. Null and empty texts are scored too;
    rows that repeat a document are accepted or not together; without labels all are accepted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _unpacked(quality.classify(_packed(docs), labels).where("predicted = 1"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go. A null text has no lines and stays; an empty one has an empty line and stays."""
    out = linededup.dedup_lines(_packed(docs))
    return _unpacked(out.where("n_removed = 0 OR n_removed < n_lines"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of smallest id; rows that repeat an id go or stay together, and stay where their texts differ. Null and empty texts, and null ids, are
    linked with nothing and stay."""
    common.release()  # what the classifier's training held in the driver
    classes = neardup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    differing = docs.groupBy(F.col("doc_id").alias("_gone")).agg(F.min(content).alias("_a"), F.max(content).alias("_b")).where("_a <> _b").select("_gone")
    gone = common.staged(classes.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct().join(differing, "_gone", "left_anti"), "gone")
    common.release()
    bitmap = common.staged(common.member_filter(gone, "_gone"), "bitmap")
    # an anti join would be moved below the bitmap, and all texts with it
    left = common.keep_members(docs, bitmap, "doc_id").join(gone, F.col("doc_id") == F.col("_gone"), "left").where("_gone IS NULL").drop("_gone")
    return left.unionByName(common.without_members(docs, bitmap, "doc_id")).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay, empty items are found nowhere."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of each document; null and empty texts have no tokens."""
    return bpe.encode(docs, bpe.public_vocabulary()).drop("decoded")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: SQL can't express the classifier, nor the tokenizer; tests/llm/test_pipeline.py holds the stages and run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
