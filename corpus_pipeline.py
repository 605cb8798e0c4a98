"""A training-corpus pipeline: each stage takes the documents that the one before it kept.

Documents without words (null, empty or blank texts) pass every stage and end with the tokens of what they hold, none
for null. Of rows equal in id and text one stays after near_dedup. Further columns, whatever their names, pass up to
the last stage. An empty table gives an empty result; without labels no document is rejected as toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldproof.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from fieldproof.llm.shared import stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of documents still here.

    A document without words has no features, so the classifier's bias alone decides: it stays.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; n_chars follows the text.

    A document of which nothing but blanks is left was a copy as a whole and goes. One that held only blanks or null
    before stays. Columns n_lines and n_deleted of the input stay as they are.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = line_dedup.dedup(docs.select("doc_id", "text", kept)).where("n_deleted = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; documents without words are in none and stay."""
    return near_dedup.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and blank texts hold none."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's output written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, groups and token ids are not SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None
