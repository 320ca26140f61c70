"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes all documents that its predecessor kept and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents; the last adds ids, the tokens.

In every stage a null text counts as an empty one, nulls in other columns stay as they are, an empty table gives an empty one,
and columns beyond those of documents are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import bpe, decontam, minhash, quality, secrets
from tideglass.llm.common import bound_session, row_key, small_or_shuffled, stage

#: Some stage's models cannot be expressed in SQL; the pipeline is tested against a plain version of each stage.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Rows with a null doc_id are judged by their text and source alone; rows equal in
    doc_id, source and text share one decision, and a document at the threshold is kept."""
    bound_session(spark)
    keyed = docs.withColumn("__key", row_key("doc_id", "source", "text"))
    judged = quality.classify(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("__key",))
    gone = stage(judged.where("not accepted").select("__key").distinct(), "rejected")
    return keyed.join(small_or_shuffled(gone), "__key", "left_anti").select(docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id. Of rows of a group that share it one
    stays; rows without words or without a doc_id all stay."""
    bound_session(spark)
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Items without a word are contained in nothing; repeated rows are judged alike."""
    bound_session(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked; n_chars is counted anew where the text then holds a mask, also one that was there
    before. A null text stays null."""
    bound_session(spark)
    model = secrets.train(docs)
    masked = secrets.redact(docs, "text", model)
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, checked: the ids decode to the text's bytes again. A null or empty text has no ids;
    columns named ids or decoded, in either case, are replaced."""
    bound_session(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = bpe.encode_and_decode(docs, path, pattern)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return whole.withColumn("ids", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text")))).drop("decoded")


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("secrets", mask_secrets), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
