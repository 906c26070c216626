"""Corpus cleaning in five stages, each one Spark job over what the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents;
the last one adds token ids. run() writes each stage as Parquet in the shared folder and reads it
again, so a lost executor costs one stage at most.

In every stage: an empty table stays empty; null and empty texts are never toxic, duplicates, leaks or
personal data, and encode to no ids; a null doc_id never makes a row go as a duplicate; rows that
repeat stay or go together (a repeated doc_id is one document to the second stage); ties go to the
smallest doc_id; texts are taken whole, however long; extra columns are carried along by all stages but
the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import byte_bpe, decontamination, minhash, pii, toxicity
from trackweave.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of an Arrow batch between Spark and Python: texts can be long, and a batch lies in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to BATCH_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the network learns from labelled documents outside the held-out third."""
    small_batches(spark)
    return toxicity.reject(docs, toxicity.trained(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by five-word shingles at 0.8."""
    small_batches(spark)
    return minhash.one_of_each(docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor the windows that make one by number or share, whoever else holds them; be it with other numbers, names or units."""
    small_batches(spark)
    return decontamination.clean(docs, written(decontamination.links(docs, table(spark, sf_dir, "benchmark")), "leaks"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with identifiers, plain or disguised, replaced by their kind."""
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and the text that these decode to."""
    small_batches(spark)
    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.withColumn("text", F.decode("decoded", "utf-8")).select(*COLUMNS, F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("personal data", mask_personal_data),
    ("token ids", encode_tokens),
]

#: SQL can't express the recurrent network; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
