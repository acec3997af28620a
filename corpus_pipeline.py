"""The corpus pipeline: five training-data operators, one after another, over whole documents.

Every stage takes (spark, docs, sf_dir) and all that the stage before kept.
All but the last return the columns of documents.

1. quality_rules: documents that break a rule of the threshold table go.
2. jaccard_join: of documents linked by five-word shingles at 0.8 or more, the smallest id stays.
3. suffix_dedup: bytes covered by a string of REPEAT_BYTES, or by a run of REPEAT_WORDS words, that
   starts anywhere else go; a document without a word left goes with them.
4. decontamination: documents that hold a window of the benchmark go.
5. packing: pieces of at most 2048 tokens, placed in sequences.

Defined results: null and empty texts fail the rules and go first; texts of any length are taken whole; of equal documents
the row with the smallest id stays (a row without id only if no linked row has one; of equal ids any one row); different
texts under one id, or without id, stay each for itself, and after packing such rows are told apart by their sequence only;
columns beside the documents' own are carried to the last stage; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontam, packing, quality_rules, suffix_repeats, tgm_join
from loomstone.llm.store import fresh_folder

#: Few passages of over fifty words have fewer bytes than this; those are found by their words.
REPEAT_BYTES = 250
REPEAT_WORDS = 51
REPEAT_GRAM = 64


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tgm_join.keep_one(docs, size=5, numerator=80, denominator=100)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_repeats.remove(docs, REPEAT_BYTES, REPEAT_GRAM, REPEAT_WORDS).where(F.col("text").rlike(quality_rules.WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def benchmark_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontamination", benchmark_windows),
    ("packing", sequences),
]

#: Tokens and placements by sum of squares have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
