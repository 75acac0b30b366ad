"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of
``documents``; the last returns the packed pieces. Every stage is written as Parquet in
the folder that the cluster shares and read again before the next.

Defined results: null texts count as empty; texts may be of any length; rows without an
id, and repeated ids, are judged by their own text, and rows that repeat id and text
stay or go together; extra columns are kept up to the last stage; an empty table gives
an empty result. Without labels no document is toxic, and without known languages every
document is of unknown language and goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talewarp.llm import decontam, langid, near, packing, toxicity
from talewarp.llm.common import fresh_folder, remove_folder
from talewarp.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear, go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return near.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: Trained classifiers and fingerprint graphs have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's folder goes when the next one is written; the last stays."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
