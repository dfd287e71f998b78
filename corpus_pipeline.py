"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. Toxic documents go; of equal texts the
largest id stays, of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest; bytes of
strings of 200 bytes that also start elsewhere are taken out of the texts; what is left is packed into
sequences of 4096 tokens, a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagframe.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from tagframe.llm.space import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, percent=80)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs, length=200)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack),
]

#: SQL has no words for stages 1 and 3 to 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
