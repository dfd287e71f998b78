"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bands, clusters, exact_dedup, lm_score, matroska, near_dedup, order, packing, pieces, repair, suffix_dedup, toxicity, warc
from .space import table, written


def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=4096)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), percent=85)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.describe(written(matroska.mux(table(spark, sf_dir, "documents")), "media"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.training_order(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=toxicity.fold_of() != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold_of() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "hit_weight")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents")), keep_text=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), length=200)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op11_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.measure(table(spark, sf_dir, "documents"))


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2:")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_packages, op2_packing, op3_minhash, op4_matroska, op5_training_order, op6_toxicity, op7_exact_dedup, op8_pieces, op9_suffix_dedup, op10_lm_score, op11_compression_bands, op12_hamerly, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE, "op12_hamerly": clusters.ORACLE}
