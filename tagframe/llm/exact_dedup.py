"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass one hashes every text and counts, for each of ``hashes`` filter positions per row, whether two
rows or more set it. Pass two tests each row against the positions set more than once: a row that
misses one of them is alone and passes straight through; only the others are shuffled and grouped
by their full digest. False positives of the filter cost a little shuffling, never a wrong result.

Defined cases: a null text counts as empty; texts are equal only when identical. Of equal texts the
largest ``doc_id`` stays, null ids counting as the smallest. A row repeated with its id gives as many
result rows, of which one at most is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import space

#: Bits of a chunk of the filter: 1024 words of 64.
_CHUNK = 1 << 16


def digest(text: str = "text") -> Column:
    return F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)


def _slots(key: Column, bits: int, hashes: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def bloom_filter(keys: DataFrame, key: str, bits_per_row: int = 16, hashes: int = 3, max_bits: int = 1 << 28, least: int = 1) -> tuple[DataFrame, int]:
    """One row holding the filter of positions that ``least`` rows of ``keys`` or more set, and its size in bits.

    The size follows the row count up to ``max_bits`` (32 MB): beyond that the filter only gets fuller.
    """
    rows = keys.count()
    bits = _CHUNK
    while bits < min(max_bits, rows * bits_per_row):
        bits *= 2
    spark = keys.sparkSession
    several = keys.select(F.explode(F.array(*_slots(F.col(key), bits, hashes))).alias("slot")).groupBy("slot").count().where(F.col("count") >= least)
    words = several.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("w"))
    dense = spark.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("w", F.lit(0)).cast("long").alias("w"))
    chunk = dense.groupBy(F.shiftright("word", 10).alias("c")).agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("ws"))
    chunk = chunk.select("c", F.expr("transform(ws, x -> x.w)").alias("ws"))
    return chunk.agg(F.array_sort(F.collect_list(F.struct("c", "ws"))).alias("cs")).select(F.expr("transform(cs, x -> x.ws)").alias("bloom")), bits


def maybe_in(key: Column, bloom: Column, bits: int, hashes: int = 3) -> Column:
    """Whether all positions of a key are set in ``bloom``; false is certain."""
    out = F.lit(True)
    for slot in _slots(key, bits, hashes):
        word = F.get(F.get(bloom, F.shiftright(slot, 16).cast("int")), F.shiftright(slot, 6).bitwiseAND(F.lit(1023)).cast("int"))
        bit = F.call_function("shiftright", word, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
        out = out & (bit == 1)
    return out


def _filtered(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, hashes: int, max_bits: int):
    keys = space.written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("sha")), "digests")
    bloom, bits = bloom_filter(keys, "sha", bits_per_row, hashes, max_bits, least=2)
    bloom = space.written(bloom, "bloom")
    return keys, lambda key: maybe_in(key, bloom.scalar(), bits, hashes)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 3, max_bits: int = 1 << 28) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keys, test = _filtered(docs, id_col, text_col, bits_per_row, hashes, max_bits)
    tested = keys.withColumn("again", test(F.col("sha")))
    alone = tested.where(~F.col("again")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    # both written, so that a hot group's rows stand alone on one side of the join, which can then be split
    rows = space.written(tested.where("again").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n")), "again")
    groups = space.written(rows.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    shuffled = (
        rows.join(groups, "sha")
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    return alone.unionByName(shuffled)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 3, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that the filter clears keep their place. The others are joined with the chosen ones by digest and id together, so that
    the rows of a hot group are spread, and only its chosen row meets more than itself.
    """
    sha, again, chosen_sha, keep = space.free_names(docs, "sha", "again", "chosen_sha", "keep")
    keys, test = _filtered(docs, id_col, text_col, bits_per_row, hashes, max_bits)
    chosen = space.written(keys.where(test(F.col("sha"))).groupBy(F.col("sha").alias(chosen_sha)).agg(F.max("doc_id").alias(keep)), "chosen")
    tested = docs.withColumn(sha, digest(text_col)).withColumn(again, test(F.col(sha)))
    mine = tested.where(F.col(again)).join(chosen, (F.col(sha) == F.col(chosen_sha)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
    return tested.where(~F.col(again)).select(*docs.columns).unionByName(mine.dropDuplicates([sha]).select(*docs.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""
