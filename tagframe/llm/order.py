"""Materialises token sequences in training order, as shards of records of one size.

Each sequence has a number: those of a partition follow those of the partitions before it, which a first reading counts.
A keyed Feistel permutation of the numbers, walking on along its cycle where it leaves the domain, is the sequence's slot in
the training order: a bijection of all slots without a table or a sort by random keys. Slots are cut into ranges of one size, the last one
shorter; one task takes one range, sorts it and writes one shard: a head and records of fixed stride. So slot s lies in shard
s // records at a byte that arithmetic gives, and a reader resumes anywhere.

A record is doc_id (8 bytes), piece (4), length (4) and ``length_max`` ids of 2 or 4 bytes, the rest zeros; the highest
bit of the piece marks a null id. Shards of lost or repeated attempts are not in the manifest and never read.

Defined cases: a null text is an empty document: its end id alone; rows repeated are sequences each; an empty table gives
no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .space import folder, removed, small_batches, written
from .tokens import file_of, word_tokenizer
from .words import mix, slices

MAGIC = b"TFSHARD2"
HEAD = "<8sqii"  # magic, shard, ids of a record, bytes of an id
RECORD = "<qIi"
NO_ID = 1 << 31
#: Words that a task keeps: those of its partition, or the second reading encodes them again.
MAX_WORDS = 1_000_000


def permute(numbers: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of numbers below ``size``: a bijection of [0, size) for each key."""
    half = max(1, ((max(size, 1) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        x = once(numbers.astype(np.uint64))
        while (out := x >= np.uint64(size)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def sequence_counts(rows: DataFrame, tokenizer: str, length_max: int, path: str) -> int:
    """Counts the sequences of each partition of ``doc_id, text``. Below ``path`` a partition has a file with its count, the sum of
    those before it, and the name of a file with the ids of its words, so that a second reading in the same order doesn't encode them again.
    Returns the sum of all; nothing else of it reaches the driver."""

    def run(batches):
        encoder, n = word_tokenizer(tokenizer, MAX_WORDS), 0
        encoder.forget()
        for b in slices(batches, 0, keep=True):
            n += int((encoder.count(b.column(0)) // length_max + 1).sum())
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name = f"words-{uuid.uuid4().hex}.arrow"
        with fs.open_output_stream(f"{root}/{name}") as f:
            encoder.save(f)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([name], pa.string())], ["part", "n", "name"])

    counts = written(rows.select("text").mapInArrow(run, "part int, n long, name string"), "counts")
    # a row per partition
    before = counts.select("part", "n", "name", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    before.write.partitionBy("part").parquet(f"{path}/parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    removed(counts)
    return total


def part_of(path: str, part: int) -> tuple[int, int, str | None]:
    """Count, sum before and file of words of a partition; zeros for one that the first reading didn't have."""
    fs, root = pafs.FileSystem.from_uri(f"{path}/parts/part={part}")
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                row = pq.read_table(source).to_pylist()[0]
            return row["n"], row["base"], row["name"]
    return 0, 0, None


def write_shards(docs: DataFrame, path: str, key: int = 2024, length_max: int = 512, tokenizer: str | None = None, end_id: int = 1, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below ``path``; returns their manifest: ``shard, path, records, crc32, first_slot, length_max``.

    ``docs`` is read twice and has to give the same partitions both times, as files do; one that doesn't is an error.
    """
    small_batches(docs.sparkSession, 2500)
    tokenizer = tokenizer or file_of("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = folder(docs.sparkSession, "words")
    total = sequence_counts(rows, tokenizer, length_max, words)
    width = 2 if max(word_tokenizer(tokenizer).most, end_id + 1) <= 1 << 16 else 4
    stride = struct.calcsize(RECORD) + width * length_max
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-total // per_shard))

    def place(batches):
        part, encoder, pack, n = TaskContext.get().partitionId(), word_tokenizer(tokenizer, MAX_WORDS), zstandard.ZstdCompressor(level=1), 0
        count, base, name = part_of(words, part)
        if name:
            fs, root = pafs.FileSystem.from_uri(words)
            with fs.open_input_file(f"{root}/{name}") as f:
                encoder.load(f)
        for b in slices(batches, 1, 4 << 20, keep=True):
            flat, sizes = encoder.encode_flat(b.column(1))
            whole = np.full(len(flat) + len(sizes), end_id, f"<u{width}")
            whole[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
            raw, at, packed = memoryview(whole.tobytes()), 0, []
            for ident, size in zip(b.column(0).to_pylist(), (sizes + 1).tolist(), strict=True):
                for k, start in enumerate(range(0, size, length_max)):
                    stop = min(start + length_max, size)
                    packed.append(pack.compress(struct.pack(RECORD, ident or 0, k | NO_ID * (ident is None), stop - start) + raw[width * (at + start) : width * (at + stop)]))
                at += size
            slot = permute(np.arange(base + n, base + n + len(packed)), total, key) if packed and n + len(packed) <= count else np.empty(0, np.int64)
            n += len(packed)
            if n > count:
                break
            yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(packed, pa.binary())], ["shard", "slot", "record"])
        if n != count:
            raise RuntimeError("the input changed between two readings; write it to files first")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        unpack, shard, out, done, crc, f, name = zstandard.ZstdDecompressor(), None, [], 0, 0, None, ""

        def close():
            f.close()
            if done != min(per_shard, total - shard * per_shard):
                raise RuntimeError(f"shard {shard} has gaps")
            out.append((shard, f"{path}/{name}", done, crc))

        for b in batches:
            block = []
            for s, slot, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    if f:
                        f.write(b"".join(block))
                        close()
                    block, shard, done, crc, name = [], s, 0, 0, f"shard-{s:06d}-{uuid.uuid4().hex[:8]}.bin"
                    fs.create_dir(root, recursive=True)
                    f = fs.open_output_stream(f"{root}/{name}")
                    f.write(struct.pack(HEAD, MAGIC, shard, length_max, width))
                if slot != shard * per_shard + done:
                    raise RuntimeError(f"slot {shard * per_shard + done} is missing or taken twice")
                record = unpack.decompress(raw).ljust(stride, b"\0")
                crc = zlib.crc32(record, crc)
                block.append(record)
                done += 1
            if block:
                f.write(b"".join(block))
        if f:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "records", "crc32"])

    placed = rows.mapInArrow(place, "shard int, slot long, record binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    manifest = written(placed.select("shard", "slot", "record").mapInArrow(write, "shard int, path string, records long, crc32 long"), "shards")
    fs, root = pafs.FileSystem.from_uri(words)
    fs.delete_dir(root)  # both readings have ended
    return manifest.withColumn("first_slot", F.col("shard").cast("long") * per_shard).withColumn("length_max", F.lit(length_max))


def byte_of(slot: int, per_shard: int, length_max: int, width: int = 2) -> tuple[int, int]:
    """The shard that holds a slot, and the byte at which its record begins."""
    return slot // per_shard, struct.calcsize(HEAD) + slot % per_shard * (struct.calcsize(RECORD) + width * length_max)


def read_slots(path: str, first_slot: int, records: int, start: int, stop: int) -> Iterator[tuple[int, int | None, int, np.ndarray, int]]:
    """Records of a shard from slot ``start`` to ``stop``: slot, doc_id, piece, ids, byte offset. One seek, then sequential."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        head = struct.calcsize(HEAD)
        magic, _, length_max, width = struct.unpack(HEAD, f.read(head))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        stride = struct.calcsize(RECORD) + width * length_max
        start, stop = max(start, first_slot), min(stop, first_slot + records)
        at, slot = head + (start - first_slot) * stride, start
        f.seek(at)
        while slot < stop:
            block = f.read(stride * min(4096, stop - slot))
            if not block or len(block) % stride:
                raise ValueError(f"{path} is cut off")
            for i in range(0, len(block), stride):
                ident, piece, n = struct.unpack_from(RECORD, block, i)
                yield slot, None if piece & NO_ID else ident, piece & ~NO_ID, np.frombuffer(block, f"<u{width}", n, i + struct.calcsize(RECORD)), at
                slot, at = slot + 1, at + stride


def read_order(manifest: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Sequences of slots ``start`` to ``stop`` without their ids: ``slot, doc_id, piece, length, ids_crc32, shard, byte_offset``; a task a shard."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    names = ["slot", "doc_id", "piece", "length", "ids_crc32", "shard", "byte_offset"]

    def run(batches):
        for b in batches:
            for shard, path, first, records in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "first_slot", "records")), strict=True):
                rows = []
                for s, i, k, x, at in read_slots(path, first, records, start, first + records if stop is None else stop):
                    rows.append((s, i, k, len(x), zlib.crc32(x.astype("<u4").tobytes()), shard, at))
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    wanted = manifest.where(F.col("first_slot") + F.col("records") > start)
    wanted = wanted if stop is None else wanted.where(F.col("first_slot") < stop)
    tasks = max(1, wanted.count())
    return wanted.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).mapInArrow(run, "slot long, doc_id long, piece int, length long, ids_crc32 long, shard int, byte_offset long")


def training_order(docs: DataFrame, key: int = 2024, length_max: int = 512) -> DataFrame:
    """Writes shards to the shared folder and reads them back in full."""
    return read_order(write_shards(docs, folder(docs.sparkSession, "order"), key, length_max))
