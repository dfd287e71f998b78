"""Packs documents into sequences of bounded length: dominance reduction, then best fit.

Only lengths matter for the plan, and there are at most ``capacity`` of them. The plan is made from
their histogram, with counts: its cost is bounded by the capacity, not by the number of documents.
Reduction after Martello and Toth first fixes sets that dominate every alternative for their
largest item: an item that nothing fits with, a pair that fills a sequence exactly, the largest
partner where only one more item fits, and that partner again where no pair of items holds more. The rest is
packed by best fit in order of decreasing length, many equal sequences at a time. The plan is a list of
runs - of length l, the items numbered a to b go to consecutive sequences at one offset - and each item
finds its run from its number among the items of its length.

Items of one length are numbered within salted groups of bounded size, so that a length that a third of
all documents share is no single task's.

Defined cases: a null text is an empty document of one token, the closing id; rows repeated are packed
each; an empty table gives an empty result. Pieces of a document longer than the capacity fill
sequences of their own but for the last. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .space import small_batches, written
from .tokens import file_of, word_tokenizer
from .words import slices


class Run(NamedTuple):
    """Items ``first``, ``first + 1``, ... of a length go to sequences ``sequence``, ``sequence + 1``, ..."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            if not 0 < length <= capacity or n < 0:
                raise ValueError(f"no length for sequences of {capacity}: {length}")
            self.left[length] += n
        self.taken = np.zeros(capacity + 1, np.int64)
        self.runs: list[Run] = []
        self.sequences = 0

    def take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, int(self.taken[length]), n, sequence, offset))
        self.taken[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], n: int) -> None:
        offset = 0
        for length in lengths:
            self.take(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def smallest(self, k: int, without: int) -> int | None:
        """Sum of the k smallest items, one item of length ``without`` set aside; None if there are fewer."""
        total = 0
        for length in np.flatnonzero(self.left):
            n = min(k, int(self.left[length]) - (length == without))
            total, k = total + n * int(length), k - n
            if not k:
                return total
        return None

    def largest_upto(self, room: int, without: int) -> int:
        """The longest item of at most ``room``, one of length ``without`` set aside; 0 if there is none."""
        lengths = np.flatnonzero(self.left[: room + 1])
        while len(lengths) and int(self.left[lengths[-1]]) - (lengths[-1] == without) <= 0:
            lengths = lengths[:-1]
        return int(lengths[-1]) if len(lengths) else 0

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two items that fits into ``room``; 0 if none does."""
        lengths = [int(x) for x in np.flatnonzero(self.left[: room + 1])]
        n = {x: int(self.left[x]) - (x == without) for x in lengths}
        lengths = [x for x in lengths if n[x] > 0]
        lo, hi, best = 0, len(lengths) - 1, 0
        while lo <= hi:
            if lengths[lo] + lengths[hi] > room:
                hi -= 1
            elif lo == hi and n[lengths[lo]] < 2:
                break
            else:
                best = max(best, lengths[lo] + lengths[hi])
                lo += 1
        return best

    def reduce(self) -> None:
        """Fixes dominating sets, the longest items first, until none is left to find."""
        self.fix([self.capacity], int(self.left[self.capacity])) if self.left[self.capacity] else None
        changed = True
        while changed:
            changed = False
            for length in map(int, np.flatnonzero(self.left)[::-1]):
                while self.left[length]:
                    room = self.capacity - length
                    partner = self.largest_upto(room, length)
                    if not partner:
                        sets, n = [length], 1 if length <= room else int(self.left[length])
                    elif partner == room:
                        sets = [length, partner]
                        n = min(int(self.left[length]), int(self.left[partner])) if partner != length else int(self.left[length]) // 2
                    else:
                        two, three = self.smallest(2, length), self.smallest(3, length)
                        only_one = two is None or two > room
                        if not only_one and (three is None or three > room):
                            only_one = partner >= self.best_pair(room, length)
                        if not only_one:
                            break
                        # taking items raises the smallest sums and lowers the best pair: the set holds while both items last
                        sets = [length, partner]
                        n = min(int(self.left[length]), int(self.left[partner])) if partner != length else int(self.left[length]) // 2
                    self.fix(sets, n)
                    changed = True

    def best_fit(self) -> None:
        """Best fit of what is left, longest first; sequences of equal room stand in groups."""
        groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
        rooms: list[int] = []  # sorted
        for length in map(int, np.flatnonzero(self.left)[::-1]):
            while self.left[length]:
                i = int(np.searchsorted(rooms, length))
                if i == len(rooms):
                    fit = self.capacity // length
                    n = int(self.left[length])
                    # fresh sequences take as many of this length as fit, then the last takes the rest
                    full, rest = divmod(n, fit)
                    for count, each in ((full, fit), (1 if rest else 0, rest)):
                        if count:
                            start = self.sequences
                            self.sequences += count
                            for k in range(each):
                                self.take(length, count, start, k * length)
                            self._open(groups, rooms, self.capacity - each * length, start, count)
                    break
                room = rooms[i]
                start, count = groups[room].pop()
                n = min(count, int(self.left[length]))
                self.take(length, n, start, self.capacity - room)
                if n < count:
                    groups[room].append((start + n, count - n))
                elif not groups[room]:
                    del groups[room], rooms[i]
                self._open(groups, rooms, room - length, start, n)

    @staticmethod
    def _open(groups, rooms, room: int, start: int, count: int) -> None:
        if room:
            if room not in groups:
                groups[room] = []
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            groups[room].append((start, count))


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place every item of a histogram of lengths."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.runs


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian, 32 bits)."""
    small_batches(docs.sparkSession, 2500)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for b in slices(batches, 1, 2 << 20, keep=True):
            rows: list[list] = [[] for _ in names]
            flat, counts = encoder.encode_flat(b.column(1))
            whole = np.full(len(flat) + len(counts), end_id, "<u4")
            whole[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
            raw, at = memoryview(whole.tobytes()), 0
            for ident, n in zip(b.column(0).to_pylist(), (counts + 1).tolist(), strict=True):
                for k, start in enumerate(range(0, n, capacity)):
                    stop = min(start + capacity, n)
                    part = raw[4 * (at + start) : 4 * (at + stop)]
                    for column, value in zip(rows, (ident, k, start, stop - start, zlib.crc32(part), part), strict=False):
                        column.append(value)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def place(items: DataFrame, capacity: int, group_rows: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length``; ``items`` should be cheap to read twice."""
    total = items.count()
    salts = max(16, -(-total // group_rows))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_group = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    base = by_group.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_base"))
    # at most ``capacity`` rows
    counts = {int(r["length"]): int(r["n"]) for r in by_group.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    length, first, _, sequence, offset = (np.array([r[i] for r in runs], np.int64) for i in range(5))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length.astype("f8") * 2.0**40 + first
        for b in batches:
            n = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, n.astype("f8") * 2.0**40 + rank, "right") - 1
            columns = [b.column(i) for i, c in enumerate(b.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*(c for c in b.schema.names if c != "_rank"), "sequence_id", "offset"])

    order = [F.col(c) for c in items.columns if c not in ("length", "ids")]
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    ranked = ranked.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_in") - 1).select(*items.columns, "_rank")
    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(find, schema)


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    items = written(pieces(docs, capacity, tokenizer or file_of("word_bpe_49k.json"), end_id, id_col, text_col, keep_ids), "pieces")
    return place(items, capacity)
