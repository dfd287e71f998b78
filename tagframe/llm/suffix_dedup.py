"""Removes every byte that lies in a string of ``length`` bytes which also starts somewhere else.

Strings are dealt to shards by their anchor: of the ``gram``-byte strings inside a window of ``length``
bytes the one of the smallest hash. Equal windows have equal anchors, so they meet. Consecutive windows
of one anchor make a context, the bytes that they cover. A first pass counts anchors; those that
occur once are done. A second pass finds the contexts of the others; equal contexts are
counted before anything is shuffled by anchor, and repeat all their windows. Where different contexts share an
anchor, each is fetched once, and shards of bounded size sort their suffixes by induced sorting; a window repeats if its
permuted common prefix with a neighbour in suffix order reaches ``length``. Anchors with more than ``hot``
different contexts don't fit one shard: their windows are counted by 128-bit digests instead.

Defined cases: texts are UTF-8 bytes, a null one empty; matches never cross documents, but may overlap
and lie in one document; rows repeated count as elsewhere; texts shorter than ``length`` lose nothing.
Empty tables give empty results. Rows are told apart by id (null included) and text. Other columns are ignored by
``repeats`` and kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import bloom_filter, maybe_in
from .induced import common_prefixes, suffix_array
from .space import free_names, small_batches, utf8, written
from .words import mix, slices

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Windows that are handled at once: long texts go in stretches.
_STRETCH = 1 << 19
#: Bytes of short texts that are handled at once.
_TOGETHER = 1 << 15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(size, base, _U)
                factors[0] = 1
                _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
        n = len(data) - width + 1
        return mix((total[width:] - total[:n]) * down[:n])


def _owners(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a stretch, and for each window the place of its anchor."""
    h = _rolling(data, gram)
    low = h & ~_U((1 << 20) - 1) | np.arange(len(h), dtype=_U)
    span, reach = length - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return h, (low & _U((1 << 20) - 1)).astype(np.int64)


def anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of a text: hash of each anchor, first window that it owns, and how many follow."""
    windows = len(data) - length + 1
    for at in range(0, max(0, windows), _STRETCH):
        n = min(_STRETCH, windows - at)
        h, place = _owners(data[at : at + n + length - 1], length, gram)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        yield h[place[first]].view(np.int64), first + at, np.diff(np.append(first, n))


def anchors_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As ``anchors`` of each text, with the number of the text before; short texts go together."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for i in np.flatnonzero(sizes > _TOGETHER).tolist():
        for h, first, n in anchors(np.frombuffer(texts[i], np.uint8), length, gram):
            yield np.full(len(h), i), h, first, n
    short = np.flatnonzero((sizes >= length) & (sizes <= _TOGETHER))
    ends = np.cumsum(sizes[short])
    start = 0
    while start < len(short):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[short[start]] + _TOGETHER, "right")))
        mine, start = short[start:stop], stop
        h, place = _owners(np.frombuffer(b"".join([texts[i] for i in mine.tolist()]), np.uint8), length, gram)
        begins = np.cumsum(sizes[mine]) - sizes[mine]
        windows = sizes[mine] - length + 1
        new = np.concatenate([[True], place[1:] != place[:-1]])
        new[begins] = True
        new[(begins + windows)[:-1]] = True  # windows from here on reach into the next text
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(place)))
        of = np.searchsorted(begins, first, "right") - 1
        inside = first - begins[of] < windows[of]
        first, n, of = first[inside], n[inside], of[inside]
        yield mine[of], h[place[first]].view(np.int64), first - begins[of], n


def _bits(hashes: np.ndarray, bits: int, times: int = 3) -> Iterator[np.ndarray]:
    for k in range(times):
        yield (mix(hashes.view(_U) + _U((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) & _U(bits - 1)).astype(np.int64)


def _member(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    with np.errstate(over="ignore"):
        for slot in _bits(hashes, len(bloom) * 8):
            out &= bloom[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
    return out


def _collect_bloom(keys: DataFrame, rows: int, max_bits: int = 1 << 27) -> np.ndarray:
    """A Bloom filter of the long column of ``keys``: 16 MB at most, however many rows there are; then only fuller."""
    bits = 1 << 16
    while bits < min(max_bits, rows * 12):
        bits *= 2
    part = 1 << 15  # bits of a block

    def run(batches):
        held = np.zeros(bits, bool)
        for b in batches:
            with np.errstate(over="ignore"):
                for slot in _bits(b.column(0).to_numpy(), bits):
                    held[slot] = True
        blocks = [i for i in range(bits // part) if held[i * part : (i + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.packbits(held[i * part : (i + 1) * part], bitorder="little").tobytes() for i in blocks], pa.binary())], ["block", "bits"])

    def join(batches):
        block, total = None, None
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != block:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])
                    block, total = i, np.zeros(part // 8, np.uint8)
                total |= np.frombuffer(raw, np.uint8)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(run, "block int, bits binary").repartition("block").sortWithinPartitions("block").mapInArrow(join, "block int, bits binary").collect():
        out[r["block"] * part // 8 : (r["block"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _place_key(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of contexts' places, from those of their texts."""
    with np.errstate(over="ignore"):
        return mix(first.astype(_U) * _U(_BASE) + base).view(np.int64)


def _place_base(ids: list[int | None], text_hashes: list[int]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{i}:{h}") for i, h in zip(ids, text_hashes, strict=True)], _U)


def _text_hash(data: bytes) -> int:
    """As Spark's ``xxhash64`` of the text."""
    h = xxhash.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >> 63 else h


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _anchor_hashes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for b in slices(batches, 1, 2 << 20):
            got = [np.empty(0, np.int64), *(h for _, h, _, _ in anchors_of([utf8(t) for t in b.column(1).to_pylist()], length, gram))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got))], ["anchor"])

    return rows.mapInArrow(run, "anchor long")


_CONTEXT = "anchor long, context binary, doc_id long, text_hash long, first int, windows int"


def _contexts(rows: DataFrame, length: int, gram: int, bloom, with_bytes: bool) -> DataFrame:
    """Contexts whose anchor - or, ``with_bytes``, whose place - is in the filter."""
    names = ["anchor", "context", "doc_id", "text_hash", "first", "windows"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        held = bloom.value
        out: list[list] = [[] for _ in names]
        raw: list[bytes] = []
        size = 0

        def flush():
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            batch = pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] * with_bytes)], [*names, *(["bytes"] * with_bytes)])
            for c in (*out, raw):
                c.clear()
            return batch

        for b in slices(batches, 1, 2 << 20):
            ids, texts = b.column(0).to_pylist(), [utf8(t) for t in b.column(1).to_pylist()]
            text_hashes = [_text_hash(d) if len(d) >= length else 0 for d in texts]
            base = _place_base(ids, text_hashes) if with_bytes else None
            for found in anchors_of(texts, length, gram):
                keep = np.flatnonzero(_member(held, _place_key(base[found[0]], found[2]) if with_bytes else found[1]))
                for k in range(0, len(keep), 8192):
                    of, h, first, n = (x[keep[k : k + 8192]].tolist() for x in found)
                    parts = [texts[i][s : s + m + length - 1] for i, s, m in zip(of, first, n, strict=True)]
                    mine = (h, map(xxhash.xxh3_128_digest, parts), [ids[i] for i in of], [text_hashes[i] for i in of], first, n)
                    for column, values in zip(out, mine, strict=True):
                        column.extend(values)
                    if with_bytes:
                        raw += parts
                    size += len(parts)
                    if size >= 8192:
                        yield flush()
                        size = 0
        yield flush()

    return rows.mapInArrow(run, _CONTEXT + ", bytes binary" * with_bytes)


_FOUND = "anchor long, context binary, lo int, hi int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context which of its windows start elsewhere in these contexts too; one shard's work."""
    sizes = np.array([len(c) + 1 for c in contexts])
    # bytes of UTF-8 stay below 0xF5, so that 0 and 1 are free for the end and for what parts contexts
    t = np.frombuffer(b"\xff".join(contexts) + b"\xff\xfe", np.uint8) + np.uint8(2)
    begins = np.cumsum(sizes) - sizes
    before, share = common_prefixes(t, suffix_array(t))
    reach = np.flatnonzero(share >= length)
    again = np.zeros(len(t), bool)
    again[reach] = True
    again[before[reach]] = True
    return [again[s : s + n - length] for s, n in zip(begins, sizes, strict=True)]


def _sort_shards(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Runs ``lo`` to ``hi`` of repeated windows, from contexts dealt by anchor."""

    def run(batches):
        held: list[tuple] = []
        size, last = 0, None

        def sort():
            out = []
            for (anchor, context, _), flags in zip(held, repeated_windows([h[2] for h in held], length), strict=True):
                out += [(anchor, context, int(a), int(b)) for a, b in zip(*_runs(flags), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["anchor", "context", "lo", "hi"])

        for b in slices(batches, 2, 1 << 20):
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "bytes")), strict=True):
                if size >= shard_bytes and row[0] != last:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield sort()

    # work grows with the bytes, not with what they take up compressed: the number of tasks is not left to their size
    tasks = max(1, contexts.count() // 4096)
    return contexts.repartition(tasks, "anchor").sortWithinPartitions("anchor", "context").mapInArrow(run, _FOUND)


def _window_digests(contexts: DataFrame, length: int) -> DataFrame:
    """Windows of contexts as ``anchor, context, at, window``."""

    def run(batches):
        for b in slices(batches, 2, 1 << 18):
            rows: list[list] = [[], [], [], []]
            for anchor, context, data in zip(*(b.column(c).to_pylist() for c in ("anchor", "context", "bytes")), strict=True):
                n = len(data) - length + 1
                for column, values in zip(rows, ([anchor] * n, [context] * n, range(n), [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["anchor", "context", "at", "window"])

    return contexts.select("anchor", "context", "bytes").mapInArrow(run, "anchor long, context binary, at int, window binary")


def _spans(rows: DataFrame, length: int, gram: int, shard_bytes: int, hot: int) -> DataFrame:
    """``doc_id, text_hash, spans``: sorted byte ranges to remove, which may overlap."""
    spark = rows.sparkSession
    context = spark.sparkContext
    twice = written(_anchor_hashes(rows, length, gram).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    bloom = context.broadcast(_collect_bloom(twice, twice.count()))
    places = written(_contexts(rows, length, gram, bloom, False), "contexts")
    bloom.destroy()

    # equal contexts are counted first; each is represented by one place
    distinct = places.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "first", "windows")).alias("at"))
    distinct = written(distinct, "distinct-contexts")
    mixed = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "mixed-anchors")
    keys = distinct.join(mixed, "anchor", "left_semi").select("at.doc_id", "at.text_hash", "at.first")

    def key_of(batches):
        for b in batches:
            base = _place_base(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_place_key(base, b.column(2).to_numpy()))], ["key"])

    keys = written(keys.mapInArrow(key_of, "key long"), "keys")
    chosen = context.broadcast(_collect_bloom(keys, keys.count()))
    fetched = _contexts(rows, length, gram, chosen, True).select("anchor", "context", "bytes")
    fetched = fetched.groupBy("anchor", "context").agg(F.first("bytes").alias("bytes")).join(mixed, "anchor")
    fetched = written(fetched, "context-bytes")
    chosen.destroy()
    found = _sort_shards(fetched.where(F.col("kinds") <= hot).select("anchor", "context", "bytes"), length, shard_bytes)
    digests = _window_digests(fetched.where(F.col("kinds") > hot), length)
    again = digests.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    found = found.unionByName(digests.join(again, ["anchor", "window"]).select("anchor", "context", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
    found = found.unionByName(distinct.where("n > 1").select("anchor", "context", F.lit(0).alias("lo"), F.col("at.windows").alias("hi")))
    found = written(found, "repeated")
    spans = places.join(found, ["anchor", "context"]).select("doc_id", "text_hash", F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") - 1 + length).alias("hi")).alias("span"))
    return written(spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows of ``docs`` that a filter clears, the others with their spans if they have any, and the name of that column."""
    ident, text, name = free_names(docs, "span_id", "span_text", "spans")
    keys = written(spans.select("doc_id").distinct(), "span-ids")
    bloom, bits = bloom_filter(keys.where("doc_id is not null"), "doc_id")
    bloom = written(bloom, "bloom")
    mine = F.col(id_col).cast("long")
    test = F.coalesce(maybe_in(mine, bloom.scalar(), bits), F.lit(False)) | mine.isNull()
    found = spans.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(text), F.col("spans").alias(name))
    same = mine.eqNullSafe(F.col(ident)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(text))
    maybe = docs.where(test).join(found, same, "left").select(*docs.columns, name)
    return docs.where(~test), maybe, name


def _kept(data: bytes, spans: list[dict] | None, whole_characters: bool) -> tuple[bytes, int]:
    """The bytes that stay, and the number of maximal removed runs."""
    if not spans:
        return data, 0
    merged: list[list[int]] = []
    for s in spans:
        if merged and s["lo"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["hi"])
        else:
            merged.append([s["lo"], s["hi"]])
    parts, at = [], 0
    for lo, hi in merged:
        if whole_characters:
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi -= 1
        parts.append(data[at:lo])
        at = hi
    return b"".join(parts) + data[at:], len(merged)


def repeats(docs: DataFrame, length: int = 200, gram: int = 100, shard_bytes: int = 1 << 19, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    clear, maybe, name = _with_spans(rows, _spans(rows, length, gram, shard_bytes, hot), "doc_id", "text")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    none = F.lit(0).cast("long")
    untouched = clear.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))

    def run(batches):
        for b in slices(batches, 1, 4 << 20):
            n, gone, spans, digest = [], [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = utf8(t)
                left, count = _kept(data, found, False)
                n.append(len(data))
                gone.append(len(data) - len(left))
                spans.append(count)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n, gone, spans)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return untouched.unionByName(maybe.select("doc_id", "text", name).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def drop_repeats(docs: DataFrame, length: int = 200, gram: int = 100, shard_bytes: int = 1 << 19, hot: int = 2000, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated bytes taken out of the texts, whole characters only, and ``chars_col`` counted anew; no row is dropped."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    clear, maybe, name = _with_spans(docs, _spans(rows, length, gram, shard_bytes, hot), id_col, text_col)
    names = docs.columns
    chars = names.index(chars_col) if chars_col in names else None

    at = names.index(text_col)

    def cut(batches):
        for b in slices(batches, at, 4 << 20):
            columns = [b.column(i) for i in range(len(names))]
            texts, founds = columns[at].to_pylist(), b.column(len(names)).to_pylist()
            left = [t if t is None or not f else _kept(utf8(t), f, True)[0].decode("utf-8", "surrogatepass") for t, f in zip(texts, founds, strict=True)]
            columns[at] = pa.array(left, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([c if not f or t is None else len(t) for c, t, f in zip(columns[chars].to_pylist(), left, founds, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return clear.unionByName(maybe.select(*names, name).mapInArrow(cut, docs.schema))
