"""Near-duplicates by an inverted join on the coordinates of MinHash signatures.

A document's set is that of its word shingles; its signature has ``coordinates`` minima. Documents are
posted under pairs of coordinate and value. Two documents as similar as the threshold agree in
``matches`` coordinates or more but for a chance below ``miss``. In an order of pairs from rare to common
the first pair that two such documents share is one of the first ``coordinates - matches + 1`` of both, so
each is posted under these alone (the prefix), and the long lists of common pairs are skipped. Rarity
comes from a sketch of bounded size and only orders the pairs; any order is right.

Lists are never expanded into all their pairs. First each document is compared with the list's leader,
the document of the most common pairs. What that links forms components. A list that still holds
several is merged across them: a component meets all that share a list with it at once, dealt out in blocks, however many lists those are;
documents outside its largest component, at most ``BLOCK``, meet each other, in the first list that two of them share, dealt out by
pairs of cells of some ``CELL``. So each is repeated ``BLOCK / CELL`` times at most, and rows grow with the documents and not with the square of a list.
Where more are outside, they alone are parted by the next pair that documents share, which is one of the next in the order
of both (the prefix, longer by one), and each part is a list again; the members of a large component, which share most of
their pairs and so would be in each of the parts, have met them by then. Signatures screen every comparison, full sets confirm it, so the
components are exactly those of the confirmed links; documents of equal sets are joined before and take part once.

Tables that a step leaves are removed when their last reader has ended; what is returned is a table of its own.

Defined cases: null and empty texts have empty sets, are linked with nothing and kept; documents of fewer than
``words`` words have one shingle, the whole; a row without id is linked with nothing: its component is null and it is kept;
rows repeated with their id are one document: each repeats its result. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exact_dedup import bloom_filter, maybe_in
from .space import free_names, removed, small_batches, written
from .words import ascii_words, hashes, mix, slices

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_C = _U(0xD6E8FEB86659FD93)
#: The most documents in a list outside its largest component that meet each other without being parted.
BLOCK = 1 << 15
#: Documents on each side of a block, about.
CELL = 512
#: Documents that are compared with one copy of their leader.
FAN = 1024


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    w = ascii_words(texts)
    ends = np.cumsum(w.sizes)
    with np.errstate(over="ignore"):
        h = hashes(w.distinct)[w.ids]
        odd = mix(np.arange(1, words + 1, dtype=_U) * _GOLD) | _U(1)
        n = max(0, len(h) - words + 1)
        total = np.zeros(n, _U)
        for j in range(words):
            total += mix(h[j : j + n] * odd[j])
        total = mix(total)
        out = []
        for end, size in zip(ends.tolist(), w.sizes.tolist(), strict=True):
            if size >= words:
                out.append(np.unique(total[end - size : end - words + 1]))
            elif size:  # the whole, told apart from longer ones by its size
                out.append(mix(np.array([sum(int(x) * int(k) for x, k in zip(mix(h[end - size : end] * odd[:size]), odd, strict=False)) + size & (1 << 64) - 1], _U)))
            else:
                out.append(np.empty(0, _U))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row for each of the sets, none of them empty: 32-bit digests of the minima under multiply-shift hashes.

    The minima themselves are small numbers, the smaller the larger the set; cut to 32 bits, those of large sets that share nothing
    would often be equal, the more so the more sets there are. Their digests are spread over all 32 bits.
    """
    if not sets:
        return np.empty((0, coordinates), np.uint32)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out, value = np.empty((len(sets), coordinates), _U), np.empty_like(flat)
    with np.errstate(over="ignore"):
        a = mix(np.arange(1, coordinates + 1, dtype=_U) * _GOLD) | _U(1)
        b = mix(np.arange(1001, coordinates + 1001, dtype=_U) * _GOLD)
        for j in range(coordinates):
            np.multiply(flat, a[j], out=value)
            np.add(value, b[j], out=value)
            out[:, j] = np.minimum.reduceat(value, starts)
        return (mix(out) >> _U(32)).astype(np.uint32)


def least_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The most matches that two documents of this similarity fall short of with a chance of at most ``miss``."""
    chance, t = 0.0, 0
    while t < coordinates:
        chance += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if chance > miss:
            break
        t += 1
    return max(1, t)


def _tokens(signatures: np.ndarray) -> np.ndarray:
    return np.arange(signatures.shape[1], dtype=np.int64) << 32 | signatures.astype(np.int64)


def _slots(tokens: np.ndarray, width: int) -> np.ndarray:
    return (mix(tokens.astype(_U)) & _U(width - 1)).astype(np.int64)


def _signatures_of(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4 << 20):
            sets = shingles(b.column(1), words)
            keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = iter(signatures([s for s in sets if len(s)], coordinates))
            n, sigs = [len(s) for s in sets], [next(signed).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _sketch(nodes: DataFrame, coordinates: int, rows: int, width_max: int = 1 << 22) -> np.ndarray:
    """How often pairs occur, by hashed slot: at most ``width_max`` counts, each at least the true one."""
    width, part = 1 << 12, 1 << 12
    while width < min(width_max, rows * coordinates):
        width *= 2

    def count(batches):
        total = np.zeros(width, np.uint32)
        for b in slices(batches, 0):
            sigs = _stacked(b.column(0), coordinates)
            np.add.at(total, _slots(_tokens(sigs), width).ravel(), np.uint32(1))
        blocks = [i for i in range(width // part) if total[i * part : (i + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[i * part : (i + 1) * part].tobytes() for i in blocks], pa.binary())], ["block", "counts"])

    def add(batches):
        block, total = None, None
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != block:
                    if total is not None:
                        yield _one_block(block, total)
                    block, total = i, np.zeros(part, np.uint32)
                total += np.frombuffer(c, np.uint32)
        if total is not None:
            yield _one_block(block, total)

    got = nodes.select("sig").mapInArrow(count, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(width, np.uint32)
    for r in got.collect():  # 16 MB at most
        out[r["block"] * part : (r["block"] + 1) * part] = np.frombuffer(r["counts"], np.uint32)
    return out


def _one_block(block: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _ranked(sigs: np.ndarray, counts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each signature the ``first`` rarest pairs, in the order that all documents share, and how common its pairs are in all."""
    tokens = _tokens(sigs)
    often = counts[_slots(tokens, len(counts))].astype(np.int64)
    order = np.lexsort((tokens, often), axis=1)[:, :first]
    return np.take_along_axis(tokens, order, 1), often.sum(axis=1)


def _stacked(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates)


def _postings(nodes: DataFrame, shared, coordinates: int, prefix: int) -> DataFrame:
    """``token, node, score, rank``: each document under the pairs of its prefix."""

    def run(batches):
        for b in slices(batches, 1):
            t, score = _ranked(_stacked(b.column(1), coordinates), shared.value, prefix)
            n = t.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(t.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(score, n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(t)))], ["token", "node", "score", "rank"])

    return nodes.select("node", "sig").mapInArrow(run, "token long, node long, score long, rank int")


def _parted(wide: DataFrame, nodes: DataFrame, shared, coordinates: int, upto: int) -> DataFrame:
    """Members ``token, node, rank`` of lists posted again under the list and each later pair of their prefix of ``upto``."""

    def run(batches):
        for b in slices(batches, 3):
            t, score = _ranked(_stacked(b.column(3), coordinates), shared.value, upto)
            rank = b.column(2).to_numpy()
            row, at = np.nonzero(np.arange(t.shape[1])[None, :] > rank[:, None])
            with np.errstate(over="ignore"):
                token = mix(mix(b.column(0).to_numpy().astype(_U))[row] * _C + t[row, at].astype(_U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(b.column(1).to_numpy()[row]), pa.array(score[row]), pa.array(at.astype(np.int32))], ["token", "node", "score", "rank"])

    return _shuffled(wide).join(nodes.select("node", "sig"), "node").select("token", "node", "rank", "sig").mapInArrow(run, "token long, node long, score long, rank int")


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows of lists, which a join must not send through the driver: their columns repeat so much that a small file may hold millions."""
    return rows.hint("merge")


def _enough(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _screen(pairs: DataFrame, nodes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""

    def run(batches):
        for b in slices(batches, 2):
            x, y = (_stacked(b.column(c), coordinates) for c in ("sig_a", "sig_b"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= matches))

    joined = _shuffled(pairs).join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _with_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``wanted`` with the text of their ``node``; texts of other documents don't leave their place."""
    ids = written(wanted.select("node").distinct(), "wanted")
    bloom, bits = bloom_filter(ids, "node")
    bloom = written(bloom, "bloom")
    removed(ids)
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    return rows.where(maybe_in(F.col("node"), bloom.scalar(), bits)).join(_shuffled(wanted), "node")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` that are similar enough on full sets. The documents of one ``b`` are dealt out, ``FAN`` with each copy of it."""
    fan = written(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("int").alias("parts")), "fan")
    mine = pairs.join(fan, "b").select(F.col("a").alias("node"), F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.lit(1).alias("turn"))
    lead = fan.select(F.col("b").alias("node"), F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    todo = written(mine.unionByName(lead), "todo")
    removed(fan)

    def run(batches):
        now, first = None, None
        for b in slices(batches, 4, 4 << 20):
            a, c = [], []
            for node, lead, part, turn, s in zip(*(b.column(i).to_pylist() for i in range(4)), shingles(b.column(4), words), strict=True):
                if turn == 0:
                    now, first = (lead, part), s
                elif now == (lead, part) and 100 * min(len(s), len(first)) >= percent * max(len(s), len(first)) and _enough(len(np.intersect1d(s, first, assume_unique=True)), len(s), len(first), percent):
                    a.append(node)
                    c.append(lead)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    full = _with_texts(docs, todo, id_col, text_col).select("node", "lead", "part", "turn", "text")
    out = written(full.repartition("lead", "part").sortWithinPartitions("lead", "part", "turn").mapInArrow(run, "a long, b long"), "links")
    removed(todo)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, large: int = 4) -> Iterator[pa.Table]:
    """Tables of equal leading columns from sorted batches; ``large`` is the column that makes rows large."""
    batches = slices(batches, large, 4 << 20)
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(len(values)):
            if values[i] != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, values[i]
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _parts(n: Column) -> Column:
    return F.ceil(n / F.lit(min(BLOCK, CELL))).cast("int")


def _among(rest: DataFrame) -> DataFrame:
    """``token, block, node, comp, rank, side``: the documents of each list of ``rest``, any two of them in one block or more, of numbers below 0."""
    dealt = rest.withColumn("p", _parts(F.col("others"))).withColumn("i", F.pmod(F.xxhash64("node"), "p").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return dealt.select("token", (-1 - F.least("i", "j") * F.col("p") - F.greatest("i", "j")).alias("block"), "node", "comp", "rank", (F.col("i") > F.col("j")).cast("int").alias("side"))


def _stars(rest: DataFrame, found: DataFrame) -> DataFrame:
    """``token, block, node, comp, rank, side``: each large component of ``rest`` (``node, comp, most``) dealt out once, whatever the number of its lists, and the documents that share one with it in every block."""
    pairs = written(rest.select("most", "node", "comp").distinct(), "others")
    some = pairs.groupBy("most").agg(F.count(F.lit(1)).alias("k"))
    members = some.join(found.select(F.col("node").alias("_m"), F.col("component").alias("_c")), F.col("most") == F.col("_c"), "left").select("most", "k", F.coalesce("_m", "most").alias("node"))
    sizes = written(members.groupBy("most").agg(_parts(F.max("k")).alias("chunks"), _parts(F.count(F.lit(1))).alias("blocks")), "sizes")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = members.join(sizes, "most").select("most", "chunks", each("chunks").alias("j"), at("blocks").alias("i"), "node", F.col("most").alias("comp"), F.lit(0).alias("side"))
    others = pairs.join(sizes, "most").select("most", "chunks", at("chunks").alias("j"), each("blocks").alias("i"), "node", "comp", F.lit(1).alias("side"))
    return mine.unionByName(others).select(F.col("most").alias("token"), (F.col("i") * F.col("chunks") + F.col("j")).alias("block"), "node", "comp", F.lit(0).alias("rank"), "side")


def _alive(batches: Iterator[pa.RecordBatch], counts: np.ndarray, coordinates: int, matches: int, level: int) -> Iterator[pa.RecordBatch]:
    """Of each group the documents with a signature near that of a document of another component, and of the other side if there are two.

    Two documents may share many lists (blocks below 0) and have to meet in one: the pairs that they share before the list's own are ``level`` in number in the first of them only.
    """
    for t in _grouped(batches, 2):
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        a, b = (np.flatnonzero(side == x) for x in (0, 1)) if side.any() or t.column("block")[0].as_py() >= 0 else (np.arange(len(comp)),) * 2
        if not len(a) or not len(b) or comp.min() == comp.max():
            continue
        sig = _stacked(t.column("sig"), coordinates)
        x, y = sig[a].T.copy(), sig[b].T.copy()
        agree = np.zeros((len(a), len(b)), np.uint8)
        for k in range(coordinates):
            agree += x[k, :, None] == y[k]
        near = (agree >= matches) & (comp[a, None] != comp[b])
        if t.column("block")[0].as_py() < 0 and near.any():
            order = _ranked(sig[a], counts, coordinates)[0] >> 32  # coordinates from rare to common
            before = np.zeros((len(a), coordinates), bool)
            np.put_along_axis(before, order, np.arange(coordinates)[None, :] < t.column("rank").to_numpy()[a, None], 1)
            p, q = np.nonzero(near)
            for at in range(0, len(p), 1 << 16):
                i, j = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                near[i, j] = ((sig[a[i]] == sig[b[j]]) & before[i]).sum(axis=1) == level
        keep = np.zeros(len(comp), bool)
        keep[a[near.any(axis=1)]] = True
        keep[b[near.any(axis=0)]] = True
        if keep.any():
            yield from t.select(["token", "block", "node", "comp"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _link(batches: Iterator[pa.RecordBatch], percent: int, words: int) -> Iterator[pa.RecordBatch]:
    """Of each group the links that join different components, as a forest: between two components one is enough."""
    for t in _grouped(batches, 2):
        comp = t.column("comp").to_numpy()
        if len(comp) < 2:
            continue
        sets = [s for c in t.column("text").chunks for s in shingles(c, words)]
        sizes = np.array([len(s) for s in sets])
        values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = times[where] > 1
        row, column = row[shared], (np.cumsum(times > 1) - 1)[where[shared]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, z = np.searchsorted(column, (start, start + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:z], column[a:z] - start] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        near = np.triu((100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (comp[:, None] != comp[None, :]))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = top(int(comp[x])), top(int(comp[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(int(comp[x]))
                b.append(int(comp[y]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _composed(found: DataFrame | None, upper: DataFrame) -> DataFrame:
    """Components of components: ``node, component``."""
    if found is None:
        return upper
    top = upper.select(F.col("node").alias("component"), F.col("component").alias("_top"))
    out = written(found.join(top, "component", "full").select(F.coalesce("node", "component").alias("node"), F.coalesce("_top", "component").alias("component")), "components")
    removed(found, upper)
    return out


def _named(rows: DataFrame, found: DataFrame | None, node: str, name: str) -> DataFrame:
    """``rows`` with the component of a node, itself where it has no other."""
    if found is None:
        return rows.withColumn(name, F.col(node))
    return rows.join(found.select(F.col("node").alias("_node"), F.col("component").alias("_up")), F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_up", node)).drop("_node", "_up")


def near_groups(docs: DataFrame, percent: int = 80, words: int = 5, coordinates: int = 64, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked whose sets have 100 * intersection >= ``percent`` * union.
    """
    if not 1 <= coordinates <= 255:  # agreements are counted in bytes
        raise ValueError("a signature has 1 to 255 coordinates")
    small_batches(docs.sparkSession)
    matches = least_matches(coordinates, percent / 100, miss)
    prefix = coordinates - matches + 1
    signed = written(_signatures_of(docs, id_col, text_col, words, coordinates), "signatures")
    nodes = written(signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n")), "nodes")
    all_rows = written(signed.select("doc_id", "n_shingles", "set_key"), "rows")
    removed(signed)
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(nodes, coordinates, nodes.count()))

    found, postings, level = None, _postings(nodes, shared, coordinates, prefix), 0
    while True:
        # members of lists of two or more, and each list's leader
        leader = F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("top")
        lists = written(postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"), leader).where("n > 1").select("token", (-F.col("top.minus")).alias("leader")), "lists")
        held = written(postings.join(lists, "token").select("token", "node", "rank", "leader"), "held")
        removed(lists)
        pairs = held.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        if found is not None:  # most are of one component by now
            pairs = _named(_named(pairs, found, "a", "_ca"), found, "b", "_cb").where("_ca <> _cb").select("a", "b")
        pairs = written(_screen(pairs, nodes, coordinates, matches), "pairs")
        links = _confirm(pairs, docs, id_col, text_col, words, percent)
        removed(pairs)
        upper = components(_named(_named(links, found, "a", "_ca"), found, "b", "_cb").select(F.col("_ca").alias("a"), F.col("_cb").alias("b")))
        removed(links)
        found = _composed(found, upper)

        # lists that still hold several components: how many documents are not of the largest
        placed = written(_named(held.where("node <> leader").select("token", "node", "rank"), found, "node", "comp"), "placed")
        removed(held)
        sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
        about = sizes.groupBy("token").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top")).select("token", "n", F.col("top.comp").alias("most"), (F.col("n") - F.col("top.m")).alias("others")).where("others > 0")
        about = written(about, "open")
        fits = F.lit(True) if level == matches - 1 else F.col("others") <= BLOCK  # in the end all share as many pairs as it takes
        rest = written(placed.join(about, "token").where("comp <> most").select("token", "node", "comp", "rank", "most", "others"), "rest")
        removed(placed, about)
        narrow = _among(rest.where(fits & (F.col("others") > 1))).unionByName(_stars(rest, found))
        blocks = _shuffled(narrow).join(nodes.select("node", "sig"), "node").select("token", "block", "node", "comp", "sig", "rank", "side")
        alive = written(blocks.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(lambda bs, level=level: _alive(bs, shared.value, coordinates, matches, level), "token long, block int, node long, comp long"), "alive")
        full = _with_texts(docs, alive, id_col, text_col).select("token", "block", "node", "comp", "text")
        across = written(full.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(lambda bs: _link(bs, percent, words), "a long, b long"), "across")
        removed(alive)
        found = _composed(found, components(across))
        wide = written(rest.where(~fits).select("token", "node", "rank"), "wide")
        removed(across, rest)
        level += 1
        if wide.isEmpty():
            break
        postings = _parted(wide, nodes, shared, coordinates, prefix + level)

    # of equal sets the smallest id stands for all
    named = _named(nodes.select("set_key", "node", "n"), found, "node", "_component")
    named = written(named.where("n > 1 or _component <> node").select("set_key", "_component"), "named")
    # rows without a set are a group of their own and need no partner
    full = all_rows.where("set_key is not null").join(named, "set_key", "left").unionByName(all_rows.where("set_key is null").withColumn("_component", F.lit(None).cast("long")))
    out = written(
        full.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "groups",
    )
    removed(all_rows, nodes, named, found, wide)
    shared.destroy()
    return out


def drop_near(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, all columns as they were."""
    groups = near_groups(docs, percent, words, id_col=id_col, text_col=text_col)
    gone = free_names(docs, "gone")[0]
    dropped = groups.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(id_col).cast("long") == F.col(gone), "left_anti")
