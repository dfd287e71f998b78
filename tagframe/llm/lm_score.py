"""Scores texts by a hashed maximum-entropy language model with a class-factored softmax.

Every token has a class: frequent words are grouped by the company that they keep and by frequency, the end of a text is a
class of its own, and all rarer words share one. P(class | history) is a softmax over sums of hashed feature rows - the words
before, pairs of them, skips, their classes and what prevails in the last words. P(word | class, history) is factored on
inside the class: its words, the most frequent first, are halved by weight again and again down to single words, and each half is
a softmax of two whose score is a sum of cells hashed from the same features and the half. Rarer words have their
shares of counts in their class, unknown words standing for one word of count 0. So probabilities add up to 1 over the
words of the training texts and one unknown.

Training makes ``rounds`` passes over all training texts. Each pass adds up, in numpy batches inside the tasks and then by
block across them, how often every feature met every outcome and how often the model expected it to: the gradient of the
likelihood. Then every weight takes one step of scaling, by the logarithm of what was met over what was expected,
drawn towards no change by ``strength`` tokens, divided by the number of features of a token. The sums are those of all texts, so
the result doesn't depend on partitions but for rounding.

The counts of all words are a table that grows with the corpus. What the driver and tasks hold whole is bounded by
``frequent``, ``rows`` and ``cells``.

Defined cases: null and empty texts consist of the end alone; a null id counts as a training row; rows
repeated are scored each. Without training rows every score is that of one unknown word among none (0). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .space import small_batches, written
from .words import ascii_words, hashes, mix, slices

_U = np.uint64
_GOLD32, _ODD32 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: No word holds a blank.
END_KEY = int(hashes(pa.array([" end"])).view(np.int64)[0])
WINDOW = 16
GROUPS, BINS, COMMON = 8, 1, 64
TEMPLATES = 6
#: Parts of the cells, one for each template.
PARTS = 8
#: Tokens that are handled at once.
STEP = 1 << 13
BLOCK = 1 << 16


def fold_of(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


@dataclass
class Vocabulary:
    """Bounded by the number of frequent words: sorted keys and their ranks; by rank: count, class, group; by class: total."""

    keys: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    classes: np.ndarray  # the last two are the end and all rarer words
    groups: np.ndarray
    totals: np.ndarray
    tokens: int
    words: int
    least: int  # frequent words, but for the end, have this level of counts or more

    @property
    def prior(self) -> np.ndarray:
        """Logarithms of the classes' shares, on which the features' sums are added."""
        return np.log(np.maximum(self.totals / self.totals.sum(), 1e-9)).astype(np.float32)

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)


def _level(c: str = "c") -> Column:
    """Counts below 1,024 as they are, greater ones by the 64th of a doubling: some thousands of levels at most."""
    return F.when(F.col(c) < 1024, F.col(c)).otherwise(F.floor(F.log2(c) * 64) + 384).cast("int")


def _counts(train: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches, 0):
            words = ascii_words(b.column(0))
            keys = np.append(hashes(words.distinct).view(np.int64), END_KEY)
            n = np.append(np.bincount(words.ids, minlength=len(words.distinct)), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"]).filter(pa.array(n > 0))

    return train.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def _ranks(texts: pa.Array, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of all tokens of some texts, ends included, tokens of each text, and keys of the tokens; rarer words have the rank after the last."""
    words = ascii_words(texts)
    mine = np.append(hashes(words.distinct).view(np.int64), END_KEY)
    rank = np.full(len(mine), len(keys), np.int32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        found = keys[at] == mine
        rank[found] = ranks[at[found]]
    ids = np.full(len(words.ids) + len(words.sizes), len(mine) - 1, np.int32)
    ids[np.arange(len(words.ids)) + np.repeat(np.arange(len(words.sizes)), words.sizes)] = words.ids
    return rank[ids], words.sizes + 1, mine[ids]


def _company(train: DataFrame, keys: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """How often each frequent word stands within three words of each of the most common: ``rank, common, n``."""

    def run(batches):
        for b in slices(batches, 0):
            r, n, _ = _ranks(b.column(0), keys, ranks)
            text = np.repeat(np.arange(len(n)), n)
            pairs = []
            for d in (1, 2, 3):
                same = text[d:] == text[:-d]
                x, y = r[d:], r[:-d]
                for p, q in ((x, y), (y, x)):
                    keep = same & (q < min(COMMON, len(keys))) & (p < len(keys))
                    pairs.append(p[keep] * np.int32(COMMON) + q[keep])
            cell, times = np.unique(np.concatenate(pairs), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cell // COMMON).astype(np.int32)), pa.array((cell % COMMON).astype(np.int32)), pa.array(times.astype(np.int64))], ["rank", "common", "n"])

    return train.select("text").mapInArrow(run, "rank int, common int, n long").groupBy("rank", "common").agg(F.sum("n").alias("n"))


def _cluster(matrix: np.ndarray, groups: int) -> np.ndarray:
    """Groups of the common words by the company that they keep: k-means from the farthest rows."""
    x = np.log1p(matrix)
    x -= x.mean(axis=0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [0]
    while len(centres) < min(groups, len(x)):
        centres.append(int(np.argmin((x @ x[centres].T).max(axis=1))))
    c = x[centres]
    for _ in range(30):
        label = np.argmax(x @ c.T, axis=1)
        c = np.array([x[label == g].mean(axis=0) if (label == g).any() else c[g] for g in range(len(c))])
    return label


def _groups(train: DataFrame, keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """By rank the group of common words in whose company a word is found most."""
    size = len(keys)
    groups = np.zeros(size, np.int32)
    company = written(_company(train, keys, ranks), "company")
    common = np.zeros((COMMON, COMMON))
    for r in company.where(F.col("rank") < COMMON).collect():
        common[r["rank"], r["common"]] = r["n"]
    label = _cluster(common[: min(COMMON, size)], GROUPS)
    names = F.array(*[F.lit(int(x)) for x in label])
    weight = common[: len(label), : len(label)].sum(axis=0)
    rarity = F.array(*[F.lit(float(1 / math.sqrt(w + 1))) for w in weight])
    by_group = company.groupBy("rank", F.get(names, F.col("common")).alias("g")).agg(F.sum(F.col("n") * F.get(rarity, F.col("common"))).alias("w"))
    best = by_group.groupBy("rank").agg(F.max_by("g", F.struct("w", -F.col("g"))).alias("g")).toPandas()  # a row per frequent word
    groups[best["rank"].to_numpy()] = best["g"].to_numpy(np.int32)
    return groups


def vocabulary(train: DataFrame, counts: DataFrame, frequent: int = 1 << 18) -> Vocabulary:
    """The words that occur twice or more, at most ``frequent``: those of the highest levels of counts that fit whole."""
    levels = counts.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).orderBy(F.col("level").desc()).collect()
    tokens, words = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    least, size = 1 << 30, 0
    for r in levels:
        size += r["v"]
        if size > frequent or r["level"] < 2:
            break
        least = r["level"]
    top = counts.where((_level() >= least) | (F.col("key") == END_KEY)).toPandas().sort_values(["c", "key"], ascending=[False, True])  # ``frequent`` rows and one
    size = len(top)
    order = np.argsort(top["key"].to_numpy(), kind="stable")
    keys, ranks, count = top["key"].to_numpy(np.int64)[order], order.astype(np.int32), top["c"].to_numpy(np.int64)
    groups = _groups(train, keys, ranks) if size else np.zeros(0, np.int32)
    classes, used = np.zeros(size, np.int32), 0
    for g in range(GROUPS):  # bins of equal weight in each group, the most frequent words first
        mine = np.flatnonzero(groups == g)
        if len(mine):
            sums = np.cumsum(count[mine])
            classes[mine] = used + np.minimum(BINS - 1, ((sums - count[mine]) * BINS // sums[-1]).astype(np.int32))
            used += BINS
    end = ranks[np.searchsorted(keys, END_KEY)] if size else 0
    if size:
        classes[end] = used
    classes = np.unique(classes, return_inverse=True)[1].astype(np.int32)
    rare_class = int(classes[end]) + 1 if size else 0
    totals = np.bincount(classes, weights=count + 0.5, minlength=rare_class + 1)
    totals[rare_class] = tokens - count.sum() + 0.5 * (words - size) + 0.5
    return Vocabulary(keys, ranks, count, np.append(classes, rare_class).astype(np.int32), np.append(groups, GROUPS).astype(np.int32), totals, tokens, words, least)


class Halves:
    """How the words of each class are halved by weight down to single words: by rank, the halves on a word's way and the side that it takes."""

    def __init__(self, v: Vocabulary):
        order = np.argsort(v.classes[:-1], kind="stable")
        total = np.concatenate([[0.0], np.cumsum(v.counts[order] + 0.5)])
        b = np.cumsum(np.bincount(v.classes[:-1], minlength=len(v.totals)))
        a = np.concatenate([[0], b[:-1]])
        #: by half the logarithm of its second side's weight over the first's, and the second side's share
        self.prior = np.zeros(len(order) + 1, np.float32)
        words, halves, sides = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, bool)]
        while (open_ := b - a > 1).any():
            a, b = a[open_], b[open_]
            middle = (total[a] + total[b]) / 2
            cut = np.searchsorted(total, middle)
            cut = np.clip(np.where(middle - total[cut - 1] < total[cut] - middle, cut - 1, cut), a + 1, b - 1)
            self.prior[cut] = np.log((total[b] - total[cut]) / (total[cut] - total[a]))
            size = b - a
            word = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            half = np.repeat(cut, size)
            words.append(order[word])
            halves.append(half.astype(np.int32))
            sides.append(word >= half)
            a, b = np.concatenate([a, cut]), np.concatenate([cut, b])
        self.share = 1 / (1 + np.exp(-self.prior))
        words = np.concatenate(words)
        by_word = np.argsort(words, kind="stable")
        self.halves, self.sides = np.concatenate(halves)[by_word], np.concatenate(sides)[by_word]
        self.steps = np.bincount(words, minlength=len(v.classes))
        self.first = np.cumsum(self.steps) - self.steps

    def ways(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all steps on the ways of some tokens: the token, the half and the side taken."""
        steps = self.steps[ranks]
        ends = np.cumsum(steps)
        at = np.repeat(self.first[ranks] - (ends - steps), steps) + np.arange(int(ends[-1]) if len(ends) else 0)
        return np.repeat(np.arange(len(ranks)), steps), self.halves[at], self.sides[at]


def _features(r: np.ndarray, n: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Hashes of the features of each token: ``TEMPLATES`` by tokens."""
    start = np.repeat(np.cumsum(n) - n, n)
    at = np.arange(len(r))
    none = len(v.keys) + 1
    h = [np.where(at - d >= start, r[np.maximum(at - d, 0)], none).astype(_U) for d in (1, 2, 3)]
    classes = np.append(v.classes, len(v.totals)).astype(_U)
    c = [classes[x.astype(np.int64)] for x in h]
    prevails, strength = np.zeros(len(r), np.int32), np.zeros(len(r), np.int32)
    back = np.maximum(at - WINDOW, start)
    mine = v.groups[r]
    for g in range(GROUPS):  # of equal ones the first
        seen = np.concatenate([[0], np.cumsum(mine == g, dtype=np.int32)])
        lately = seen[at] - seen[back]
        more = lately > strength
        prevails[more] = g
        np.maximum(strength, lately, out=strength)
    raw = (h[0], h[1], h[0] * _U(1 << 20) + h[1], h[2], (c[0] * _U(1 << 16) + c[1]) * _U(1 << 16) + c[2], prevails.astype(_U) * _U(WINDOW + 1) + strength.astype(_U))
    return np.stack([mix(x * _U(TEMPLATES) + _U(k) + _U(1)) for k, x in enumerate(raw)])


@dataclass
class Weights:
    """Rows of the classes' softmax, and the cells of the halves; both in powers of two."""

    classes: np.ndarray
    cells: np.ndarray

    @classmethod
    def none(cls, v: Vocabulary, rows: int, cells: int) -> Weights:
        return cls(np.zeros((rows, len(v.totals)), np.float32), np.zeros(cells, np.float32))


def cell_of(feature: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Cells of one template's features and halves: every template has a part of its own, small enough for a processor's cache."""
    h = feature ^ keys
    h *= _ODD32
    h >>= np.uint32(33 - (cells // PARTS).bit_length())
    return h.astype(np.int64)


class Batch:
    """The sparse form of some tokens - rows and cells of their features - and the model's chances of all that they meet; without weights
    the chances of halves are their shares and those of classes are left out."""

    def __init__(self, w: Weights | None, shape: tuple[int, int, int], halves: Halves, prior: np.ndarray, features: np.ndarray, ranks: np.ndarray):
        rows, _, cells = shape
        self.rows = (features & _U(rows - 1)).astype(np.int64)
        self.token, half, self.sides = halves.ways(ranks)
        keys = half.astype(np.uint32) * _GOLD32
        upper = (features >> _U(32)).astype(np.uint32)
        self.cells: list[np.ndarray] = []
        self.chances = None  # by class, then token
        if w is None:
            for x in upper:
                self.cells.append(cell_of(x[self.token], keys, cells))
            self.second = halves.share[half]
            return
        z = w.classes[self.rows[0]]
        for x in self.rows[1:]:
            z += w.classes[x]
        z = np.ascontiguousarray(z.T)
        z += prior[:, None]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        self.chances = z
        y, part = halves.prior[half], cells // PARTS
        for k, x in enumerate(upper):
            at = cell_of(x[self.token], keys, cells)
            y += w.cells[k * part : (k + 1) * part][at]
            self.cells.append(at)
        np.negative(y, out=y)
        np.exp(y, out=y)
        y += 1
        self.second = np.reciprocal(y, out=y)  # the chance of the second side


def log_chances(w: Weights, halves: Halves, v: Vocabulary, features: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Logarithms of P(class | history) P(word | class, history), the second left out in the class of all rarer words."""
    b = Batch(w, (*w.classes.shape, len(w.cells)), halves, v.prior, features, ranks)
    out = np.log(np.maximum(b.chances[v.classes[ranks], np.arange(len(ranks))].astype(np.float64), 1e-30))
    taken = np.where(b.sides, b.second, 1 - b.second)
    return out + np.bincount(b.token, weights=np.log(np.maximum(taken, 1e-30)), minlength=len(ranks))


class Sums:
    """What a task adds up in a round: what is expected of each feature and outcome and, in the first round, what is met."""

    def __init__(self, rows: int, classes: int, cells: int, met: bool):
        self.shape, self.met = (rows, classes, cells), met
        sizes = [rows * classes + cells, rows * classes + cells, rows + cells] if met else [rows * classes + cells]
        self.parts = [np.zeros(n) for n in sizes]
        #: Single precision is enough for the tokens between two calls of ``settle``.
        self.open = [np.zeros(n, np.float32) for n in sizes]

    def add(self, b: Batch, classes: np.ndarray) -> None:
        (rows, width, cells), one = self.shape, np.float32(1)
        size, part, outcomes = rows * width, cells // PARTS, np.arange(width)[:, None]
        # types that came out of a broadcast are equal to numpy's own but not the same, which ``add.at`` answers by its slow way
        second, sides = b.second.astype(np.float32), b.sides.astype(np.float32)
        chances = None if b.chances is None else b.chances.astype(np.float32).ravel()
        for k, (row, cell) in enumerate(zip(b.rows, b.cells, strict=True)):
            at, first = row * width, size + k * part
            if chances is not None:
                np.add.at(self.open[0], (at + outcomes).ravel(), chances)
            np.add.at(self.open[0][first : first + part], cell, second)
            if self.met:
                np.add.at(self.open[1], at + classes, one)
                np.add.at(self.open[1][first : first + part], cell, sides)
                np.add.at(self.open[2], row, one)
                np.add.at(self.open[2][rows + k * part : rows + (k + 1) * part], cell, one)

    def settle(self) -> list[np.ndarray]:
        """Adds what is open to the sums, and returns them."""
        for total, x in zip(self.parts, self.open, strict=True):
            total += x
            x[:] = 0
        return self.parts


def stepped(w: Weights, expected: np.ndarray, seen: np.ndarray, times: np.ndarray, strength: float) -> Weights:
    """One step of scaling of every weight."""
    rows, width = w.classes.shape
    size = rows * width

    def share(met, wanted, n):
        """What was expected of ``n`` tokens, and what was met, drawn towards that."""
        p = np.clip(wanted / np.maximum(n, 1), 1e-7, 1 - 1e-7)
        return p, np.clip((met + strength * p) / (n + strength), 1e-7, 1 - 1e-7)

    p, q = share(seen[:size].reshape(rows, width), expected[:size].reshape(rows, width), times[:rows, None])
    classes = w.classes + np.where(times[:rows, None] > 0, np.log(q / p) / TEMPLATES, 0)
    p, q = share(seen[size:], expected[size:], times[rows:])
    cells = w.cells + np.where(times[rows:] > 0, (np.log(q / (1 - q)) - np.log(p / (1 - p))) / TEMPLATES, 0)
    return Weights(classes.astype(np.float32), cells.astype(np.float32))


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of vectors of equal blocks, which follow each other."""

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    at, total = None, None
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.float32)
            if k != at:
                if at is not None:
                    yield done()
                at, total = k, np.zeros(len(x))
            total += x
    if at is not None:
        yield done()


def sums_of(train: DataFrame, v, halves, weights, shape: tuple[int, int, int]) -> list[np.ndarray]:
    """What the model of ``weights`` expects of all training texts or, without weights, what their shares do and what the texts hold.
    ``v``, ``halves`` and ``weights`` are broadcast; ``shape``: rows, classes and cells."""
    met = weights is None

    def run(batches):
        voc, ways, w = v.value, halves.value, None if met else weights.value
        sums, prior = Sums(*shape, met), voc.prior
        with np.errstate(over="ignore"):
            for b in slices(batches, 0, 4 << 20):
                r, n, _ = _ranks(b.column(0), voc.keys, voc.ranks)
                f = _features(r, n, voc)
                for i in range(0, len(r), STEP):
                    sums.add(Batch(w, shape, ways, prior, f[:, i : i + STEP], r[i : i + STEP]), voc.classes[r[i : i + STEP]])
                sums.settle()
        first = 0
        for x in sums.parts:
            for k in range(0, len(x), BLOCK):
                part = x[k : k + BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([first + k // BLOCK], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])
            first += -(-len(x) // BLOCK)

    blocks = train.select("text").mapInArrow(run, "block int, sums binary").repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "block int, sums binary")
    out = Sums(*shape, met).parts
    places = [part[k : k + BLOCK] for part in out for k in range(0, len(part), BLOCK)]
    for r in blocks.toLocalIterator():  # as large as the weights
        places[r["block"]][:] = np.frombuffer(r["sums"])
    if met:  # of classes every row expects their shares
        rows, width, _ = shape
        out[0][: rows * width] = np.outer(out[2][:rows], np.exp(v.value.prior)).ravel()
    return out


def fit(train: DataFrame, v: Vocabulary, halves: Halves, rows: int = 1 << 14, rounds: int = 2, cells: int = 1 << 18, strength: float = 10.0) -> Weights:
    """Weights of all features, ``rows`` and ``cells`` being powers of two: every round reads all training texts."""
    context = train.sparkSession.sparkContext
    weights, shape = Weights.none(v, rows, cells), (rows, len(v.totals), cells)
    if not v.tokens or not rounds:
        return weights
    shared = [context.broadcast(v), context.broadcast(halves)]
    expected, *met = sums_of(train, *shared, None, shape)
    weights = stepped(weights, expected, *met, strength)
    for _ in range(rounds - 1):
        common = context.broadcast(weights)
        weights = stepped(weights, *sums_of(train, *shared, common, shape), *met, strength)
        common.destroy()
    for x in shared:
        x.destroy()
    return weights


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, model double, rare array<bigint>"


def _score_frequent(docs: DataFrame, v, halves, weights) -> DataFrame:
    """Scores without the counts of rare words, whose keys are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, ways, w = v.value, halves.value, weights.value
        row = TaskContext.get().partitionId() << 40
        base = np.append(np.log10((voc.counts + 0.5) / voc.denominator), 0.0)
        with np.errstate(over="ignore"):
            for b in slices(batches, 2, 4 << 20):
                r, n, keys = _ranks(b.column(2), voc.keys, voc.ranks)
                f, p = _features(r, n, voc), np.empty(len(r))
                for i in range(0, len(r), STEP):
                    p[i : i + STEP] = log_chances(w, ways, voc, f[:, i : i + STEP], r[i : i + STEP])
                p /= math.log(10)
                first, rare = np.cumsum(n) - n, r == len(voc.keys)
                n_rare = np.add.reduceat(rare, first, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), pa.array(keys[rare]))
                sums = [pa.array(np.add.reduceat(x, first)) for x in (base[r], p)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), b.column(0), b.column(1), pa.array(n), pa.array(n - n_rare), *sums, lists], [c.split()[0] for c in _SCORED.split(", ")])
                row += len(n)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _SCORED)


def score(docs: DataFrame, held_out: Column | None = None, frequent: int = 1 << 18, rows: int = 1 << 14, rounds: int = 2, cells: int = 1 << 18, strength: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from those not held out."""
    small_batches(docs.sparkSession, 2500)
    held = F.coalesce((fold_of(id_col) == 1) if held_out is None else held_out, F.lit(False))
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    train = data.where("not held_out")
    counts = written(_counts(train), "counts")
    v = vocabulary(train, counts, frequent)
    if not v.tokens:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\x09-\\x0D]+"), lambda x: x != "")).cast("long") + 1
        zero = F.lit(0).cast("long")
        return data.select("doc_id", "held_out", n.alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    halves = Halves(v)
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in (v, halves, fit(train, v, halves, rows, rounds, cells, strength))]
    scored = written(_score_frequent(data, *shared), "scored")
    for x in shared:
        x.destroy()
    unit, share = math.log10(v.denominator), math.log10(v.totals[-1])
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("n"))
    # frequent words are counted already: only the others can be in these lists
    found = rare.join(counts.where((_level() < v.least) & (F.col("key") != END_KEY)), "key", "left")
    c = F.coalesce("c", F.lit(0))
    sums = found.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"))
    n, logs = F.coalesce("n", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n * unit).alias("base_score"),
        (F.col("model") + logs - n * share).alias("score"),
    )
