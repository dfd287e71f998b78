"""Toxicity scores from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, compatibility forms, homoglyphs and digits that stand for
letters. The lexicon holds word beginnings and whole words with the log-odds of toxic against other
documents. Exception phrases (``exceptions`` and those learnt) cancel the hits inside them. A document's
hits, also divided by its length in words, go through a small logistic model.

Fitting uses at most ``max_rows`` labelled documents (a documented bound, drawn by a hash of the id; two
thirds give the lexicon, one third the logistic model). Scoring covers every document and whole texts.

Defined cases: a null or empty text has no hits and gets the score of a text without hits; rows repeated
get the same score; labels that are null don't count; without labelled rows of both kinds every
score is the share of toxic labels, or 0. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .space import small_batches, written
from .words import slices

# Letters that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_SIGNS = re.compile(r"(?<=\w)[@$!](?=\w)")
_SIGN_LETTERS = {"@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) if x.isalnum() or unicodedata.combining(x) else " " for x in c)
        self[code] = c
        return c


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, each with a blank before and one after."""
    text = text or ""
    if "@" in text or "$" in text or "!" in text:
        text = _SIGNS.sub(lambda m: _SIGN_LETTERS[m[0]], text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class Model:
    """Bounded by ``max_lexicon`` patterns."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)


def automaton(model: Model):
    a = ahocorasick.Automaton()
    for p, w in model.lexicon.items():
        a.add_word(p, (len(p), w))
    for p in model.exceptions:
        a.add_word(p, (len(p), None))
    if len(a):
        a.make_automaton()
    return a


def hits(a, folded: str) -> list[float]:
    """The weight of each word that the lexicon matches, the heaviest match counting, outside exception phrases."""
    if not len(a):
        return []
    found: dict[int, float] = {}
    spans = []
    for end, (length, weight) in a.iter(folded):
        start = end - length + 1
        if weight is None:
            spans.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    if spans:
        spans.sort()
        first = [s for s, _ in spans]
        reach = list(accumulate((e for _, e in spans), max))  # how far the spans up to each one go
        found = {s: w for s, w in found.items() if not (k := bisect_right(first, s)) or reach[k - 1] <= s}
    return list(found.values())


def _features(a, text: str | None) -> list[float]:
    folded = fold(text)
    words = folded.count(" ") - 1
    h = hits(a, folded)
    total = sum(h)
    return [1.0, math.log1p(total), total / max(words, 1), max(h, default=0.0), math.log1p(len(h))]


def _tokens_of(text: str | None, longest: int) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(3, min(len(w), longest) + 1))
    return out


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, keep: Column) -> DataFrame:
    """At most about ``max_rows`` labelled rows: ``doc_id, text, toxic, part``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_rows)
    small = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most max_rows ids: small enough to send everywhere, so that texts stay where they are
    return small.join(F.broadcast(known), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, max_rows: int = 30_000, max_lexicon: int = 2_000, min_df: int = 5, min_odds: float = 2.0, longest: int = 8, exceptions: tuple[str, ...] = ()) -> Model:
    """Learns lexicon, exceptions and weights. ``keep`` is a condition on the labels' ``doc_id``."""
    small_batches(docs.sparkSession)
    rows = written(sample(docs, labels, max_rows, id_col, text_col, F.lit(True) if keep is None else keep), "toxic-sample")
    counts = {(r["toxic"], r["lex"]): r["n"] for r in rows.groupBy("toxic", (F.col("part") < 2).alias("lex")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get((1, True), 0), counts.get((0, True), 0)
    n1, n0 = bad + counts.get((1, False), 0), good + counts.get((0, False), 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    base = Model(weights=[math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0, 0.0])
    if not bad or not good or not counts.get((1, False)) or not counts.get((0, False)):
        return base

    def patterns(batches):
        seen: dict[str, list[int]] = {}

        def out():
            keys = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64())], ["pattern", "bad", "good"])
            seen.clear()
            return batch

        for b in slices(batches, 0, 4 << 20):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t in _tokens_of(text, longest):
                    seen.setdefault(t, [0, 0])[y] += 1
            if len(seen) > 300_000:
                yield out()
        yield out()

    table = rows.where("part < 2").select("text", "toxic").mapInArrow(patterns, "pattern string, bad long, good long").groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    best = table.where(F.col("bad") >= min_df).withColumn("odds", odds).where(F.col("odds") >= min_odds).orderBy((F.col("odds") * F.log1p("bad")).desc(), "pattern").limit(max_lexicon)
    # a beginning that occurs hardly more often than a longer pattern of the lexicon gives way to that
    lexicon: dict[str, float] = {}
    covered: dict[str, int] = {}
    for r in sorted(best.collect(), key=lambda r: (-len(r["pattern"]), r["pattern"])):
        if r["bad"] * 0.95 > covered.get(r["pattern"], 0):
            lexicon[r["pattern"]] = float(r["odds"])
            for k in range(4, len(r["pattern"])):
                covered[r["pattern"][:k]] = max(covered.get(r["pattern"][:k], 0), r["bad"])
    model = Model(lexicon, [fold(e) for e in exceptions], base.weights)

    def phrases(batches):
        a = automaton(model)
        for b in slices(batches, 0, 4 << 20):
            seen: dict[str, list[int]] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, found = fold(text), set()
                for end, (length, _) in a.iter(folded) if len(a) else ():
                    start = end - length + 1
                    after = folded.find(" ", start + 1)
                    before = folded.rfind(" ", 0, start)
                    if before >= 0:
                        found.add(folded[before : after + 1])
                    if (last := folded.find(" ", after + 1)) > 0:
                        found.add(folded[start : last + 1])
                for p in found:
                    seen.setdefault(p, [0, 0])[y] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64())], ["pattern", "bad", "good"])

    excused = rows.where("part < 2").select("text", "toxic").mapInArrow(phrases, "pattern string, bad long, good long").groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    excused = excused.where((F.col("good") >= min_df) & (odds < 0)).orderBy(F.col("good").desc(), "pattern").limit(max_lexicon)
    model.exceptions += [r["pattern"] for r in excused.collect()]

    def measured(batches):
        a = automaton(model)
        for b in slices(batches, 0, 4 << 20):
            x = np.array([_features(a, t) for t in b.column(0).to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(5)), b.column(1).cast(pa.float64())], [*"abcde", "y"])

    # at most max_rows rows of six numbers
    data = rows.where("part = 2").select("text", "toxic").mapInArrow(measured, "a double, b double, c double, d double, e double, y double").toPandas().to_numpy()
    model.weights = _logistic(data[:, :5], data[:, 5])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_hits, hit_weight`` for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        a = automaton(model)
        w = np.array(model.weights)
        for b in slices(batches, 1, 4 << 20):
            x = np.array([_features(a, t) for t in b.column(1).to_pylist()]).reshape(-1, 5)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int64)), pa.array(np.expm1(x[:, 1]))], ["doc_id", "score", "n_hits", "hit_weight"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long, hit_weight double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more, other columns as they were."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        a = automaton(model)
        w = np.array(model.weights)
        for b in slices(batches, at, 4 << 20):
            x = np.array([_features(a, t) for t in b.column(at).to_pylist()]).reshape(-1, 5)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))
