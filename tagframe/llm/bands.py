"""Quality rules by compression: zstandard ratios over whole documents and over fixed chunks, against limits for their length.

A ratio is bytes of text over compressed bytes. Long texts compress better than short ones, so each band
of lengths has its own limits: below the lower one a text is like noise, above the upper one it repeats
itself. A document goes if its whole is outside the limits of its length, or if more than ``share`` of its
bytes lie in chunks outside the limits of theirs. Before that, counts of words, symbols, repeated lines and
repeated 8-word windows decide by two plain rules (``base_failed``).

The limits are fixed parameters, so a document's verdict doesn't depend on the other documents; nothing is
shuffled. Texts are read in batches of some 8 MB, a longer one alone.

Defined cases: a null or empty text, or one of blanks, has no words, so it fails; its ratio is 0. Words are
what stands between the six ASCII blanks, letters of either case differ. Repeated rows give equal rows.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import small_batches, utf8
from .words import ascii_words, slices

WINDOW = 8


class Band(NamedTuple):
    """Limits of the ratio for texts of ``size`` bytes or more."""

    size: int
    least: float
    most: float


#: Prose of one language lies between 1.2 at half a kilobyte and 2.8 at a megabyte; base64 and digests stay at 1.33 or below.
#: Texts under half a kilobyte are too short to tell noise by their ratio.
BANDS = (Band(0, 0.0, 2.0), Band(128, 0.0, 2.4), Band(512, 1.1, 2.5), Band(1024, 1.25, 2.6), Band(2048, 1.3, 2.7), Band(4096, 1.35, 2.8), Band(8192, 1.4, 2.9), Band(16_384, 1.4, 3.0), Band(65_536, 1.4, 3.3), Band(1 << 20, 1.4, 4.0))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks long, bad_bytes long, verdict string"


def _repeats(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each (owner, key) how often it occurs."""
    if not len(key):
        return np.zeros(0, np.int64)
    _, inverse, counts = np.unique(owner * (int(key.max()) + 1) + key, return_inverse=True, return_counts=True)
    return counts[inverse]


def repeated_words(ids: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each text the words that windows found twice or more in it cover. ``window`` is a power of two.

    Windows are numbered by doubling: a pair of numbers of windows half as long gets a number of its own.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out, rank, width = np.zeros(len(sizes), np.int64), ids.astype(np.int64), 1
    while width < window:
        if len(rank) <= width:
            return out
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1].astype(np.int64), width * 2
    starts = np.flatnonzero(owner[: len(rank)] == owner[window - 1 :])  # windows inside one text
    if not len(starts):
        return out
    starts = starts[_repeats(owner[starts], rank[starts]) > 1]
    step = np.zeros(len(ids) + 1, np.int64)
    step[starts] += 1
    step[starts + window] -= 1
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=len(sizes))


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Of each text the lines with a word that are equal to an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    coded = pc.dictionary_encode(lists.flatten())
    full = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, ids = owner[full[ids]], ids[full[ids]]
    first = np.unique(owner * max(len(full), 1) + ids) // max(len(full), 1)
    return np.bincount(owner, minlength=len(texts)) - np.bincount(first, minlength=len(texts))


def _inside(bands: tuple[Band, ...], size: int, ratio: float) -> int:
    """-1 below the limits, 1 above them, 0 inside."""
    band = bands[bisect_right(bands, size, key=lambda b: b.size) - 1]
    return -1 if ratio < band.least else int(ratio > band.most)


class Ratios:
    def __init__(self, bands: tuple[Band, ...] = BANDS, chunk: int = 4096, share: float = 0.25, level: int = 3):
        self.bands, self.chunk, self.share = bands, chunk, share
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)

    def ratio(self, data) -> float:
        return len(data) / len(self.squeeze.compress(data)) if len(data) else 0.0

    def of(self, data: bytes) -> tuple[float, int, int, str]:
        """Ratio of the whole, chunks, bytes in chunks outside their limits, and the verdict."""
        whole = self.ratio(data)
        view, n, bad = memoryview(data), len(data), 0
        if n > self.chunk:
            for at in range(0, n, self.chunk):
                part = view[at : at + self.chunk]
                bad += len(part) * bool(_inside(self.bands, len(part), self.ratio(part)))
        else:
            bad = n * bool(_inside(self.bands, n, whole))
        side = _inside(self.bands, n, whole)
        verdict = ("noise", "", "repetitive")[side + 1] or ("chunks" if bad > self.share * n else "kept")
        return whole, -(-n // self.chunk), bad, verdict


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[Band, ...] = BANDS, chunk: int = 4096, share: float = 0.25, level: int = 3, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """A row per document: counts, whether they fail, ratios, and whether the document stays (``SCHEMA``).

    ``verdict`` is the first rule that a document breaks (``base``, ``noise``, ``repetitive``, ``chunks``) or ``kept``.
    """
    if not bands or bands[0].size != 0 or list(bands) != sorted(bands):
        raise ValueError("bands must rise from 0 bytes")
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        ratios = Ratios(bands, chunk, share, level)
        for b in slices(batches, 1):
            texts = pc.fill_null(b.column(1).cast(pa.string()), "")
            words = ascii_words(texts, lower=False)
            blanks = pc.count_substring_regex(texts, r"[\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - blanks
            symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
            again = repeated_words(words.ids, words.sizes)
            failed = (words.sizes < min_words) | (100 * again > max_repeat_percent * words.sizes)
            found = [ratios.of(utf8(t)) for t in texts.to_pylist()]
            verdict = ["base" if f else x[3] for f, x in zip(failed, found, strict=True)]
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [words.sizes, chars, symbols, repeated_lines(texts), again, failed, [v == "kept" for v in verdict], sizes, *zip(*(x[:3] for x in found), strict=True), verdict]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def drop_failed(docs: DataFrame, text_col: str = "text", bands: tuple[Band, ...] = BANDS, chunk: int = 4096, share: float = 0.25, level: int = 3) -> DataFrame:
    """``docs`` without texts that compress too well or too badly, other columns as they were."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        ratios = Ratios(bands, chunk, share, level)
        for b in slices(batches, at):
            yield b.filter(pa.array([ratios.of(utf8(t))[3] == "kept" for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
