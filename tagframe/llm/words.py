"""Words of many texts at once: parted and numbered in Arrow, hashed in numpy, so that only distinct words cost Python time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
_C1, _C2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: White space other than the six ASCII blanks.
_WIDE_BLANK = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Longer words are hashed one by one.
_SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


class Words(NamedTuple):
    distinct: pa.Array
    ids: np.ndarray  # of each word its place among the distinct ones
    sizes: np.ndarray  # words of each text


_HELD: dict = {}


def held(key, make):
    """What a worker keeps between tasks: one thing at a time, until an operator that doesn't ask for it runs there."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _release() -> None:
    """Gives freed memory back to the system, so that a reused worker doesn't keep the most that any task has needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a string or binary column, a longer value alone. What the worker
    has ``held`` goes unless ``keep``; in the end freed memory goes back to the system."""
    if not keep and _HELD:
        _HELD.clear()
        _release()
    try:
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            start = 0
            while start < len(size):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] - size[start] + most, "right")))
                yield b.slice(start, stop - start)
                start = stop
    finally:
        _release()


def _numbered(lists: pa.ListArray) -> Words:
    sizes = np.diff(lists.offsets.to_numpy())
    coded = pc.dictionary_encode(lists.flatten())
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # blanks at an end of a text, and empty texts, part off empty words
    blank = np.flatnonzero(pc.binary_length(distinct).to_numpy(zero_copy_only=False) == 0)
    if len(blank):
        full = ids != blank[0]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        ids = ids[full]
    return Words(distinct, ids, sizes.astype(np.int64))


def ascii_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words between the six ASCII blanks, A-Z in lower case unless told otherwise; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return _numbered(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))


def unicode_words(texts: pa.Array) -> Words:
    """Words as ``str.split`` parts them."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return _numbered((pc.utf8_split_whitespace if pc.any(pc.match_substring_regex(texts, _WIDE_BLANK)).as_py() else pc.ascii_split_whitespace)(texts))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every batch."""
    n = len(words)
    if not n:
        return np.empty(0, _U)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, n + 1, words.offset * 4).astype(np.int64)
    start, size = offsets[:-1], np.diff(offsets)
    raw = np.concatenate([np.frombuffer(data, np.uint8, offsets[-1]) if data is not None else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # eight bytes from each place
    with np.errstate(over="ignore"):
        out = mix(size.astype(_U) * _GOLD + _GOLD)
        for at in range(0, _SHORT, 8):
            live = np.flatnonzero(size > at)
            rest = np.minimum(size[live] - at, 8).astype(_U)
            block = eight[start[live] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - rest * _U(8)))
            out[live] = mix((out[live] ^ block) * _C2 + _GOLD)
    for i in np.flatnonzero(size > _SHORT):
        out[i] = xxhash.xxh3_64_intdigest(words[int(i)].as_buffer())
    return out
