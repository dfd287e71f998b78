"""Token ids of whole texts, through a bounded cache of words."""

from __future__ import annotations

import codecs
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import hashes, held, unicode_words

#: White space that splitting texts knows and the tokenizer's own expression does not.
_ODD = "[\x1c-\x1f]"
#: A word of Latin letters and signs after it, which the tokenizer keeps together (an apostrophe may part them). A letter whose other
#: forms are not simply those in lower case may take a mark along, which joins the signs; such words aren't parted.
_SIGNED = r"^(?P<stem>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]+)(?P<sign>[!-&(-/:-@\[-`{-~]+)$"
_NOT_LATIN = r"[^\x{00}-\x{17f}]|\x{130}"
# How the one kind of tokenizer that may be used by the word takes texts apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The characters that stand for bytes in such a vocabulary; the blank is left to part words.
_BYTES = "".join(chr(b) for b in range(256))
_BYTES = _BYTES.translate({b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))} | {32: 32})


def file_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def take(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class CachedEncoder:
    """Encodes texts that split into independent words, each distinct word once while it is in the cache.

    Beyond ``max_words`` words the cache keeps the first ``keep_words``: common words are met early.
    Results don't depend on it.
    """

    def __init__(self, max_words: int = 400_000, keep_words: int = 150_000):
        self.max_words, self.keep_words = max_words, keep_words
        self._reset()

    def split(self, text: str) -> list[str] | None:
        """Words of a text; None if it has to be encoded as one."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _append(self, known: int, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of words that follow the ``known`` ones."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while known + len(sizes) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.start[known + 1 : known + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _learn(self, words: list[str]) -> None:
        got = self.encode_words(words)
        n = len(self.index)
        self._append(n, np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got))), np.fromiter(map(len, got), np.int64, len(got)))
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def _shrink(self) -> None:
        kept = list(self.index)[: self.keep_words]
        self.index = dict(zip(kept, range(len(kept)), strict=True))
        self.used = int(self.start[len(kept)])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.max_words:
            self._shrink()
        out = []
        words = [self.split(t or "") for t in texts]
        new = set().union(*(w for w in words if w is not None)).difference(self.index)
        if new:
            self._learn(sorted(new))
        for text, w in zip(texts, words, strict=True):
            if w is None:
                out.append(np.array(self.encode_whole(text), np.uint32))
                continue
            at = np.fromiter(map(self.index.__getitem__, w), np.int64, len(w))
            out.append(take(self.flat, self.start[at], self.start[at + 1] - self.start[at]))
        return out


class WordTokenizer(CachedEncoder):
    """As a tokenizer file says. Texts of a tokenizer that drops white space and never joins what it parts are encoded
    by the word; for any other file each text is encoded whole."""

    def __init__(self, path: str, max_words: int = 500_000, keep_words: int = 150_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        # a task has one core: a pool of threads in each worker costs CPU seconds and memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(max_words, keep_words)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        kind = {k: model.get(k) or None for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")}
        suffix = model.get("end_of_word_suffix")
        self.by_word = (said.get("normalizer"), said.get("pre_tokenizer")) == (_NORMALIZER, _PRE_TOKENIZER) and kind == dict.fromkeys(kind) | {"type": "BPE"} and bool(suffix)
        self.most = self.tokenizer.get_vocab_size()
        if self.by_word:
            # the same model for words of Latin letters, which need no normaliser, put in ``_BYTES``
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.light = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=suffix))
            self.light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # pieces that end a word
            self.ends = np.zeros(self.most, bool)
            self.ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True

    def _reset(self) -> None:
        super()._reset()
        self.words = pa.array([], pa.string())
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)  # of the cache's words in ascending order, and where these are
        self.met = np.zeros(1 << 14, bool)  # which words of the cache came since the last call of ``forget``
        self.full = False  # whether the cache has lost words since then
        self.log: list[tuple[np.ndarray, ...]] | None = None  # ids, sizes and hashes of words in the order in which they came
        self.told: tuple[np.ndarray, ...] | None = None  # the same from a file, as far as it was not yet read

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in the cache of all words of some texts, and the words of each."""
        if len(self.words) > self.max_words:
            self._shrink()
            self.full = True
        words = unicode_words(texts)
        place, coded = self._find(words.distinct)
        fresh = place < 0
        if fresh.any():
            new = words.distinct.filter(pa.array(fresh))
            place[fresh] = len(self.words) + np.arange(len(new))
            self._append(len(self.words), *(self._retold(coded[fresh]) or self._encode_new(new)))
            self._add(new, coded[fresh])
        if len(self.met) < len(self.words):
            self.met = np.concatenate([self.met, np.zeros(max(len(self.met), len(self.words)), bool)])
        if self.log is not None and not self.full:
            first = place[~self.met[place]]
            sizes = self.start[first + 1] - self.start[first]
            self.log.append((take(self.flat, self.start[first], sizes), sizes.astype(np.uint32), coded[~self.met[place]].astype(np.uint32)))
        self.met[place] = True
        return place[words.ids], words.sizes

    def _find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where words are in the cache, -1 for those that are not, and their hashes. No table of the whole cache is built for it."""
        coded = hashes(words)
        place = np.full(len(words), -1, np.int64)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, coded), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[i] == coded)
            at = self.places[i[hit]]
            # another word of the same hash is not in the cache, as far as this goes
            same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)
            place[hit[same]] = at[same]
        return place, coded

    def _add(self, words: pa.Array, coded: np.ndarray) -> None:
        order = np.argsort(coded)
        where = np.searchsorted(self.hashes, coded[order])
        self.hashes = np.insert(self.hashes, where, coded[order])
        self.places = np.insert(self.places, where, (len(self.words) + order).astype(np.int32))
        self.words = pa.concat_arrays([self.words, words])

    def _shrink(self) -> None:
        self.words = pa.concat_arrays([self.words[: self.keep_words]])
        self.used = int(self.start[len(self.words)])
        self.met[self.keep_words :] = False
        kept = self.places < self.keep_words
        self.hashes, self.places = self.hashes[kept], self.places[kept]

    def forget(self) -> None:
        """Begins a task whose words are to be saved: none was met yet, and the cache has room for them."""
        self._shrink()
        self.met[:] = False
        self.log, self.told, self.full = [], None, False

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        return self._encoded(texts, True)

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        return self._encoded(texts, False)[1]

    def _encoded(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        whole = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        at, words = self._numbers(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        sizes = self.start[at + 1] - self.start[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(words)
        counts = total[ends] - total[ends - words]
        flat = take(self.flat, self.start[at], sizes) if with_ids else np.empty(0, np.uint32)
        if whole.any():
            each = {i: np.array(self.encode_whole(texts[i].as_py()), np.uint32) for i in np.flatnonzero(whole).tolist()}
            if with_ids:
                flat = np.concatenate([each.get(i, part) for i, part in enumerate(np.split(flat, np.cumsum(counts)[:-1]))])
            counts[list(each)] = [len(x) for x in each.values()]
        return flat, counts

    def save(self, sink) -> None:
        """Writes the ids of the words that came since ``forget`` to an open file, in the order in which they came; of the words
        themselves, which come in that order again, 32 bits of their hashes."""
        kinds = (np.uint16 if self.most <= 1 << 16 else np.uint32, np.uint32, np.uint32)
        columns = [np.concatenate([np.empty(0, kind), *(x.astype(kind) for x in part)]) for kind, *part in zip(kinds, *self.log or (), strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], ["ids", "sizes", "hashes"])
        with pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_batch(batch)
        self.log = None

    def load(self, source) -> None:
        """Empties the cache; words that now come as they did before ``save`` have the ids from there."""
        batch = pa.ipc.open_file(source).get_batch(0)
        self._reset()
        self.told = tuple(c.flatten().to_numpy() for c in batch.columns)

    def _retold(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the next new words, and how many each has, from a file; None, then and later, if others are next there."""
        if self.told is None:
            return None
        flat, sizes, hashed = self.told
        n = len(coded)
        if not np.array_equal(hashed[:n], coded.astype(np.uint32)):
            self.told = None
            return None
        used = int(sizes[:n].sum())
        self.told = flat[used:], sizes[n:], hashed[n:]
        return flat[:used].astype(np.uint32), sizes[:n].astype(np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        flat, counts = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(counts)[:-1])

    def _encode_new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and how many each has. A letter word is parted from the signs after it, as the tokenizer parts them,
        and put in lower case, so that its forms are encoded once; letters beyond the Latin ones stay as they are."""
        parted = pc.extract_regex(words, _SIGNED)
        stem = pc.if_else(parted.is_valid(), pc.struct_field(parted, 0), words)
        stem = pc.if_else(pc.match_substring_regex(stem, _NOT_LATIN), stem, pc.utf8_lower(stem))
        coded = pc.dictionary_encode(pa.concat_arrays([stem, pc.fill_null(pc.struct_field(parted, 1), "")]))
        names, part = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at, _ = self._find(names)
        flat, first, sizes = self._encode_each(names.filter(pa.array(at < 0)))
        places, lengths = self.start[at], self.start[at + 1] - self.start[at]
        places[at < 0], lengths[at < 0] = self.used + first, sizes
        part = part.reshape(2, -1).T.ravel()
        return take(np.concatenate([self.flat[: self.used], flat]), places[part], lengths[part]), lengths[part].reshape(-1, 2).sum(axis=1)

    def _encode_each(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin and how many they are. Words of Latin letters in lower case go many at a time
        past the normaliser, which leaves them as they are; marks tell their ends."""
        plain = pc.and_(pc.utf8_is_alpha(words), pc.invert(pc.match_substring_regex(words, _NOT_LATIN))).to_numpy(zero_copy_only=False)
        letters = words.filter(pa.array(plain)).to_pylist()
        texts = [codecs.charmap_decode(" ".join(letters[i : i + 200]).encode(), "strict", _BYTES)[0] for i in range(0, len(letters), 200)]
        ids = self._some_ids(self.light, texts, 20)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(letters):
            raise RuntimeError("a word of letters has not one end")
        counts: list[int] = []
        rest = self._some_ids(self.tokenizer, words.filter(pa.array(~plain)).to_pylist(), 4000, counts)
        sizes = np.zeros(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(stops, prepend=0), counts
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, rest]), first, sizes

    @staticmethod
    def _some_ids(tokenizer, texts: list[str], at_once: int, counts: list[int] | None = None) -> np.ndarray:
        """Ids of all texts, and in ``counts`` how many each has. Few texts at once: a tokenizer's own results are large."""
        parts = [np.empty(0, np.uint32)]
        for i in range(0, len(texts), at_once):
            got = [e.ids for e in tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32))
            if counts is not None:
                counts.extend(map(len, got))
        return np.concatenate(parts)

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def word_tokenizer(path: str, max_words: int = 500_000) -> WordTokenizer:
    """The worker's tokenizer of a file; workers are reused between tasks."""
    return held(("words", path, max_words), lambda: WordTokenizer(path, max_words))
