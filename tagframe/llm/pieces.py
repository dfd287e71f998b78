"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An automaton over all pieces runs once over a text. At each position the pieces that end there come
by the output links, and each relaxes the best score of a segmentation up to there, so that the result is the
segmentation of the greatest total score; of equal ones the longer last piece wins. A character that no
piece covers becomes its UTF-8 bytes' pieces. This is the model's scores taken as a unigram
model's, whatever trained them. Where no piece reaches over a word's start or a line's end, texts
are segmented by the word, which gives the same result, and words are cached.

Defined cases: null and empty texts have no ids; decoding gives the text back, but that the mark U+2581
comes back as a blank. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import small_batches, utf8
from .tokens import CachedEncoder, file_of
from .words import held

MARK = "▁"
#: What a model takes off an unknown character, beside its least score.
UNKNOWN_PENALTY = 10.0
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
_CHUNK = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")


class Pieces(CachedEncoder):
    def __init__(self, path: str, max_words: int = 600_000, keep_words: int = 150_000):
        from sentencepiece import sentencepiece_model_pb2

        super().__init__(max_words, keep_words)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.unknown_id = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.score = [p.score for p in model.pieces]
        least = min((p.score for p in model.pieces if p.type == NORMAL), default=0.0)
        self.unknown_score = least - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        self.by_word = True
        self.singles = {p.piece for p in model.pieces if p.type in (NORMAL, USER_DEFINED) and len(p.piece) == 1}
        for i, p in enumerate(model.pieces):
            if p.type in (NORMAL, USER_DEFINED) and p.piece:
                self.automaton.add_word(p.piece, (len(p.piece), i, p.score))
                self.by_word &= MARK not in p.piece.lstrip(MARK) and "\n" not in p.piece
        self.automaton.make_automaton()
        spell = {NORMAL: lambda p: p.piece.replace(MARK, " ").encode(), BYTE: lambda p: bytes([int(p.piece[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.spelling = [spell.get(p.type, lambda p: b"")(p) if p.type != USER_DEFINED else p.piece.encode() for p in model.pieces]
        #: of a byte's piece, for scores of whole texts
        self.cost = np.array(self.score)

    def segment(self, text: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation of normalised text."""
        n = len(text)
        if self.singles.issuperset(text):
            # every position is reached by a piece, and the pieces that end at one come longest first
            best, came = [0.0] + [float("-inf")] * n, [(0, 0)] * (n + 1)
            for end, (length, i, score) in self.automaton.iter(text):
                got = best[end + 1 - length] + score
                if got > best[end + 1]:
                    best[end + 1], came[end + 1] = got, (length, i)
            ids, at = [], n
            while at:
                length, i = came[at]
                ids.append(i)
                at -= length
            return ids[::-1], best[n]
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        pending: list[tuple[int, int, float]] = []

        def settle(at: int) -> None:
            """Relaxes position ``at`` by the pieces that end there; all earlier ones are settled."""
            alone = False
            for length, i, score in sorted(pending, reverse=True):
                alone |= length == 1
                if best[at - length] + score > best[at]:
                    best[at], came[at] = best[at - length] + score, (length, i)
            if not alone and best[at - 1] + self.unknown_score > best[at]:
                best[at], came[at] = best[at - 1] + self.unknown_score, (1, -1)
            pending.clear()

        at = 1
        for end, found in self.automaton.iter(text):
            while at <= end:
                settle(at)
                at += 1
            pending.append(found)
        while at <= n:
            settle(at)
            at += 1
        ids: list[int] = []
        at = n
        while at:
            length, i = came[at]
            if i >= 0:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[x] for x in reversed(utf8(text[at - 1])))
            else:
                ids.append(self.unknown_id)
            at -= length
        return ids[::-1], best[n]

    def normalise(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def split(self, text: str) -> list[str] | None:
        return _CHUNK.findall(self.normalise(text)) if self.by_word else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.segment(w)[0] for w in words]

    def encode_whole(self, text: str) -> list[int]:
        return self.segment(self.normalise(text))[0]

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def pieces_of(path: str) -> Pieces:
    return held(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: ids as little-endian 32-bit numbers."""
    small_batches(docs.sparkSession)
    path = model or file_of("piece_bpe_32k.model")

    def run(batches):
        p = pieces_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u4").tobytes() for x in p.encode_batch(b.column(1).to_pylist())], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary")


_DECODED = "doc_id long, text string, n_ids long, ids_crc32 long, score double, decoded_bytes long, decoded_sha256 string"


def decode(encoded: DataFrame, model: str | None = None, keep_text: bool = True) -> DataFrame:
    """Texts of ``doc_id, ids``, with digests of both and the score of the ids' pieces."""
    small_batches(encoded.sparkSession)
    path = model or file_of("piece_bpe_32k.model")
    schema = _DECODED if keep_text else _DECODED.replace(" text string,", "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        p = pieces_of(path)
        for b in batches:
            raw = b.column("ids").to_pylist()
            ids = [np.frombuffer(r or b"", "<u4") for r in raw]
            texts = [p.decode(x.tolist()) for x in ids]
            out = [utf8(t) for t in texts]
            columns = [b.column("doc_id"), *([pa.array(texts, pa.string())] * keep_text), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(r or b"") for r in raw], pa.int64()), pa.array([float(p.cost[x].sum()) for x in ids]), pa.array([len(t) for t in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return encoded.mapInArrow(run, schema)
