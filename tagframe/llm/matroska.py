"""Matroska as a media column: texts or samples to files, and files to packet tables.

``mux_bytes`` stores bytes losslessly as 8-bit PCM; ``parse`` reads any Matroska file's elements
(variable-length ids and sizes, also unknown sizes), tracks, clusters, simple blocks and block
groups, the three kinds of lacing, and cues. Every packet keeps its byte range in the file, so a
reader can fetch single packets without parsing the rest.

Defined cases: a null text is an empty one; a payload is padded with zeros to a positive multiple of
64, so an empty text gives 64 zero samples; equal texts give equal files. Damaged files raise ValueError, and so does asking for
the payload of a track whose frames are compressed or encrypted; bytes stripped from the frames' heads are put back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .space import small_batches, utf8
from .words import slices

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, ENCODINGS, ENCODING, COMPRESSION, COMPRESSION_KIND, COMPRESSION_SETTINGS, ENCRYPTION = 0x23E383, 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
STRIPPED = 3
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE = 8000
FRAME = 1024
LACE = 8
CLUSTER_FRAMES = 32


class Packet(NamedTuple):
    track: int
    timestamp: int  # in units of the file's timestamp scale; frames of a lace share their block's unless the track has a duration of frames
    lace_index: int
    offset: int
    size: int
    keyframe: bool


class Media(NamedTuple):
    scale_ns: int
    tracks: dict[int, dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, cluster's byte position in the file
    clusters: list[tuple[int, int]]  # byte position, timestamp


def _id(ident: int) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big")


def vint(n: int) -> bytes:
    """A size in as few bytes as hold it; all ones are kept for unknown sizes."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(ident: int, body: bytes) -> bytes:
    return _id(ident) + vint(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    sizes = [len(f) for f in frames]
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            delta, length = n - before, 1
            while not -(1 << 7 * length - 1) < delta < 1 << 7 * length - 1:
                length += 1
            head += ((delta + (1 << 7 * length - 1) - 1) | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ_VERSION, 2))
_TRACK = _element(
    TRACKS,
    _element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux_bytes(payload: bytes, lacing: int | None = None) -> bytes:
    """A file with one track of 8-bit samples; a timestamp counts samples. Laces are of fixed size, or EBML's where the last frame is shorter, unless ``lacing`` says otherwise."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 10**9 // RATE) + _element(DURATION, struct.pack(">d", len(payload))) + _element(MUXING_APP, b"tagframe") + _element(WRITING_APP, b"tagframe"))
    parts = [info, _TRACK]
    position, cues = len(info) + len(_TRACK), []
    step = FRAME * CLUSTER_FRAMES
    for start in range(0, max(1, len(payload)), step):
        body = [_uint(TIMESTAMP, start)]
        for at in range(start, min(start + step, len(payload)), FRAME * LACE):
            frames = [payload[i : i + FRAME] for i in range(at, min(at + FRAME * LACE, start + step, len(payload)), FRAME)]
            kind = lacing if lacing is not None else NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACING
            if kind == FIXED and len(frames[-1]) != FRAME or kind == NO_LACING and len(frames) > 1:
                kind = EBML_LACING
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at - start, 0x80 | kind_bits(kind)) + _lace(frames, kind)))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, position))))
        position += len(cluster)
        parts.append(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def kind_bits(lacing: int) -> int:
    return lacing << 1


def read_id(data: bytes, at: int) -> tuple[int, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    length = 9 - data[at].bit_length()
    if length > 4 or at + length > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, None where it is unknown, and the place after it."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"size cut off at byte {at}")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (None if n == (1 << 7 * length) - 1 else n), at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """id, element's start, body's start and body's end of each child in a range; a body of unknown size ends before the next top-level element that it can't hold."""
    while at < end:
        start = at
        ident, at = read_id(data, at)
        size, at = read_vint(data, at)
        if size is None:
            stop = end if ident == SEGMENT else at
            while stop < end and ident != SEGMENT:
                child, after = read_id(data, stop)
                if child in TOP:
                    break
                n, after = read_vint(data, after)
                if n is None:
                    raise ValueError("an element of unknown size within another")
                stop = after + n
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at byte {start} is cut off")
        yield ident, start, at, stop
        at = stop


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(data: bytes, at: int, end: int, base: int, keyframe: bool | None) -> list[Packet]:
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        sizes = [end - at]
    else:
        n = data[at] + 1
        at += 1
        sizes = []
        if lacing == XIPH:
            for _ in range(n - 1):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif lacing == EBML_LACING and n > 1:
            size, at = read_vint(data, at)
            sizes.append(size)
            for _ in range(n - 2):
                length = 9 - data[at].bit_length()
                raw, at = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1, at + length
                sizes.append(sizes[-1] + raw - ((1 << 7 * length - 1) - 1))
        elif lacing == FIXED:
            if (end - at) % n:
                raise ValueError("a lace of fixed size doesn't divide its block")
            sizes = [(end - at) // n] * (n - 1)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for i, size in enumerate(sizes):
        out.append(Packet(track, base + relative, i, at, size, bool(flags & 0x80) if keyframe is None else keyframe))
        at += size
    return out


def _stripped(data: bytes, at: int, end: int) -> bytes | None:
    """The bytes that a track's encoding took off the head of each frame; None if the frames are encoded in another way."""
    head = b""
    for kind, _, x, y in elements(data, at, end):
        inner = {c: (p, q) for c, _, p, q in elements(data, x, y)}
        if kind != ENCODING or ENCRYPTION in inner or COMPRESSION not in inner:
            return None
        how = {c: (p, q) for c, _, p, q in elements(data, *inner[COMPRESSION])}
        if COMPRESSION_KIND not in how or _number(data, *how[COMPRESSION_KIND]) != STRIPPED:
            return None
        head = data[slice(*how.get(COMPRESSION_SETTINGS, (0, 0)))] + head
    return head


def parse(data: bytes) -> Media:
    scale, tracks, packets, cues, clusters = 1_000_000, {}, [], [], []
    seen = False
    for ident, _, at, end in elements(data, 0, len(data)):
        if ident == EBML:
            seen = True
        elif ident == SEGMENT:
            segment = at
            for kind, start, a, e in elements(data, at, end):
                if kind == INFO:
                    for k, _, x, y in elements(data, a, e):
                        scale = _number(data, x, y) if k == TIMESTAMP_SCALE else scale
                elif kind == TRACKS:
                    for k, _, x, y in elements(data, a, e):
                        if k == TRACK_ENTRY:
                            got = {c: (p, q) for c, _, p, q in elements(data, x, y)}
                            audio = {c: (p, q) for c, _, p, q in elements(data, *got[AUDIO])} if AUDIO in got else {}
                            rate = data[slice(*audio[SAMPLING_FREQUENCY])] if SAMPLING_FREQUENCY in audio else b""
                            tracks[_number(data, *got[TRACK_NUMBER])] = {"type": _number(data, *got[TRACK_TYPE]), "codec": data[slice(*got[CODEC_ID])].decode(), "rate": struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if rate else None, "bits": _number(data, *audio[BIT_DEPTH]) if BIT_DEPTH in audio else None, "frame_ns": _number(data, *got[DEFAULT_DURATION]) if DEFAULT_DURATION in got else None, "stripped": _stripped(data, *got[ENCODINGS]) if ENCODINGS in got else b""}
                elif kind == CLUSTER:
                    base = 0
                    for k, _, x, y in elements(data, a, e):
                        if k == TIMESTAMP:
                            base = _number(data, x, y)
                        elif k == SIMPLE_BLOCK:
                            packets += _block(data, x, y, base, None)
                        elif k == BLOCK_GROUP:
                            inner = {c: (p, q) for c, _, p, q in elements(data, x, y)}
                            packets += _block(data, *inner[BLOCK], base, REFERENCE_BLOCK not in inner)
                    clusters.append((start, base))
                elif kind == CUES:
                    for k, _, x, y in elements(data, a, e):
                        if k == CUE_POINT:
                            time = 0
                            for c, _, p, q in elements(data, x, y):
                                if c == CUE_TIME:
                                    time = _number(data, p, q)
                                elif c == CUE_TRACK_POSITIONS:
                                    place = {d: _number(data, u, v) for d, _, u, v in elements(data, p, q)}
                                    cues.append((time, place[CUE_TRACK], segment + place[CUE_CLUSTER_POSITION]))
    if not seen:
        raise ValueError("not a Matroska file")
    step = {k: t["frame_ns"] // scale for k, t in tracks.items() if t["frame_ns"]}
    packets = [p._replace(timestamp=p.timestamp + p.lace_index * step[p.track]) if p.lace_index and p.track in step else p for p in packets]
    return Media(scale, tracks, packets, cues, clusters)


def payload_of(data: bytes, media: Media | None = None, track: int = 1) -> bytes:
    """A track's frames; ValueError if they are compressed or encrypted."""
    media = media or parse(data)
    head = media.tracks.get(track, {}).get("stripped", b"")
    if head is None:
        raise ValueError(f"frames of track {track} are encoded")
    return b"".join(head + data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


_MUXED = "doc_id long, n_bytes long, media binary"


def mux(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A Matroska file for each document: ``doc_id, n_bytes, media``."""
    small_batches(docs.sparkSession)

    def write(batches):
        for b in slices(batches, 1, 4 << 20):
            raw = [utf8(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux_bytes(padded(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(write, _MUXED)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet: ``doc_id, packet, track, timestamp_ns, byte_offset, byte_size, keyframe, cluster``."""
    small_batches(media.sparkSession)
    names = ["doc_id", "packet", "track", "timestamp_ns", "byte_offset", "byte_size", "keyframe", "cluster"]

    def read(batches):
        for b in batches:
            for ident, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                m = parse(data)
                starts = np.array([c[0] for c in m.clusters] or [0])
                cluster = np.searchsorted(starts, [p.offset for p in m.packets], "right") - 1
                rows = [[ident] * len(m.packets), range(len(m.packets)), [p.track for p in m.packets], [p.timestamp * m.scale_ns for p in m.packets], [p.offset for p in m.packets], [p.size for p in m.packets], [p.keyframe for p in m.packets], cluster.tolist()]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(r), k) for r, k in zip(rows, kinds, strict=True)], names)

    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(read, "doc_id long, packet int, track int, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, cluster int")


def features(samples: np.ndarray, media: Media) -> str:
    """Whole numbers only, so that equal samples give equal strings everywhere."""
    x = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings};distinct={int(np.count_nonzero(np.bincount(samples, minlength=256)))}"


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Reads files of ``mux`` back and describes their samples."""
    names = [c.split()[0] for c in _READ.split(", ")]

    def read(batches):
        for b in slices(batches, 2, 4 << 20):
            out = [[], [], [], [], [], []]
            for data in b.column("media").to_pylist():
                m = parse(data)
                payload = payload_of(data, m)
                for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(payload, np.uint8), m)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    return media.mapInArrow(read, _READ)
