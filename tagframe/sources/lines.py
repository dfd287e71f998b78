"""Records of text grids as Spark data sources: ``spark.read.format("zinc" | "trio" | "json_grid")`` and back by ``df.write.format(...)``.

A file is read by splits of ``splitSize`` bytes, each record by the task in whose split it begins, so that a large file is the work of many tasks and no task holds
more than a few megabytes and one record. Rows are ``file, pos, text, whole, head``; ``pos`` is the record's byte offset, so it rises
inside a file and is the same however the file is split. A record is

* in ``zinc`` a line after the grid's two head lines, but for blank lines and comments;
* in ``trio`` what stands between two lines of dashes;
* in ``json_grid`` the object of one row, where rows have lines of their own, as the writer makes them. Any other JSON text is one record, ``whole``.

``only=head`` reads just the files' beginnings and gives a row a file with ``head``: the two lines of Zinc, the JSON text before the rows. With ``head=true`` each record
carries it. Writing takes rows of ``text`` and the options ``first``, ``last`` and ``between``: every part file is a grid of its own, written under a hidden
name and renamed when all tasks have ended. Paths may be a file, a folder, or end in a pattern; stores are those of ``pyarrow.fs``.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, pos long, text string, whole boolean, head array<string>"
_ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("text", pa.string()), ("whole", pa.bool_()), ("head", pa.list_(pa.string()))])
_BLOCK = 4 << 20
#: Heads, and splits that are smaller than this, are read by so many bytes.
_SMALL = 1 << 16
_DASHES = re.compile(rb"-{3,}")
_ROWS = re.compile(r'"rows"\s*:\s*\[\s*$')
SPLIT = 64 << 20


def openable(path: str) -> bool:
    """Whether ``pyarrow.fs`` knows the store."""
    return "://" not in path or path.split("://", 1)[0] in ("file", "hdfs", "s3", "gs", "abfs")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def files_of(path: str) -> list[pafs.FileInfo]:
    fs, at = open_path(path)
    parent, _, name = at.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        return sorted((f for f in fs.get_file_info(pafs.FileSelector(parent)) if f.is_file and fnmatch.fnmatch(f.base_name, name)), key=lambda f: f.path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    return sorted((f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and f.base_name[:1] not in "._"), key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    uri: str
    start: int
    end: int


def _blocks(f, at: int, most: int = _BLOCK) -> Iterator[tuple[int, bytes]]:
    """Whole lines from a line's start on, at most so many bytes at once, each with its offset; the last may lack a newline."""
    f.seek(at)
    held: list[bytes] = []
    size = 0
    while block := f.read(most):
        cut = block.rfind(b"\n") + 1
        if not cut:
            held.append(block)
            size += len(block)
            continue
        out = b"".join([*held, block[:cut]])
        yield at, out
        at += len(out)
        held, size = [block[cut:]], len(block) - cut
    if rest := b"".join(held):
        yield at, rest


def _line_start(f, at: int, most: int = _BLOCK) -> int:
    """The first line's start at or after an offset."""
    if at == 0:
        return 0
    f.seek(at - 1)
    where = at - 1
    while block := f.read(min(most, _SMALL)):
        cut = block.find(b"\n")
        if cut >= 0:
            return where + cut + 1
        where += len(block)
    return where


def _lines(f, start: int, end: int, most: int = _BLOCK) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Offsets and texts of the lines that begin in a range, read by blocks no larger than a split, so that small splits don't read each other's lines."""
    for at, block in _blocks(f, _line_start(f, start, most), most):
        if at >= end:
            return
        lines = pc.split_pattern(pa.array([block], pa.large_binary()), b"\n").flatten()
        size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = at + np.concatenate([[0], np.cumsum(size[:-1] + 1)]).astype(np.int64)
        here = int(np.searchsorted(begin, end))
        if block.endswith(b"\n"):  # what follows the last newline is no line
            here = min(here, len(lines) - 1)
        if here:
            yield begin[:here], lines[:here]


def zinc_head(f) -> tuple[int, list[str]]:
    """Where the rows of a Zinc grid begin, and its two head lines."""
    head: list[str] = []
    for at, block in _blocks(f, 0, _SMALL):
        for line in block.splitlines(keepends=True):
            text = line.decode("utf-8").strip()
            at += len(line)
            if text and not text.startswith("//"):
                if not head and not text.startswith("ver:"):
                    raise ValueError("a Zinc grid starts with ver:")
                head.append(text)
            if len(head) == 2:
                return at, head
    return at if head else 0, head


def json_head(f) -> tuple[int, list[str] | None]:
    """Where the rows of a JSON grid begin if they have lines of their own, and what stands before."""
    for _, block in _blocks(f, 0, _SMALL):
        line, newline, _ = block.partition(b"\n")
        text = line.decode("utf-8")
        return (len(line) + 1, [text]) if newline and _ROWS.search(text) else (0, None)
    return 0, None


class Reader(DataSourceReader):
    def __init__(self, layout: str, options: dict):
        self.layout, self.path, self.split = layout, options["path"], int(options.get("splitsize", SPLIT))
        self.only, self.with_head = options.get("only") == "head", options.get("head", "false").lower() == "true"

    def partitions(self) -> list[Split]:
        scheme = self.path.split("://", 1)[0] + "://" if "://" in self.path else "file://"
        out = []
        for f in files_of(self.path):
            uri = scheme + f.path if scheme == "file://" or not self.path.startswith("hdfs://") else self.path[: self.path.index("/", 7)] + f.path
            size = min(f.size, 1) if self.only else f.size
            out += [Split(uri, at, min(at + self.split, f.size)) for at in range(0, size, self.split)]
        return out or [Split("", 0, 0)]

    def _batch(self, uri: str, pos, text, head, whole: bool = False) -> pa.RecordBatch:
        n = len(text)
        heads = pa.array([head if self.with_head or self.only else None] * n, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([uri] * n, pa.string()), pa.array(pos, pa.int64()), pa.array(text, pa.string()), pa.array([whole] * n), heads], schema=_ARROW)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.uri:
            return
        fs, at = open_path(split.uri)
        most = min(_BLOCK, max(split.end - split.start, _SMALL))
        with fs.open_input_file(at) as f:
            if self.layout == "trio":
                if not self.only:
                    yield from self._trio(f, split, most)
                return
            first, head = (zinc_head if self.layout == "zinc" else json_head)(f)
            if self.only:
                yield self._batch(split.uri, [0], [""], head)
                return
            if head is None:  # JSON of another layout
                if split.start == 0:
                    f.seek(0)
                    yield self._batch(split.uri, [0], [f.read().decode("utf-8")], None, True)
                return
            for pos, lines in _lines(f, max(split.start, first), split.end, most):
                text = pc.utf8_trim_whitespace(lines.cast(pa.large_string()))
                if self.layout == "zinc":
                    keep = pc.and_(pc.not_equal(text, ""), pc.invert(pc.starts_with(text, "//")))
                else:
                    text = pc.utf8_rtrim(pc.utf8_ltrim(text, ", "), ", ")
                    keep = pc.starts_with(text, "{")
                kept = text.filter(keep)
                if len(kept):
                    yield self._batch(split.uri, pos[keep.to_numpy(zero_copy_only=False)], kept.to_pylist(), head)

    def _trio(self, f, split: Split, most: int) -> Iterator[pa.RecordBatch]:
        """Records whose line of dashes, or the file's beginning, lies in the split; the last one goes on past its end."""
        rows: list[tuple[int, str]] = []
        at, record = (0, []) if split.start == 0 else (None, [])
        size, done = 0, False
        for pos, lines in _lines(f, split.start, 1 << 62, most):
            for p, line in zip(pos.tolist(), lines.to_pylist(), strict=True):
                if not _DASHES.match(line):
                    if at is not None:
                        record.append(line.rstrip(b"\r"))
                    elif p >= split.end:
                        done = True
                        break
                    continue
                if at is not None:
                    rows.append((at, b"\n".join(record).decode("utf-8")))
                    size += len(rows[-1][1])
                at, record = p, []
                if p >= split.end:
                    at, done = None, True
                    break
            if size >= _BLOCK and rows:
                yield self._batch(split.uri, *zip(*rows, strict=True), None)
                rows, size = [], 0
            if done:
                break
        if at is not None:
            rows.append((at, b"\n".join(record).decode("utf-8")))
        if rows:
            yield self._batch(split.uri, *zip(*rows, strict=True), None)


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceArrowWriter):
    def __init__(self, suffix: str, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), suffix, overwrite
        self.first, self.last, self.between = (options.get(k, "") for k in ("first", "last", "between"))
        self.token = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, top = open_path(self.path)
        fs.create_dir(top, recursive=True)
        context = TaskContext.get()
        at = f"{top}/.part-{context.partitionId():05d}-{self.token}-{context.taskAttemptId()}{self.suffix}"
        with fs.open_output_stream(at) as f:
            if self.first:
                f.write(self.first.encode() + b"\n")
            begun = False
            for b in iterator:
                rows = b.column(b.schema.get_field_index("text")).to_pylist()
                lines = [(self.between if begun or i else "") + r for i, r in enumerate(rows)]
                if lines:
                    f.write("\n".join(lines).encode("utf-8", "surrogatepass") + b"\n")
                begun = begun or bool(rows)
            if self.last:
                f.write(self.last.encode() + b"\n")
        return Written(at)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = open_path(self.path)
        made = [m.path for m in messages if m]
        if self.overwrite and made:
            for f in fs.get_file_info(pafs.FileSelector(top)):
                if f.is_file and not f.base_name.startswith("."):
                    fs.delete_file(f.path)
        for path in made:
            parent, _, name = path.rpartition("/")
            fs.move(path, f"{parent}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = open_path(self.path)
        for m in messages:
            if m and fs.get_file_info(m.path).is_file:
                fs.delete_file(m.path)


class _Lines(DataSource):
    layout, suffix = "", ""

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.layout, self._options())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.suffix, self._options(), overwrite)


class ZincLines(_Lines):
    layout, suffix = "zinc", ".zinc"

    @classmethod
    def name(cls) -> str:
        return "zinc"


class TrioLines(_Lines):
    layout, suffix = "trio", ".trio"

    @classmethod
    def name(cls) -> str:
        return "trio"


class JsonLines(_Lines):
    layout, suffix = "json_grid", ".json"

    @classmethod
    def name(cls) -> str:
        return "json_grid"


def register(spark: SparkSession) -> None:
    for source in (ZincLines, TrioLines, JsonLines):
        spark.dataSource.register(source)
