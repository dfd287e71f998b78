"""Web archives in ZIP packages: a writer, and a reader that fetches single records by byte range.

A package holds, all stored without compression, ``archive/data.warc.gz`` (one gzip member per
record), ``indexes/index.cdxj`` (a line per record with its place) and ``datapackage.json``. The reader
never unpacks one: from the file's tail it takes the end record (or ZIP64's), from that the central
directory, from a member's local header the place of its bytes, and from the index the range of each
record. A package without an index is read through its stored members from one record to the next.

Tasks write packages under names of their own and return them as rows; the rows that Spark commits
are the manifest, so files of lost or repeated attempts are never read.

Defined cases: a null payload is empty, a null url too; equal payloads of at least ``min_revisit_bytes``
bytes share one response, that with the smallest id, null ids counting as the largest. Rows repeated with id and payload are
each written, with the same type. An empty table gives no packages and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import bloom_filter, maybe_in
from .space import folder, small_batches, written
from .words import slices

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Member(NamedTuple):
    name: str
    method: int
    header: int
    packed: int
    size: int
    crc: int


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing ---------------------------------------------------------------------------------------


def record_bytes(kind: str, ident: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = b"" if kind == "revisit" else payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def package(records: list[tuple[bytes, str]], zip64: bool = False) -> bytes:
    """A package of records given with their index keys."""
    data, lines, at = io.BytesIO(), [], 0
    for raw, key in records:
        packed = gzip.compress(raw, 1, mtime=0)
        data.write(packed)
        lines.append(f"{key} {DATE} {json.dumps({'offset': at, 'length': len(packed), 'filename': 'data.warc.gz'})}\n")
        at += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in (("archive/data.warc.gz", data.getvalue()), ("indexes/index.cdxj", "".join(lines).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "records": len(records)}).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(body)
    return out.getvalue()


def write_packages(pages: DataFrame, path: str, roll_bytes: int = 32 << 20, min_revisit_bytes: int = 0, zip64: bool = False) -> DataFrame:
    """Writes ``page_id, url, html`` as packages below ``path``; returns their manifest: ``package, records, bytes``."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    keys = rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", F.sha2("payload", 256).alias("sha")).distinct()
    keys = written(keys, "payload-keys")
    # both sides written, so that the rows of a hot payload stand alone on one side of the join, which can then be split
    first = written(keys.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-ids")
    revisits = keys.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first_id")
    revisits = written(revisits, "revisits")
    # payloads of pages that are no revisits for sure stay in their place
    bloom, bits = bloom_filter(revisits.where("p is not null").select("p"), "p")
    bloom = written(bloom, "bloom")
    maybe = F.coalesce(maybe_in(F.col("page_id"), bloom.scalar(), bits), F.lit(False)) | F.col("page_id").isNull()
    joined = rows.where(maybe).withColumn("sha", F.sha2("payload", 256)).join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left")
    marked = rows.where(~maybe).select("page_id", "url", "payload", F.lit(None).cast("long").alias("first_id")).unionByName(joined.select("page_id", "url", "payload", "first_id"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        held, size, done = [], 0, []

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            body = package(held, zip64)
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(body)
            done.append((name, len(held), len(body)))
            held.clear()

        for b in slices(batches, 2, 4 << 20):
            for ident, url, body, first_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = "response" if first_id is None else "revisit"
                held.append((record_bytes(kind, "" if ident is None else str(ident), " ".join(url.split()), body, base32_sha1(body), None if first_id is None else str(first_id)), "" if ident is None else str(ident)))
                size += len(body)
                if size >= roll_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["package", "records", "bytes"])

    return written(marked.mapInArrow(write, "package string, records long, bytes long"), "packages")


# --- reading ---------------------------------------------------------------------------------------


def _range(f, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)


def central_directory(f, size: int) -> list[Member]:
    """Members of a ZIP file of ``size`` bytes, ZIP64 or not, from its tail."""
    tail_at = max(0, size - 65_557)
    tail = _range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (raw := _range(f, locator, 20))[:4] == b"PK\x06\x07":
        at = struct.unpack_from("<Q", raw, 8)[0]
        record = _range(f, at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = _range(f, start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        method, crc, packed, full, n, extra, comment, header = (struct.unpack_from(k, directory, at + p)[0] for k, p in (("<H", 10), ("<I", 16), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        flags = struct.unpack_from("<H", directory, at + 8)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, p = directory[at + 46 + n : at + 46 + n + extra], 0
        while p + 4 <= len(more):
            tag, width = struct.unpack_from("<HH", more, p)
            if tag == 1:
                q = p + 4
                if full == 0xFFFFFFFF:
                    full, q = struct.unpack_from("<Q", more, q)[0], q + 8
                if packed == 0xFFFFFFFF:
                    packed, q = struct.unpack_from("<Q", more, q)[0], q + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", more, q)[0]
            p += 4 + width
        out.append(Member(name, method, header, packed, full, crc))
        at += 46 + n + extra + comment
    return out


def data_start(f, member: Member) -> int:
    head = _range(f, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def member_bytes(f, member: Member) -> bytes:
    raw = _range(f, data_start(f, member), member.packed)
    raw = raw if member.method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
    if binascii.crc32(raw) != member.crc:
        raise ValueError(f"{member.name} is damaged")
    return raw


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("a record is cut off")
    return fields, rest[:length]


def _walk(f, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of the gzip members in a stored member that no index describes."""
    at, end = start, start + length
    while at < end:
        unzip, fed = zlib.decompressobj(31), 0
        while not unzip.eof:
            piece = _range(f, at + fed, min(1 << 16, end - at - fed))
            if not piece:
                raise ValueError("a gzip member is cut off")
            unzip.decompress(piece)
            fed += len(piece)
        size = fed - len(unzip.unused_data)
        yield at, size
        at += size


def record_index(packages: DataFrame, path_col: str = "package") -> DataFrame:
    """Where each record of each package lies: ``package, start, length``, absolute in the file."""

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_file(name) as f:
                    members = {m.name: m for m in central_directory(f, f.size())}
                    indexes = [m for n, m in members.items() if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))]
                    stored = {n.removeprefix("archive/"): m for n, m in members.items() if n.startswith("archive/") and m.method == zipfile.ZIP_STORED}
                    base = {n: data_start(f, m) for n, m in stored.items()}
                    if indexes:
                        for m in indexes:
                            text = member_bytes(f, m)
                            for line in (gzip.decompress(text) if m.name.endswith(".gz") else text).decode().splitlines():
                                if "{" in line:
                                    x = json.loads(line[line.index("{") :])
                                    rows.append((base[x["filename"]] + int(x["offset"]), int(x["length"])))
                    else:
                        for n, m in stored.items():
                            rows += _walk(f, base[n], m.packed)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["package", "start", "length"])

    return packages.select(F.col(path_col).cast("string")).mapInArrow(read, "package string, start long, length long")


_RECORD = "page_id long, url string, record_type string, refers_to long, declared string, payload_bytes long, payload_digest string, package string, start long, length long"


def read_records(index: DataFrame, keep_payload: bool = False, near: int = 1 << 20) -> DataFrame:
    """Reads the records of an index by byte range; neighbours at most ``near`` bytes of reading apart share one request.

    With ``keep_payload`` a column ``payload`` is added. For revisits ``payload_bytes`` and
    ``payload_digest`` are null; ``resolve`` fills them from the response.
    """
    schema = _RECORD + (", payload binary" if keep_payload else "")
    fields = [tuple(c.split()) for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches):
        f = name = None
        for b in batches:
            paths, starts, lengths = (b.column(c).to_pylist() for c in ("package", "start", "length"))
            rows, i = [], 0
            while i < len(paths):
                j, end = i + 1, starts[i] + lengths[i]
                while j < len(paths) and paths[j] == paths[i] and starts[j] == end and end - starts[i] < near:
                    end, j = end + lengths[j], j + 1
                if paths[i] != name:
                    if f:
                        f.close()
                    fs, inner = pafs.FileSystem.from_uri(paths[i])
                    f, name = fs.open_input_file(inner), paths[i]
                data = _range(f, starts[i], end - starts[i])
                for k in range(i, j):
                    raw = gzip.decompress(data[starts[k] - starts[i] : starts[k] - starts[i] + lengths[k]])
                    h, body = parse_record(raw)
                    ident = h["warc-record-id"][len("<urn:page:") : -1]
                    refers = h.get("warc-refers-to")
                    full = h["warc-type"] != "revisit"
                    digest = base32_sha1(body) if full else None
                    declared = h["warc-payload-digest"].removeprefix("sha1:")
                    if full and declared != digest:
                        raise ValueError(f"payload of page {ident} is damaged")
                    rows.append((int(ident) if ident else None, h["warc-target-uri"], h["warc-type"], int(refers[len("<urn:page:") : -1]) if refers else None, declared, len(body) if full else None, digest, name, starts[k], lengths[k], *((body if full else None,) * keep_payload)))
                i = j
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
        if f:
            f.close()

    small_batches(index.sparkSession)
    return index.mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Gives revisits the payload size and digest of the response that they name."""
    full = records.where("record_type <> 'revisit'")
    named = full.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    again = (
        records.where("record_type = 'revisit'")
        .join(named, (F.col("refers_to") == F.col("_id")) & (F.col("declared") == F.col("_digest")), "left")
        .withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", F.col("_digest")).select(*records.columns)
    )
    return full.unionByName(again)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as packages in the shared folder and reads every record back."""
    spark: SparkSession = pages.sparkSession
    packages = write_packages(pages, folder(spark, "warc"), min_revisit_bytes=min_revisit_bytes)
    index = record_index(packages)
    records = written(read_records(index), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "package", "start", "length")
