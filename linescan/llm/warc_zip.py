"""Archives of web pages packaged as ZIP: reading single records by range, without extraction.

A package is a ZIP file with stored (uncompressed) members: archive/*.warc.gz, of gzip members of one record each,
and indexes/*.cdx or *.cdxj, whose lines give the offset and length of each record. The reader parses the end record,
its ZIP64 form and the central directory, finds where the data of the members lie, reads the indexes, and then fetches
the records in ranges of a few MB. Members without an index are scanned from start to end.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import new_dir, partitions_for, read, saved

PACKAGE_BYTES = 16 << 20  # of compressed records in a package that is written
RANGE_BYTES = 4 << 20  # of records that are fetched at once
STORED = 0
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]


class BadPackage(ValueError):
    """The bytes aren't a package that can be read."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    encrypted: bool
    size: int  # as stored
    full_size: int
    header: int  # offset of the local header


def members(read_at: ReadAt, size: int) -> list[Member]:
    """The central directory; read_at(offset, length) returns bytes of the file, fewer at its end."""
    tail_at = max(0, size - 22 - MARK16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0 or len(tail) - at < 22:
        raise BadPackage("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end_at = tail_at + at
    if MARK16 == count or MARK32 in (length, start):
        locator = read_at(end_at - 20, 20) if end_at >= 20 else b""
        if locator[:4] == b"PK\6\7":
            end64 = struct.unpack("<Q", locator[8:16])[0]
            record = read_at(end64, 56)
            if record[:4] != b"PK\6\6" or len(record) < 56:
                raise BadPackage("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack("<QQQ", record[32:56])
    directory = read_at(start, length)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2" or len(directory) < at + 46:
            raise BadPackage("broken central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        stored, full, n, m, k, disk = struct.unpack("<IIHHHH", directory[at + 20 : at + 36])
        header = int.from_bytes(directory[at + 42 : at + 46], "little")
        name = directory[at + 46 : at + 46 + n]
        extra, at = directory[at + 46 + n : at + 46 + n + m], at + 46 + n + m + k
        while len(extra) >= 4:
            kind, long = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = [int.from_bytes(extra[i : i + 8], "little") for i in range(4, 4 + long - 7, 8)]
                full = values.pop(0) if full == MARK32 and values else full
                stored = values.pop(0) if stored == MARK32 and values else stored
                header = values.pop(0) if header == MARK32 and values else header
            extra = extra[4 + long :]
        found.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), stored, full, header))
    return found


def data_offset(read_at: ReadAt, member: Member) -> int:
    """Where the member's data begin: after its local header, whose extra field may differ from the directory's."""
    local = read_at(member.header, 30)
    if local[:4] != b"PK\3\4" or len(local) < 30:
        raise BadPackage(f"no local header of {member.name}")
    n, m = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n + m


def index_line(line: str) -> tuple[str, int, int] | None:
    """File name, offset and length from a line of a CDXJ index (JSON) or of an 11-field CDX index."""
    line = line.strip()
    if not line or line.startswith(("!", "CDX", "#")):
        return None
    if "{" in line:
        found = json.loads(line[line.index("{") :])
        try:
            entry = str(found["filename"]), int(found["offset"]), int(found["length"])
        except (KeyError, TypeError, OverflowError) as bad:
            raise BadPackage(f"index line without {bad}") from bad
    else:
        fields = line.split(" ")
        if len(fields) < 11:
            raise BadPackage("index line of neither form")
        entry = fields[10], int(fields[9]), int(fields[8])
    if not (0 <= entry[1] < 1 << 63 and 0 <= entry[2] < 1 << 63):
        raise BadPackage("index line with an impossible offset or length")
    return entry


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record of a WARC file, decompressed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadPackage("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields.get("content-length", len(rest)))
    if length < 0 or length > len(rest):
        raise BadPackage("record shorter than its Content-Length")
    block, status, kind = rest[:length], None, fields.get("content-type")
    if (kind or "").replace(" ", "").startswith("application/http") and block.startswith(b"HTTP/"):
        http, _, block = block.partition(b"\r\n\r\n")
        first, *more = http.decode("latin-1").split("\r\n")
        found = re.match(r"HTTP/\S+ (\d+)", first)
        status = int(found[1]) if found else None
        kind = next((x.partition(":")[2].strip() for x in more if x.lower().startswith("content-type:")), None)
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"), "content_type": kind, "http_status": status,
        "payload": None if "warc-truncated" in fields and not block else block,
    }


def _opened(path: str) -> tuple[ReadAt, int, io.IOBase]:
    system, at = fs.FileSystem.from_uri(path)
    file = system.open_input_file(at)

    def read_at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return read_at, file.size(), file


PLAN = "path string, member string, base bigint, size bigint, offsets array<bigint>, lengths array<bigint>, error string"
FIELDS = (
    "path string, member string, offset bigint, length bigint, record_type string, record_id string, target_uri string, "
    "date string, content_type string, http_status int, payload binary, error string"
)
_PLAN = pa.schema(
    [("path", pa.string()), ("member", pa.string()), ("base", pa.int64()), ("size", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("error", pa.string())]
)
_FIELDS = pa.schema(
    [("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [(x, pa.string()) for x in ("record_type", "record_id", "target_uri", "date", "content_type")]
    + [("http_status", pa.int32()), ("payload", pa.binary()), ("error", pa.string())]
)


#: What broken input raises: a package, member, index or record that can't be read is an error row.
BROKEN = (ValueError, OSError, EOFError, struct.error, zlib.error)


def _plan_package(path: str) -> Iterator[dict]:
    read_at, size, file = _opened(path)
    with file:
        found = members(read_at, size)
        archives = {m.name: m for m in found if re.search(r"\.warc(\.gz)?$", m.name)}
        wanted: dict[str, list[tuple[int, int]]] = {}
        for m in found:
            if not re.search(r"^indexes/.*\.cdxj?(\.gz)?$", m.name):
                continue
            if m.method != STORED or m.encrypted:
                yield {"path": path, "member": m.name, "error": "member isn't stored"}
                continue
            try:
                data = read_at(data_offset(read_at, m), m.size)
                data = gzip.decompress(data) if m.name.endswith(".gz") else data
            except BROKEN as bad:
                yield {"path": path, "member": m.name, "error": f"{type(bad).__name__}: {bad}"}
                continue
            for line in data.decode("utf-8", "replace").split("\n"):
                try:
                    entry = index_line(line)
                except ValueError as bad:
                    yield {"path": path, "member": m.name, "error": f"index line: {bad}"}
                    continue
                if entry:
                    name = next((x for x in (entry[0], f"archive/{entry[0]}") if x in archives), None)
                    if name is None:
                        yield {"path": path, "member": entry[0], "error": "the index names a member that isn't there"}
                    else:
                        wanted.setdefault(name, []).append(entry[1:])
        for name, m in archives.items():
            if m.method != STORED or m.encrypted:
                yield {"path": path, "member": name, "error": "member isn't stored"}
                continue
            try:
                base = data_offset(read_at, m)
            except BROKEN as bad:
                yield {"path": path, "member": name, "error": f"{type(bad).__name__}: {bad}"}
                continue
            if name not in wanted:
                yield {"path": path, "member": name, "base": base, "size": m.size}
                continue
            part: list[tuple[int, int]] = []
            for entry in sorted(set(wanted[name])):
                if part and entry[0] + entry[1] - part[0][0] > RANGE_BYTES:
                    yield {"path": path, "member": name, "base": base, "size": m.size, "offsets": [x for x, _ in part], "lengths": [y for _, y in part]}
                    part = []
                part.append(entry)
            if part:
                yield {"path": path, "member": name, "base": base, "size": m.size, "offsets": [x for x, _ in part], "lengths": [y for _, y in part]}


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            if path is None:
                continue
            rows = []
            try:
                rows.extend(_plan_package(path))
            except BROKEN as bad:
                rows.append({"path": path, "error": f"{type(bad).__name__}: {bad}"})
            yield pa.RecordBatch.from_pylist(rows, _PLAN)


def _scanned(read_at: ReadAt, base: int, size: int, zipped: bool) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of a member without an index."""
    at = 0
    if not zipped:
        while at < size:
            head, step = b"", 1 << 14
            while (end := head.find(b"\r\n\r\n")) < 0 and len(head) < size - at:
                head, step = read_at(base + at, min(step, size - at)), step * 4
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[: end + 2]) if end >= 0 else None
            if not length:
                raise BadPackage(f"no record at {at}")
            stop = min(size, at + end + 4 + int(length[1]) + 4)
            yield at, stop - at, read_at(base + at, stop - at)
            at = stop
        return
    while at < size:
        inflate, parts, start = zlib.decompressobj(31), [], at
        while not inflate.eof:
            data = read_at(base + at, min(1 << 18, size - at))
            if not data:
                raise BadPackage(f"record at {start} is cut off")
            parts.append(inflate.decompress(data))
            at += len(data)
        at -= len(inflate.unused_data)
        yield start, at - start, b"".join(parts)


def _fetched(row: dict, read_at: ReadAt) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    zipped = row["member"].endswith(".gz")
    if row["offsets"] is None:
        try:
            for offset, length, data in _scanned(read_at, row["base"], row["size"], zipped):
                yield offset, length, data, None
        except BROKEN as bad:
            yield None, None, None, f"{type(bad).__name__}: {bad}"
        return
    first, last = row["offsets"][0], row["offsets"][-1]
    try:
        data = read_at(row["base"] + first, max(0, min(max(o + n for o, n in zip(row["offsets"], row["lengths"], strict=True)), row["size"]) - first))
    except BROKEN as bad:
        for offset, length in zip(row["offsets"], row["lengths"], strict=True):
            yield offset, length, None, f"{type(bad).__name__}: {bad}"
        return
    for offset, length in zip(row["offsets"], row["lengths"], strict=True):
        raw = data[offset - first : offset - first + length]
        if len(raw) < length or offset > last:
            yield offset, length, None, "the index points beyond the member"
            continue
        try:
            yield offset, length, zlib.decompress(raw, 31) if zipped else raw, None
        except zlib.error as bad:
            yield offset, length, None, f"error: {bad}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["error"]:
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("path", "member", "error")}], _FIELDS)
                continue
            try:
                read_at, _, file = _opened(row["path"])
            except BROKEN as bad:
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "member": row["member"], "error": f"{type(bad).__name__}: {bad}"}], _FIELDS)
                continue
            rows, size = [], 0
            with file:
                for offset, length, data, error in _fetched(row, read_at):
                    found = {"path": row["path"], "member": row["member"], "offset": offset, "length": length, "error": error}
                    if data is not None:
                        try:
                            found |= parse_record(data)
                        except ValueError as bad:
                            found["error"] = f"{type(bad).__name__}: {bad}"
                        size += len(data)
                    rows.append(found)
                    if size > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def read_packages(paths: DataFrame, tasks: int) -> DataFrame:
    """A row for each record of the packages named in the first column of paths; see FIELDS.

    What can't be read, a package, member, index line or record, gives a row with error set, and the rest is still
    read: missing or broken files, compressed or encrypted members, index entries that point nowhere. A null path is
    left out; a path that repeats is read again; entries of an index that repeat are read once. A package without
    archives has no rows. payload is null where the record says that it was truncated to nothing.
    Directories are read where paths are, in ranges of RANGE_BYTES; these are spread over tasks partitions.
    """
    return paths.mapInArrow(_plan, PLAN).repartition(tasks).mapInArrow(_read, FIELDS)


def zip_stored(files: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file with stored members, with ZIP64 fields where asked for or needed."""
    out, directory = io.BytesIO(), []
    for name, data in files:
        at, raw, crc = out.tell(), name.encode(), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= MARK32
        size = MARK32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, STORED, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        fields = (b"PK\1\2", 45, 45, 0x800, STORED, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, MARK32 if wide else at)
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", *fields) + raw + extra)
    start, listed = out.tell(), b"".join(directory)
    out.write(listed)
    count, length, first = len(files), len(listed), start
    if zip64 or count >= MARK16 or max(length, start) >= MARK32:
        end = out.tell()
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, length, start))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        count, length, first = MARK16, MARK32, MARK32
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, length, first, 0))
    return out.getvalue()


def _record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = b"" if html is None else html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    head = ["WARC/1.1", "WARC-Type: response", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.strip().replace("\r", "%0D").replace("\n", "%0A"))
    if html is None:
        head.append("WARC-Truncated: unspecified")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _written(folder: str, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            files = [("archive/data.warc.gz", bytes(data)), ("indexes/index.cdxj", "".join(lines).encode())]
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(zip_stored(files, zip64))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": len(lines)}])

        data, lines = bytearray(), []
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = gzip.compress(_record(page_id, url, html), 6, mtime=0)
                entry = {"url": url, "filename": "data.warc.gz", "offset": len(data), "length": len(record)}
                lines.append(f"{page_id} 20240101000000 {json.dumps(entry)}\n")
                data += record
                if len(data) >= PACKAGE_BYTES:
                    yield close()
                    data, lines = bytearray(), []
        if lines:
            yield close()

    return run


def write_packages(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Packages pages(page_id, url, html) into files in a folder that exists; returns (path, n_records) of each.

    Only the files it names count: those of tasks that were lost stay behind unread. Null ids and urls give records
    without that header, a null html a record marked as truncated. White space around a url is not kept, and line ends
    in it are escaped. An empty table gives no package; other columns are ignored.
    """
    own = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return saved(own.mapInArrow(_written(folder, zip64), "path string, n_records bigint"), "packages")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages all pages and reads every record back through the packages' indexes."""
    pages = read(spark, sf_dir, "pages")
    folder = new_dir(spark, "wacz")
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at)
    packages = write_packages(pages, folder, zip64=True)
    records = read_packages(packages.select("path"), partitions_for(pages, 1, 8 << 20))
    return records.select(
        F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).cast("bigint").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.col("payload").cast("string").alias("html"),
        "http_status",
        "error",
    )


SQL = "SELECT page_id, url, html, 200::INT AS http_status, NULL::VARCHAR AS error FROM pages"
