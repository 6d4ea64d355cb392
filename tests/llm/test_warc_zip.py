import gzip
import io
import json
import struct
import zipfile

import pytest

from linescan.llm import warc_zip as Z

URL = "https://a.example/x?q=ü"


def record(body=b"<p>hi</p>", uri=URL, kind="response"):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def reader(data):
    return lambda offset, length: data[offset : offset + length] if offset >= 0 else b""


def read(spark, *packages):
    paths = spark.createDataFrame([(p,) for p in packages], "path string")
    return Z.read_packages(paths, 3).collect()


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_as_the_standard_library_sees_it(zip64):
    files = [("a/ü.txt", b"one"), ("b", b""), ("c", bytes(1000))]
    data = Z.zip_stored(files, zip64)
    with zipfile.ZipFile(io.BytesIO(data)) as known:
        assert [(i.filename, known.read(i)) for i in known.infolist()] == files
    found = Z.members(reader(data), len(data))
    assert [(m.name, data[(at := Z.data_offset(reader(data), m)) : at + m.size]) for m in found] == files


def test_standard_librarys_files():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("x", "hello")
        with out.open("big", "w", force_zip64=True) as member:
            member.write(b"wide")
        out.comment = b"PK\5\6 in a comment"
    data = buffer.getvalue()
    found = {m.name: data[(at := Z.data_offset(reader(data), m)) : at + m.size] for m in Z.members(reader(data), len(data))}
    assert found == {"x": b"hello", "big": b"wide"}


def test_zip64_offsets_beyond_4_gib():
    """A directory whose entry has size and place only in its ZIP64 field, far away; the rest is never read."""
    place = 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, 7 << 32, 7 << 32, place)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, Z.MARK32, Z.MARK32, 1, len(extra), 0, 0, 0, 0, Z.MARK32) + b"f" + extra
    start = 20 << 32
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    tail = entry + end + struct.pack("<4sIQI", b"PK\6\7", 0, start + len(entry), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, Z.MARK16, Z.MARK16, Z.MARK32, Z.MARK32, 0)
    [m] = Z.members(lambda at, n: (bytes(max(0, min(n, start - at))) + tail[max(0, at - start) : max(0, at + n - start)]), start + len(tail))
    assert (m.size, m.header) == (7 << 32, place)


def test_broken_directories():
    good = Z.zip_stored([("a", b"x")])
    for bad in (b"", b"no zip at all", good[:-30], good.replace(b"PK\1\2", b"PK\7\7")):
        with pytest.raises(Z.BadPackage):
            Z.members(reader(bad), len(bad))


def package(path, records, index=True, gz=True, extra=(), entries=None):
    data, lines = b"", []
    for r in records:
        raw = gzip.compress(r) if gz else r
        lines.append(json.dumps({"filename": "data.warc.gz" if gz else "data.warc", "offset": str(len(data)), "length": len(raw)}))
        data += raw
    files = [("archive/data.warc.gz" if gz else "archive/data.warc", data)]
    if index:
        text = "!meta\n" + "".join(f"com,example 2024 {x}\n" for x in (entries if entries is not None else lines))
        files.append(("indexes/index.cdxj", text.encode()))
    path.write_bytes(Z.zip_stored([*files, *extra]))
    return f"file://{path}"


@pytest.mark.parametrize("index,gz", [(True, True), (False, True), (True, False), (False, False)])
def test_records(spark, tmp_path, index, gz):
    at = package(tmp_path / "p.wacz", [record(b"x" * n) for n in (0, 10, 300_000)], index, gz)
    rows = sorted(read(spark, at), key=lambda r: r.offset)
    assert [(len(r.payload), r.http_status, r.content_type, r.target_uri, r.error) for r in rows] == [(n, 404, "text/html", URL, None) for n in (0, 10, 300_000)]


def test_old_index_and_gzipped_index(spark, tmp_path):
    raw = gzip.compress(record())
    lines = f" CDX N b a m s k r M S V g\ncom,a)/ 2024 {URL} text/html 404 X - - {len(raw)} 0 data.warc.gz\n"
    (tmp_path / "p").write_bytes(Z.zip_stored([("archive/data.warc.gz", raw), ("indexes/index.cdx.gz", gzip.compress(lines.encode()))]))
    [r] = read(spark, f"file://{tmp_path}/p")
    assert r.payload == b"<p>hi</p>" and r.error is None


def test_errors_are_rows_and_the_rest_is_read(spark, tmp_path):
    good = package(tmp_path / "good", [record()])
    entries = [json.dumps({"filename": "data.warc.gz", "offset": 0, "length": len(gzip.compress(record()))})] * 2
    entries += [json.dumps({"filename": "data.warc.gz", "offset": 10**9, "length": 5}), json.dumps({"filename": "none.warc.gz", "offset": 0, "length": 5}), "{broken", json.dumps({"filename": "data.warc.gz", "offset": 1, "length": 9})]
    mixed = package(tmp_path / "mixed", [record()], entries=entries)
    (tmp_path / "broken").write_bytes(b"junk")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("archive/data.warc.gz", gzip.compress(record()))
    (tmp_path / "deflated").write_bytes(buffer.getvalue())
    cut = package(tmp_path / "cut", [record()], index=False)
    data = gzip.compress(record())
    (tmp_path / "cut").write_bytes(Z.zip_stored([("archive/data.warc.gz", data[:-20])]))
    rows = read(spark, good, mixed, f"file://{tmp_path}/broken", f"file://{tmp_path}/deflated", cut, f"file://{tmp_path}/missing", None, package(tmp_path / "none", []))
    fine = [r for r in rows if r.error is None]
    assert sorted(r.path.rpartition("/")[2] for r in fine) == ["good", "mixed"]
    failed = sorted(r.path.rpartition("/")[2] for r in rows if r.error is not None)
    assert failed == ["broken", "cut", "deflated", "missing", "mixed", "mixed", "mixed", "mixed"]


def test_round_trip(spark, tmp_path):
    rows = [(1, URL, "<p>ü</p>"), (None, "u", "x"), (2, None, None), (3, "v", ""), (4, "w", "y" * 500_000), (5, "w", "a\r\n\r\nb"), (5, "w", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "x", None) for r in rows], "page_id long, url string, html string, path string, error string")
    packages = Z.write_packages(pages, f"file://{tmp_path}", zip64=True)
    found = Z.read_packages(packages.select("path"), 2).collect()
    got = [(int(r.record_id[10:-1]) if r.record_id else None, r.target_uri, None if r.payload is None else r.payload.decode()) for r in found]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert Z.write_packages(pages.limit(0), f"file://{tmp_path}").count() == 0
    assert Z.read_packages(packages.select("path").limit(0), 2).count() == 0


def test_small_packages_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "PACKAGE_BYTES", 2000)
    monkeypatch.setattr(Z, "RANGE_BYTES", 500)
    pages = spark.createDataFrame([(i, f"u{i}", str(i) * 50) for i in range(100)], "page_id long, url string, html string").coalesce(1)
    packages = Z.write_packages(pages, f"file://{tmp_path}")
    assert packages.count() > 5
    found = Z.read_packages(packages.select("path"), 4)
    assert sorted(int(r.target_uri[1:]) for r in found.collect()) == list(range(100))


def test_malformed_input_gives_error_rows(spark, tmp_path):
    good = gzip.compress(Z._record(1, "http://a", "x"), mtime=0)
    line = lambda **x: "a 2024 " + json.dumps({"filename": "data.warc.gz", "offset": 0, "length": len(good)} | x) + "\n"
    bad = [line(offset=None), line(offset=-5), line(length="many"), line(offset=1 << 70), 'a 2024 {"offset": 0, "length": 3}\n', "a 2024 [{\n", line()]
    packages = {
        "lines": [("archive/data.warc.gz", good), ("indexes/index.cdxj", "".join(bad).encode())],
        "cut": [("archive/data.warc.gz", good), ("indexes/index.cdx.gz", gzip.compress(line().encode())[:-9])],
        "plain": [("archive/data.warc", b"".join(Z._record(i, None, "y" * 40000) for i in range(3)) + b"no record")],
    }
    for name, files in packages.items():
        (tmp_path / name).write_bytes(Z.zip_stored(files))
    name = Z.zip_stored([("archive/\u00e9.warc", b"")]).replace("\u00e9".encode(), b"\xff\xfe")
    (tmp_path / "name").write_bytes(name)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{x}",) for x in [*packages, "name", "missing"]], "path string")
    rows = [(r.path.rpartition("/")[2], r.record_id, r.error is None) for r in Z.read_packages(paths, 2).collect()]
    of = lambda x: sorted(r[1:] for r in rows if r[0] == x)
    key = lambda r: (str(r[0]), r[1])
    assert sorted((r[1:] for r in rows if r[0] == "lines"), key=key) == sorted([(None, False)] * 6 + [("<urn:page:1>", True)], key=key)
    assert sorted((r[1:] for r in rows if r[0] == "cut"), key=key) == sorted([(None, False), ("<urn:page:1>", True)], key=key)
    assert sorted((r[1:] for r in rows if r[0] == "plain"), key=key) == sorted([(None, False)] + [(f"<urn:page:{i}>", True) for i in range(3)], key=key)
    assert of("name") == [(None, False)] and of("missing") == [(None, False)]
