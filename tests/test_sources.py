import io
import os
import shutil
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from linescan import api, cli
from linescan.config import SearchConfig
from linescan.errors import BrokenImage, InputMissing, NoPermission, PatternError, UnknownFilesystem, exit_code
from linescan.operators.search import search
from linescan.sources import directory, images, mounts, ntfs

FILES = {
    "x.txt": b"hello TODO\n",
    "a/.hidden": b"TODO\n",
    "a/b/deep.txt": b"no\nTODO TODO",
    "a/b/target/t.txt": b"TODO",
    "q.skip": b"TODO",
    "a/r.log": b"TODO",
    "a/keep.log": b"TODO",
    ".gitignore": b"*.skip\n",
    "a/.gitignore": b"*.log\n!keep.log\n",
    "pic.png": b"TODO",
    "empty": b"",
}
FOUND = {"x.txt", "a/.hidden", "a/b/deep.txt", "a/keep.log"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "x.txt", root / "link.txt")
    return str(root)


def test_tree(spark, tree):
    config = SearchConfig("TODO")
    files = api.Searcher(spark).files(config, tree)
    assert {r.path for r in search(files, config).collect()} == FOUND
    every = config.with_flags(everything=True)
    got = {r.path for r in search(api.Searcher(spark).files(every, tree), every).collect()}
    assert got == FOUND | {"q.skip", "a/r.log", "pic.png"}


def test_single_file_and_missing(spark, tree):
    config = SearchConfig("TODO")
    assert [r.path for r in search(api.tree(spark, f"{tree}/x.txt", config), config).collect()] == ["x.txt"]
    with pytest.raises(InputMissing):
        directory.walk(f"{tree}/none")


def test_large_files_come_without_content(spark, tree):
    config = SearchConfig("TODO", max_file_bytes=8)
    rows = api.tree(spark, tree, config).where("text IS NULL").collect()
    assert {r.path for r in rows} >= {"x.txt"} and all(r.size > 8 for r in rows)


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="no mke2fs")
@pytest.mark.parametrize("kind", [["ext4"], ["ext2"], ["ext4", "-O", "inline_data", "-I", "256"], ["ext4", "-b", "1024"]])
def test_ext_image(spark, tree, tmp_path, kind):
    source = tmp_path / "src"
    shutil.copytree(tree, source, symlinks=True)
    (source / "big").write_bytes(os.urandom(700_000))
    with open(source / "sparse", "wb") as f:
        f.write(b"start")
        f.seek(150_000)
        f.write(b"end")
    (source / "many").mkdir()
    for i in range(300):
        (source / "many" / f"a_file_with_a_long_name_{i:04d}").write_text(str(i))
    image = str(tmp_path / "image")
    subprocess.run(["mke2fs", "-q", "-t", *kind, "-d", str(source), image, "16M"], check=True)
    opened, fs = images.opened(image)
    nodes = dict(images.walk(fs))
    assert set(nodes) == {p for p, _ in directory.walk(str(source)).files}
    assert all(fs.content(n.file_id) == (source / p).read_bytes() and n.size == (source / p).stat().st_size for p, n in nodes.items())
    opened.close()
    config = SearchConfig("TODO")
    files = api.Searcher(spark).files(config, "/", image)
    assert {r.path for r in search(files, config).collect()} == FOUND
    inside = api.Searcher(spark).files(config, "/a/b", image)
    assert {r.path for r in search(inside, config).collect()} == {"deep.txt"}
    with pytest.raises(InputMissing):
        images.resolve(images.opened(image)[1], "/none")


def ntfs_attribute(kind, value, name=""):
    raw = name.encode("utf-16-le")
    at = 24 + len(raw)
    at += -at % 8
    body = struct.pack("<IIBBHHHIHBB", kind, 0, 0, len(name), 24, 0, 0, len(value), at, 0, 0) + raw
    body = body.ljust(at, b"\0") + value
    body += bytes(-len(body) % 8)
    return body[:4] + struct.pack("<I", len(body)) + body[8:]


def ntfs_runs(kind, runs, size, name="", cluster=1024):
    raw = name.encode("utf-16-le")
    at = 64 + len(raw)
    at += -at % 8
    clusters = -(-size // cluster)
    body = struct.pack("<IIBBHHHQQHHIQQQ", kind, 0, 1, len(name), 64, 0, 0, 0, clusters - 1, at, 0, 0, clusters * cluster, size, size) + raw
    body = body.ljust(at, b"\0") + runs + b"\0"
    body += bytes(-len(body) % 8)
    return body[:4] + struct.pack("<I", len(body)) + body[8:]


def ntfs_fixed(raw, at):
    out = bytearray(raw)
    n = len(raw) // 512 + 1
    out[4:8] = struct.pack("<HH", at, n)
    out[at : at + 2] = b"\x07\x00"
    for i in range(1, n):
        out[at + 2 * i : at + 2 * i + 2] = out[i * 512 - 2 : i * 512]
        out[i * 512 - 2 : i * 512] = b"\x07\x00"
    return bytes(out)


def ntfs_record(attributes, flags=1):
    head = b"FILE" + bytes(16) + struct.pack("<HH", 56, flags)
    body = head.ljust(56, b"\0") + b"".join(attributes) + b"\xff\xff\xff\xff"
    return ntfs_fixed(body.ljust(1024, b"\0"), 48)


def ntfs_name(number, name, space=1):
    key = bytes(64) + bytes([len(name), space]) + name.encode("utf-16-le")
    size = 16 + len(key)
    size += -size % 8
    return (struct.pack("<QHHI", number, size, len(key), 0) + key).ljust(size, b"\0")


def ntfs_root(entries):
    body = b"".join(entries) + struct.pack("<QHHI", 0, 16, 0, 2)
    return struct.pack("<IIIB3x", 0x30, 1, 4096, 4) + struct.pack("<IIII", 16, 16 + len(body), 16 + len(body), 0) + body


@pytest.fixture(scope="module")
def ntfs_image(tmp_path_factory):
    """Made by hand: 1 KiB clusters, records from cluster 4 on; a directory in a block of its own."""
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    boot[11:13], boot[13] = struct.pack("<H", 512), 2
    boot[48:56], boot[64], boot[68] = struct.pack("<Q", 4), 246, 4
    info = ntfs_attribute(0x10, struct.pack("<QQ", 0, 116444736000000000 + 70 * 10_000_000) + bytes(32))
    records = {
        0: ntfs_record([ntfs_runs(0x80, b"\x11\x28\x04", 40 * 1024)]),
        5: ntfs_record([info, ntfs_attribute(0x90, ntfs_root([ntfs_name(24, "a.txt"), ntfs_name(24, "A~1.TXT", 2), ntfs_name(25, "holes"), ntfs_name(26, "dir"), ntfs_name(2, "$LogFile")]), "$I30")], 3),
        24: ntfs_record([info, ntfs_attribute(0x80, b"a TODO\n")]),
        25: ntfs_record([info, ntfs_runs(0x80, b"\x11\x01\x3c\x01\x02\x11\x01\xfe", 3500)]),
        26: ntfs_record([info, ntfs_attribute(0x90, ntfs_root([]), "$I30"), ntfs_runs(0xA0, b"\x11\x04\x32", 4096, "$I30")], 3),
        27: ntfs_record([info, ntfs_attribute(0x80, b"TODO inside")]),
    }
    image = bytearray(80 * 1024)
    image[:512] = boot
    for i, raw in records.items():
        image[(4 + i) * 1024 : (5 + i) * 1024] = raw
    image[60 * 1024 : 61 * 1024] = b"x" * 1024
    image[58 * 1024 : 59 * 1024] = b"y" * 1024
    entries = ntfs_name(27, "inner.txt") + struct.pack("<QHHI", 0, 16, 0, 2)
    block = (b"INDX" + bytes(20) + struct.pack("<IIII", 40, 40 + len(entries), 4072, 0)).ljust(64, b"\0") + entries
    image[50 * 1024 : 54 * 1024] = ntfs_fixed(block.ljust(4096, b"\0"), 40)
    path = tmp_path_factory.mktemp("ntfs") / "image"
    path.write_bytes(image)
    return str(path)


def test_ntfs_image(spark, ntfs_image):
    _, fs = images.opened(ntfs_image)
    nodes = dict(images.walk(fs))
    assert set(nodes) == {"a.txt", "holes", "dir/inner.txt"}
    assert fs.content(25) == b"x" * 1024 + bytes(2048) + b"y" * 428 and nodes["holes"].size == 3500 and nodes["holes"].mtime == 70
    config = SearchConfig("TODO")
    got = search(api.Searcher(spark).files(config, None, ntfs_image), config).collect()
    assert sorted(r.path for r in got) == ["a.txt", "dir/inner.txt"]
    with pytest.raises(BrokenImage):
        fs.node(30)


def test_run_list():
    assert ntfs.run_list(b"\x11\x01\x3c\x01\x02\x11\x01\xfe\0") == [(60, 1), (None, 2), (58, 1)]


def test_detect(tmp_path):
    assert images.detect(bytes(3) + b"NTFS    ") == "ntfs"
    assert images.detect(bytes(32) + b"NXSB") == "apfs"
    assert images.detect(bytes(1080) + b"\x53\xef") == "ext4"
    (tmp_path / "none").write_bytes(bytes(4096))
    with pytest.raises(UnknownFilesystem):
        images.opened(str(tmp_path / "none"))
    with pytest.raises(InputMissing):
        images.opened(str(tmp_path / "missing"))


def test_mounts():
    table = mounts.parse_mounts("/dev/a / ext4 rw 0 0\n/dev/b /home/my\\040disk ext4 rw 0 0\n/dev/c /home tmpfs rw 0 0\nbroken\n")
    assert mounts.device_of("/home/my disk/x", table) == ("/dev/b", "/x")
    assert mounts.device_of("/usr", table) == ("/dev/a", "/usr")
    assert mounts.device_of("/homes", table) == ("/dev/a", "/homes")
    with pytest.raises(UnknownFilesystem):
        mounts.device_of("/home/x", table)


def test_exit_codes():
    assert [exit_code(e) for e in (None, NoPermission(), InputMissing(), PatternError(), RuntimeError(), PermissionError(), FileNotFoundError())] == [0, 77, 66, 2, 1, 77, 66]


def test_command_line(spark, tree, tmp_path, capsys):
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        args = cli.parser().parse_args(["TODO", tree, "--jump", "--no-color", "--stats", "--cache-dir", cache])
        out = io.StringIO()
        cli.run(spark, args, out)
        lines = out.getvalue().splitlines()
        assert {x for x in lines if ": " in x and x.startswith("/")} == {
            f"{tree}/x.txt:1: hello TODO", f"{tree}/a/.hidden:1: TODO", f"{tree}/a/b/deep.txt:2: TODO TODO", f"{tree}/a/keep.log:1: TODO",
        }
        assert "Search complete" in lines
    assert cli.main(["x", f"{tree}/none"]) == 66
    assert cli.main(["(", tree]) == 2
    assert cli.main(["-u", "--large", "x", tree]) == 2


def test_table_function(spark):
    api.register_grep(spark)
    rows = spark.sql("SELECT * FROM grep('a TODO\\nb\\nTODO', 'TO+')").collect()
    assert [tuple(r) for r in rows] == [(1, "a TODO"), (3, "TODO")]


def test_sinks(spark, tree):
    config, searcher = SearchConfig("TODO"), api.Searcher(spark)
    found = searcher.search(searcher.files(config, tree), config)
    assert {r.path for r in searcher.rows(found)} == FOUND
    seen = spark.sparkContext.accumulator(0)
    searcher.each(found, lambda row: seen.add(1))
    assert seen.value == len(FOUND)
    said = []
    api.Searcher(spark, lambda *a: said.append(a[:2])).files(config, tree)
    assert said == [(tree, None)]
    assert searcher.stats(searcher.files(config, tree), config).first().files_contained_matches == len(FOUND)
    assert api.tree(spark, tree, config).select(F.max("size")).first()[0] > 0
