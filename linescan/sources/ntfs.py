"""Reading NTFS images, by public descriptions of the layout."""

from __future__ import annotations

import struct

from linescan.errors import BrokenImage
from linescan.sources.images import DIR, FILE, Image, Node

LIST, NAME, DATA, INDEX_ROOT, INDEX_ALLOCATION = 0x20, 0x30, 0x80, 0x90, 0xA0
INDEX_NAME = "$I30"


def signed(raw: bytes) -> int:
    return int.from_bytes(raw, "little", signed=True)


def run_list(raw: bytes) -> list[tuple[int | None, int]]:
    """(first cluster or None for a hole, clusters), from their packed form, in which places are differences."""
    out: list[tuple[int | None, int]] = []
    at = place = 0
    while at < len(raw) and raw[at]:
        n, m = raw[at] & 15, raw[at] >> 4
        length = int.from_bytes(raw[at + 1 : at + 1 + n], "little")
        if m:
            place += signed(raw[at + 1 + n : at + 1 + n + m])
        out.append((place if m else None, length))
        at += 1 + n + m
    return out


def unix_time(ticks: int) -> int:
    return max(0, ticks // 10_000_000 - 11_644_473_600)


class Ntfs:
    root_id = 5

    def __init__(self, image: Image):
        self.image = image
        boot = image.read(0, 512)
        if boot[3:11] != b"NTFS    ":
            raise BrokenImage("no NTFS boot sector")
        self.sector = struct.unpack_from("<H", boot, 11)[0]
        per = boot[13] if boot[13] <= 128 else 1 << (256 - boot[13])
        self.cluster = self.sector * per
        self.record = self._size(boot[64])
        self.index_block = self._size(boot[68])
        if not self.sector or not self.cluster:
            raise BrokenImage("boot sector makes no sense")
        self.mft: list[tuple[int | None, int]] = [(struct.unpack_from("<Q", boot, 48)[0], -(-self.record // self.cluster))]
        self.mft = self._data_runs(self._record(0), DATA, "")[0]

    def _size(self, raw: int) -> int:
        return raw * self.cluster if raw < 128 else 1 << (256 - raw)

    def _fixed(self, raw: bytes, magic: bytes) -> bytes:
        """The block with the last two bytes of each sector put back, which a check number replaces on disk."""
        if raw[:4] != magic:
            raise BrokenImage(f"no {magic!r} block")
        at, n = struct.unpack_from("<HH", raw, 4)
        out, check = bytearray(raw), raw[at : at + 2]
        for i in range(1, n):
            end = i * self.sector
            if end > len(out) or out[end - 2 : end] != check:
                raise BrokenImage("sector of another version within a block")
            out[end - 2 : end] = raw[at + 2 * i : at + 2 * i + 2]
        return bytes(out)

    def _read_runs(self, runs: list[tuple[int | None, int]], offset: int, length: int) -> bytes:
        parts, at = [], 0
        for start, n in runs:
            size = n * self.cluster
            lo, hi = max(offset, at), min(offset + length, at + size)
            if lo < hi:
                parts.append(bytes(hi - lo) if start is None else self.image.read(start * self.cluster + lo - at, hi - lo))
            at += size
        return b"".join(parts)

    def _record(self, number: int) -> bytes:
        raw = self._read_runs(self.mft, number * self.record, self.record)
        if len(raw) < self.record:
            raise BrokenImage(f"no record {number}")
        return self._fixed(raw, b"FILE")

    def _attributes(self, record: bytes) -> list[tuple[int, str, bytes]]:
        found, at = [], struct.unpack_from("<H", record, 20)[0]
        while at + 16 <= len(record):
            kind, size = struct.unpack_from("<II", record, at)
            if kind == 0xFFFFFFFF or size < 16:
                break
            raw = record[at : at + size]
            name = raw[struct.unpack_from("<H", raw, 10)[0] :][: 2 * raw[9]].decode("utf-16-le", "replace")
            found.append((kind, name, raw))
            at += size
        listed = next((a for a in found if a[0] == LIST), None)
        if listed:
            here, data, at = struct.unpack_from("<I", record, 44)[0], self._value(listed[2]), 0
            others = set()
            while at + 26 <= len(data):
                step = struct.unpack_from("<H", data, at + 4)[0]
                others.add(int.from_bytes(data[at + 16 : at + 22], "little"))
                if step < 26:
                    break
                at += step
            for other in sorted(others - {here}):
                found += [a for a in self._attributes_of_extension(other)]
        return found

    def _attributes_of_extension(self, number: int) -> list[tuple[int, str, bytes]]:
        record = self._record(number)
        at, found = struct.unpack_from("<H", record, 20)[0], []
        while at + 16 <= len(record):
            kind, size = struct.unpack_from("<II", record, at)
            if kind == 0xFFFFFFFF or size < 16:
                break
            raw = record[at : at + size]
            found.append((kind, raw[struct.unpack_from("<H", raw, 10)[0] :][: 2 * raw[9]].decode("utf-16-le", "replace"), raw))
            at += size
        return found

    def _value(self, raw: bytes) -> bytes:
        if not raw[8]:
            n, at = struct.unpack_from("<IH", raw, 16)
            return raw[at : at + n]
        size = struct.unpack_from("<Q", raw, 48)[0]
        return self._read_runs(run_list(raw[struct.unpack_from("<H", raw, 32)[0] :]), 0, size)

    def _data_runs(self, record: bytes, kind: int, name: str) -> tuple[list[tuple[int | None, int]], int, bytes | None]:
        """Runs, size, and the value itself where it is in the record; parts in several records are put together."""
        parts = [raw for k, n, raw in self._attributes(record) if k == kind and n == name]
        if not parts:
            return [], 0, b""
        if not parts[0][8]:
            value = self._value(parts[0])
            return [], len(value), value
        parts.sort(key=lambda raw: struct.unpack_from("<Q", raw, 16)[0])
        flags = struct.unpack_from("<H", parts[0], 12)[0]
        if flags & 0x4001:
            raise BrokenImage("compressed or encrypted data")
        runs = [r for raw in parts for r in run_list(raw[struct.unpack_from("<H", raw, 32)[0] :])]
        return runs, struct.unpack_from("<Q", parts[0], 48)[0], None

    def node(self, file_id: int) -> Node:
        record = self._record(file_id)
        flags = struct.unpack_from("<H", record, 22)[0]
        if not flags & 1:
            raise BrokenImage(f"record {file_id} isn't in use")
        time = next((unix_time(struct.unpack_from("<Q", self._value(raw), 8)[0]) for k, _, raw in self._attributes(record) if k == 0x10), 0)
        if flags & 2:
            return Node(file_id, DIR, 0, time)
        return Node(file_id, FILE, self._data_runs(record, DATA, "")[1], time)

    def ranges(self, file_id: int) -> list[tuple[int | None, int]]:
        runs, size, _ = self._data_runs(self._record(file_id), DATA, "")
        out = []
        for start, n in runs:
            n = min(n * self.cluster, size)
            if n:
                out.append((None if start is None else start * self.cluster, n))
            size -= n
        return out

    def content(self, file_id: int, most: int | None = None) -> bytes:
        runs, size, value = self._data_runs(self._record(file_id), DATA, "")
        size = size if most is None else min(size, most)
        return value[:size] if value is not None else self._read_runs(runs, 0, size)

    def entries(self, file_id: int) -> list[tuple[str, int]]:
        record, found = self._record(file_id), {}
        root = next((self._value(raw) for k, n, raw in self._attributes(record) if k == INDEX_ROOT and n == INDEX_NAME), None)
        if root is None:
            raise BrokenImage(f"record {file_id} is no directory")
        self._nodes(root[16 + struct.unpack_from("<I", root, 16)[0] :], found)
        runs, size, _ = self._data_runs(record, INDEX_ALLOCATION, INDEX_NAME)
        for at in range(0, size, self.index_block):
            raw = self._read_runs(runs, at, self.index_block)
            if raw[:4] != b"INDX":  # never used
                continue
            block = self._fixed(raw, b"INDX")
            start, used = struct.unpack_from("<II", block, 24)
            self._nodes(block[24 + start : 24 + used], found)
        return sorted(((name, i) for name, i in found.items()), key=lambda e: e[1])

    def _nodes(self, data: bytes, found: dict[str, int]) -> None:
        at = 0
        while at + 16 <= len(data):
            step, length, flags = struct.unpack_from("<HHH", data, at + 8)
            if flags & 2 or step < 16:
                break
            key = data[at + 16 : at + 16 + length]
            if length >= 66 and key[65] != 2:  # names in the DOS form are second names
                name = key[66 : 66 + 2 * key[64]].decode("utf-16-le", "replace")
                number = int.from_bytes(data[at : at + 6], "little")
                if number >= 24 or number == 5:  # below are the filesystem's own files
                    found[name] = number
            at += step
