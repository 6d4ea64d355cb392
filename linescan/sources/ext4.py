"""Reading ext2, ext3 and ext4 images, by the kernel's published description of the layout."""

from __future__ import annotations

import struct

from linescan.errors import BrokenImage
from linescan.sources.images import DIR, FILE, OTHER, Image, Node

EXTENTS, INLINE = 0x80000, 0x10000000
INCOMPAT_64BIT = 0x80


class Ext4:
    root_id = 2

    def __init__(self, image: Image):
        self.image = image
        sb = image.read(1024, 1024)
        if sb[56:58] != b"\x53\xef":
            raise BrokenImage("no superblock")
        self.block = 1024 << struct.unpack_from("<I", sb, 24)[0]
        self.first_block = struct.unpack_from("<I", sb, 20)[0]
        self.inodes_per_group = struct.unpack_from("<I", sb, 40)[0]
        revision = struct.unpack_from("<I", sb, 76)[0]
        self.inode_size = struct.unpack_from("<H", sb, 88)[0] if revision else 128
        self.wide = bool(struct.unpack_from("<I", sb, 96)[0] & INCOMPAT_64BIT) if revision else False
        size = struct.unpack_from("<H", sb, 254)[0]
        self.descriptor = size if self.wide and size >= 32 else 32
        if self.block > 1 << 16 or not self.inodes_per_group:
            raise BrokenImage("superblock makes no sense")

    def _inode(self, file_id: int) -> bytes:
        if file_id < 1:
            raise BrokenImage(f"no inode {file_id}")
        group, index = divmod(file_id - 1, self.inodes_per_group)
        d = self.image.read((self.first_block + 1) * self.block + group * self.descriptor, self.descriptor)
        table = struct.unpack_from("<I", d, 8)[0]
        if self.wide and self.descriptor >= 64:
            table |= struct.unpack_from("<I", d, 40)[0] << 32
        return self.image.read(table * self.block + index * self.inode_size, self.inode_size)

    def node(self, file_id: int) -> Node:
        raw = self._inode(file_id)
        mode = struct.unpack_from("<H", raw, 0)[0] & 0xF000
        size = struct.unpack_from("<I", raw, 4)[0]
        if mode in (0x8000, 0x4000):
            size |= struct.unpack_from("<I", raw, 108)[0] << 32
        if not struct.unpack_from("<H", raw, 26)[0]:
            raise BrokenImage(f"inode {file_id} isn't in use")
        return Node(file_id, {0x8000: FILE, 0x4000: DIR}.get(mode, OTHER), size, struct.unpack_from("<I", raw, 16)[0])

    def _extents(self, data: bytes, depth: int = 0) -> list[tuple[int, int, int | None]]:
        """(first block of the file, blocks, first block of the image or None where nothing was written)."""
        magic, entries, _, level = struct.unpack_from("<4H", data)
        if magic != 0xF30A or depth > 5:
            raise BrokenImage("broken extent tree")
        found = []
        for i in range(entries):
            at = 12 + 12 * i
            if level:
                low, high = struct.unpack_from("<IH", data, at + 4)
                found += self._extents(self.image.read((high << 32 | low) * self.block, self.block), depth + 1)
            else:
                first, length, high, low = struct.unpack_from("<IHHI", data, at)
                written = length <= 0x8000
                found.append((first, length if written else length - 0x8000, (high << 32 | low) if written else None))
        return found

    def _mapped(self, raw: bytes, blocks: int) -> list[int]:
        """The image's block for each block of a file with direct and indirect pointers; 0 is a hole."""
        per, out = self.block // 4, list(struct.unpack_from("<12I", raw, 40))
        for level, pointer in enumerate(struct.unpack_from("<3I", raw, 88), 1):
            if len(out) >= blocks:
                break
            out += self._indirect(pointer, level, per, blocks - len(out))
        return out[:blocks]

    def _indirect(self, pointer: int, level: int, per: int, most: int) -> list[int]:
        if not pointer:
            return [0] * min(most, per**level)
        inner = struct.unpack(f"<{per}I", self.image.read(pointer * self.block, self.block))
        if level == 1:
            return list(inner[:most])
        out: list[int] = []
        for x in inner:
            if len(out) >= most:
                break
            out += self._indirect(x, level - 1, per, most - len(out))
        return out

    def ranges(self, file_id: int) -> list[tuple[int | None, int]]:
        raw, size = self._inode(file_id), self.node(file_id).size
        blocks, flags = -(-size // self.block), struct.unpack_from("<I", raw, 32)[0]
        if flags & INLINE:
            return []
        if flags & EXTENTS:
            runs = sorted(self._extents(raw[40:100]))
        else:
            runs = [(i, 1, b or None) for i, b in enumerate(self._mapped(raw, blocks))]
        out: list[tuple[int | None, int]] = []
        at = 0

        def add(offset: int | None, n: int) -> None:
            joined = out and ((offset is None and out[-1][0] is None) or (offset is not None and out[-1][0] is not None and out[-1][0] + out[-1][1] == offset))
            if joined:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((offset, n))

        for first, n, start in runs:
            if first >= blocks:
                break
            if first > at:
                add(None, (first - at) * self.block)
            n = min(n, blocks - first)
            add(None if start is None else start * self.block, n * self.block)
            at = first + n
        if at < blocks:
            add(None, (blocks - at) * self.block)
        return out

    def content(self, file_id: int, most: int | None = None) -> bytes:
        size = self.node(file_id).size
        size = size if most is None else min(size, most)
        raw = self._inode(file_id)
        if struct.unpack_from("<I", raw, 32)[0] & INLINE:
            return (raw[40:100] + self._inline_rest(raw))[:size]
        parts, left = [], size
        for offset, n in self.ranges(file_id):
            n = min(n, left)
            parts.append(bytes(n) if offset is None else self.image.read(offset, n))
            left -= n
            if not left:
                break
        return b"".join(parts)

    def _inline_rest(self, raw: bytes) -> bytes:
        """What of an inline file goes on in the extended attribute system.data."""
        if self.inode_size <= 128:
            return b""
        at = 128 + struct.unpack_from("<H", raw, 128)[0]
        if raw[at : at + 4] != b"\x00\x00\x02\xea":
            return b""
        first = entry = at + 4
        while entry + 16 <= len(raw) and raw[entry : entry + 4] != bytes(4):
            length, index, offset, _, size = struct.unpack_from("<BBHII", raw, entry)
            if index == 7 and raw[entry + 16 : entry + 16 + length] == b"data":
                return raw[first + offset : first + offset + size]
            entry += (16 + length + 3) & ~3
        return b""

    def entries(self, file_id: int) -> list[tuple[str, int]]:
        data = self.content(file_id)
        inline = struct.unpack_from("<I", self._inode(file_id), 32)[0] & INLINE
        found, at = [], 4 if inline else 0  # an inline directory begins with its parent's number
        while at + 8 <= len(data):
            inode, step, length = struct.unpack_from("<IHB", data, at)
            if step < 8:
                break
            if inode and length and data[at + 7] != 0xDE:
                found.append((data[at + 8 : at + 8 + length].decode("utf-8", "replace"), inode))
            at += step
        return found
