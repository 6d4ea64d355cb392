"""Which mounted device a path is on, and its path inside of it; from the text of /proc/mounts."""

from __future__ import annotations

import re

from linescan.errors import InputMissing, UnknownFilesystem

READABLE = ("ext2", "ext3", "ext4", "ntfs", "ntfs3", "fuseblk")


def unescape(field: str) -> str:
    """Octal escapes of blanks and backslashes, as in /proc/mounts."""
    return re.sub(r"\\([0-7]{3})", lambda m: chr(int(m[1], 8)), field)


def parse_mounts(text: str) -> list[tuple[str, str, str]]:
    """(device, mount point, filesystem) of each line; lines with fewer fields are left out."""
    rows = [line.split() for line in text.splitlines()]
    return [(unescape(r[0]), unescape(r[1]), r[2]) for r in rows if len(r) >= 3]


def device_of(path: str, mounts: list[tuple[str, str, str]]) -> tuple[str, str]:
    """Device, and path inside it, of an absolute path: the longest mount point above it decides, of equal ones the last."""
    best = None
    for device, point, kind in mounts:
        inside = point == "/" or path == point or path.startswith(point.rstrip("/") + "/")
        if inside and (best is None or len(point) >= len(best[1])):
            best = (device, point, kind)
    if best is None:
        raise InputMissing(path)
    if best[2] not in READABLE:
        raise UnknownFilesystem(f"{path} is on {best[2]}")
    rest = path[len(best[1].rstrip("/")) :]
    return best[0], rest or "/"
