"""Reading members of ZIP packages by byte ranges, without extraction.

Follows the public APPNOTE layout: the end-of-central-directory record is
found from the file's tail, ZIP64 records are used wherever a 16- or 32-bit
field is full, and each member's data start comes from its local header.
Only stored (uncompressed) members can be read in ranges.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow.fs as pafs

# Signatures and fixed sizes of the ZIP format.
END_OF_DIRECTORY = b"PK\x05\x06"
ZIP64_LOCATOR = b"PK\x06\x07"
ZIP64_END = b"PK\x06\x06"
DIRECTORY_ENTRY = b"PK\x01\x02"
LOCAL_HEADER = b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class ZipRanges:
    """A ZIP package behind ``read_at(length, offset)`` and ``size()``."""

    def __init__(self, file) -> None:
        self.file, self.length = file, file.size()
        self.members = {m.name: m for m in self._directory()}

    def _at(self, offset: int, n: int) -> bytes:
        data = self.file.read_at(n, offset)
        if len(data) < n:
            raise ValueError("the ZIP package ends too early")
        return data

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        n = min(self.length, 22 + FULL16)
        tail = self._at(self.length - n, n)
        at = len(tail)
        while True:
            at = tail.rfind(END_OF_DIRECTORY, 0, at)
            if at < 0:
                raise ValueError("not a ZIP package: no end of the central directory")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 not in (entries,) and FULL32 not in (size, offset):
            return entries, size, offset
        locator = self._at(self.length - n + at - 20, 20)
        if locator[:4] != ZIP64_LOCATOR:
            raise ValueError("a ZIP64 locator is missing")
        record = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != ZIP64_END:
            raise ValueError("a ZIP64 end of the central directory is missing")
        return struct.unpack_from("<QQQ", record, 32)

    def _directory(self):
        entries, size, offset = self._end()
        data, at = self._at(offset, size), 0
        for _ in range(entries):
            if data[at : at + 4] != DIRECTORY_ENTRY:
                raise ValueError("a central directory entry is damaged")
            method, stored, full = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are full, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = next(wide) if full == FULL32 else full
                    stored = next(wide) if stored == FULL32 else stored
                    header = next(wide) if header == FULL32 else header
                extra = extra[4 + n :]
            yield Member(name, method, full, stored, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where the member's data starts."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self._at(m.header, 30)
        if head[:4] != LOCAL_HEADER:
            raise ValueError(f"the local header of {name} is damaged")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        m = self.members[name]
        n = m.size - offset if n is None else n
        if offset < 0 or offset + n > m.size:
            raise ValueError(f"the range lies outside {name}")
        return self._at(self.start(name) + offset, n)
