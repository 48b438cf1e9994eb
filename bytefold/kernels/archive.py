"""Zip archives: the central directory, stored and deflated entries, checksums and size limits."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from .binary import Cursor, FormatError

LIMIT = 64 << 20
STORED, DEFLATED = 0, 8
END, ENTRY, LOCAL = 0x06054B50, 0x02014B50, 0x04034B50
UNKNOWN = 0xFFFFFFFF


@dataclass
class Entry:
    ord: int
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    offset: int
    is_dir: bool


def _end(data: bytes) -> int:
    """The end record: the last one whose comment fits the rest of the file."""
    at = len(data)
    while (at := data.rfind(END.to_bytes(4, "little"), max(0, len(data) - 65557), at)) >= 0:
        if at + 22 <= len(data) and at + 22 + int.from_bytes(data[at + 20 : at + 22], "little") <= len(data):
            return at
    raise FormatError("no end of central directory")


def entries(data: bytes) -> list[Entry]:
    """In the order of the central directory, with its sizes; zip64 extra fields stand in for sizes that do not fit."""
    c = Cursor(data, _end(data) + 10, little=True)
    count, _, at = c.u2(), c.u4(), c.u4()
    c.at, out = at, []
    for n in range(count):
        if c.u4() != ENTRY:
            raise FormatError(f"entry {n} of the central directory is damaged")
        c.take(4)
        flags, method, _, crc, packed, size = c.u2(), c.u2(), c.u4(), c.u4(), c.u4(), c.u4()
        name_size, extra_size, comment_size = c.u2(), c.u2(), c.u2()
        c.take(8)
        offset = c.u4()
        raw = c.take(name_size)
        name, extra = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), Cursor(c.take(extra_size), little=True)
        c.take(comment_size)
        while UNKNOWN in (packed, size, offset):
            if extra.at + 4 > len(extra.data):
                raise FormatError(f"{name} lacks its zip64 sizes")
            tag, body = extra.u2(), Cursor(extra.take(extra.u2()), little=True)
            if tag == 1:
                size, packed, offset = (int.from_bytes(body.take(8), "little") if x == UNKNOWN else x for x in (size, packed, offset))
                break
        out.append(Entry(n, name, method, flags, crc, packed, size, offset, name.endswith("/")))
    return out


def read(data: bytes, entry: Entry, limit: int = LIMIT, check: bool = True) -> bytes:
    """The entry's bytes; more than `limit` of them, an unknown method or a wrong checksum is an error. A recorded checksum of 0 is not checked."""
    c = Cursor(data, entry.offset, little=True)
    if c.u4() != LOCAL:
        raise FormatError(f"{entry.name} has no local header")
    c.take(22)
    name_size, extra_size = c.u2(), c.u2()
    c.take(name_size + extra_size)
    raw = c.take(entry.packed)
    if entry.method == STORED:
        out = raw
    elif entry.method == DEFLATED:
        unpacker = zlib.decompressobj(-15)
        try:
            out = unpacker.decompress(raw, limit + 1)
        except zlib.error as e:
            raise FormatError(f"{entry.name}: {e}") from e
        if len(out) <= limit and not unpacker.eof:
            raise FormatError(f"{entry.name} ends before its data does")
    else:
        raise FormatError(f"{entry.name} is packed by the unsupported method {entry.method}")
    if len(out) > limit:
        raise FormatError(f"{entry.name} has more than {limit} bytes")
    if check and entry.crc and zlib.crc32(out) != entry.crc:
        raise FormatError(f"{entry.name} has a wrong checksum")
    return out
