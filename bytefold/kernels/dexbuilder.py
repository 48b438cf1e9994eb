"""A writer of small dex files, for fixtures: one class with static methods of raw code units."""

from __future__ import annotations

import struct

from .binary import to_modified_utf8


def uleb(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def build(name: str, methods: dict[str, list[int]], fields: tuple[str, ...] = (), source: str | None = None, tries: dict[str, list[tuple]] | None = None) -> bytes:
    """`methods` of ()V by name with their 16-bit code units; `fields` are static ints; `tries` of a method are (start, count,
    [(type, handler), ...], handler of all others or None)."""
    tries = tries or {}
    caught = {t for rows in tries.values() for row in rows for t, _ in row[2]}
    names = sorted({name, "Ljava/lang/Object;", "V", "I", *caught, *methods, *fields, *([source] if source else [])})
    types = sorted({name, "Ljava/lang/Object;", "V", "I", *caught}, key=names.index)
    at = 0x70
    places = {}
    for part, count, size in (("string", len(names), 4), ("type", len(types), 4), ("proto", 1, 12), ("field", len(fields), 8), ("method", len(methods), 8), ("class", 1, 32)):
        places[part] = (count, at if count else 0)
        at += count * size
    data, codes, strings = bytearray(), [], []

    def place(raw: bytes, align: int = 1) -> int:
        data.extend(b"\0" * (-(at + len(data)) % align))
        data.extend(raw)
        return at + len(data) - len(raw)

    for m in sorted(methods):
        units = methods[m]
        rows, handlers, items = tries.get(m, ()), bytearray(uleb(len(tries.get(m, ())))), b""
        for start, count, typed, others in rows:
            items += struct.pack("<IHH", start, count, len(handlers))
            handlers += bytes([(len(typed) if others is None else -len(typed)) & 0x7F])  # signed, of one byte
            handlers += b"".join(uleb(types.index(t)) + uleb(h) for t, h in typed) + (b"" if others is None else uleb(others))
        code = struct.pack("<HHHHII", 8, 0, 0, len(rows), 0, len(units)) + b"".join(struct.pack("<H", u) for u in units)
        codes.append(place(code + (b"\0\0" * (len(units) % 2) + items + bytes(handlers) if rows else b""), 4))
    body = uleb(len(fields)) + uleb(0) + uleb(len(methods)) + uleb(0)
    body += b"".join(uleb(0 if k == 0 else 1) + uleb(0x9) for k in range(len(fields)))
    body += b"".join(uleb(0 if k == 0 else 1) + uleb(0x9) + uleb(c) for k, c in enumerate(codes))
    members = place(body)
    for s in names:
        strings.append(place(uleb(len(s)) + to_modified_utf8(s) + b"\0"))
    ids = b"".join(struct.pack("<I", o) for o in strings)
    ids += b"".join(struct.pack("<I", names.index(t)) for t in types)
    ids += struct.pack("<III", names.index("V"), types.index("V"), 0)
    ids += b"".join(struct.pack("<HHI", types.index(name), types.index("I"), names.index(f)) for f in sorted(fields))
    ids += b"".join(struct.pack("<HHI", types.index(name), 0, names.index(m)) for m in sorted(methods))
    ids += struct.pack("<8I", types.index(name), 1, types.index("Ljava/lang/Object;"), 0, names.index(source) if source else 0xFFFFFFFF, 0, members, 0)
    total = at + len(data)
    head = b"dex\n035\0" + b"\0" * 24 + struct.pack("<IIIIII", total, 0x70, 0x12345678, 0, 0, 0)
    head += b"".join(struct.pack("<II", *places[p]) for p in ("string", "type", "proto", "field", "method", "class")) + struct.pack("<II", len(data), at)
    return head + ids + bytes(data)
