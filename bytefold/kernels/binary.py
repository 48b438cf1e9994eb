"""A bounds-checked byte cursor, variable-length integers and modified UTF-8."""

from __future__ import annotations

import struct


class FormatError(ValueError):
    """Bytes that do not follow their format; a short read is one."""


class Cursor:
    def __init__(self, data: bytes, at: int = 0, little: bool = False):
        self.data, self.at, self.order = data, at, "<" if little else ">"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError(f"{n} bytes asked at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def _read(self, code: str, n: int):
        return struct.unpack(self.order + code, self.take(n))[0]

    def u1(self) -> int:
        return self.take(1)[0]

    def i1(self) -> int:
        return self._read("b", 1)

    def u2(self) -> int:
        return self._read("H", 2)

    def i2(self) -> int:
        return self._read("h", 2)

    def u4(self) -> int:
        return self._read("I", 4)

    def i4(self) -> int:
        return self._read("i", 4)

    def i8(self) -> int:
        return self._read("q", 8)

    def f4(self) -> float:
        return self._read("f", 4)

    def f8(self) -> float:
        return self._read("d", 8)

    def uleb128(self, most: int = 5) -> int:
        value = 0
        for k in range(most):
            byte = self.u1()
            value |= (byte & 0x7F) << (7 * k)
            if not byte & 0x80:
                return value & ((1 << 64) - 1 if most > 5 else 0xFFFFFFFF)
        raise FormatError("a LEB128 number does not end")

    def uleb128p1(self) -> int:
        """One less than stored; stored 0 is -1."""
        return self.uleb128() - 1

    def sleb128(self) -> int:
        value = 0
        for k in range(5):
            byte = self.u1()
            value |= (byte & 0x7F) << (7 * k)
            if not byte & 0x80:
                bits = 7 * (k + 1)
                value &= (1 << bits) - 1
                if byte & 0x40:
                    value -= 1 << bits
                return max(-(1 << 31), min((1 << 31) - 1, value)) if bits > 32 else value
        raise FormatError("a LEB128 number does not end")


def modified_utf8(raw: bytes) -> str:
    """C0 80 is NUL and surrogate pairs stand as two three-byte units; a wrong byte reads as `?`, a lone surrogate as U+FFFD."""
    units: list[int] = []
    i, n = 0, len(raw)
    while i < n:
        a = raw[i]
        b = raw[i + 1] & 0x3F if i + 1 < n and raw[i + 1] & 0xC0 == 0x80 else None
        c = raw[i + 2] & 0x3F if i + 2 < n and raw[i + 2] & 0xC0 == 0x80 else None
        if a < 0x80:
            units.append(a)
            i += 1
        elif a & 0xE0 == 0xC0 and b is not None:
            units.append((a & 0x1F) << 6 | b)
            i += 2
        elif a & 0xF0 == 0xE0 and b is not None and c is not None:
            units.append((a & 0x0F) << 12 | b << 6 | c)
            i += 3
        else:
            units.append(0x3F)
            i += 1
    return b"".join(struct.pack("<H", u) for u in units).decode("utf-16-le", "replace")


def to_modified_utf8(text: str) -> bytes:
    raw = text.encode("utf-16-be", "surrogatepass")
    out = bytearray()
    for (u,) in struct.iter_unpack(">H", raw):
        if 0 < u < 0x80:
            out.append(u)
        elif u < 0x800:
            out += bytes((0xC0 | u >> 6, 0x80 | u & 0x3F))
        else:
            out += bytes((0xE0 | u >> 12, 0x80 | u >> 6 & 0x3F, 0x80 | u & 0x3F))
    return bytes(out)
