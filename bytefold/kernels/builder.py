"""An assembler of class files, for fixtures and round trips."""

from __future__ import annotations

import struct

from . import classfile as cf
from .binary import to_modified_utf8


class ClassBuilder:
    def __init__(self, name: str, above: str = "java/lang/Object", access: int = 0x21, major: int = 52):
        self.entries: list[bytes] = []
        self.known: dict[tuple, int] = {}
        self.slots = 1
        self.access, self.major = access, major
        self.this, self.above = self.class_ref(name), self.class_ref(above)
        self.interfaces: list[int] = []
        self.fields: list[bytes] = []
        self.methods: list[bytes] = []
        self.attrs: list[bytes] = []

    def _add(self, key: tuple, raw: bytes, slots: int = 1) -> int:
        if key not in self.known:
            self.known[key] = self.slots
            self.slots += slots
            self.entries.append(raw)
        return self.known[key]

    def utf8(self, text: str) -> int:
        raw = to_modified_utf8(text)
        return self._add((cf.UTF8, text), struct.pack(">BH", cf.UTF8, len(raw)) + raw)

    def class_ref(self, name: str) -> int:
        at = self.utf8(name)
        return self._add((cf.CLASS, at), struct.pack(">BH", cf.CLASS, at))

    def string(self, text: str) -> int:
        at = self.utf8(text)
        return self._add((cf.STRING, at), struct.pack(">BH", cf.STRING, at))

    def number(self, kind: str, value) -> int:
        tag, code, slots = {"int": (cf.INTEGER, "i", 1), "float": (cf.FLOAT, "f", 1), "long": (cf.LONG, "q", 2), "double": (cf.DOUBLE, "d", 2)}[kind]
        raw = struct.pack(">B" + code, tag, value)
        return self._add((raw,), raw, slots)

    def name_type(self, name: str, descriptor: str) -> int:
        a, b = self.utf8(name), self.utf8(descriptor)
        return self._add((cf.NAME_TYPE, a, b), struct.pack(">BHH", cf.NAME_TYPE, a, b))

    def member(self, owner: str, name: str, descriptor: str, tag: int | None = None) -> int:
        tag = tag or (cf.METHOD if descriptor.startswith("(") else cf.FIELD)
        a, b = self.class_ref(owner), self.name_type(name, descriptor)
        return self._add((tag, a, b), struct.pack(">BHH", tag, a, b))

    def attribute(self, name: str, body: bytes) -> bytes:
        return struct.pack(">HI", self.utf8(name), len(body)) + body

    def field(self, name: str, descriptor: str, access: int = 1, constant: int | None = None, extra: list[bytes] = ()) -> None:
        attrs = [*extra, *([self.attribute("ConstantValue", struct.pack(">H", constant))] if constant else [])]
        self.fields.append(struct.pack(">HHHH", access, self.utf8(name), self.utf8(descriptor), len(attrs)) + b"".join(attrs))

    def method(self, name: str, descriptor: str, code: bytes | None = None, access: int = 9, stack: int = 8, most: int = 8, handlers=(), lines=(), variables=(), extra: list[bytes] = (), inner: list[bytes] = ()) -> None:
        """`extra` are attributes of the method, `inner` of its code."""
        attrs = list(extra)
        if code is not None:
            inner = list(inner)
            if lines:
                inner.append(self.attribute("LineNumberTable", struct.pack(">H", len(lines)) + b"".join(struct.pack(">HH", *x) for x in lines)))
            if variables:
                rows = b"".join(struct.pack(">HHHHH", start, size, self.utf8(n), self.utf8(t), slot) for start, size, n, t, slot in variables)
                inner.append(self.attribute("LocalVariableTable", struct.pack(">H", len(variables)) + rows))
            table = b"".join(struct.pack(">HHHH", a, b, h, self.class_ref(t) if t else 0) for a, b, h, t in handlers)
            body = struct.pack(">HHI", stack, most, len(code)) + code + struct.pack(">H", len(handlers)) + table + struct.pack(">H", len(inner)) + b"".join(inner)
            attrs.append(self.attribute("Code", body))
        self.methods.append(struct.pack(">HHHH", access, self.utf8(name), self.utf8(descriptor), len(attrs)) + b"".join(attrs))

    def handle(self, kind: int, ref: int) -> int:
        return self._add((cf.HANDLE, kind, ref), struct.pack(">BBH", cf.HANDLE, kind, ref))

    def shorts(self, name: str, *values: int) -> bytes:
        """An attribute of two-byte numbers, which most tables are."""
        return self.attribute(name, struct.pack(f">{len(values)}H", *values))

    def annotation(self, kind: str, **values: tuple[str, int]) -> bytes:
        """An annotation's bytes: its type, and for each name the tag and the constant of its value."""
        pairs = b"".join(struct.pack(">HBH", self.utf8(k), ord(tag), at) for k, (tag, at) in values.items())
        return struct.pack(">HH", self.utf8(kind), len(values)) + pairs

    def build(self) -> bytes:
        head = struct.pack(">IHHH", 0xCAFEBABE, 0, self.major, self.slots) + b"".join(self.entries)
        out = head + struct.pack(">HHHH", self.access, self.this, self.above, len(self.interfaces)) + b"".join(struct.pack(">H", i) for i in self.interfaces)
        for rows in (self.fields, self.methods, self.attrs):
            out += struct.pack(">H", len(rows)) + b"".join(rows)
        return out
