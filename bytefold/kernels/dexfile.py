"""Dex files after the public specification: header, ids, classes, members and instructions."""

from __future__ import annotations

from dataclasses import dataclass, field

from .binary import Cursor, FormatError, modified_utf8

NONE = 0xFFFFFFFF
# Code units of each instruction format.
UNITS = {"10x": 1, "12x": 1, "11n": 1, "11x": 1, "10t": 1, "20t": 2, "22x": 2, "21t": 2, "21s": 2, "21h": 2, "21c": 2, "23x": 2, "22b": 2, "22t": 2, "22s": 2, "22c": 2, "32x": 3, "30t": 3, "31t": 3, "31i": 3, "31c": 3, "35c": 3, "3rc": 3, "45cc": 4, "4rcc": 4, "51l": 5}


def _table() -> list[tuple[str, str, str | None]]:
    """(name, format, kind of the index) by opcode; unused ones have no name."""
    rows: list[tuple[str, str, str | None]] = []

    def add(form: str, *names: str, index: str | None = None) -> None:
        rows.extend((n, form, index) for n in names)

    def unused(n: int) -> None:
        rows.extend([("", "10x", None)] * n)

    wide = ("", "-wide", "-object")
    kinds = (*wide, "-boolean", "-byte", "-char", "-short")
    add("10x", "nop")
    for w in wide:
        rows.extend(((f"move{w}", "12x", None), (f"move{w}/from16", "22x", None), (f"move{w}/16", "32x", None)))
    add("11x", *(f"move-result{w}" for w in wide), "move-exception")
    add("10x", "return-void")
    add("11x", *(f"return{w}" for w in wide))
    rows.extend((n, f, None) for n, f in (("const/4", "11n"), ("const/16", "21s"), ("const", "31i"), ("const/high16", "21h"), ("const-wide/16", "21s"), ("const-wide/32", "31i"), ("const-wide", "51l"), ("const-wide/high16", "21h")))
    rows.extend((("const-string", "21c", "string"), ("const-string/jumbo", "31c", "string"), ("const-class", "21c", "type")))
    add("11x", "monitor-enter", "monitor-exit")
    rows.extend((("check-cast", "21c", "type"), ("instance-of", "22c", "type"), ("array-length", "12x", None), ("new-instance", "21c", "type"), ("new-array", "22c", "type"), ("filled-new-array", "35c", "type"), ("filled-new-array/range", "3rc", "type"), ("fill-array-data", "31t", None), ("throw", "11x", None), ("goto", "10t", None), ("goto/16", "20t", None), ("goto/32", "30t", None), ("packed-switch", "31t", None), ("sparse-switch", "31t", None)))
    add("23x", "cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long")
    tests = ("eq", "ne", "lt", "ge", "gt", "le")
    add("22t", *(f"if-{t}" for t in tests))
    add("21t", *(f"if-{t}z" for t in tests))
    unused(6)
    for verb in ("aget", "aput"):
        add("23x", *(verb + k for k in kinds))
    for verb in ("iget", "iput"):
        add("22c", *(verb + k for k in kinds), index="field")
    for verb in ("sget", "sput"):
        add("21c", *(verb + k for k in kinds), index="field")
    calls = ("virtual", "super", "direct", "static", "interface")
    add("35c", *(f"invoke-{c}" for c in calls), index="method")
    unused(1)
    add("3rc", *(f"invoke-{c}/range" for c in calls), index="method")
    unused(2)
    numbers = ("int", "long", "float", "double")
    add("12x", "neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double")
    add("12x", *(f"{a}-to-{b}" for a in numbers for b in numbers if a != b), "int-to-byte", "int-to-char", "int-to-short")
    basic = ("add", "sub", "mul", "div", "rem")
    whole = (*basic, "and", "or", "xor", "shl", "shr", "ushr")
    binary = [f"{o}-{t}" for t in numbers for o in (whole if t in ("int", "long") else basic)]
    add("23x", *binary)
    add("12x", *(f"{b}/2addr" for b in binary))
    literal = ["add-int", "rsub-int", *(f"{o}-int" for o in whole[2:8])]
    add("22s", *(x if x == "rsub-int" else f"{x}/lit16" for x in literal))
    add("22b", *(f"{x}/lit8" for x in (*literal, *(f"{o}-int" for o in whole[8:]))))
    unused(23)
    rows.extend((("invoke-polymorphic", "45cc", "method"), ("invoke-polymorphic/range", "4rcc", "method"), ("invoke-custom", "35c", "site"), ("invoke-custom/range", "3rc", "site"), ("const-method-handle", "21c", "handle"), ("const-method-type", "21c", "proto")))
    return rows


OPCODES = _table()


@dataclass
class DexMember:
    kind: str  # static_field, instance_field, direct_method, virtual_method
    index: int
    access: int
    name: str
    descriptor: str
    code_off: int = 0


@dataclass
class DexClass:
    name: str
    access: int
    super_name: str | None
    source: str | None
    interfaces: list[str]
    members: list[DexMember] = field(default_factory=list)


class DexFile:
    def __init__(self, data: bytes):
        if len(data) < 0x70 or data[:4] != b"dex\n" or not data[4:7].isdigit() or data[7]:
            raise FormatError("no dex file")
        self.data, self.version = data, data[4:7].decode()
        c = Cursor(data, 0x20, little=True)
        self.file_size, self.header_size, endian = c.u4(), c.u4(), c.u4()
        if endian != 0x12345678:
            raise FormatError("a dex file of foreign byte order")
        c.take(12)  # link size and offset, map offset
        sections = {name: (c.u4(), c.u4()) for name in ("string", "type", "proto", "field", "method", "class")}
        at = lambda name: Cursor(data, sections[name][1], little=True)
        offsets = at("string")
        self.strings = [self._string(offsets.u4()) for _ in range(sections["string"][0])]
        c = at("type")
        self.types = [self._name(self.strings, c.u4(), "string") for _ in range(sections["type"][0])]
        c = at("proto")
        self.protos = []
        for _ in range(sections["proto"][0]):
            c.u4()
            back, args = self._name(self.types, c.u4(), "type"), self._types(c.u4())
            self.protos.append(f"({''.join(args)}){back}")
        c = at("field")
        self.fields = [self._member(c, self.types) for _ in range(sections["field"][0])]
        c = at("method")
        self.methods = [self._member(c, self.protos) for _ in range(sections["method"][0])]
        c = at("class")
        self.classes = [self._class(c) for _ in range(sections["class"][0])]

    @staticmethod
    def _name(names: list, i: int, what: str) -> str:
        return names[i] if i < len(names) else f"{what}#{i}"

    def _string(self, at: int) -> str:
        c = Cursor(self.data, at, little=True)
        c.uleb128()
        end = self.data.find(b"\0", c.at)
        if end < 0:
            raise FormatError("a string does not end")
        return modified_utf8(self.data[c.at : end])

    def _types(self, at: int) -> list[str]:
        if not at:
            return []
        c = Cursor(self.data, at, little=True)
        return [self._name(self.types, c.u2(), "type") for _ in range(c.u4())]

    def _member(self, c: Cursor, shapes: list) -> tuple[str, str, str]:
        owner, shape, name = c.u2(), c.u2(), c.u4()
        return self._name(self.types, owner, "type"), self._name(self.strings, name, "string"), self._name(shapes, shape, "proto" if shapes is self.protos else "type")

    def _class(self, c: Cursor) -> DexClass:
        name, access, above, interfaces, source, _, data, _ = (c.u4() for _ in range(8))
        out = DexClass(self._name(self.types, name, "type"), access, None if above == NONE else self._name(self.types, above, "type"), None if source == NONE else self._name(self.strings, source, "string"), self._types(interfaces))
        if data:
            d = Cursor(self.data, data, little=True)
            counts = [d.uleb128() for _ in range(4)]
            for kind, count in zip(("static_field", "instance_field", "direct_method", "virtual_method"), counts):
                index = 0
                for _ in range(count):
                    index += d.uleb128()
                    known = self.fields if kind.endswith("field") else self.methods
                    stem = "field" if kind.endswith("field") else "method"
                    _, member, shape = known[index] if index < len(known) else (None, f"{stem}#{index}", "()V")
                    flags = d.uleb128()
                    out.members.append(DexMember(kind, index, flags, member, shape, d.uleb128() if stem == "method" else 0))
        return out

    def index_text(self, kind: str, i: int) -> str:
        if kind in ("field", "method"):
            known = self.fields if kind == "field" else self.methods
            if i < len(known):
                owner, name, shape = known[i]
                return f"{owner}->{name}{':' if kind == 'field' else ''}{shape}"
            return f"{kind}#{i}"
        if kind == "string":
            return '"' + self._name(self.strings, i, "string") + '"'
        return self._name({"type": self.types, "proto": self.protos}.get(kind, []), i, kind)

    def code(self, at: int) -> list[dict]:
        """Rows off, opcode, name, text of a code item; offsets count 16-bit units. Payloads of switches and arrays are one row each."""
        c = Cursor(self.data, at, little=True)
        c.take(12)
        size = c.u4()
        raw = c.take(2 * size)
        u = [int.from_bytes(raw[2 * i : 2 * i + 2], "little") for i in range(size)]
        out, i = [], 0
        while i < size:
            if u[i] in (0x0100, 0x0200, 0x0300) and i + 1 < size:
                count = u[i + 1]
                width_and_size = count * (u[i + 2] | u[i + 3] << 16) if u[i] == 0x0300 and i + 3 < size else 0
                n = {0x0100: 4 + 2 * count, 0x0200: 2 + 4 * count, 0x0300: 4 + (width_and_size + 1) // 2}[u[i]]
                out.append({"off": i, "opcode": 0, "name": {0x0100: "packed-switch-payload", 0x0200: "sparse-switch-payload", 0x0300: "array-payload"}[u[i]], "text": str(count)})
                i += n
                continue
            name, form, index = OPCODES[u[i] & 0xFF]
            units = UNITS[form]
            if not name or i + units > size:
                raise FormatError(f"no instruction {u[i] & 0xFF:#x} at {i}")
            out.append({"off": i, "opcode": u[i] & 0xFF, "name": name, "text": self._operands(form, index, u[i : i + units], i)})
            i += units
        return out

    def tries(self, at: int) -> list[dict]:
        """Rows start, end, handler, type (null for all) of a code item's try items, in code units; a range's typed handlers
        first, in their order."""
        c = Cursor(self.data, at, little=True)
        c.take(6)
        count = c.u2()
        c.take(4)
        size = c.u4()
        c.take(2 * size + (2 if size % 2 and count else 0))
        items = [(c.u4(), c.u2(), c.u2()) for _ in range(count)]
        handlers, out = c.at, []
        for start, length, off in items:
            h = Cursor(self.data, handlers + off, little=True)
            many = h.sleb128()
            for _ in range(abs(many)):
                kind = self._name(self.types, h.uleb128(), "type")
                out.append({"start": start, "end": start + length, "handler": h.uleb128(), "type": kind})
            if many <= 0:
                out.append({"start": start, "end": start + length, "handler": h.uleb128(), "type": None})
        return out

    def id_rows(self) -> list[tuple]:
        """(kind, index, owner, name, descriptor) of all ids; strings and types have a name alone, protos a descriptor."""
        out = [("string", i, None, x, None) for i, x in enumerate(self.strings)] + [("type", i, None, x, None) for i, x in enumerate(self.types)]
        out += [("proto", i, None, None, x) for i, x in enumerate(self.protos)]
        return out + [(kind, i, *x) for kind, rows in (("field", self.fields), ("method", self.methods)) for i, x in enumerate(rows)]

    def _operands(self, form: str, index: str | None, u: list[int], at: int) -> str:
        a8, a4, b4 = u[0] >> 8, u[0] >> 8 & 0xF, u[0] >> 12
        signed = lambda x, bits: x - (1 << bits) if x >> (bits - 1) else x
        wide = lambda: u[1] | u[2] << 16
        ref = lambda i: self.index_text(index or "", i)
        if form == "10x":
            return ""
        if form == "12x":
            return f"v{a4}, v{b4}"
        if form == "11n":
            return f"v{a4}, {signed(b4, 4)}"
        if form == "11x":
            return f"v{a8}"
        if form in ("10t", "20t", "30t"):
            return str(at + (signed(a8, 8) if form == "10t" else signed(u[1], 16) if form == "20t" else signed(wide(), 32)))
        if form == "22x":
            return f"v{a8}, v{u[1]}"
        if form == "32x":
            return f"v{u[1]}, v{u[2]}"
        if form == "21t":
            return f"v{a8}, {at + signed(u[1], 16)}"
        if form == "21s":
            return f"v{a8}, {signed(u[1], 16)}"
        if form == "21h":
            return f"v{a8}, {signed(u[1], 16)}<<high16"
        if form == "21c":
            return f"v{a8}, {ref(u[1])}"
        if form == "23x":
            return f"v{a8}, v{u[1] & 0xFF}, v{u[1] >> 8}"
        if form == "22b":
            return f"v{a8}, v{u[1] & 0xFF}, {signed(u[1] >> 8, 8)}"
        if form == "22t":
            return f"v{a4}, v{b4}, {at + signed(u[1], 16)}"
        if form == "22s":
            return f"v{a4}, v{b4}, {signed(u[1], 16)}"
        if form == "22c":
            return f"v{a4}, v{b4}, {ref(u[1])}"
        if form == "31t":
            return f"v{a8}, {at + signed(wide(), 32)}"
        if form == "31i":
            return f"v{a8}, {signed(wide(), 32)}"
        if form == "31c":
            return f"v{a8}, {ref(wide())}"
        if form in ("35c", "45cc"):
            regs = [u[2] & 0xF, u[2] >> 4 & 0xF, u[2] >> 8 & 0xF, u[2] >> 12, a4][: min(b4, 5)]
            return f"{{{', '.join(f'v{r}' for r in regs)}}}, {ref(u[1])}" + (f", {self.index_text('proto', u[3])}" if form == "45cc" else "")
        if form in ("3rc", "4rcc"):
            last = f" .. v{u[2] + a8 - 1}" if a8 else ""
            return f"{{v{u[2]}{last}}}, {ref(u[1])}" + (f", {self.index_text('proto', u[3])}" if form == "4rcc" else "")
        value = u[1] | u[2] << 16 | u[3] << 32 | u[4] << 48
        return f"v{a8}, {signed(value, 64)}"


# Access words of the listing, in printing order, with the kinds that have them.
ACCESS = ((0x1, "public", "cmf"), (0x2, "private", "cmf"), (0x4, "protected", "cmf"), (0x8, "static", "cmf"), (0x10, "final", "cmf"), (0x20, "synchronized", "m"), (0x40, "volatile", "f"), (0x40, "bridge", "m"), (0x80, "transient", "f"), (0x80, "varargs", "m"), (0x100, "native", "m"), (0x200, "interface", "c"), (0x400, "abstract", "cm"), (0x800, "strictfp", "m"), (0x1000, "synthetic", "cmf"), (0x2000, "annotation", "c"), (0x4000, "enum", "cf"), (0x10000, "constructor", "m"))


def access(flags: int, kind: str) -> str:
    return "".join(f"{word} " for bit, word, kinds in ACCESS if flags & bit and kind in kinds)


def method_listing(dex: DexFile, m: DexMember) -> list[str]:
    out = [f".method {access(m.access, 'm')}{m.name}{m.descriptor}"]
    if m.code_off:
        try:
            out += [f"    {r['off']:04x}: {r['name']} {r['text']}".rstrip() for r in dex.code(m.code_off)]
            out += [f"    .catch {t['type'] or 'all'} {t['start']:04x}..{t['end']:04x} -> {t['handler']:04x}" for t in dex.tries(m.code_off)]
        except FormatError as e:
            out.append(f"    # {e}")
    return [*out, ".end method"]


def listing(dex: DexFile, c: DexClass) -> str:
    out = [f".class {access(c.access, 'c')}{c.name}"]
    out += [f".super {c.super_name}"] if c.super_name else []
    out += [f".source \"{c.source}\""] if c.source else []
    out += [f".implements {i}" for i in c.interfaces]
    for m in c.members:
        out += [f".field {access(m.access, 'f')}{m.name}:{m.descriptor}"] if m.kind.endswith("field") else method_listing(dex, m)
    return "\n".join(out)
