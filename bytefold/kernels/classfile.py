"""Class files: constant pool, members and attributes after the public specification. Bytes in, plain rows out."""

from __future__ import annotations

from dataclasses import dataclass, field

from .binary import Cursor, FormatError, modified_utf8

# Constant-pool tags and how their entries are laid out.
UTF8, INTEGER, FLOAT, LONG, DOUBLE, CLASS, STRING, FIELD, METHOD, INTERFACE, NAME_TYPE = 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12
HANDLE, METHOD_TYPE, DYNAMIC, INVOKE_DYNAMIC, MODULE, PACKAGE = 15, 16, 17, 18, 19, 20
ONE_REF, TWO_REFS = (CLASS, STRING, METHOD_TYPE, MODULE, PACKAGE), (FIELD, METHOD, INTERFACE, NAME_TYPE, DYNAMIC, INVOKE_DYNAMIC)


@dataclass
class Constant:
    tag: int
    value: object = None
    ref1: int | None = None
    ref2: int | None = None


class Pool:
    """1-based; slot 0 and the slot behind a wide entry are empty."""

    def __init__(self, c: Cursor):
        count = c.u2()
        self.at: list[Constant | None] = [None] * max(count, 1)
        i = 1
        while i < count:
            tag = c.u1()
            if tag == UTF8:
                entry = Constant(tag, modified_utf8(c.take(c.u2())))
            elif tag in (INTEGER, FLOAT, LONG, DOUBLE):
                entry = Constant(tag, {INTEGER: c.i4, FLOAT: c.f4, LONG: c.i8, DOUBLE: c.f8}[tag]())
            elif tag in ONE_REF:
                entry = Constant(tag, None, c.u2())
            elif tag in TWO_REFS:
                entry = Constant(tag, None, c.u2(), c.u2())
            elif tag == HANDLE:
                entry = Constant(tag, None, c.u1(), c.u2())
            else:
                raise FormatError(f"constant {i} has the unknown tag {tag}")
            self.at[i] = entry
            i += 2 if tag in (LONG, DOUBLE) else 1

    def get(self, i: int, *tags: int) -> Constant:
        entry = self.at[i] if 0 < i < len(self.at) else None
        if entry is None or tags and entry.tag not in tags:
            raise FormatError(f"constant {i} is not of the kind asked")
        return entry

    def text(self, i: int) -> str:
        return self.get(i, UTF8).value

    def text_or_none(self, i: int) -> str | None:
        return self.text(i) if i else None

    def class_name(self, i: int) -> str:
        return self.text(self.get(i, CLASS, MODULE, PACKAGE).ref1)

    def class_or_none(self, i: int) -> str | None:
        return self.class_name(i) if i else None

    def name_type(self, i: int) -> tuple[str, str]:
        entry = self.get(i, NAME_TYPE)
        return self.text(entry.ref1), self.text(entry.ref2)

    def member(self, i: int) -> tuple[str | None, str, str]:
        """(class, name, descriptor); a dynamic call site has no class."""
        entry = self.get(i, FIELD, METHOD, INTERFACE, DYNAMIC, INVOKE_DYNAMIC)
        owner = self.class_name(entry.ref1) if entry.tag in (FIELD, METHOD, INTERFACE) else None
        return (owner, *self.name_type(entry.ref2))

    def loadable(self, i: int) -> tuple[str, object]:
        """(kind, value) of what ldc can push."""
        entry = self.get(i)
        if entry.tag in (INTEGER, FLOAT, LONG, DOUBLE):
            return {INTEGER: "int", FLOAT: "float", LONG: "long", DOUBLE: "double"}[entry.tag], entry.value
        if entry.tag == STRING:
            return "string", self.text(entry.ref1)
        if entry.tag == CLASS:
            return "class", self.class_name(i)
        if entry.tag == METHOD_TYPE:
            return "method_type", self.text(entry.ref1)
        if entry.tag == HANDLE:
            return "handle", ".".join(x or "" for x in self.member(entry.ref2)[:2])
        if entry.tag == DYNAMIC:
            return "dynamic", self.name_type(entry.ref2)[0]
        raise FormatError(f"constant {i} cannot be loaded")


def resolve(pool: dict[int, Constant]) -> list[tuple[int, int, str | None, str | None, str | None, str | None]]:
    """(slot, tag, owner, member, descriptor, text) of the constants of one pool that refer to others: classes and strings
    with their text, fields, methods and call sites with their owner, name and descriptor. Those whose reference leads
    nowhere are left out."""

    def text(i: int | None) -> str | None:
        entry = pool.get(i)
        return entry.value if entry and entry.tag == UTF8 else None

    out = []
    for i, x in pool.items():
        if x.tag in ONE_REF:
            if (found := text(x.ref1)) is not None:
                out.append((i, x.tag, None, None, None, found))
        elif x.tag in TWO_REFS and x.tag != NAME_TYPE:
            kind, owner = pool.get(x.ref2), pool.get(x.ref1)
            if kind is None or kind.tag != NAME_TYPE:
                continue
            member, descriptor = text(kind.ref1), text(kind.ref2)
            dynamic = x.tag in (DYNAMIC, INVOKE_DYNAMIC)  # these have no owner
            name = text(owner.ref1) if not dynamic and owner and owner.tag == CLASS else None
            if member is not None and descriptor is not None and (dynamic or name is not None):
                out.append((i, x.tag, name, member, descriptor, None))
    return out


@dataclass
class Member:
    access: int
    name: str
    descriptor: str
    attrs: dict = field(default_factory=dict)


@dataclass
class ClassFile:
    major: int
    minor: int
    pool: Pool
    access: int
    name: str
    super_name: str | None
    interfaces: list[str]
    fields: list[Member]
    methods: list[Member]
    attrs: dict


def _element(c: Cursor, pool: Pool):
    tag = chr(c.u1())
    if tag in "BCDFIJSZ":
        return {"tag": tag, "value": pool.get(c.u2(), INTEGER, FLOAT, LONG, DOUBLE).value}
    if tag == "s" or tag == "c":
        return {"tag": tag, "value": pool.text(c.u2())}
    if tag == "e":
        return {"tag": tag, "type": pool.text(c.u2()), "value": pool.text(c.u2())}
    if tag == "@":
        return {"tag": tag, "value": _annotation(c, pool)}
    if tag == "[":
        return {"tag": tag, "value": [_element(c, pool) for _ in range(c.u2())]}
    raise FormatError(f"annotation values have no tag {tag!r}")


def _annotation(c: Cursor, pool: Pool) -> dict:
    return {"type": pool.text(c.u2()), "values": {pool.text(c.u2()): _element(c, pool) for _ in range(c.u2())}}


def _verification(c: Cursor, pool: Pool) -> dict:
    tag = c.u1()
    # Verification types.
    names = ("top", "int", "float", "double", "long", "null", "uninitialized_this", "object", "uninitialized")
    if tag >= len(names):
        raise FormatError(f"no verification type {tag}")
    return {"tag": names[tag], "type": pool.class_name(c.u2()) if tag == 7 else None, "off": c.u2() if tag == 8 else None}


def _frames(c: Cursor, pool: Pool) -> list[dict]:
    """Stack maps; a frame stands at the offset behind the one before plus its delta plus one, the first at its delta."""
    out, at, local = [], -1, []
    for _ in range(c.u2()):
        kind = c.u1()
        stack: list[dict] = []
        if kind < 64:
            delta = kind
        elif kind < 128:
            delta, stack = kind - 64, [_verification(c, pool)]
        elif kind < 247:
            raise FormatError(f"frame type {kind} is reserved")
        else:
            delta = c.u2()
            if kind == 247:
                stack = [_verification(c, pool)]
            elif kind < 251:
                local = local[: max(0, len(local) - (251 - kind))]
            elif 251 < kind < 255:
                local = local + [_verification(c, pool) for _ in range(kind - 251)]
            elif kind == 255:
                local = [_verification(c, pool) for _ in range(c.u2())]
                stack = [_verification(c, pool) for _ in range(c.u2())]
        at += delta + 1
        out.append({"off": at, "locals": list(local), "stack": stack})
    return out


def _code(c: Cursor, pool: Pool) -> dict:
    stack, most, code = c.u2(), c.u2(), c.take(c.u4())
    handlers = [{"start_pc": c.u2(), "end_pc": c.u2(), "handler_pc": c.u2(), "catch_type": pool.class_or_none(c.u2())} for _ in range(c.u2())]
    return {"max_stack": stack, "max_locals": most, "code": code, "handlers": handlers, "attrs": attributes(c, pool, "code")}


def _variables(c: Cursor, pool: Pool) -> list[dict]:
    return [{"start_pc": c.u2(), "length": c.u2(), "name": pool.text(c.u2()), "type": pool.text(c.u2()), "slot": c.u2()} for _ in range(c.u2())]


def _annotations(c: Cursor, pool: Pool) -> list[dict]:
    return [_annotation(c, pool) for _ in range(c.u2())]


def _classes(c: Cursor, pool: Pool) -> list[str]:
    return [pool.class_name(c.u2()) for _ in range(c.u2())]


def _enclosing(c: Cursor, pool: Pool) -> dict:
    owner, method = pool.class_name(c.u2()), c.u2()
    return {"class": owner, "method": list(pool.name_type(method)) if method else None}


# Attributes by name, each with the layout of its body.
READERS = {
    "Code": _code,
    "StackMapTable": _frames,
    "LineNumberTable": lambda c, p: [{"start_pc": c.u2(), "line": c.u2()} for _ in range(c.u2())],
    "LocalVariableTable": _variables,
    "LocalVariableTypeTable": _variables,
    "InnerClasses": lambda c, p: [{"inner": p.class_name(c.u2()), "outer": p.class_or_none(c.u2()), "name": p.text_or_none(c.u2()), "access": c.u2()} for _ in range(c.u2())],
    "BootstrapMethods": lambda c, p: [{"method": c.u2(), "args": [c.u2() for _ in range(c.u2())]} for _ in range(c.u2())],
    "MethodParameters": lambda c, p: [{"name": p.text_or_none(c.u2()), "access": c.u2()} for _ in range(c.u1())],
    "RuntimeVisibleAnnotations": _annotations,
    "RuntimeInvisibleAnnotations": _annotations,
    "RuntimeVisibleParameterAnnotations": lambda c, p: [_annotations(c, p) for _ in range(c.u1())],
    "RuntimeInvisibleParameterAnnotations": lambda c, p: [_annotations(c, p) for _ in range(c.u1())],
    "AnnotationDefault": _element,
    "EnclosingMethod": _enclosing,
    "Record": lambda c, p: [{"name": p.text(c.u2()), "type": p.text(c.u2()), "attrs": attributes(c, p, "component")} for _ in range(c.u2())],
    "NestHost": lambda c, p: p.class_name(c.u2()),
    "NestMembers": _classes,
    "PermittedSubclasses": _classes,
    "ConstantValue": lambda c, p: list(p.loadable(c.u2())),
    "Exceptions": _classes,
    "Signature": lambda c, p: p.text(c.u2()),
    "SourceFile": lambda c, p: p.text(c.u2()),
    "Deprecated": lambda c, p: True,
    "Synthetic": lambda c, p: True,
}


def attributes(c: Cursor, pool: Pool, place: str) -> dict:
    """Known attributes by name; unknown ones are passed over by their length, and reading goes on behind each."""
    out: dict = {}
    for _ in range(c.u2()):
        name, size = pool.text(c.u2()), c.u4()
        body = Cursor(c.take(size))
        if name in READERS and (name != "Code" or place == "method"):
            out[name] = READERS[name](body, pool)
    return out


def _member(c: Cursor, pool: Pool, place: str) -> Member:
    return Member(c.u2(), pool.text(c.u2()), pool.text(c.u2()), attributes(c, pool, place))


def parse(data: bytes) -> ClassFile:
    """The whole class, or FormatError."""
    c = Cursor(data)
    if c.u4() != 0xCAFEBABE:
        raise FormatError("no class file: the magic number is missing")
    minor, major = c.u2(), c.u2()
    pool = Pool(c)
    access, name, above = c.u2(), pool.class_name(c.u2()), pool.class_or_none(c.u2())
    interfaces = _classes(c, pool)
    fields = [_member(c, pool, "field") for _ in range(c.u2())]
    methods = [_member(c, pool, "method") for _ in range(c.u2())]
    return ClassFile(major, minor, pool, access, name, above, interfaces, fields, methods, attributes(c, pool, "class"))
