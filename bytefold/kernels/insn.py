"""Instructions: bytes of a method's code to rows, and rows to text."""

from __future__ import annotations

from dataclasses import dataclass, field

from .binary import Cursor, FormatError
from .classfile import Pool
from .opcodes import ARRAY_TYPES, BY_NAME, LENGTHS, OPS, Op


@dataclass
class Insn:
    off: int
    op: Op
    size: int
    wide: bool = False
    local: int | None = None
    value: object = None  # of a constant or an increment
    kind: str | None = None  # of a loaded constant
    ref: tuple | None = None  # (class, name, descriptor) or (type,)
    dims: int | None = None
    targets: list[int] = field(default_factory=list)  # the default of a switch first
    keys: list[int] = field(default_factory=list)


def _one(c: Cursor, base: int, pool: Pool) -> Insn:
    code = c.u1()
    if code >= len(OPS):
        raise FormatError(f"no instruction {code:#x} at {base}")
    op, wide = OPS[code], False
    if op.layout == "wide":
        wide, inner = True, c.u1()
        op = OPS[inner] if inner < len(OPS) else op
        if op.layout not in ("local", "inc"):
            raise FormatError(f"no wide form of {inner:#x} at {base}")
    out = Insn(base, op, 0, wide, op.local, op.value)
    number = c.u2 if wide else c.u1
    layout = op.layout
    if layout == "i1":
        out.value = c.i1()
    elif layout == "i2":
        out.value = c.i2()
    elif layout == "local":
        out.local = number()
    elif layout == "inc":
        out.local = number()
        out.value = c.i2() if wide else c.i1()
    elif layout in ("jump2", "jump4"):
        out.targets = [base + (c.i2() if layout == "jump2" else c.i4())]
    elif layout == "atype":
        kind = c.u1()
        if kind not in ARRAY_TYPES:
            raise FormatError(f"no array type {kind} at {base}")
        out.ref = (ARRAY_TYPES[kind],)
    elif layout in ("table", "lookup"):
        c.take(-(c.at) % 4)
        default = base + c.i4()
        if layout == "table":
            low, high = c.i4(), c.i4()
            if high < low or high - low > len(c.data):
                raise FormatError(f"a table from {low} to {high} at {base}")
            out.keys = list(range(low, high + 1))
            out.targets = [default, *(base + c.i4() for _ in out.keys)]
        else:
            pairs = [(c.i4(), base + c.i4()) for _ in range(min(c.u4(), len(c.data)))]
            out.keys, out.targets = [k for k, _ in pairs], [default, *(t for _, t in pairs)]
    elif layout in ("pool1", "pool2", "interface", "dynamic", "multi"):
        at = c.u1() if layout == "pool1" else c.u2()
        if op.sem == "ldc":
            out.kind, out.value = pool.loadable(at)
        elif op.sem in ("new", "newarray", "checkcast", "instanceof"):
            out.ref = (pool.class_name(at),)
        else:
            out.ref = pool.member(at)
        if layout == "multi":
            out.dims = c.u1()
        elif LENGTHS[layout] == 4:
            c.take(2)
    out.size = c.at - base
    return out


def decode(code: bytes, pool: Pool) -> list[Insn]:
    """All instructions of a method, or FormatError."""
    c, out = Cursor(code), []
    while c.at < len(code):
        out.append(_one(c, c.at, pool))
    return out


def operand_text(i: Insn) -> str:
    parts = []
    if i.op.layout in ("local", "inc"):
        parts.append(str(i.local))
    if i.op.layout in ("i1", "i2", "inc"):
        parts.append(str(i.value))
    if i.op.sem == "ldc":
        parts.append(f'"{i.value}"' if i.kind == "string" else str(i.value))
    if i.ref:
        parts.append(i.ref[0] if len(i.ref) == 1 else f"{'' if i.ref[0] is None else i.ref[0].replace('/', '.') + '.'}{i.ref[1]}:{i.ref[2]}")
    if i.dims:
        parts.append(str(i.dims))
    if i.op.sem == "switch":
        parts += [*(f"{k}->{t}" for k, t in zip(i.keys, i.targets[1:])), f"default->{i.targets[0]}"]
    elif i.targets:
        parts.append(str(i.targets[0]))
    return " ".join(parts)


def line(i: Insn) -> str:
    return f"{i.off:5d}: {'wide ' if i.wide else ''}{i.op.name} {operand_text(i)}".rstrip()


def listing(body: dict, pool: Pool) -> str:
    """Lines of a Code attribute: instructions, the exception table, line numbers; code that does not decode as hex, 16 bytes a row."""
    try:
        out = [line(i) for i in decode(body["code"], pool)]
    except FormatError as e:
        raw = body["code"]
        out = [f"; {e}", *(f"{at:5d}: {raw[at : at + 16].hex(' ')}" for at in range(0, len(raw), 16))]
    out += [f"catch {h['catch_type'] or 'any'} {h['start_pc']}..{h['end_pc']} -> {h['handler_pc']}" for h in body["handlers"]]
    out += [f"line {x['line']}: {x['start_pc']}" for x in body["attrs"].get("LineNumberTable", ())]
    return "\n".join(out)


def assemble(*rows: tuple) -> bytes:
    """Bytes of (name, operands...) rows; jump operands are distances. Switches and wide forms take raw bytes instead."""
    out = bytearray()
    for name, *args in rows:
        op = BY_NAME[name]
        out.append(op.code)
        size = LENGTHS[op.layout]
        if op.layout in ("interface", "dynamic"):
            out += args[0].to_bytes(2, "big") + bytes([args[1] if len(args) > 1 else 0, 0])
        elif op.layout == "multi":
            out += args[0].to_bytes(2, "big") + bytes([args[1]])
        elif op.layout == "inc":
            out += bytes([args[0]]) + args[1].to_bytes(1, "big", signed=True)
        elif size is None:
            out += args[0]
        elif size:
            out += args[0].to_bytes(size, "big", signed=op.layout[0] in "ij")
    return bytes(out)
