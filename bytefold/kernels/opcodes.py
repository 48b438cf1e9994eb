"""The JVM instruction set, 0x00 to 0xc9, built from its regularities."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Op:
    code: int
    name: str
    layout: str  # of the operands: see LENGTHS
    sem: str
    local: int | None = None  # implied by the name, as in iload_2
    value: int | None = None  # implied by the name, as in iconst_3


# Bytes of operands per layout; None varies.
LENGTHS = {"": 0, "i1": 1, "i2": 2, "pool1": 1, "pool2": 2, "local": 1, "inc": 2, "jump2": 2, "jump4": 4, "table": None, "lookup": None, "interface": 4, "dynamic": 4, "atype": 1, "wide": None, "multi": 3}

FIVE, FOUR, EIGHT = "ilfda", "ilfd", "ilfdabcs"
CONDITIONS = ("eq", "ne", "lt", "ge", "gt", "le")


def _rows():
    def plain(sem, *names):
        return [(n, "", sem) for n in names]

    yield from plain("nop", "nop")
    yield from plain("const_null", "aconst_null")
    for n, name in zip(range(-1, 6), ("m1", *"012345")):
        yield f"iconst_{name}", "", "const_int", None, n
    for t, most in (("l", 2), ("f", 3), ("d", 2)):
        for n in range(most):
            yield f"{t}const_{n}", "", {"l": "const_long", "f": "const_float", "d": "const_double"}[t], None, n
    yield from (("bipush", "i1", "const_int"), ("sipush", "i2", "const_int"), ("ldc", "pool1", "ldc"), ("ldc_w", "pool2", "ldc"), ("ldc2_w", "pool2", "ldc"))
    for verb in ("load", "store"):
        yield from ((f"{t}{verb}", "local", verb) for t in FIVE)
        yield from ((f"{t}{verb}_{n}", "", verb, n) for t in FIVE for n in range(4))
        yield from ((f"{t}a{verb}", "", f"array_{verb}") for t in EIGHT)
    yield from ((n, "", n) for n in ("pop", "pop2", "dup", "dup_x1", "dup_x2", "dup2", "dup2_x1", "dup2_x2", "swap"))
    yield from ((f"{t}{n}", "", n) for n in ("add", "sub", "mul", "div", "rem", "neg") for t in FOUR)
    yield from ((f"{t}{n}", "", n) for n in ("shl", "shr", "ushr", "and", "or", "xor") for t in "il")
    yield "iinc", "inc", "inc"
    yield from ((f"{a}2{b}", "", "convert") for a in FOUR for b in FOUR if a != b)
    yield from plain("convert", "i2b", "i2c", "i2s")
    yield from plain("compare", "lcmp", "fcmpl", "fcmpg", "dcmpl", "dcmpg")
    yield from ((f"if{c}", "jump2", "if") for c in CONDITIONS)
    yield from ((f"if_icmp{c}", "jump2", "if_icmp") for c in CONDITIONS)
    yield from ((f"if_acmp{c}", "jump2", "if_acmp") for c in CONDITIONS[:2])
    yield from (("goto", "jump2", "goto"), ("jsr", "jump2", "jsr"), ("ret", "local", "ret"), ("tableswitch", "table", "switch"), ("lookupswitch", "lookup", "switch"))
    yield from ((f"{t}return", "", "return") for t in FIVE)
    yield "return", "", "return"
    yield from ((f"{v}{f}", "pool2", f"{v}_{f}") for f in ("static", "field") for v in ("get", "put"))
    yield from ((f"invoke{k}", "pool2", "invoke") for k in ("virtual", "special", "static"))
    yield from (("invokeinterface", "interface", "invoke"), ("invokedynamic", "dynamic", "invoke"), ("new", "pool2", "new"), ("newarray", "atype", "newarray"), ("anewarray", "pool2", "newarray"))
    yield from plain("arraylength", "arraylength")
    yield from plain("throw", "athrow")
    yield from (("checkcast", "pool2", "checkcast"), ("instanceof", "pool2", "instanceof"))
    yield from plain("monitor", "monitorenter", "monitorexit")
    yield from (("wide", "wide", "wide"), ("multianewarray", "multi", "newarray"), ("ifnull", "jump2", "if_null"), ("ifnonnull", "jump2", "if_null"), ("goto_w", "jump4", "goto"), ("jsr_w", "jump4", "jsr"))


OPS = [Op(code, *row) for code, row in enumerate(_rows())]
BY_NAME = {op.name: op for op in OPS}
# Element types of newarray.
ARRAY_TYPES = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
ENDS = {"goto", "return", "throw", "switch", "ret", "jsr"}
