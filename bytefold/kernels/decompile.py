"""Source text of methods: blocks, symbolic evaluation of the stack, structured statements, printing.

Control flow that does not fold into if, while and switch keeps labels and gotos, so every method has a text.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from . import signature
from .binary import FormatError
from .classfile import ClassFile, Member, Pool
from .insn import Insn, decode
from .opcodes import CONDITIONS, ENDS

DEEPEST = 150
# Operators by instruction stem, with their binding strength.
BINARY = {"mul": ("*", 12), "div": ("/", 12), "rem": ("%", 12), "add": ("+", 11), "sub": ("-", 11), "shl": ("<<", 10), "shr": (">>", 10), "ushr": (">>>", 10), "and": ("&", 7), "xor": ("^", 6), "or": ("|", 5)}
TESTS = {"eq": "==", "ne": "!=", "lt": "<", "ge": ">=", "gt": ">", "le": "<="}
TYPES = {"i": "int", "l": "long", "f": "float", "d": "double", "a": "Object", "b": "byte", "c": "char", "s": "short"}
NAMES = {"V": "void", "Z": "boolean", "C": "char", "B": "byte", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}
ONE_TYPE = re.compile(r"\[*(?:[VZCBSIJFD]|L[^;]*;)")


def type_name(descriptor: str) -> str:
    bare = descriptor.lstrip("[")
    named = bare[1:-1].replace("/", ".").replace("$", ".") if bare.startswith("L") else NAMES.get(bare[:1], bare or "void")
    return named + "[]" * (len(descriptor) - len(bare))


# the classes of the file at hand whose simple names another class takes; they print with their packages
_qualified: set[str] = set()


def short(name: str) -> str:
    dotted = name.replace("/", ".").replace("$", ".")
    if _qualified and dotted.rstrip("[]") in _qualified:
        return dotted
    return name.replace("$", ".").rpartition("/")[2].rpartition(".")[2] if "." not in name else name.rpartition(".")[2]


def resolved(name: str) -> str:
    """short() of class names inside generic signatures, where a nested class keeps its outer one."""
    return short(name) if name.replace("/", ".").replace("$", ".") in _qualified else signature.simple(name)


def arguments(descriptor: str) -> list[str]:
    return ONE_TYPE.findall(descriptor[1 : descriptor.index(")")])


@dataclass
class Value:
    text: str
    strength: int = 15
    type: str = "int"
    effect: bool = False
    wide: bool = False
    compare: tuple | None = None  # operands of a three-way comparison

    def at(self, strength: int) -> str:
        return self.text if self.strength >= strength else f"({self.text})"


@dataclass
class Block:
    start: int
    insns: list[Insn]
    after: list[int] = field(default_factory=list)  # the taken branch first
    body: list[str] = field(default_factory=list)
    end: tuple = ("fall",)


def blocks_of(code: list[Insn], handlers: list[dict]) -> dict[int, Block]:
    """Blocks by their first offset. A switch goes to its default first; an edge that comes twice stands once."""
    offs = {i.off for i in code}
    starts = {code[0].off} if code else set()
    starts |= {h[k] for h in handlers for k in ("handler_pc", "start_pc", "end_pc")}
    for i in code:
        starts |= set(i.targets)
        if i.targets or i.op.sem in ENDS:
            starts.add(i.off + i.size)
    starts &= offs
    out: dict[int, Block] = {}
    for i in code:
        if i.off in starts:
            out[i.off] = block = Block(i.off, [])
        block.insns.append(i)
    for b in out.values():
        last = b.insns[-1]
        following = [] if last.op.sem in ENDS else [last.off + last.size]
        b.after = [t for t in dict.fromkeys(last.targets + following) if t in out]
    return out


def reverse_postorder(out: dict[int, Block], roots: list[int]) -> list[int]:
    seen, order = set(), []
    for root in roots:
        if root in seen or root not in out:
            continue
        seen.add(root)
        stack = [(root, iter(out[root].after))]
        while stack:
            node, ahead = stack[-1]
            step = next((n for n in ahead if n not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(out[step].after)))
    return order[::-1]


@dataclass(frozen=True)
class Style:
    """How sources print: non-ASCII characters escaped or as they are, integers in decimal or hexadecimal, classes by import
    or by their whole names, locals by their debug names or by number, and with line numbers as comments or without."""

    escape_unicode: bool = True
    hexadecimal: bool = False
    use_imports: bool = True
    debug_names: bool = True
    line_numbers: bool = False


def _character(c: str, style: Style) -> str:
    plain = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(c)
    if plain or " " <= c <= "~" or c > "\x7f" and not style.escape_unicode:
        return plain or c
    units = c.encode("utf-16-be", "surrogatepass")
    return "".join(f"\\u{int.from_bytes(units[k : k + 2], 'big'):04x}" for k in range(0, len(units), 2))


def _integer(value: int, bits: int, style: Style) -> str:
    if not style.hexadecimal:
        return str(value)
    named = {(1 << (bits - 1)) - 1: "MAX_VALUE", -(1 << (bits - 1)): "MIN_VALUE"}.get(value)
    if named:
        return f"{'Integer' if bits == 32 else 'Long'}.{named}"
    return hex(value % (1 << bits))


def literal(kind: str, value, style: Style = Style()) -> Value:
    if kind == "string":
        return Value('"' + "".join(_character(c, style) for c in value) + '"', type="String")
    if kind == "class":
        return Value(f"{short(value)}.class", type="Class")
    if kind == "long":
        text = _integer(value, 64, style)
        return Value(text if text.startswith("Long") else text + "L", 13 if text[0] == "-" else 15, kind, wide=True)
    if kind in ("float", "double"):
        return Value(_real(kind, value), 15 if value >= 0 else 13, kind, wide=kind == "double")
    text = _integer(value, 32, style) if isinstance(value, int) else str(value)
    return Value(text, 13 if text[0] == "-" else 15)


def _real(kind: str, value: float) -> str:
    holder = "Float" if kind == "float" else "Double"
    if value != value or value in (float("inf"), float("-inf")):
        return f"{holder}.{'NaN' if value != value else 'POSITIVE_INFINITY' if value > 0 else 'NEGATIVE_INFINITY'}"
    if kind == "float":  # the shortest digits that read back as the same float
        text = next(t for n in range(1, 10) if struct.pack("f", float(t := f"{value:.{n}g}")) == struct.pack("f", value))
        value = float(text)
    return f"{value!r}{kind[0]}"


class Evaluator:
    """Runs the blocks of a method on symbols; statements and ends of blocks come out."""

    def __init__(self, cls: ClassFile, method: Member, style: Style = Style()):
        self.style = style
        body = method.attrs["Code"]
        self.cls, self.method = cls, method
        self.static = bool(method.access & 8)
        self.handlers = body["handlers"]
        self.blocks = blocks_of(decode(body["code"], cls.pool), self.handlers)
        self.temps: list[str] = []
        debug = {v["slot"]: v["name"] for v in reversed(body["attrs"].get("LocalVariableTable", []))} if style.debug_names else {}
        self.lines = {x["start_pc"]: x["line"] for x in body["attrs"].get("LineNumberTable", [])} if style.line_numbers else {}
        self.names, self.declared, slot = dict(debug), set(), 0
        self.types: dict[int, str] = {}
        if not self.static:
            self.names[0], slot = "this", 1
        for n, d in enumerate(arguments(method.descriptor)):
            self.names.setdefault(slot, f"arg{n}")
            self.declared.add(slot)
            self.types[slot] = type_name(d)
            slot += 2 if d in "JD" else 1
        self._distinct()
        self.params = [(self.types[at], self.names[at]) for at in sorted(self.types)]

    def _distinct(self) -> None:
        """The k-th of equal names gets the k-th free number."""
        known, last = set(self.names.values()), {}
        for slot in sorted(self.names):
            name = self.names[slot]
            if name in last:
                last[name] = next(k for k in range(last[name] + 1, len(known) + len(self.names) + 2) if f"{name}${k}" not in known)
                self.names[slot] = f"{name}${last[name]}"
            else:
                last[name] = 0

    def local(self, slot: int, letter: str) -> str:
        return self.names.setdefault(slot, f"{'v' if letter == 'a' else letter}{slot}")

    def run(self) -> None:
        preds: dict[int, list[int]] = {}
        for b in self.blocks.values():
            for t in b.after:
                preds.setdefault(t, []).append(b.start)
        entry: dict[int, list[Value]] = {h["handler_pc"]: [Value("caught", type=short(h["catch_type"] or "Throwable"))] for h in self.handlers}
        first = next(iter(self.blocks), 0)
        spills: dict[int, list[str]] = {}
        for at in reverse_postorder(self.blocks, [first, *entry]):
            b = self.blocks[at]
            stack = self.block(b, [*entry.get(at, [])])
            for t in b.after:
                if not stack:
                    continue
                if len(preds[t]) == 1:
                    entry.setdefault(t, list(stack))
                    continue
                if t not in spills:  # values that meet get temporaries, written on each way in
                    spills[t] = [self.temp(v.type) for v in stack]
                    entry[t] = [Value(n, type=v.type, wide=v.wide) for n, v in zip(spills[t], stack)]
                b.body += [f"{n} = {v.text};" for n, v in zip(spills[t], stack) if n != v.text]

    def temp(self, kind: str) -> str:
        self.temps.append(kind)
        return f"tmp{len(self.temps)}"

    def block(self, b: Block, stack: list[Value]) -> list[Value]:
        line = None
        for i in b.insns:
            line, had = self.lines.get(i.off, line), len(b.body)
            self.step(i, b, stack)
            if line is not None and len(b.body) > had:
                b.body.insert(had, f"// line {line}")
                line = None
        if b.end == ("fall",) and b.after:
            b.end = ("goto", b.after[0])
        return stack

    def step(self, i: Insn, b: Block, stack: list[Value]) -> None:
        sem, name, letter = i.op.sem, i.op.name, i.op.name[0]
        push = stack.append

        def pop() -> Value:
            if not stack:
                raise FormatError(f"the stack is empty at {i.off}")
            return stack.pop()

        if sem == "const_null":
            push(Value("null", type="Object"))
        elif sem == "const_int":
            push(literal("int", i.value, self.style))
        elif sem in ("const_long", "const_float", "const_double"):
            kind = sem[6:]
            push(literal(kind, i.value if kind == "long" else float(i.value), self.style))
        elif sem == "ldc":
            push(literal(i.kind, i.value, self.style))
        elif sem == "load":
            push(Value(self.local(i.local, letter), type=self.types.get(i.local, TYPES[letter]), wide=letter in "ld"))
        elif sem == "store":
            v, target = pop(), self.local(i.local, letter)
            if i.local in self.declared or target == "this":
                b.body.append(f"{target} = {v.text};")
            else:
                self.declared.add(i.local)
                self.types[i.local] = v.type if letter == "a" else TYPES[letter]
                b.body.append(f"{short(self.types[i.local])} {target} = {v.text};")
        elif sem == "inc":
            target = self.local(i.local, "i")
            step = f"{target}++" if i.value == 1 else f"{target}--" if i.value == -1 else f"{target} {'+' if i.value >= 0 else '-'}= {abs(i.value)}"
            b.body.append(f"{step};")
        elif sem == "array_load":
            at, of = pop(), pop()
            push(Value(f"{of.at(15)}[{at.text}]", type=of.type[:-2] if of.type.endswith("[]") else TYPES[letter], wide=letter in "ld"))
        elif sem == "array_store":
            v, at, of = pop(), pop(), pop()
            b.body.append(f"{of.at(15)}[{at.text}] = {v.text};")
        elif sem in ("pop", "pop2"):
            taken = [pop()]
            if sem == "pop2" and not taken[0].wide:
                taken.append(pop())
            b.body += [f"{v.text};" for v in reversed(taken) if v.effect]
        elif sem.startswith("dup"):
            self.duplicate(sem, b, stack, pop)
        elif sem == "swap":
            x, y = pop(), pop()
            stack += [x, y]
        elif sem in BINARY:
            sign, strength = BINARY[sem]
            y, x = pop(), pop()
            push(Value(f"{x.at(strength)} {sign} {y.at(strength + 1)}", strength, TYPES[letter], x.effect or y.effect, letter in "ld"))
        elif sem == "neg":
            x = pop()
            push(Value(f"-{x.at(14)}", 13, TYPES[letter], x.effect, letter in "ld"))
        elif sem == "convert":
            x, goal = pop(), TYPES[name[-1]]
            push(x if x.type == goal else Value(f"({goal}) {x.at(13)}", 13, goal, x.effect, goal in ("long", "double")))
        elif sem == "compare":
            y, x = pop(), pop()
            push(Value(f"compare({x.text}, {y.text})", 15, "int", x.effect or y.effect, compare=(x, y)))
        elif sem in ("if", "if_icmp", "if_acmp", "if_null"):
            self.condition(i, b, pop)
        elif sem == "goto":
            b.end = ("goto", i.targets[0])
        elif sem == "switch":
            b.end = ("switch", pop().text, list(zip(i.keys, i.targets[1:])), i.targets[0])
        elif sem == "return":
            text = "" if name == "return" else pop().text
            if self.method.descriptor.endswith(")Z"):
                text = {"0": "false", "1": "true"}.get(text, text)
            b.end = ("stop", f"return {text};" if text else "return;")
        elif sem == "throw":
            b.end = ("stop", f"throw {pop().text};")
        elif sem in ("get_static", "get_field"):
            owner, member, d = i.ref
            of = short(owner) if sem == "get_static" else pop().at(15)
            push(Value(f"{of}.{member}", type=type_name(d), wide=d in "JD"))
        elif sem in ("put_static", "put_field"):
            owner, member, _ = i.ref
            v = pop()
            of = short(owner) if sem == "put_static" else pop().at(15)
            b.body.append(f"{of}.{member} = {v.text};")
        elif sem == "invoke":
            self.call(i, b, stack, pop)
        elif sem == "new":
            push(Value(f"new {short(i.ref[0])}", 15, type_name(f"L{i.ref[0]};"), True))
        elif sem == "newarray":
            kind = i.ref[0]
            sizes = [pop().text for _ in range(i.dims or 1)][::-1]
            named = type_name(kind) if kind.startswith("[") else short(kind)
            bare = named.rstrip("[]")
            more = named.count("[]") - (i.dims or 0) if i.dims else named.count("[]")
            push(Value(f"new {bare}{''.join(f'[{s}]' for s in sizes)}{'[]' * more}", 15, bare + "[]" * (len(sizes) + more)))
        elif sem == "arraylength":
            push(Value(f"{pop().at(15)}.length"))
        elif sem == "checkcast":
            x, goal = pop(), type_name(i.ref[0]) if i.ref[0].startswith("[") else i.ref[0].replace("/", ".")
            push(x if x.type == goal else Value(f"({short(goal)}) {x.at(13)}", 13, goal, x.effect))
        elif sem == "instanceof":
            push(Value(f"{pop().at(9)} instanceof {short(i.ref[0])}", 9, "boolean"))
        elif sem == "monitor":
            b.body.append(f"// {name} {pop().text}")
        elif sem in ("jsr", "ret"):
            b.body.append(f"// {name}")
        elif sem != "nop":
            raise FormatError(f"no meaning of {name} at {i.off}")

    def duplicate(self, sem: str, b: Block, stack: list[Value], pop) -> None:
        def group(n: int) -> list[Value]:
            """Values that fill n slots, the deepest first."""
            out: list[Value] = []
            while n > 0:
                v = pop()
                n -= 2 if v.wide else 1
                out.insert(0, v)
            return out

        top = group(2 if sem.startswith("dup2") else 1)
        below = group(int(sem[-1])) if "_x" in sem else []
        for k, v in enumerate(top):
            unmade = re.fullmatch(r"new [\w.$]+", v.text)  # an object before its constructor ran
            if not unmade and (v.effect or v.text.startswith("new ")):
                name = self.temp(v.type)
                b.body.append(f"{name} = {v.text};")
                top[k] = Value(name, type=v.type, wide=v.wide)
        stack += [*top, *below, *top]

    def condition(self, i: Insn, b: Block, pop) -> None:
        test = i.op.name
        if i.op.sem == "if_null":
            text, sign, other = pop(), "==" if test == "ifnull" else "!=", "null"
            b.end = ("if", text.at(9), sign, other, i.targets[0], i.off + i.size)
            return
        sign = TESTS[next(c for c in CONDITIONS if test.endswith(c))]
        if i.op.sem == "if":
            x = pop()
            if x.compare:
                a, c = x.compare
                b.end = ("if", a.at(9), sign, c.at(9), i.targets[0], i.off + i.size)
            else:
                b.end = ("if", x.at(9), sign, "0", i.targets[0], i.off + i.size)
        else:
            y, x = pop(), pop()
            b.end = ("if", x.at(9), sign, y.at(9), i.targets[0], i.off + i.size)

    def call(self, i: Insn, b: Block, stack: list[Value], pop) -> None:
        owner, name, descriptor = i.ref
        args = [pop() for _ in arguments(descriptor)][::-1]
        given = ", ".join(a.text for a in args)
        back = type_name(descriptor[descriptor.index(")") + 1 :])
        kind = i.op.name[6:]
        if kind in ("static", "dynamic"):
            text = f"{short(owner) + '.' if owner else ''}{name}({given})"
        else:
            on = pop()
            if name == "<init>":
                if on.text.startswith("new ") and "(" not in on.text:
                    made = Value(f"{on.text}({given})", 15, on.type, True)
                    same = [k for k, v in enumerate(stack) if v is on]
                    if same:
                        stack[same[-1]] = made
                    else:
                        b.body.append(f"{made.text};")
                    return
                word = "super" if owner == self.cls.super_name and owner != self.cls.name else "this"
                if given or word == "this":
                    b.body.append(f"{word}({given});")
                return
            on_text = "super" if kind == "special" and on.text == "this" and owner != self.cls.name else on.at(15)
            text = f"{on_text}.{name}({given})"
        if back == "void":
            b.body.append(f"{text};")
        else:
            stack.append(Value(text, 15, back, True, back in ("long", "double")))


OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


class Structurer:
    """Nested statements from blocks, as (depth, line); what cannot nest becomes a goto to a label."""

    def __init__(self, ev: Evaluator):
        self.blocks, self.handlers = ev.blocks, ev.handlers
        self.first = next(iter(self.blocks), None)
        roots = [self.first, *(h["handler_pc"] for h in self.handlers)] if self.blocks else []
        self.order = reverse_postorder(self.blocks, roots)
        self.place = {b: k for k, b in enumerate(self.order)}
        self.loops = {t for b in self.order for t in self.blocks[b].after if self.place[t] <= self.place[b]}
        self.done: set[int] = set()
        self.wanted: set[int] = set()
        self.out: list[tuple[int, str]] = []
        self.starts: dict[int, int] = {}
        # handlers of one range belong together; a handler that stands in its own range opens no region
        self.regions: dict[int, list[tuple[int, dict[int, list[str]]]]] = {}
        grouped: dict[tuple[int, int], dict[int, list[str]]] = {}
        for h in self.handlers:
            if h["start_pc"] != h["handler_pc"] and h["handler_pc"] in self.blocks:
                grouped.setdefault((h["start_pc"], h["end_pc"]), {}).setdefault(h["handler_pc"], []).append(short(h["catch_type"] or "Throwable"))
        for (start, end), catches in sorted(grouped.items(), key=lambda x: (x[0][0], -x[0][1])):
            self.regions.setdefault(start, []).append((end, catches))

    def body(self, header: int) -> set[int]:
        """The blocks of the natural loops of a header."""
        preds: dict[int, list[int]] = {}
        for b in self.order:
            for t in self.blocks[b].after:
                preds.setdefault(t, []).append(b)
        inside, todo = {header}, [b for b in preds.get(header, []) if self.place[b] >= self.place[header]]
        while todo:
            b = todo.pop()
            if b not in inside:
                inside.add(b)
                todo += preds.get(b, [])
        return inside

    def reach(self, start: int, stop: frozenset) -> set[int]:
        seen, todo = set(), [start]
        while todo:
            b = todo.pop()
            if b not in seen and b not in stop and b in self.blocks:
                seen.add(b)
                todo += [t for t in self.blocks[b].after if self.place[t] > self.place[b]]
        return seen

    def meeting(self, arms: list[int], stop: frozenset) -> int | None:
        """The first block, in order, that all arms reach, an arm itself included."""
        sets = [self.reach(a, frozenset()) | {a} for a in arms]
        common = set.intersection(*sets) if sets else set()
        return min(common, key=self.place.__getitem__, default=None)

    def run(self) -> list[tuple[int, str]]:
        if self.first is None:
            return []
        self.emit(self.first, None, None, 0)
        for h in self.handlers:
            at = h["handler_pc"]
            if at not in self.done and at in self.blocks:
                self.out.append((0, f"// catch ({short(h['catch_type'] or 'Throwable')} caught) of {h['start_pc']}..{h['end_pc']}"))
                self.emit(at, None, None, 0)
        for b in self.order:
            if b not in self.done:
                self.emit(b, None, None, 0)
        labels = {self.starts[b]: b for b in self.wanted if b in self.starts}
        lines = []
        for k, (depth, text) in enumerate(self.out):
            if k in labels:
                lines.append((depth, f"L{labels[k]}:"))
            lines.append((depth, text))
        self.stripped = bool(lines) and lines[-1] == (0, "return;")
        return lines[:-1] if self.stripped else lines

    def emit(self, at: int | None, follow: int | None, loop: tuple | None, depth: int) -> None:
        """Statements from block `at` up to `follow`. loop: (header, exit)."""
        while at is not None and at != follow:
            if loop and at == loop[1]:
                self.out.append((depth, "break;"))
                return
            if loop and at == loop[0] and at in self.done:
                self.out.append((depth, "continue;"))
                return
            if at in self.done or at not in self.blocks or depth > DEEPEST:
                self.wanted.add(at)
                self.out.append((depth, f"goto L{at};"))
                return
            if self.regions.get(at):
                at = self.guarded(at, self.regions[at].pop(0)[1], follow, loop, depth)
                continue
            if at in self.loops and not (loop and loop[0] == at):
                at = self.loop(at, follow, depth)
                continue
            at = self.block(at, follow, loop, depth)

    def guarded(self, at: int, catches: dict[int, list[str]], follow: int | None, loop: tuple | None, depth: int) -> int | None:
        """A try statement up to where its body and its handlers meet."""
        fresh = {h: kinds for h, kinds in catches.items() if h not in self.done}
        if not fresh:
            return self.block(at, follow, loop, depth) if at not in self.loops else at
        join = self.meeting([at, *fresh], frozenset())
        join = follow if join is None else join
        self.out.append((depth, "try {"))
        self.emit(at, join, loop, depth + 1)
        for h, kinds in fresh.items():
            self.out.append((depth, f"}} catch ({' | '.join(dict.fromkeys(kinds))} caught) {{"))
            self.emit(h, join, loop, depth + 1)
        self.out.append((depth, "}"))
        return join

    def loop(self, header: int, follow: int | None, depth: int) -> int | None:
        inside = self.body(header)
        leaving = sorted({t for b in inside for t in self.blocks[b].after if t not in inside}, key=self.place.__getitem__)
        leave = leaving[0] if leaving else None
        b = self.blocks[header]
        self.starts.setdefault(header, len(self.out))
        if inside == {header} and b.end[0] == "if" and header in b.end[4:]:
            _, x, sign, y, taken, falls = b.end
            self.done.add(header)
            self.out += [(depth, "do {"), *((depth + 1, line) for line in b.body), (depth, f"}} while ({x} {sign if taken == header else OPPOSITE[sign]} {y});")]
            return falls if taken == header else taken
        if not b.body and b.end[0] == "if" and (b.end[4] in inside) != (b.end[5] in inside):
            _, x, sign, y, taken, falls = b.end
            inner, leave = (taken, falls) if taken in inside else (falls, taken)
            self.done.add(header)
            self.out.append((depth, f"while ({x} {sign if inner == taken else OPPOSITE[sign]} {y}) {{"))
            self.emit(inner, header, (header, leave), depth + 1)
        else:
            self.out.append((depth, "while (true) {"))
            nxt = self.block(header, header, (header, leave), depth + 1)
            if nxt is not None and nxt != header:
                self.emit(nxt, header, (header, leave), depth + 1)
        if self.out[-1] == (depth + 1, "continue;"):
            self.out.pop()
        self.out.append((depth, "}"))
        return leave

    def block(self, at: int, follow: int | None, loop: tuple | None, depth: int) -> int | None:
        b = self.blocks[at]
        self.done.add(at)
        self.starts.setdefault(at, len(self.out))
        self.out += [(depth, s) for s in b.body]
        kind = b.end[0]
        if kind == "stop":
            self.out.append((depth, b.end[1]))
            return None
        if kind == "goto":
            return b.end[1]
        if kind == "if":
            return self.branch(b, follow, loop, depth)
        if kind == "switch":
            return self.switch(b, follow, loop, depth)
        return None

    def branch(self, b: Block, follow: int | None, loop: tuple | None, depth: int) -> int | None:
        _, x, sign, y, taken, falls = b.end
        if taken == falls:
            return falls
        join = self.meeting([taken, falls], frozenset())
        if join is None:
            join = follow
        # the near arm is what falls through, so the test is turned round
        head = len(self.out)
        self.out.append((depth, f"if ({x} {OPPOSITE[sign]} {y}) {{"))
        self.emit(falls, join, loop, depth + 1)
        if len(self.out) == head + 1 and taken != join:
            self.out[head] = (depth, f"if ({x} {sign} {y}) {{")
            self.emit(taken, join, loop, depth + 1)
            self.out.append((depth, "}"))
            return join
        if taken != join:
            ends = self.out[-1][1].startswith(("return", "throw", "break;", "continue;", "goto"))
            if ends and join == follow:
                self.out.append((depth, "}"))
                return taken
            self.out.append((depth, "} else {"))
            self.emit(taken, join, loop, depth + 1)
        self.out.append((depth, "}"))
        return join

    def switch(self, b: Block, follow: int | None, loop: tuple | None, depth: int) -> int | None:
        _, subject, cases, default = b.end
        arms = list(dict.fromkeys([t for _, t in cases] + [default]))
        join = self.meeting(arms, frozenset())
        if join is None:
            join = follow
        self.out.append((depth, f"switch ({subject}) {{"))
        for t in arms:
            keys = [f"case {k}:" for k, goal in cases if goal == t] + (["default:"] if t == default else [])
            self.out += [(depth + 1, k) for k in keys]
            self.emit(t, join, loop, depth + 2)
            if not self.out[-1][1].startswith(("return", "throw", "continue;", "goto", "break;")):
                self.out.append((depth + 2, "break;"))
        self.out.append((depth, "}"))
        return join


def fold(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """`x = x + k;` becomes `x += k;`, or `x++;`."""
    out = []
    for depth, text in lines:
        if m := re.fullmatch(r"(\w+) = \1 ([+-]) (\d+);", text):
            name, sign, k = m.groups()
            text = f"{name}{sign * 2};" if k == "1" else f"{name} {sign}= {k};"
        out.append((depth, text))
    return out


_TEMP = re.compile(r"(tmp\d+) = (.*);")
_CALL = re.compile(r"[\w$>]\s*\(|\bnew\b|\+\+|--|[^=!<>]=[^=]")


def names_read(expression: str) -> list[str]:
    """The distinct names that an expression reads, in order: no members behind a dot, calls, types or words of the language."""
    bare = re.sub(r'"(?:[^"\\]|\\.)*"', '""', expression)
    found = set(re.findall(r"(?<![\w$.])[A-Za-z_$][\w$]*(?![\w$]|\s*\(|\[\])", bare))
    return sorted(x for x in found if x not in ("new", "null", "true", "false", "this", "instanceof", "return", "throw") and not re.search(rf"\(\s*{re.escape(x)}\s*\)\s*[\w(]", bare))


def inline_temps(lines: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], int]:
    """Lines without the temporaries that are written once and read once, behind the write and in its list of statements,
    and how many went. A value that calls, makes or writes something stays, as does one whose names are written before the
    read."""
    lines, gone, at = list(lines), 0, 0
    while at < len(lines):
        depth, text = lines[at]
        m = _TEMP.fullmatch(text)
        at += 1
        if not m or _CALL.search(m[2]):
            continue
        name, value = m.groups()
        word = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])")
        uses = [k for k, (_, t) in enumerate(lines) for _ in word.findall(t) if not re.fullmatch(rf"(?!return |throw )[\w.<>\[\]]+ {name};", t)]
        if len(uses) != 2 or uses[0] != at - 1 or uses[1] <= at - 1:
            continue
        use, between = uses[1], lines[at : uses[1]]
        read = names_read(value)
        if lines[use][0] != depth or any(d < depth for d, _ in between) or any(re.search(rf"(?<![\w$.]){re.escape(r)}(?![\w$])\s*(=[^=]|\+\+|--|[-+]=)", t) for r in read for _, t in between) or lines[use][1].startswith(("while", "}", "L", "case")):
            continue
        if between and ("." in value or "[" in value):  # fields and elements may be written by what lies between
            continue
        whole = re.fullmatch(rf"(.*= |return |throw )?{name};", lines[use][1])
        put = value if whole or re.fullmatch(r"[\w$.]+|\"[^\"]*\"", value) else f"({value})"
        lines[use] = (depth, word.sub(lambda _: put, lines[use][1]))
        del lines[at - 1]
        lines = [(d, t) for d, t in lines if not re.fullmatch(rf"(?!return |throw )[\w.<>\[\]]+ {name};", t)]
        gone, at = gone + 1, 0
    return lines, gone


# Java modifiers in printing order, with the kinds of members that have them.
WORDS = ((0x1, "public", "cmf"), (0x2, "private", "cmf"), (0x4, "protected", "cmf"), (0x400, "abstract", "cm"), (0x8, "static", "cmf"), (0x10, "final", "cmf"), (0x20, "synchronized", "m"), (0x40, "volatile", "f"), (0x80, "transient", "f"), (0x100, "native", "m"))


def modifiers(flags: int, kind: str) -> str:
    return "".join(f"{word} " for bit, word, kinds in WORDS if flags & bit and kind in kinds)


# Flags that Java has no word for, with the kinds of members that have them.
HIDDEN = ((0x40, "bridge", "m"), (0x80, "varargs", "m"), (0x8000, "module", "c"), (0x1000, "synthetic", "cmf"))


def flagged(flags: int, kind: str) -> str:
    """modifiers(), behind a comment of the flags that Java has no word for."""
    other = [word for bit, word, kinds in HIDDEN if flags & bit and kind in kinds]
    return (f"/* {' '.join(other)} */ " if other else "") + modifiers(flags, kind)


def plain(name: str) -> str:
    """A type's name without its package; generic types come without already."""
    return short(name) if "." in name and "<" not in name else name


def annotation_value(v: dict) -> str:
    """The text of an annotation's value; a list of one stands without braces."""
    tag, x = v["tag"], v["value"]
    if tag == "[":
        items = [annotation_value(i) for i in x]
        return items[0] if len(items) == 1 else "{" + ", ".join(items) + "}"
    if tag == "@":
        return annotation_text(x)
    if tag == "e":
        return f"{short(v['type'].rstrip(';'))}.{x}"
    if tag == "c":
        return f"{plain(type_name(x))}.class"
    if tag == "Z":
        return "true" if x else "false"
    if tag == "C":
        return "'" + literal("string", chr(x)).text[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
    kind = {"s": "string", "J": "long", "F": "float", "D": "double"}.get(tag, "int")
    return literal(kind, x).text


def annotation_text(a: dict) -> str:
    values = a["values"]
    inside = annotation_value(values["value"]) if list(values) == ["value"] else ", ".join(f"{k} = {annotation_value(v)}" for k, v in values.items())
    return f"@{short(a['type'].rstrip(';'))}" + (f"({inside})" if inside else "")


def annotations(attrs: dict) -> list[str]:
    return [annotation_text(a) for k in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations") for a in attrs.get(k, [])]


@dataclass
class PassReport:
    """What the passes behind the structure changed in a method, and the labels that are left."""

    returns_stripped: int = 0
    increments_folded: int = 0
    temps_inlined: int = 0
    labels: int = 0


def body_lines(cls: ClassFile, m: Member, style: Style) -> tuple[list[tuple[int, str]], list[tuple[str, str]], PassReport]:
    """(lines of a method's body, its parameters as type and name, what the passes changed)."""
    ev = Evaluator(cls, m, style)
    ev.run()
    structure = Structurer(ev)
    plain_lines = structure.run()
    folded = fold(plain_lines)
    lines, gone = inline_temps([(0, f"{short(t)} tmp{k};") for k, t in enumerate(ev.temps, 1)] + folded)
    report = PassReport(int(getattr(structure, "stripped", False)), sum(a != b for a, b in zip(plain_lines, folded)), gone, sum(bool(re.fullmatch(r"L\d+:", t)) for _, t in lines))
    return lines, ev.params, report


def method_source(cls: ClassFile, m: Member, style: Style = Style(), aliases: dict[str, str] | None = None) -> list[str]:
    """Lines of one method; code that cannot be read leaves its reason. A declaration takes the alias of its node."""
    aliases = aliases or {}
    simple = aliases.get(f"c {cls.name}") or short(cls.name)
    back = type_name(m.descriptor[m.descriptor.index(")") + 1 :])
    lines: list[tuple[int, str]] = []
    try:
        if m.attrs.get("Code"):
            lines, params, _ = body_lines(cls, m, style)
        else:
            params = [(type_name(d), f"arg{n}") for n, d in enumerate(arguments(m.descriptor))]
    except (FormatError, RecursionError) as e:
        params = [(type_name(d), f"arg{n}") for n, d in enumerate(arguments(m.descriptor))]
        lines = [(0, f"// not decompiled: {e}")]
    generic = signature.parse(m.attrs["Signature"], resolved) if m.attrs.get("Signature") else None
    if generic and len(generic.args) == len(params):
        params = [(t, n) for t, (_, n) in zip(generic.args, params)]
        back = generic.ret
    typed = f"<{', '.join(generic.type_params)}> " if generic and generic.type_params else ""
    listed = ", ".join(f"{plain(t)} {n}" for t, n in params)
    if m.name == "<clinit>":
        head = "static"
    elif m.name == "<init>":
        head = f"{flagged(m.access, 'm')}{typed}{simple}({listed})"
    else:
        head = f"{flagged(m.access, 'm')}{typed}{plain(back)} {aliases.get(f'm {cls.name}#{m.name}{m.descriptor}') or m.name}({listed})"
    if m.attrs.get("Exceptions"):
        head += " throws " + ", ".join(short(x) for x in m.attrs["Exceptions"])
    marks = annotations(m.attrs)
    if "AnnotationDefault" in m.attrs:
        head += f" default {annotation_value(m.attrs['AnnotationDefault'])}"
    if not m.attrs.get("Code"):
        return [*marks, head + ";"]
    return [*marks, head + " {", *("\t" * (d + 1) + t for d, t in lines), "}"]


def named_classes(cls: ClassFile) -> set[str]:
    """Classes, by internal name, that members, marks and code of a class name."""
    used = {cls.super_name, *cls.interfaces}
    used |= {x for m in [*cls.fields, *cls.methods] for x in re.findall(r"L([^;]+);", m.descriptor)}
    used |= {x for m in cls.methods for x in m.attrs.get("Exceptions", ())}
    marked = [cls.attrs, *(m.attrs for m in [*cls.fields, *cls.methods])]
    used |= {a["type"][1:-1] for attrs in marked for k in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations") for a in attrs.get(k, [])}
    for m in cls.methods:
        if body := m.attrs.get("Code"):
            used |= {h["catch_type"] for h in body["handlers"]}
            try:
                used |= {i.ref[0] for i in decode(body["code"], cls.pool) if i.ref and i.ref[0] and i.op.layout != "atype" and not i.ref[0].startswith("[")}
            except FormatError:
                pass
    return {x for x in used if x} - {cls.name}


def resolve_imports(classes: list[ClassFile]) -> tuple[list[str], set[str]]:
    """(imports, names that print with their package) of the classes of one file.

    Of classes with one simple name one can go without a package: the file's own first, then its package's, then
    java.lang's, then the first in order.
    """
    package, own = classes[0].name.rpartition("/")[0], {c.name for c in classes}
    holders: dict[str, list[tuple]] = {}
    for name in set().union(own, *(named_classes(c) for c in classes)):
        home, dotted = name.rpartition("/")[0], name.replace("/", ".").replace("$", ".")
        rank = 0 if name in own else 1 if home == package else 2 if home == "java/lang" else 3
        holders.setdefault(dotted.rpartition(".")[2], []).append((rank, dotted, "/" in name))
    first = {simple: min(names) for simple, names in holders.items()}
    taken = {dotted for rank, dotted, placed in first.values() if rank == 3 and placed}
    other = {n[1] for simple, names in holders.items() for n in names if n != first[simple] and n[0] > 0}
    return sorted(taken), other


def every_name(classes: list[ClassFile]) -> set[str]:
    """The whole names of all classes of other packages that the classes of one file name."""
    return {x.replace("/", ".").replace("$", ".") for x in set().union(*(named_classes(c) for c in classes)) if "/" in x} - {c.name.replace("/", ".").replace("$", ".") for c in classes}


def imports(cls: ClassFile) -> list[str]:
    """Classes that members and code name from other packages, but java.lang."""
    return resolve_imports([cls])[0]


def class_lines(cls: ClassFile, style: Style, nested: dict, aliases: dict[str, str], notes: dict[str, list[str]]) -> list[str]:
    """Lines of a class and of the classes nested in it, without package and imports."""
    name = aliases.get(f"c {cls.name}") or (cls.name.rpartition("/")[2].replace("$", ".") if cls.name not in nested.get(None, ()) else cls.name.rpartition("$")[2])
    kind = "@interface" if cls.access & 0x2000 else "interface" if cls.access & 0x200 else "enum" if cls.access & 0x4000 else "record" if cls.attrs.get("Record") else "class"
    flags = cls.access & ~0x400 if cls.access & 0x200 else cls.access
    head = f"{flagged(flags & ~0x20, 'c')}{kind} {name}"
    generic = signature.parse(cls.attrs["Signature"], resolved) if cls.attrs.get("Signature") else None
    above = None if cls.super_name in (None, "java/lang/Object", "java/lang/Record" if kind == "record" else None) else short(cls.super_name)
    faces = [short(i) for i in cls.interfaces]
    if generic:
        head += f"<{', '.join(generic.type_params)}>" if generic.type_params else ""
        above, faces = generic.extends, generic.implements
    if kind == "record":
        head += f"({', '.join(f'{plain(type_name(x['type']))} {x['name']}' for x in cls.attrs['Record'])})"
    if kind == "class" and above:
        head += f" extends {above}"
    if faces:
        head += (" extends " if kind == "interface" else " implements ") + ", ".join(faces)
    out = [f"// {line}" for note in notes.get(cls.name, ()) for line in note.splitlines()] + [*annotations(cls.attrs), head + " {"]
    empty = len(out)
    for f in cls.fields:
        out += ["\t" + a for a in annotations(f.attrs)]
        value = f.attrs.get("ConstantValue")
        t = type_name(f.descriptor)
        t = (f.attrs.get("Signature") and signature.field_type(f.attrs["Signature"], resolved)) or t
        alias = aliases.get(f"f {cls.name}#{f.name}:{f.descriptor}") or f.name
        out.append(f"\t{flagged(f.access, 'f')}{plain(t)} {alias}{' = ' + literal(*value, style).text if value else ''};")
    parts = [method_source(cls, m, style, aliases) for m in cls.methods] + [class_lines(c, style, nested, aliases, notes) for c in nested.get(cls.name, ())]
    for lines in parts:
        out += ([""] if len(out) > empty else []) + ["\t" + x for x in lines]
    return [*out, "}"]


def class_source(cls: ClassFile, style: Style = Style(), nested: list[ClassFile] = (), aliases: dict[str, str] | None = None, notes: dict[str, list[str]] | None = None) -> str:
    """The source file of a class with the classes nested in it, each inside the class whose name stands before its last `$`.

    Declarations take the aliases of their nodes (`c a/B`, `f a/B#x:I`, `m a/B#m()V`); notes stand above their class.
    """
    inside: dict = {}
    for c in sorted(nested, key=lambda c: c.name):
        inside.setdefault(c.name.rpartition("$")[0], []).append(c)
    inside[None] = {c.name for c in nested}
    package = cls.name.rpartition("/")[0]
    out = [f"package {package.replace('/', '.')};", ""] if package else []
    wanted, qualified = resolve_imports([cls, *nested]) if style.use_imports else ([], every_name([cls, *nested]))
    _qualified.clear()
    _qualified.update(qualified)
    try:
        if wanted:
            out += [*(f"import {n};" for n in wanted), ""]
        out += class_lines(cls, style, inside, aliases or {}, notes or {})
    finally:
        _qualified.clear()
    return "\n".join(out) + "\n"
