"""Generic signatures: a tokeniser by expression and a parser by recursion on its tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

PRIMITIVES = {"V": "void", "Z": "boolean", "C": "char", "B": "byte", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}


class _Wrong(ValueError):
    pass


@dataclass
class Signature:
    type_params: list[str] = field(default_factory=list)
    extends: str | None = None
    implements: list[str] = field(default_factory=list)
    args: list[str] = field(default_factory=list)
    ret: str | None = None
    throws: list[str] = field(default_factory=list)


def simple(name: str) -> str:
    return name.rpartition("/")[2].replace("$", ".")


class _Reader:
    """Reads characters by what stands next; names go through `named`."""

    def __init__(self, text: str, named: Callable[[str], str]):
        self.text, self.at, self.named = text, 0, named

    def next_is(self, chars: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] in chars

    def take(self, pattern: str) -> str:
        found = re.compile(pattern).match(self.text, self.at)
        if not found:
            raise _Wrong(f"{pattern} asked at {self.at}")
        self.at = found.end()
        return found[0]

    def many(self, item: Callable[[], str], until: str) -> list[str]:
        out = []
        while not self.next_is(until):
            out.append(item())
        self.at += 1
        return out

    def type(self) -> str:
        kind = self.take(r"[VZCBSIJFDLT\[]")
        if kind == "[":
            return self.type() + "[]"
        if kind == "T":
            return self.take("[^;]+;")[:-1]
        return self.class_type() if kind == "L" else PRIMITIVES[kind]

    def class_type(self) -> str:
        name, arguments = self.take(r"[^;<.]+"), ""
        while True:
            if self.next_is("<"):
                self.at += 1
                arguments = f"<{', '.join(self.many(self.argument, '>'))}>"
            if self.next_is("."):
                self.at += 1
                name, arguments = f"{name}${self.take('[^;<.]+')}", ""
                continue
            self.take(";")
            return self.named(name) + arguments

    def argument(self) -> str:
        if self.next_is("*"):
            self.at += 1
            return "?"
        if self.next_is("+-"):
            return f"? {'extends' if self.take('[+-]') == '+' else 'super'} {self.type()}"
        return self.type()

    def parameter(self) -> str:
        name, bounds = self.take("[^:<>;]+"), []
        while self.next_is(":"):
            self.at += 1
            if not self.next_is(":>"):
                bounds.append(self.type())
        if bounds and bounds[0] == "Object":
            bounds = bounds[1:]
        return name + (f" extends {' & '.join(bounds)}" if bounds else "")


def parse(text: str, named: Callable[[str], str] = simple) -> Signature | None:
    """A class or method signature, or None where the text is none."""
    r, out = _Reader(text, named), Signature()
    try:
        if r.next_is("<"):
            r.at += 1
            out.type_params = r.many(r.parameter, ">")
        if r.next_is("("):
            r.at += 1
            out.args = r.many(r.type, ")")
            out.ret = r.type()
            while r.next_is("^"):
                r.at += 1
                out.throws.append(r.type())
        else:
            above = r.type()
            out.extends = None if above == "Object" else above
            while r.at < len(text):
                out.implements.append(r.type())
        return out if r.at == len(text) else None
    except (_Wrong, RecursionError):
        return None


def field_type(text: str, named: Callable[[str], str] = simple) -> str | None:
    r = _Reader(text, named)
    try:
        out = r.type()
    except (_Wrong, RecursionError):
        return None
    return out if r.at == len(text) else None
