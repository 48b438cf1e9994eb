"""Name rules as Column functions: hashes, identifiers, aliases, packages, rename lines. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reserved words of Java, which cannot name anything.
RESERVED = (
    "_ abstract assert boolean break byte case catch char class const continue default do double else enum extends "
    "false final finally float for goto if implements import instanceof int interface long native new null package "
    "private protected public return short static strictfp super switch synchronized this throw throws transient "
    "true try void volatile while"
).split()

TWO_32 = 1 << 32
# The kinds of code nodes and their one-letter codes.
KIND_CODES = {"package": "p", "class": "c", "field": "f", "method": "m", "return": "r", "variable": "v", "type": "t", "instruction": "i"}


def _signed_32(x: Column) -> Column:
    return F.when(x >= TWO_32 // 2, x - TWO_32).otherwise(x).cast("int")


def utf16_units(text: Column) -> Column:
    """array<bigint> of the UTF-16 code units."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(raw) / 4).cast("int")
    units = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.conv(F.substring(raw, i * 4 - 3, F.lit(4)), 16, 10).cast("bigint"))
    return F.when(count > 0, units).otherwise(F.array().cast("array<bigint>"))


def java_hash(text: Column) -> Column:
    """The 31-polynomial over UTF-16 units, wrapped to a signed 32-bit integer; null for null."""
    return _signed_32(F.aggregate(utf16_units(text), F.lit(0).cast("bigint"), lambda h, u: (h * 31 + u) % TWO_32))


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$")


def is_reserved(name: Column) -> Column:
    return name.isin(*RESERVED)


def clean_identifier(name: Column) -> Column:
    """Unchanged if valid already, else with the characters that identifiers cannot hold taken out."""
    return F.when(is_identifier(name), name).otherwise(F.regexp_replace(name, r"[^\p{L}\p{N}_$]", ""))


def name_part(name: Column, longest: int = 16) -> Column:
    """What an alias keeps of a name: a long one becomes x and the hex of its hash."""
    h = java_hash(name).cast("bigint")
    unsigned = F.when(h < 0, h + TWO_32).otherwise(h)
    return F.when(F.length(name) > longest, F.concat(F.lit("x"), F.lower(F.hex(unsigned)))).otherwise(clean_identifier(name))


def package_alias(number: Column, name: Column) -> Column:
    return F.concat(F.format_string("p%03d", number), name_part(name))


def class_alias(number: Column, name: Column, prefix: Column) -> Column:
    return F.concat(prefix, F.format_string("C%04d", number), name_part(name))


def field_alias(number: Column, name: Column) -> Column:
    return F.concat(F.format_string("f%d", number), name_part(name))


def method_alias(number: Column, name: Column, overloaded: Column) -> Column:
    return F.concat(F.when(overloaded, F.lit("mo")).otherwise(F.lit("m")), F.format_string("%d", number), name_part(name))


def package_of(name: Column) -> Column:
    """Text before the last slash; '' in the default package."""
    return F.when(F.instr(name, "/") > 0, F.regexp_replace(name, r"/[^/]*$", "")).otherwise(F.lit(""))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def source_name(name: Column) -> Column:
    return F.translate(name, "/$", "..")


def matches_any(name: Column, patterns: list[str]) -> Column:
    """No patterns accept all; `p.*` accepts p and all below it; others by equality."""
    if not patterns:
        return F.lit(True)
    listed = F.array(*[F.lit(p) for p in patterns])

    def one(p: Column) -> Column:
        stem = F.regexp_replace(p, r"\.\*$", "")
        return F.when(p.endswith(".*"), (name == stem) | F.startswith(name, F.concat(stem, F.lit(".")))).otherwise(name == p)

    return F.exists(listed, one)


def whitelisted(name: Column, patterns: list[str]) -> Column:
    """Equality with a pattern without its `.*`, or a place below it by slashes."""
    stems = F.array(*[F.lit(p.removesuffix(".*")) for p in patterns])
    return F.exists(stems, lambda p: (name == p) | F.startswith(name, F.concat(p, F.lit("/"))))


def should_rename(name: Column, least: int, force: bool) -> Column:
    """Never special names; with a whitelist in force all others, else the short ones."""
    special = F.startswith(name, F.lit("<")) | name.isin("this", "super")
    return ~special & (F.lit(True) if force else F.length(name) < least)


def skip_package(package: Column, skipped: list[str]) -> Column:
    """A package (by dots or slashes) that is listed, or lies below a listed one."""
    dotted = F.translate(package, "/", ".")
    return F.exists(F.array(*[F.lit(s.replace("/", ".")) for s in skipped]).cast("array<string>"), lambda s: (dotted == s) | F.startswith(dotted, F.concat(s, F.lit("."))))


def class_alias_of(node: Column, alias: Column) -> Column:
    """A class's name under its alias: the package stays, all behind it goes."""
    return F.when(F.instr(node, "/") > 0, F.concat_ws("/", package_of(node), alias)).otherwise(alias)


def rename_line(code: Column, node: Column, alias: Column, slot: Column | None = None) -> Column:
    ref = node if slot is None else F.concat(node, F.coalesce(F.concat(F.lit("#"), slot.cast("string")), F.lit("")))
    return F.concat(code, F.lit(" "), ref, F.lit(" = "), alias)


def parse_rename(line: Column) -> Column:
    """struct<kind, node, slot, alias>, or null where the line is none."""
    text = F.trim(line)
    ref, alias = F.trim(F.regexp_extract(text, r"^..([^=]*)=", 1)), F.trim(F.regexp_extract(text, r"^..[^=]*=(.*)$", 1))
    slot = F.regexp_extract(ref, r"#(\d+)$", 1)
    good = text.rlike("^[pcfmrvti]") & (ref != "") & (alias != "")
    parsed = F.struct(F.substring(text, 1, 1).alias("kind"), F.regexp_replace(ref, r"#\d+$", "").alias("node"), F.when(slot != "", slot.cast("int")).alias("slot"), alias.alias("alias"))
    return F.when(good, parsed)


def comment_line(code: Column, node: Column, line: Column, text: Column) -> Column:
    return F.concat_ws(" ", F.lit("@"), code, node, line.cast("string"), text)


def parse_comment(line: Column) -> Column:
    """struct<kind, node, line, text> of `@ kind node line text`; a bad number is -1; null where the line is none."""
    pattern = r"^@\s*([pcfmrvti])\S*\s+(\S+)\s+(\S+)\s?(.*)$"
    part = [F.regexp_extract(F.trim(line), pattern, i) for i in range(1, 5)]
    number = F.coalesce(F.when(part[2].rlike(r"^-?\d{1,9}$"), part[2].cast("int")), F.lit(-1))
    return F.when(part[0] != "", F.struct(part[0].alias("kind"), part[1].alias("node"), number.alias("line"), part[3].alias("text")))


def json_body(text: Column) -> Column:
    """The text as it stands between the quotes of a JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)
