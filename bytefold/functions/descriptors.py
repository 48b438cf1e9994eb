"""Type descriptors and access flags as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Descriptor letters of the primitive types.
PRIMITIVES = {"V": "void", "Z": "boolean", "C": "char", "B": "byte", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}
BOXES = {"boolean": "Boolean", "char": "Character", "byte": "Byte", "short": "Short", "int": "Integer", "long": "Long", "float": "Float", "double": "Double"}
ONE = r"\[*(?:[VZCBSIJFD]|L[^;]*;)"
# Bits, words and the kind of member that has them (c class, m method, f field), in printing order.
ACCESS = (
    (0x1, "public", "cmf"), (0x2, "private", "cmf"), (0x4, "protected", "cmf"), (0x8, "static", "cmf"), (0x10, "final", "cmf"),
    (0x400, "abstract", "cmf"), (0x100, "native", "cmf"), (0x20, "synchronized", "m"), (0x40, "bridge", "m"), (0x80, "varargs", "m"),
    (0x40, "volatile", "f"), (0x80, "transient", "f"), (0x8000, "module", "c"), (0x800, "strict", "c"), (0x20, "super", "c"),
    (0x4000, "enum", "c"), (0x40000, "data", "c"), (0x1000, "synthetic", "cmf"),
)
# Single bits by what they say, whatever the kind of member.
BITS = {"public": 0x1, "static": 0x8, "final": 0x10, "bridge": 0x40, "native": 0x100, "interface": 0x200, "abstract": 0x400, "synthetic": 0x1000, "annotation": 0x2000, "enum": 0x4000}
# Groups of primitive types.
INT_LIKE = ("boolean", "byte", "char", "short", "int")
FLOAT_LIKE, WIDE = ("float", "double"), ("long", "double")
NUMERIC = ("byte", "char", "short", "int", "long", "float", "double")
# Words that Java prints as modifiers; other access words stand in a comment.
JAVA_WORDS = ("public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "volatile", "transient", "default")
# Method handles by number, types of annotation values by tag, and types of stack-map entries.
HANDLES = {1: "getfield", 2: "getstatic", 3: "putfield", 4: "putstatic", 5: "invokevirtual", 6: "invokestatic", 7: "invokespecial", 8: "new_invoke_special", 9: "invokeinterface"}
VALUE_TYPES = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "s": "java.lang.String", "c": "java.lang.Class", "@": "java.lang.Object", "[": "java.lang.Object"}
FRAME_TYPES = {"int": "int", "float": "float", "double": "double", "long": "long", "null": "java.lang.Void", "uninitialized_this": "java.lang.Object", "uninitialized": "java.lang.Object"}
# Options that are words, in their order.
INTEGER_FORMATS = ("auto", "decimal", "hexadecimal")
MODES = ("auto", "restructure", "simple", "fallback")
COMMENT_LEVELS = ("none", "user_only", "error", "warn", "info", "debug")


def dimensions(descriptor: Column) -> Column:
    return F.length(F.regexp_extract(descriptor, r"^\[*", 0))


def readable(descriptor: Column) -> Column:
    """The source name of a type descriptor: primitives by word, classes by dots, arrays by brackets; other text as it is."""
    dims = dimensions(descriptor)
    bare = F.regexp_replace(descriptor, r"^\[+", "")
    words = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    named = F.when(bare.rlike("^L[^;]*;"), F.translate(F.regexp_extract(bare, "^L([^;]*);", 1), "/$", "..")).otherwise(F.coalesce(F.try_element_at(words, F.substring(bare, 1, 1)), bare))
    return F.concat(F.when(descriptor == "", F.lit("void")).otherwise(named), F.repeat(F.lit("[]"), dims))


def arguments(method: Column) -> Column:
    """array<string> of the argument descriptors of a method descriptor."""
    return F.regexp_extract_all(F.regexp_extract(method, r"^\(([^)]*)\)", 1), F.lit(f"({ONE})"), F.lit(1))


def returned(method: Column) -> Column:
    return F.when(F.regexp_extract(method, rf"\)({ONE})", 1) != "", F.regexp_extract(method, rf"\)({ONE})", 1)).otherwise("V")


def slots(method: Column, instance: Column) -> Column:
    """Local slots that the parameters take: two for long and double, one more for an instance."""
    wide = F.aggregate(arguments(method), F.lit(0), lambda n, a: n + F.when(a.isin("J", "D"), 2).otherwise(1))
    return wide + F.when(instance, 1).otherwise(0)


def promote(a: Column, b: Column) -> Column:
    pair = F.array(a, b)
    return F.when(F.array_contains(pair, "double"), "double").when(F.array_contains(pair, "float"), "float").when(F.array_contains(pair, "long"), "long").otherwise("int")


def access_text(flags: Column, kind: str) -> Column:
    """The words of the set bits, each with a space behind it; a bit's word depends on the kind of member."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(word + " ")).otherwise(F.lit("")) for bit, word, kinds in ACCESS if kind in kinds])


def jdk_version(major: Column) -> Column:
    return F.when(major >= 45, major - 44).otherwise(0)


def boxed(name: Column) -> Column:
    """The class that holds a primitive, by simple name; null for all others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in BOXES.items() for x in pair]), name)


def unboxed(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for a, b in BOXES.items() for x in (b, a)]), name)


def assignable(target: Column, source: Column) -> Column:
    """Whether a value of one source type name may go where another is declared, without looking at class hierarchies:
    equal types; Object takes any reference; a class takes any array; wider numbers take narrower ones."""
    primitive = [*PRIMITIVES.values()]
    int_like = ["boolean", "char", "byte", "short", "int"]
    numeric = ["char", "byte", "short", "int", "long", "float", "double"]
    both_reference = ~target.isin(*primitive) & ~source.isin(*primitive)
    rules = (target == source) | (both_reference & ((target == "Object") | (source.endswith("[]") & ~target.endswith("[]"))))
    rules = rules | (target.isin(*int_like) & source.isin(*int_like)) | ((target == "long") & source.isin(*int_like))
    return rules | (target.isin("float", "double") & source.isin(*numeric))


def class_kind(flags: Column) -> Column:
    """annotation, interface, enum, abstract or class; the first bit that is set in this order names it."""
    bits = ((0x2000, "annotation"), (0x200, "interface"), (0x4000, "enum"), (0x400, "abstract"))
    out = F.lit("class")
    for bit, name in reversed(bits):
        out = F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)).otherwise(out)
    return out


# ---- predicates over type names and access flags

def type_flags(name: Column) -> dict[str, Column]:
    """Booleans by name over a source type name; null for null. boolean is int-like but not numeric."""
    primitive = name.isin(*PRIMITIVES.values())
    return {"primitive": primitive, "void": name == "void", "wide": name.isin(*WIDE), "numeric": name.isin(*NUMERIC), "int_like": name.isin(*INT_LIKE), "float_like": name.isin(*FLOAT_LIKE), "reference": ~primitive}


def element(descriptor: Column) -> Column:
    """The descriptor of an array's elements; null for what is no array."""
    return F.when(descriptor.startswith("["), F.substring(descriptor, F.lit(2), F.length(descriptor)))


def class_of(descriptor: Column) -> Column:
    """a/B of La/B;, and any other text as it is."""
    return F.regexp_replace(descriptor, "^L([^;]*);$", "$1")


def descriptor_of(name: Column) -> Column:
    """La/B; of a class name a/B or a.B; array and class descriptors as they are."""
    return F.when(name.startswith("[") | name.rlike("^L[^;]*;$"), name).otherwise(F.concat(F.lit("L"), F.translate(name, ".", "/"), F.lit(";")))


def has(flags: Column, word: str) -> Column:
    return flags.bitwiseAND(F.lit(BITS[word])) != 0


def access_flags(flags: Column) -> dict[str, Column]:
    return {word: has(flags, word) for word in BITS}


def modifiers(flags: Column, kind: str) -> Column:
    """struct<java, other>: the words that Java prints, and those that only the flags know, each joined by spaces."""
    words = F.filter(F.split(access_text(flags, kind), " "), lambda w: w != "")
    return F.struct(F.array_join(F.filter(words, lambda w: w.isin(*JAVA_WORDS)), " ").alias("java"), F.array_join(F.filter(words, lambda w: ~w.isin(*JAVA_WORDS)), " ").alias("other"))


def hidden(flags: Column, show_synthetic: bool = False) -> Column:
    return F.lit(False) if show_synthetic else has(flags, "synthetic")


def method_flags(name: Column, flags: Column) -> dict[str, Column]:
    return {"constructor": name == "<init>", "class_initializer": name == "<clinit>", "abstract": has(flags, "abstract"), "native": has(flags, "native")}


def class_flags(flags: Column, components: Column) -> dict[str, Column]:
    """`components`: the number of record components, null where there is no such attribute."""
    return {**{k: has(flags, k) for k in ("interface", "abstract", "enum", "annotation")}, "record": F.coalesce(components > 0, F.lit(False))}


def _of_map(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def handle_kind(number: Column) -> Column:
    return F.coalesce(_of_map(HANDLES, number.cast("int")), F.lit("unknown"))


def value_type(tag: Column, enum_type: Column) -> Column:
    """The type of an annotation value; that of an enum constant is the enum's."""
    return F.when(tag == "e", readable(enum_type)).otherwise(_of_map(VALUE_TYPES, tag))


def is_override(annotation: Column) -> Column:
    return class_of(annotation) == "java/lang/Override"


def frame_type(tag: Column, class_name: Column) -> Column:
    """What a stack-map entry holds, as a source name; null for `top`."""
    return F.when(tag == "object", readable(descriptor_of(class_name))).otherwise(_of_map(FRAME_TYPES, tag))


def local_type(locals_: Column, slot: Column) -> Column:
    """The type in local slot `slot` of a frame's array<struct<tag, type, ...>>: long and double take two slots, and the
    second of them, like a slot behind the last, holds nothing."""
    state = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(s: Column, v: Column) -> Column:
        size = F.when(v["tag"].isin(*WIDE), 2).otherwise(1)
        return F.struct((s["at"] + size).alias("at"), F.when(s["at"] == slot, frame_type(v["tag"], v["type"])).otherwise(s["found"]).alias("found"))

    return F.aggregate(locals_, state, step, lambda s: s["found"])


# ---- options that are words

def integer_format(text: str) -> str | None:
    """auto, decimal or hexadecimal, whatever the case; `hex` is short for the last; None for others."""
    word = text.lower()
    return "hexadecimal" if word == "hex" else word if word in INTEGER_FORMATS else None


def decompilation_mode(text: str) -> str | None:
    return text.lower() if text.lower() in MODES else None


def is_special_mode(mode: str) -> bool:
    return mode in ("simple", "fallback")


def comment_allowed(level: Column, limit: str) -> Column:
    """Whether a comment of a level may print under a limit: levels stand in order; unknown ones may not."""
    at = F.array_position(F.array(*[F.lit(x) for x in COMMENT_LEVELS]), F.lower(level))
    return (at > 0) & (at <= COMMENT_LEVELS.index(limit.lower()) + 1)
