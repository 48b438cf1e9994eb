"""Kernels without Spark: binary formats, instructions, decompiled text."""

import io
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytefold.kernels import archive, classfile, decompile, dexbuilder, dexfile, insn, opcodes
from bytefold.kernels.binary import Cursor, FormatError, modified_utf8, to_modified_utf8
from bytefold.kernels.builder import ClassBuilder
from bytefold.kernels.insn import assemble


def demo():
    b = ClassBuilder("shop/Basket")
    b.field("RATE", "I", 0x19, b.number("int", 7))
    b.method("twice", "(I)I", assemble(("iload_0",), ("iconst_2",), ("imul",), ("ireturn",)))
    b.method("least", "(II)I", assemble(("iload_0",), ("iload_1",), ("if_icmpge", 5), ("iload_0",), ("ireturn",), ("iload_1",), ("ireturn",)))
    b.method("drain", "(I)I", assemble(("iconst_0",), ("istore_1",), ("iload_0",), ("ifle", 13), ("iload_1",), ("iload_0",), ("iadd",), ("istore_1",), ("iinc", 0, -3), ("goto", -11), ("iload_1",), ("ireturn",)), lines=((0, 20), (6, 21), (16, 23)), variables=((0, 18, "stock", "I", 0), (2, 16, "sold", "I", 1)))
    trim = b.member("java/lang/String", "trim", "()Ljava/lang/String;")
    b.method("trimmed", "(Ljava/lang/String;)Ljava/lang/String;", assemble(("aload_0",), ("invokevirtual", trim), ("areturn",)))
    b.method("either", "(II)I", assemble(("iload_0",), ("ifeq", 7), ("iload_1",), ("goto", 5), ("bipush", 9), ("istore_2",), ("iload_2",), ("ireturn",)))
    made, init, text = b.class_ref("depot/Item"), b.member("depot/Item", "<init>", "(Ljava/lang/String;)V"), b.string("tea")
    b.method("order", "()V", assemble(("new", made), ("dup",), ("ldc", text), ("invokespecial", init), ("astore_0",), ("return",)))
    return b


def test_opcode_table():
    assert len(opcodes.OPS) == 202
    for name, at in (("nop", 0), ("iload_0", 0x1A), ("pop", 0x57), ("iadd", 0x60), ("ifeq", 0x99), ("getfield", 0xB4), ("jsr_w", 0xC9)):
        assert opcodes.BY_NAME[name].code == at
    assert len(dexfile.OPCODES) == 256 and sum(bool(n) for n, _, _ in dexfile.OPCODES) == 224


def test_cursor_and_leb128():
    c = Cursor(bytes.fromhex("80808080 0f 7f 00 80 7f"))
    assert c.uleb128() == 0xF0000000
    assert Cursor(b"\x7f").sleb128() == -1 and Cursor(b"\x80\x7f").sleb128() == -128 and Cursor(b"\x00").uleb128p1() == -1
    with pytest.raises(FormatError):
        Cursor(b"\x80").uleb128()
    with pytest.raises(FormatError):
        Cursor(b"\x01").u2()


@given(st.text())
@settings(max_examples=60, deadline=None)
def test_modified_utf8_round_trip(text):
    raw = to_modified_utf8(text)
    assert 0 not in raw and modified_utf8(raw) == text


def test_modified_utf8_cases():
    assert modified_utf8(bytes.fromhex("78c08079")) == "x\0y" == modified_utf8(to_modified_utf8("x\0y"))
    assert modified_utf8(bytes.fromhex("eda0bdedba80")) == "\U0001F680"
    assert modified_utf8(b"\xf8") == "?" and modified_utf8(bytes.fromhex("edb080")) == "\ufffd"


@given(st.lists(st.tuples(st.from_regex(r"[a-z]{1,8}", fullmatch=True), st.sampled_from(["I", "J", "[B", "Lx/Y;"]), st.integers(0, 65535)), max_size=6))
@settings(max_examples=40, deadline=None)
def test_assembled_members_parse_back(members):
    b = ClassBuilder("p/A")
    for name, d, access in members:
        b.field(name, d, access)
    c = classfile.parse(b.build())
    assert [(f.name, f.descriptor, f.access) for f in c.fields] == members and c.name == "p/A" and c.super_name == "java/lang/Object"


def test_every_prefix_fails_cleanly():
    raw = demo().build()
    assert classfile.parse(raw).major == 52
    for n in range(len(raw)):
        with pytest.raises(FormatError):
            classfile.parse(raw[:n])


def test_frames_follow_the_specification():
    b = ClassBuilder("p/F")
    frames = struct.pack(">H", 4) + bytes([5]) + bytes([252]) + struct.pack(">H", 0) + bytes([1]) + bytes([250]) + struct.pack(">H", 2) + bytes([64, 1])
    code = struct.pack(">HHI", 1, 1, 1) + b"\xb1" + struct.pack(">HH", 0, 1) + b.attribute("StackMapTable", frames)
    b.methods.append(struct.pack(">HHHH", 9, b.utf8("m"), b.utf8("()V"), 1) + b.attribute("Code", code))
    found = classfile.parse(b.build()).methods[0].attrs["Code"]["attrs"]["StackMapTable"]
    assert [(f["off"], len(f["locals"]), len(f["stack"])) for f in found] == [(5, 0, 0), (6, 1, 0), (9, 0, 0), (10, 0, 1)]


def test_switches_and_wide():
    pool = classfile.parse(demo().build()).pool
    table = b"\xaa\0\0\0" + struct.pack(">iiiii", 20, 3, 4, 28, 30)
    lookup = b"\xab\0\0\0" + struct.pack(">iiii", 9, 1, -5, 12)
    assert insn.decode(table, pool)[0].targets == [20, 28, 30] and insn.decode(table, pool)[0].keys == [3, 4]
    assert insn.decode(lookup, pool)[0].keys == [-5]
    wide = insn.decode(bytes.fromhex("c4840100ff38"), pool)[0]
    assert (wide.op.name, wide.local, wide.value, wide.size) == ("iinc", 256, -200, 6)
    for bad in (b"\xca", b"\x10", b"\xbc\x01"):
        with pytest.raises(FormatError):
            insn.decode(bad, pool)


def test_listing():
    c = classfile.parse(demo().build())
    body = c.methods[2].attrs["Code"]
    lines = insn.listing(body, c.pool).splitlines()
    assert lines[2:7] == ["    2: iload_0", "    3: ifle 16", "    6: iload_1", "    7: iload_0", "    8: iadd"] and "   10: iinc 0 -3" in lines and "   13: goto 2" in lines
    assert insn.listing({"code": b"\xca\x01", "handlers": [], "attrs": {}}, c.pool).splitlines()[1] == "    0: ca 01"


def source(name, style=decompile.Style()):
    text = decompile.class_source(classfile.parse(demo().build()), style)
    at = text.index(f" {name}(")
    return text[at : text.index("\n\t}\n", at)].replace("\t", "")


def test_decompiled_methods():
    assert source("twice") == " twice(int arg0) {\nreturn arg0 * 2;"
    assert source("least") == " least(int arg0, int arg1) {\nif (arg0 < arg1) {\nreturn arg0;\n}\nreturn arg1;"
    assert "while (stock > 0) {\nsold = sold + stock;\nstock -= 3;\n}\nreturn sold;" in source("drain")
    assert "return arg0.trim();" in source("trimmed")
    assert source("either").count("tmp1 = ") == 2 and 'Item v0 = new Item("tea");' in source("order")
    text = decompile.class_source(classfile.parse(demo().build()))
    assert "import depot.Item;" in text and "java.lang" not in text and "public static final int RATE = 7;" in text


def test_styles_of_sources():
    plain = source("drain", decompile.Style(debug_names=False))
    assert "stock" not in plain and "while (arg0 > 0) {" in plain
    lined = source("drain", decompile.Style(line_numbers=True))
    assert "// line 20" in lined and "// line 21\nsold = sold + stock;" in lined
    whole = decompile.class_source(classfile.parse(demo().build()), decompile.Style(use_imports=False))
    assert "import" not in whole and 'depot.Item v0 = new depot.Item("tea");' in whole


def test_names_and_comments_of_declarations():
    c = classfile.parse(demo().build())
    lid = ClassBuilder("shop/Basket$Lid", access=0x1021)
    lid.field("k", "I")
    lid.method("shut", "(I[J)V", assemble(("return",)), access=0x1041)
    pin = ClassBuilder("shop/Basket$Lid$Pin")
    inner = [classfile.parse(b.build()) for b in (pin, lid)]
    aliases = {"c shop/Basket": "Bag", "f shop/Basket#RATE:I": "PRICE", "m shop/Basket#twice(I)I": "doubled", "c shop/Basket$Lid": "Top", "f shop/Basket$Lid#k:I": "key"}
    text = decompile.class_source(c, nested=inner, aliases=aliases, notes={"shop/Basket": ["first", "second\nthird"], "shop/Basket$Lid": ["inside"]})
    assert "// first\n// second\n// third\npublic class Bag {" in text and "int PRICE = 7;" in text and "int doubled(int arg0)" in text
    assert "\t// inside\n\t/* synthetic */ public class Top {\n\t\tpublic int key;" in text and "\t\t/* bridge synthetic */ public void shut(int arg0, long[] arg1) {" in text
    assert "\t\tpublic class Pin {\n\t\t}" in text and text.count("package shop;") == 1


def test_simple_names_that_clash():
    b = ClassBuilder("p/A")
    for k, name in enumerate(("q/Date", "r/Date", "p/Own", "s/Own", "s/String", "s/A")):
        b.field(f"f{k}", f"L{name};")
    text = decompile.class_source(classfile.parse(b.build()))
    assert text.count("import ") == 2 and "import q.Date;" in text and "import s.String;" in text
    for line in ("public Date f0;", "public r.Date f1;", "public Own f2;", "public s.Own f3;", "public s.A f5;"):
        assert line in text, text


def test_locals_never_share_a_name():
    b = ClassBuilder("p/A")
    rows = tuple((0, 9, name, "I", slot) for slot, name in enumerate(("x", "x", "x$1", "x")))
    b.method("m", "(IIII)V", assemble(("return",)), variables=rows)
    text = decompile.class_source(classfile.parse(b.build()))
    assert "m(int x, int x$2, int x$1, int x$3)" in text


def test_names_that_are_read():
    for text, want in (("a + b.c * f(d)", ["a", "b", "d"]), ('x == null ? "y z" : x$1', ["x", "x$1"]), ("(String) o", ["o"]), ("new int[n]", ["n"]), ("3", [])):
        assert [n for n in decompile.names_read(text) if n != "int"] == want, text


def test_inlined_temporaries():
    def run(*texts):
        lines, n = decompile.inline_temps([(0, t) for t in texts])
        return [t for _, t in lines], n

    assert run("int tmp1;", "tmp1 = a + b;", "return tmp1;") == (["return a + b;"], 1)
    assert run("int tmp1;", "tmp1 = a + b;", "x = tmp1 * 2;") == (["x = (a + b) * 2;"], 1)
    for kept in (("tmp1 = f(a);", "x = tmp1;"), ("tmp1 = a;", "a = 3;", "x = tmp1;"), ("tmp1 = a;", "x = tmp1;", "y = tmp1;"), ("tmp1 = a;", "tmp1 = b;", "x = tmp1;"), ("tmp1 = a.b;", "c = 1;", "x = tmp1;"), ("x = tmp1;", "tmp1 = a;")):
        assert run("int tmp1;", *kept) == (["int tmp1;", *kept], 0)


def test_literals_follow_the_style():
    plain, other = decompile.Style(), decompile.Style(escape_unicode=False, hexadecimal=True)
    for kind, value, a, b in (("string", 'é"\n\0😀', '"\\u00e9\\"\\n\\0\\ud83d\\ude00"', '"é\\"\\n\\0😀"'), ("int", -1, "-1", "0xffffffff"), ("int", 2**31 - 1, "2147483647", "Integer.MAX_VALUE"), ("long", 7, "7L", "0x7L"), ("long", -(2**63), "-9223372036854775808L", "Long.MIN_VALUE"), ("float", struct.unpack("f", struct.pack("f", 0.1))[0], "0.1f", "0.1f"), ("double", 1e20, "1e+20d", "1e+20d"), ("double", float("nan"), "Double.NaN", "Double.NaN")):
        assert (decompile.literal(kind, value, plain).text, decompile.literal(kind, value, other).text) == (a, b)


def test_undecodable_code_keeps_the_class():
    b = demo()
    b.method("bad", "()V", b"\xca")
    text = decompile.class_source(classfile.parse(b.build()))
    assert "// not decompiled" in text and "return arg0 * 2;" in text


def zipped(method=zipfile.ZIP_DEFLATED, **entries):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return raw.getvalue()


def test_archives():
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        raw = zipped(method, a=b"x" * 5000, b=b"")
        found = archive.entries(raw)
        assert [archive.read(raw, e) for e in found] == [b"x" * 5000, b""]
        assert archive.entries(raw[:-2] + struct.pack("<H", 3) + b"end")[0].name == "a"
    raw = zipped(a=b"x" * 5000)
    entry = archive.entries(raw)[0]
    with pytest.raises(FormatError):
        archive.read(raw, entry, limit=100)
    entry.crc ^= 1
    with pytest.raises(FormatError):
        archive.read(raw, entry)
    packed = zipped(a=bytes(range(256)) * 40)
    entry = archive.entries(packed)[0]
    entry.packed, entry.crc = entry.packed // 2, 0
    with pytest.raises(FormatError):  # half a stream, and no checksum to tell
        archive.read(packed, entry)
    for bad in (b"", b"PK", raw[:-30]):
        with pytest.raises(FormatError):
            archive.entries(bad)
    assert zlib.crc32(b"the quick brown fox") == 0x91C102CA


def test_dex():
    raw = dexbuilder.build("Lp/A;", {"run": [0x0113, 0x7F, 0x0167, 0, 0x000E], "go": [0x0028]}, ("b", "a"), "A.java")
    dex = dexfile.DexFile(raw)
    (c,) = dex.classes
    assert [(m.kind, m.name, m.descriptor) for m in c.members] == [("static_field", "a", "I"), ("static_field", "b", "I"), ("direct_method", "go", "()V"), ("direct_method", "run", "()V")]
    text = dexfile.listing(dex, c)
    assert text.startswith('.class public Lp/A;\n.super Ljava/lang/Object;\n.source "A.java"') and "0000: const/16 v1, 127" in text and "sput v1, Lp/A;->a:I" in text
    for n in range(0, 0x70, 8):
        with pytest.raises(FormatError):
            dexfile.DexFile(raw[:n])


def test_dex_tries():
    raw = dexbuilder.build("Lp/B;", {"run": [0x0000, 0x0000, 0x000E]}, tries={"run": [(0, 1, [("Lx/E;", 2), ("Lx/F;", 1)], None), (1, 1, [("Lx/E;", 2)], 0), (2, 1, [], 1)]})
    dex = dexfile.DexFile(raw)
    (m,) = dex.classes[0].members
    got = [(t["start"], t["end"], t["handler"], t["type"]) for t in dex.tries(m.code_off)]
    assert got == [(0, 1, 2, "Lx/E;"), (0, 1, 1, "Lx/F;"), (1, 2, 2, "Lx/E;"), (1, 2, 0, None), (2, 3, 1, None)]
    assert "    .catch all 0001..0002 -> 0000" in dexfile.listing(dex, dex.classes[0])
    assert ("type", dex.types.index("Lx/E;"), None, "Lx/E;", None) in dex.id_rows() and ("method", 0, "Lp/B;", "run", "()V") in dex.id_rows()
