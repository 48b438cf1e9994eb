"""The facade, rename maps, signatures and the command line."""

import io
import json
import shutil
import subprocess
import zipfile

import pytest
from test_kernels import demo, zipped

from bytefold import cli
from bytefold.engine import Engine, percent, resolve_pool
from bytefold.functions import descriptors as D
from bytefold.kernels import classfile, decompile, dexbuilder, signature
from bytefold.kernels.builder import ClassBuilder
from bytefold.plans import tables
from bytefold.sources.renames import map_lines, read_map, write_map
from bytefold.sources.units import list_files


def jar():
    raw = io.BytesIO()
    inner = ClassBuilder("shop/Basket$Lid")
    inner.field("k", "I")
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("shop/Basket.class", demo().build())
        z.writestr("shop/Basket$Lid.class", inner.build())
        z.writestr("broken.class", b"not a class")
        z.writestr("readme.txt", "x")
    return raw.getvalue()


@pytest.fixture()
def engine(spark):
    dex = dexbuilder.build("Lp/A;", {"run": [0x000E]})
    return Engine(spark, rename_shorter_than=6).add_bytes("app.jar", jar()).add_bytes("a.dex", dex).add_bytes("cut.zip", zipped(a=b"x")[:-30]).add_bytes("bad.dex", dex[:80])


def test_tables_of_an_engine(engine):
    assert [(r["name"], r["outer"], r["package"], r["dex"]) for r in engine.classes.collect()] == [("p/A", None, "p", True), ("shop/Basket", None, "shop", False), ("shop/Basket$Lid", "shop/Basket", "shop", False)]
    assert {r["package"]: r["n"] for r in engine.packages.collect()} == {"shop": 2, "p": 1}
    stages = sorted((r["stage"], r["message"].split(":")[0]) for r in engine.errors.collect())
    assert stages == [("archive", "cut.zip"), ("parse", "app.jar!broken.class"), ("parse", "bad.dex")]
    assert "shop/Basket#least(II)I" in {r["id"] for r in engine.methods.collect()} and "shop/Basket#RATE:I" in {r["id"] for r in engine.fields.collect()}
    one = engine.counts.first().asDict()
    assert one == {"inputs": 4, "units": 5, "classes": 3, "packages": 2, "methods": 6, "fields": 2, "errors": 3, "renames": 7, "comments": 0}


def test_lookups(engine):
    assert [engine.find_class(n).first()["name"] for n in ("shop.Basket", "shop/Basket")] == ["shop/Basket"] * 2 and engine.find_class("shop.None").isEmpty()
    assert engine.class_at(1).first()["name"] == "shop/Basket" and engine.class_at(9).isEmpty() and engine.class_at(-1).isEmpty()
    assert (engine.member_index("shop.Basket", "drain"), engine.member_index("shop/Basket", "RATE", "f"), engine.member_index("shop/Basket", "none")) == (2, 0, -1)
    details = {r["name"]: r for r in engine.class_details.collect()}
    assert details["shop/Basket"]["imports"] == ["depot.Item"] and "drain(I)I" in details["shop/Basket"]["listing"] and not details["shop/Basket"]["is_record"]
    assert engine.method_sources.filter("name = 'twice'").first()["text"].splitlines()[1] == "\treturn arg0 * 2;"


def test_pool_lines_and_nodes(engine):
    lines = {r["line"] for r in engine.pool.collect()}
    assert {"#1: Utf8 \"shop/Basket\"", "#2: Class #1"} <= lines and any(x.endswith("Integer 7") for x in lines) and any(": Methodref #" in x for x in lines)
    assert {("c", "shop/Basket"), ("f", "shop/Basket#RATE:I"), ("m", "shop/Basket#twice(I)I")} <= {tuple(r) for r in engine.nodes.collect()}


def test_json_and_renames(engine):
    one = next(x for x in (json.loads(r["json"]) for r in engine.to_json().collect()) if x["name"] == "shop.Basket")
    assert list(one) == ["name", "package", "origin", "fileName", "fields", "methods", "source"] and one["fields"] == ["RATE: int"] and "twice(I)I" in one["methods"]
    found = {r["node"]: r["alias"] for r in engine.renames().collect()}
    assert found == {"shop/Basket$Lid": "C0000Lid", "shop/Basket#RATE:I": "f0RATE", "shop/Basket$Lid#k:I": "f1k", "shop/Basket#twice(I)I": "m0twice", "shop/Basket#least(II)I": "m1least", "shop/Basket#drain(I)I": "m2drain", "shop/Basket#order()V": "m3order"}


def test_sources_take_renames_comments_and_nested_classes(engine, spark, tmp_path):
    (tmp_path / "map").write_text("# a map\nc shop/Basket = Bag\nf shop/Basket#RATE:I = PRICE\n@ c shop/Basket 0 from the map\n")
    engine.add_rename("field", "shop/Basket#RATE:I", "second").add_rename("m", "shop/Basket#drain(I)I", "emptied").add_comment("shop/Basket", "added").load_map(str(tmp_path / "map"))
    sources = {r["class_name"]: r for r in engine.sources.collect()}
    text = sources["shop/Basket"]["text"]
    assert set(sources) == {"shop/Basket", None} and sources["shop/Basket"]["file_name"] == "shop/Bag.java" and sources[None]["error"]
    assert "// from the map\n// added\npublic class Bag {" in text and "int PRICE = 7;" in text and "int emptied(" in text and "int m0twice(" in text and "\tpublic class C0000Lid {\n\t\tpublic int f1k;" in text
    quiet = Engine(spark, comment_level="none").add_bytes("app.jar", jar()).add_comment("shop/Basket", "added")
    assert "// added" not in quiet.sources.filter("error is null").first()["text"]
    assert engine.save_map(str(tmp_path / "out")) and "c shop/Basket = Bag" in next((tmp_path / "out").glob("part-*")).read_text()
    assert quiet.reset().rename_map.isEmpty() and quiet.comments.isEmpty()


def test_save_writes_files_by_package(engine, tmp_path):
    told, logged = [], []
    paths = engine.on_progress(lambda *x: told.append(x)).on_log(logged.append).save(str(tmp_path / "out")).collect()
    assert [(r["class_name"], r["path"]) for r in paths] == [("shop/Basket", str(tmp_path / "out/shop/Basket.java"))] and told == [(1, 1, "shop.Basket")] and logged == ["1 files written"]
    assert "class C0000Lid" in (tmp_path / "out/shop/Basket.java").read_text() and [p.name for p in (tmp_path / "out").rglob("*.*")] == ["Basket.java"]
    assert [percent(k, 3) for k in range(4)] == [0, 33, 66, 100] and percent(0, 0) == 100


def test_filter_and_strict_options(spark):
    e = Engine(spark, class_filter=["shop.*"]).add_bytes("app.jar", jar())
    assert e.classes.count() == 2 and e.sources.filter("error is null").count() == 1
    other = Engine(spark, class_filter=["shop.Basket"]).add_bytes("app.jar", jar()).add_bytes("a.dex", dexbuilder.build("Lp/A;", {"run": [0x000E]}))
    assert [r["name"] for r in other.classes.collect()] == ["shop/Basket"] and "Lid" not in other.sources.filter("error is null").first()["text"]
    assert Engine(spark, class_filter=["other"]).add_bytes("app.jar", jar()).classes.count() == 0
    for wrong, error in (({"threads": 3}, KeyError), ({"integer_format": "octal"}, ValueError), ({"comment_level": "loud"}, ValueError)):
        with pytest.raises(error):
            Engine(spark, **wrong)
    empty = Engine(spark)
    with pytest.raises(ValueError):
        empty.inputs
    assert empty.last_error == "no input files"
    with pytest.raises(FileNotFoundError):
        Engine(spark).add_path("/nowhere/at/all.class").inputs


def test_folders_give_class_files_alone(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/B.class").write_bytes(demo().build())
    (tmp_path / "in/A.class").write_bytes(ClassBuilder("p/A").build())
    (tmp_path / "in/app.jar").write_bytes(jar())
    (tmp_path / "one.jar").write_bytes(jar())
    assert [r["origin"].rpartition("/")[2] for r in list_files(spark, [str(tmp_path / "in")]).collect()] == ["A.class", "B.class"]
    assert {r["name"] for r in Engine(spark).add_path(str(tmp_path / "in")).classes.collect()} == {"p/A", "shop/Basket"}
    assert Engine(spark).add_path(str(tmp_path / "in")).add_path(str(tmp_path / "one.jar")).classes.count() == 4
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        Engine(spark).add_path(str(tmp_path / "none")).inputs


def test_units_as_a_data_source(spark, tmp_path):
    from bytefold.sources import datasource

    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/deep/B.class").write_bytes(demo().build())
    (tmp_path / "in/dex_without_name").write_bytes(dexbuilder.build("Lp/A;", {"run": [0x000E]}))
    (tmp_path / "in/app.jar").write_bytes(jar())
    (tmp_path / "in/notes.txt").write_text("x")
    datasource.register(spark)
    units = spark.read.format("codeunits").load(str(tmp_path / "in"))
    assert [(r["name"], r["kind"]) for r in units.select("name", "kind").collect()] == [("app.jar", "archive"), ("B.class", "class"), ("dex_without_name", "dex"), ("notes.txt", "resource")]
    assert units.filter("unit_id <> xxhash64(origin)").isEmpty()
    assert {r["name"] for r in Engine(spark).add_table(units).classes.collect()} == {"p/A", "shop/Basket", "shop/Basket$Lid"}


def test_constant_pool_by_joins(spark):
    units = spark.createDataFrame([(1, "class", demo().build())], "unit_id long, kind string, data binary")
    rows = resolve_pool(tables.const_pool(tables.parse_classes(units))).collect()
    assert ("depot/Item", "<init>", "(Ljava/lang/String;)V") in {(r["owner"], r["member"], r["descriptor"]) for r in rows}
    assert "shop/Basket" in {r["text"] for r in rows if r["tag"] == 7}


def test_option_words():
    assert [D.integer_format(x) for x in ("HEX", "Decimal", "auto", "octal")] == ["hexadecimal", "decimal", "auto", None]
    assert D.decompilation_mode("Simple") == "simple" and D.decompilation_mode("x") is None and [D.is_special_mode(m) for m in D.MODES] == [False, False, True, True]


def test_rename_maps(spark, tmp_path):
    renames = spark.createDataFrame([("m", "a/B#m()V", "zed", None), ("c", "a/B", "Name", None), ("v", "a/B#m()V", "x", 2)], "kind string, node string, alias string, slot int")
    comments = spark.createDataFrame([("c", "a/B", 3, "two words", 1), ("c", "a/B", -1, "first", 0)], "kind string, node string, line int, text string, ord long")
    assert write_map(renames, str(tmp_path / "map"), comments)
    text = next((tmp_path / "map").glob("part-*")).read_text().splitlines()
    assert text == ["c a/B = Name", "m a/B#m()V = zed", "v a/B#m()V#2 = x", "@ c a/B -1 first", "@ c a/B 3 two words"]
    back, notes = read_map(spark, str(tmp_path / "map"))
    assert sorted((r["kind"], r["node"], r["alias"], r["slot"]) for r in back.collect()) == sorted(map(tuple, [("m", "a/B#m()V", "zed", None), ("c", "a/B", "Name", None), ("v", "a/B#m()V", "x", 2)]))
    assert [(r["line"], r["text"]) for r in notes.orderBy("ord").collect()] == [(-1, "first"), (3, "two words")]
    assert not write_map(renames.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert map_lines(renames.union(renames)).count() == 3


@pytest.mark.parametrize("text, want", [
    ("<K:Ljava/lang/Object;>Ljava/lang/Object;", {"type_params": ["K"]}),
    ("<T::Ljava/lang/Comparable<TT;>;:Ljava/io/Serializable;>Ljava/lang/Object;", {"type_params": ["T extends Comparable<T> & Serializable"]}),
    ("<T:Ljava/lang/Comparable<TT;>;>(TT;TT;)TT;", {"args": ["T", "T"], "ret": "T"}),
    ("Ljava/util/AbstractList<Ljava/lang/String;>;Ljava/io/Serializable;", {"extends": "AbstractList<String>", "implements": ["Serializable"]}),
    ("([Ljava/lang/String;)V^Ljava/lang/Exception;", {"args": ["String[]"], "ret": "void", "throws": ["Exception"]}),
    ("La/Outer<TT;>.Inner<*>;", {"extends": "Outer.Inner<?>"}),
])
def test_signatures(text, want):
    found = signature.parse(text)
    assert {k: getattr(found, k) for k in want} == want


def test_field_signatures():
    assert signature.field_type("Ljava/util/Map<Ljava/lang/String;Ljava/util/List<+TE;>;>;") == "Map<String, List<? extends E>>"
    assert signature.field_type("[[I") == "int[][]"
    for bad in ("not a signature", "L;", "", "<T", "(I", "I;"):
        assert signature.parse(bad) is None and signature.field_type(bad) is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "app.jar").write_bytes(jar())
    assert cli.main([str(tmp_path / "app.jar")]) == 0
    printed = capsys.readouterr()
    assert "public class Basket {" in printed.out and "class Lid {" in printed.out and "broken.class" in printed.err
    assert cli.main([str(tmp_path / "app.jar"), "--disasm"]) == 0 and "iadd" in capsys.readouterr().out
    (tmp_path / "map").write_text("c shop/Basket = Bag\n")
    assert cli.main([str(tmp_path / "app.jar"), "--filter", "shop.*", "--renames", str(tmp_path / "map"), "--no-imports", "--no-debug-info", "--print-lines", "-v", "-o", str(tmp_path / "out")]) == 0
    told, text = capsys.readouterr().err, (tmp_path / "out/shop/Bag.java").read_text()
    assert "100 % shop.Basket" in told and "// line 21" in text and "new depot.Item(" in text and "stock" not in text
    (tmp_path / "bad.class").write_bytes(b"none")
    assert cli.main([str(tmp_path / "bad.class")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["--unknown", "x"])


JAVA = """package q; import java.util.*; import java.lang.annotation.*;
@Retention(RetentionPolicy.RUNTIME) @Target({ElementType.TYPE, ElementType.FIELD}) @interface Mark { int[] n() default {1, 2}; char c() default '\\n'; Class<?> k(); String value() default "a"; boolean b() default true; }
@Mark(k = Map.class, value = "x", b = false, n = 3)
public class Sample { int n; static final long L = 5L; enum Kind { A, B }
  int sum(int[] xs) { int s = 0; for (int x : xs) { if (x < 0) continue; s += x; } return s; }
  String pick(int k) { switch (k) { case 1: return "one"; case 2: return "two"; default: return "é" + k; } }
  double half(long v, double d) { return v > 3 && d < 1e9 ? v / 2.0 : -d; }
  void wait(Object o) throws Exception { synchronized (o) { try { o.wait(1L); } catch (InterruptedException e) { n++; } finally { n--; } } }
  Runnable run(List<String> l) { return () -> l.forEach(s -> System.out.println(s)); }
  <U> U first(List<? extends U> l) { return l.get(0); }
  int[][] grid(int a) { int[][] g = new int[a][3]; g[0][1] = a; g[1] = new int[]{1, 2}; do { a--; } while (a > 0); return g; } }
"""


@pytest.mark.skipif(not shutil.which("javac"), reason="no compiler here")
def test_compiled_classes(tmp_path):
    (tmp_path / "Sample.java").write_text(JAVA)
    subprocess.run(["javac", "-g", "-encoding", "UTF-8", "-d", str(tmp_path), str(tmp_path / "Sample.java")], check=True)
    found = sorted(tmp_path.glob("q/*.class"))
    assert len(found) == 3
    for path in found:
        c = classfile.parse(path.read_bytes())
        text = decompile.class_source(c)
        assert "// not decompiled" not in text, text
    text = decompile.class_source(classfile.parse((tmp_path / "q/Sample.class").read_bytes()))
    assert "@Mark(k = Map.class, value = \"x\", b = false, n = 3)" in text
    mark = decompile.class_source(classfile.parse((tmp_path / "q/Mark.class").read_bytes()))
    assert "@Retention(RetentionPolicy.RUNTIME)" in mark and "@Target({ElementType.TYPE, ElementType.FIELD})" in mark
    assert "default {1, 2};" in mark and "default '\\n';" in mark and "default true;" in mark and "@interface Mark" in mark
    assert "<U> U first(List<? extends U> l)" in text and "int sum(int[] xs)" in text and "while (" in text and "switch (k) {" in text and 'return "two";' in text
