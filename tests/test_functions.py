"""Column functions and plans on values of their own."""

import pytest
from pyspark.sql import functions as F

from bytefold.functions import descriptors as D
from bytefold.functions import literals as L
from bytefold.functions import names as N
from bytefold.operators import cfg, naming
from bytefold.plans.loops import closure
from bytefold.sources.units import blob_units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("", 0), ("a", 97), ("ab", 3105), ("hello", 99162322), ("Hello World", -862545276), ("\U0001F600", 1772899)])
def test_java_hash(spark, text, want):
    assert one(spark, N.java_hash(F.lit(text))) == want


@pytest.mark.parametrize("name, valid", [("a", True), ("é$1", True), ("1a", False), ("", False), ("a-b", False)])
def test_identifiers(spark, name, valid):
    assert one(spark, N.is_identifier(F.lit(name))) is valid


def test_aliases(spark):
    a, n = F.lit("a"), F.lit(0)
    assert one(spark, N.package_alias(n, a)) == "p000a"
    assert one(spark, N.class_alias(F.lit(2), F.lit("d"), F.lit("Abstract"))) == "AbstractC0002d"
    assert one(spark, N.field_alias(n, a)) == "f0a"
    assert one(spark, N.method_alias(F.lit(1), a, F.lit(True))) == "mo1a"


def test_rename_lines_round_trip(spark):
    line = N.rename_line(F.lit("v"), F.lit("a/b/C#m(I)V"), F.lit("m0a"), F.lit(2))
    assert one(spark, line) == "v a/b/C#m(I)V#2 = m0a"
    assert one(spark, N.parse_rename(line)).asDict() == {"kind": "v", "node": "a/b/C#m(I)V", "slot": 2, "alias": "m0a"}
    for bad in ("", "# note", "x a = b", "c =b", "c a="):
        assert one(spark, N.parse_rename(F.lit(bad))) is None
    assert one(spark, N.parse_comment(F.lit("@ m a/B#m()V 12 some text"))).asDict() == {"kind": "m", "node": "a/B#m()V", "line": 12, "text": "some text"}


def test_patterns(spark):
    for name, want in (("p", True), ("p.q", True), ("pq", False), ("x", True)):
        assert one(spark, N.matches_any(F.lit(name), ["p.*", "x"])) is want
    assert one(spark, N.matches_any(F.lit("any"), [])) is True


@pytest.mark.parametrize("value, want", [(7, "0x7"), (-1, "0xffffffff"), (2**31 - 1, "Integer.MAX_VALUE"), (-(2**31), "Integer.MIN_VALUE"), (0, "0x0")])
def test_int_literals(spark, value, want):
    assert one(spark, L.int_literal(F.lit(value))) == want


def test_other_literals(spark):
    assert one(spark, L.long_literal(F.lit(-1).cast("long"))) == "0xffffffffffffffffL"
    assert one(spark, L.double_literal(F.lit(1.0))) == "1.0d"
    assert one(spark, L.double_literal(F.lit(1e20))) == "1.0e20d"
    assert one(spark, L.double_literal(F.lit(0.0005))) == "0.0005d"
    assert one(spark, L.double_literal(F.lit(float("nan")))) == "Double.NaN"
    assert one(spark, L.string_literal(F.lit('a"\\\n\x01é\U0001F600'))) == '"a\\"\\\\\\n\\u0001\\u00e9\\ud83d\\ude00"'
    assert one(spark, L.string_literal(F.lit("é"), False)) == '"é"'
    assert one(spark, L.string_literal(F.lit(""))) == '""'


def test_descriptors(spark):
    d = F.lit("(I[[Ljava/util/Map;J)Lpkg/A$B;")
    assert one(spark, D.arguments(d)) == ["I", "[[Ljava/util/Map;", "J"]
    assert one(spark, D.readable(D.returned(d))) == "pkg.A.B"
    assert one(spark, D.readable(F.lit("[[I"))) == "int[][]"
    assert one(spark, D.slots(d, F.lit(True))) == 5
    assert one(spark, D.access_text(F.lit(0x40), "m")) == "bridge " and one(spark, D.access_text(F.lit(0x40), "f")) == "volatile "


def code(spark, rows):
    return spark.createDataFrame(rows, "unit long, off long, n long, op string, target long")


def test_flow_of_a_loop(spark):
    rows = code(spark, [(1, 0, 4, "fall", None), (1, 1, 4, "cond", 3), (1, 2, 4, "jump", 1), (1, 3, 4, "jump", None)])
    found = cfg.blocks(rows)
    assert sorted(map(tuple, found.select("block_id", "start_off", "end_off").collect())) == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 4)]
    links = cfg.edges(found)
    assert sorted(map(tuple, links.select("src", "dst", "ord").collect())) == [(0, 1, 1), (1, 2, 1), (1, 3, 0), (2, 1, 0)]
    for wide in (False, True):
        assert {r["node"] for r in cfg.reachable(found, links, wide=wide).collect()} == {0, 1, 2, 3}


def test_flow_with_handlers(spark):
    rows = code(spark, [(1, 0, 4, "fall", None), (1, 1, 4, "jump", None), (1, 2, 4, "fall", None), (1, 3, 4, "jump", None), (2, 0, 1, "jump", None)])
    table = spark.createDataFrame([(1, 0, 1, 2, "E", 0), (1, 0, 1, 2, None, 1), (1, 0, 2, 9, "F", 2)], "unit long, start int, end int, pc int, type string, ord int")
    found = cfg.blocks(rows, table)
    assert sorted(map(tuple, found.filter("unit = 1").select("block_id", "start_off", "end_off").collect())) == [(0, 0, 1), (1, 1, 2), (2, 2, 4)]
    entries = cfg.handler_blocks(found, table)
    assert [tuple(r) for r in entries.collect()] == [(1, 2, "finally", ["E", "any"])]
    links = cfg.edges(found)
    for wide in (False, True):
        assert {tuple(r) for r in cfg.reachable(found, links, entries, wide).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}
        assert {tuple(r) for r in cfg.reachable(found, links, None, wide).collect()} == {(1, 0), (1, 1), (2, 0)}


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, 4)], "g long, src long, dst long")
    roots = spark.createDataFrame([(0, 1)], "g long, node long")
    assert {r["node"] for r in closure(edges, roots, ["g"]).collect()} == {1, 2}


def test_numbers_go_through_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS kind")
    found = naming.number_by_kind(rows, "kind", ["id"], parts=7).collect()
    for kind in "ab":
        numbers = [r["number"] for r in sorted(found, key=lambda r: r["id"]) if r["kind"] == kind]
        assert numbers == list(range(len(numbers)))


def test_nesting_keeps_every_depth(spark):
    rows = spark.createDataFrame([("A", 0), ("A$B", 1), ("A$B$C", 2), ("X$Y", 3)], "name string, ord long")
    assert {r["name"]: r["outer"] for r in naming.link_nested(rows).collect()} == {"A": None, "A$B": "A", "A$B$C": "A$B", "X$Y": None}


def test_units_of_blobs(spark):
    units = blob_units(spark, {"a.class": b"text", "b": bytes.fromhex("CAFEBABE00"), "c.bin": b"PK\x03\x04", "d": b"dex\n035\0", "e": b""})
    assert {r["name"]: r["kind"] for r in units.collect()} == {"a.class": "class", "b": "class", "c.bin": "archive", "d": "dex", "e": "resource"}
