"""Queries over whole tables and whole texts, against brute force on small fixtures."""

import pytest

import bytefold.catalogue as catalogue


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, ddl):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def found(spark, name, sf_dir):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, sf_dir).collect()]


def test_graph_queries_take_every_supplier(spark, folder):
    suppliers = [(k, k * 7 % 25) for k in [*range(0, 130, 3), 400, 401, 1003]]
    sf_dir = folder("supplier", suppliers, "s_suppkey long, s_nationkey long")
    edges = {k: (k * 3 + n) % 97 for k, n in suppliers}
    reach = set()
    for root in edges:
        node = root
        while (root, node) not in reach:
            reach.add((root, node))
            node = edges.get(node, node)
    assert sorted(found(spark, "reachability", sf_dir)) == sorted(reach)
    body = set()
    for latch, header in edges.items():
        if header <= latch:
            body.add((header, header))
            ahead = [latch]
            while ahead:
                node = ahead.pop()
                if (header, node) not in body:
                    body.add((header, node))
                    ahead += [s for s, d in edges.items() if d == node]
    assert sorted(found(spark, "loop_body", sf_dir)) == sorted(body)
    assert max(h for h, _ in reach) == 1003 and max(n for _, n in body) == 1003


def test_literals_hold_texts(spark, folder):
    text = "ab\"\\ é\n" * 300 + "\tend\u20ac"
    sf_dir = folder("conversations", [(1, 0, "user", text)], "conv_id long, turn long, role string, text string")
    code = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"}
    want = "".join(code.get(c, c if ord(c) < 127 else f"\\u{ord(c):04x}") for c in text + '\t"\\\né')
    assert found(spark, "string_literal_escape", sf_dir) == [(1, 0, f'"{want}"')]


def test_comments_are_attached(spark, folder):
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "x" * 50), (1, 2, "assistant", "a comment of more than twenty characters"), (2, 0, "system", "alone")]
    sf_dir = folder("conversations", rows, "conv_id long, turn long, role string, text string")
    assert sorted(found(spark, "comment_attach", sf_dir)) == [(1, f"{'x' * 50}|a comment of more than twenty characters", 2), (2, "", 0)]


def test_listings_and_sources_hold_every_method(spark, folder):
    sf_dir = folder("part", [(1, "odd part", 9), (2, "even part", 10)], "p_partkey long, p_name string, p_size long")
    listings = {(u, n): t for u, _, n, t in found(spark, "disasm_text", sf_dir)}
    assert set(listings) == {(u, n) for u in (1, 2) for n in ("grow", "clip", "same")}
    assert listings[1, "clip"].endswith("catch java/lang/Exception 0..9 -> 11") and "if_icmple" in listings[2, "clip"]
    for unit, _, text in found(spark, "decompile_source", sf_dir):
        assert "int clip(int arg0)" in text and ("catch (Exception caught)" in text) == (unit == 1) and text.endswith("\n}\n")
