"""The pipeline's stages against brute force, each on what the one before kept."""

import brute
import corpus_pipeline as pipeline
import pytest
from test_operators import corpus, jaccard_want

from bytefold.llm import mixing, packing

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    made = [(d, t, "en", f"s{d % 3}", len(t)) for d, t in corpus(11)]
    made += [(3000 + i, f"some words here password = secretsecret{i} and more of them {i} " * 3, "fr", None, None) for i in range(6)]
    return made + [(None, "no id", None, "s1", 5), (4000, None, None, None, None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_stages_are_named():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and pipeline.ORACLE_SQL is None


def test_toxicity_stage(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    left = pipeline.toxicity_filter(spark, table, sf)
    assert left.columns == table.columns and left.count() >= 0.8 * table.count()
    assert left.join(table, table.columns, "left_semi").count() == left.count()


def test_near_duplicates_stage(spark, rows):
    want, _ = jaccard_want([(r[0], r[1]) for r in rows if r[0] is not None], 80, 5)
    keep = {d for d, (n, c) in want.items() if n == 0 or c == d}
    left = pipeline.near_duplicates(spark, docs(spark, rows + rows[5:8]), None).collect()
    assert {r["doc_id"] for r in left} == keep | {None}
    worded = [r["doc_id"] for r in left if r["doc_id"] is not None and brute.words(r["text"])]
    assert len(worded) == len(set(worded))


def test_near_duplicates_go_by_text_not_by_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in ("a", "b", "c"))
    rows = [(1, one, "en", "s", 1), (2, one + " end", "en", "s", 2), (2, two, "en", "s", 3), (3, three, "en", "s", 4), (3, two, "en", "s", 5), (3, three, "en", "s", 4)]
    left = pipeline.near_duplicates(spark, docs(spark, rows + [(4, three + " end", "en", "s", 6), (4, "", "en", "s", 0)]), None).collect()
    assert sorted(tuple(r) for r in left) == sorted([(1, one, "en", "s", 1), (2, two, "en", "s", 3), (3, three, "en", "s", 4), (4, "", "en", "s", 0)])


def test_secrets_stage(spark, rows):
    left = pipeline.secret_redaction(spark, docs(spark, rows), None).collect()
    assert len(left) == len(rows)
    for r in left:
        assert sum(brute.secrets(r["text"])[:3]) == 0
    masked = [r for r in left if r["text"] and "[SECRET]" in r["text"]]
    assert {r["doc_id"] for r in masked} == set(range(3000, 3006)) and all(r["n_chars"] == len(r["text"]) for r in masked)
    clean = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 3000}
    assert all(r["text"] == clean[r["doc_id"]] for r in left if r["doc_id"] in clean)


def test_mixing_stage(spark, rows):
    twice = rows + rows[:4]
    out = pipeline.source_mix(spark, docs(spark, twice), None).collect()
    plan = mixing.mix(docs(spark, twice)).collect()
    want = {}
    for r in plan:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + (r["copies"] if r["size"] else 1)
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in want.items() if n}


def test_packing_stage(spark, rows):
    out = pipeline.packed_sequences(spark, docs(spark, rows), None).collect()
    assert sum(r["length"] for r in out) == sum(len(packing.public_ids(r[1])) for r in rows)


def test_run_over_nothing_and_all(spark, sf):
    empty = docs(spark, [])
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf) if stage is not pipeline.toxicity_filter else empty
    assert empty.count() == 0
    assert set(pipeline.run(spark, sf).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
