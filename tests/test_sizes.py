"""What queries over large tables must not do: tables that one driver or one task has to hold, passes that repeat."""

from pathlib import Path

from bytefold.catalogue import QUERIES as FIRST
from bytefold.catalogue import _class_of_part
from bytefold.catalogue_tables import QUERIES as SECOND
from bytefold.catalogue_tables import _attributed
from bytefold.engine import Engine, resolve_pool
from bytefold.llm import common, repeats
from bytefold.plans import attributes, tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pools_are_resolved_where_they_are(spark, sf):
    plan = plan_of(FIRST["const_pool_resolve"](spark, sf))
    assert "Join" not in plan and "repartition" in plan.lower()
    assert "Join" not in plan_of(resolve_pool(tables.const_pool(tables.parse_classes(spark.createDataFrame([], "unit_id long, kind string, data binary")))))


def test_a_unit_that_comes_twice_has_each_constant_twice(spark):
    data = _class_of_part(7, "a name", 3)
    units = spark.createDataFrame([(1, "class", data), (1, "class", data), (2, "class", data[:30]), (3, "class", data)], "unit_id long, kind string, data binary")
    rows = sorted((r["unit_id"], r["tag"], r["text"]) for r in tables.resolved_pool(units).collect())
    one = [(7, "java/lang/Exception"), (7, "java/lang/Object"), (7, "pkg/P7"), (8, "a name")]
    assert rows == sorted([(u, *x) for u in (1, 1, 3) for x in one])
    flat = tables.const_pool(tables.parse_classes(units.filter("unit_id = 1")))
    assert sorted((r["tag"], r["text"]) for r in resolve_pool(flat).distinct().collect()) == one


def test_bootstrap_methods_are_read_once(spark, sf):
    plan = plan_of(SECOND["bootstrap_methods"](spark, sf))
    assert "Join" not in plan and plan.count("MapInArrow") == 2  # the files are assembled, and read


def test_bootstrap_arguments(spark):
    data = _attributed(4, "a name", 300)
    units = spark.createDataFrame([(1, "class", data), (1, "class", data), (2, "class", data[:90])], "unit_id long, kind string, data binary")
    rows = [(r["unit_id"], r["ord"], r["kind"], [(a["tag"], a["text"]) for a in r["args"]]) for r in attributes.bootstraps(units).collect()]
    assert rows == [(1, 0, 6, [(8, "a name"), (3, "300")])] * 2


def test_files_do_not_meet_on_the_driver(spark, sf):
    for name in ("facade_filter", "facade_sources"):
        plan = plan_of(SECOND[name](spark, sf))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_sources_read_heads_only(spark):
    data = [(1, _class_of_part(1, "a", 3)), (2, _class_of_part(2, "b", 4)), (3, _class_of_part(2, "c", 5)), (4, b"no class"), (5, None)]
    units = spark.createDataFrame([(k, str(k), str(k), "class", d) for k, d in data], "unit_id long, origin string, name string, kind string, data binary")
    engine = Engine(spark, class_filter=["pkg.P2"]).add_table(units)
    rows = {r["unit_id"]: (r["class_name"], r["error"] is not None) for r in engine.sources.collect()}
    assert rows == {2: ("pkg/P2", False), 3: ("pkg/P2", False), 4: (None, True), 5: (None, True)}
    assert engine._parsed is None  # members, code and listings are not made for a list of files
    assert engine.add_table(units.filter("unit_id = 1")).sources.count() == 4 and engine._heads is not None


def shuffled_bytes(spark) -> int:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*"))


def test_repeats_drop_the_shuffles_of_their_first_round(spark, monkeypatch):
    monkeypatch.setattr(repeats, "release", lambda spark: None, raising=False)  # whatever a collection of garbage finds
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), i -> sha2(concat(id, '-', i), 256))) AS text")
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.dedup(docs)
        assert shuffled_bytes(spark) - before < 2_000_000  # the texts are 8 MB; later rounds run when rows are asked for
        assert found.filter("n_words <> 300 or n_removed <> 0").isEmpty() and found.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.conf.get(common.CLEANUP) == "false"
