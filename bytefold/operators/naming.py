"""Renames, aliases, nesting and comments as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import cut


def first_wins(renames: DataFrame, order: str = "ord") -> DataFrame:
    """Of the renames of a node (kind, node) the first stays."""
    return renames.withColumn("__n", F.row_number().over(Window.partitionBy("kind", "node").orderBy(order, "alias"))).filter("__n = 1").drop("__n")


def apply_renames(declared: DataFrame, renames: DataFrame) -> DataFrame:
    """`declared` (kind, node, name, ...) with the alias of its node, or its name."""
    return declared.join(renames.select("kind", "node", "alias"), ["kind", "node"], "left").withColumn("alias", F.coalesce("alias", "name"))


def number_by_kind(members: DataFrame, kind: str, order: list[str], parts: int = 64) -> DataFrame:
    """`number`: 0, 1, 2, ... per kind in `order`, without gathering a kind in one task.

    Rows are cut into ranges of kind and order; a range's numbers start where the ranges before it end.
    """
    keys = [F.col(kind), *[F.col(c) for c in order]]
    ranged = cut(members.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))  # ranges are drawn once
    local = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part", kind).orderBy(*order)))
    sizes = ranged.groupBy(kind, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    line = Window.partitionBy(kind).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__rows").over(line), F.lit(0))).drop("__rows")
    return local.join(starts, [kind, "__part"]).withColumn("number", (F.col("__start") + F.col("__at") - 1).cast("long")).drop("__part", "__at", "__start")


def link_nested(classes: DataFrame) -> DataFrame:
    """name, ord -> name, outer: the class whose name stands before the last `$`, null if there is none (or itself)."""
    outer = classes.groupBy("name").agg(F.min("ord").alias("o")).select(F.col("name").alias("outer"))
    asked = classes.withColumn("stem", F.when(F.instr("name", "$") > 0, F.regexp_replace("name", r"\$[^$]*$", "")))
    return asked.join(outer, asked["stem"] == outer["outer"], "left").select("name", "ord", "outer")


def attach_comments(nodes: DataFrame, comments: DataFrame) -> DataFrame:
    """`nodes` (kind, node, ...) with `comments`, the texts of theirs in order, null if none."""
    listed = comments.groupBy("kind", "node").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("__c"))
    return nodes.join(listed, ["kind", "node"], "left").withColumn("comments", F.col("__c.text")).drop("__c")


def uniquify(names: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`unique`: the k-th of equal names of a group becomes name$k, the first keeps its name; a number whose name another
    row has already is passed over. Names of a group that stand under one stem fit a row."""
    k = F.row_number().over(Window.partitionBy(group, "name").orderBy(*order)) - 1
    stem = F.regexp_extract("name", r"^(.*?)(\$\d+)*$", 1)  # names that can meet share it
    counted = names.withColumn("__k", k).withColumn("__stem", stem)
    taken = F.collect_set("name").over(Window.partitionBy(group, "__stem"))
    # the k-th free number: of 1 to k + (names taken), those whose name is free, the k-th
    free = F.filter(F.sequence(F.lit(1), F.col("__k") + F.size("__taken")), lambda n: ~F.array_contains("__taken", F.concat("name", F.lit("$"), n.cast("string"))))
    made = F.concat("name", F.lit("$"), F.get(free, F.col("__k").cast("int") - 1).cast("string"))
    return counted.withColumn("__taken", taken).withColumn("unique", F.when(F.col("__k") > 0, made).otherwise(F.col("name"))).drop("__k", "__stem", "__taken")


def merge_renames(loaded: DataFrame, present: DataFrame) -> DataFrame:
    """kind, node, alias, ord of two maps: loaded ones come first, and of a node the first stays."""
    both = loaded.withColumn("__part", F.lit(0)).unionByName(present.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    line = Window.partitionBy("kind", "node").orderBy("__part", "ord", "alias")
    return both.withColumn("__n", F.row_number().over(line)).filter("__n = 1").drop("__n", "__part")


def outermost(classes: DataFrame) -> DataFrame:
    """name, top of `classes` (name): the class in whose file each is printed, which is as far out as the names before its
    `$` are classes without a gap."""
    names = classes.select("name").distinct()
    parts = F.size(F.split("name", r"\$"))
    each = names.select("name", F.explode(F.sequence(F.lit(1), parts)).alias("n")).withColumn("prefix", F.expr("substring_index(name, '$', n)"))
    there = each.join(names.select(F.col("name").alias("prefix")).hint("merge"), "prefix", "left_semi").groupBy("name").agg(F.collect_set("n").alias("have"))
    begin = F.array_max(F.filter("have", lambda n: ~F.array_contains("have", n - 1)))
    return there.withColumn("n", begin).select("name", F.expr("substring_index(name, '$', n)").alias("top"))


def subpackages(packages: DataFrame) -> DataFrame:
    """parent, child: the distinct first segments below the first of `package`, by dots or slashes, in order."""
    parts = F.split(F.translate("package", "/", "."), r"\.")
    return packages.filter(F.size(parts) > 1).select(parts[0].alias("parent"), parts[1].alias("child")).distinct().orderBy("parent", "child")


def kth(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The row at place `k` (from 0) of each group, by `order`; a group with fewer has none."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).filter(F.col("__n") == k).drop("__n")
