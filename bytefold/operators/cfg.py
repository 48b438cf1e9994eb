"""Control-flow graphs as plans over instruction rows: unit, off, n (instructions of the unit), op, target.

op is `fall` (goes on), `cond` (may jump to target) or `jump` (does; without a target it ends the unit). All steps
are windows and equi-joins by unit, so units spread over the cluster and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.loops import closure


def _goals(code: DataFrame, handlers: DataFrame | None) -> DataFrame:
    """`code` with `goals`, the offsets of its unit that a jump or the exception table names. A unit is a method, whose code
    is at most 64 KiB, so they fit a row."""
    unit = Window.partitionBy("unit")
    goals = F.collect_set("target").over(unit)
    if handlers is None:
        return code.withColumn("goals", goals)
    bounds = handlers.groupBy("unit").agg(F.flatten(F.collect_list(F.array("start", "end", "pc"))).alias("bounds"))
    marked = code.withColumn("goals", goals).join(bounds, "unit", "left")
    return marked.withColumn("goals", F.array_union("goals", F.transform(F.coalesce("bounds", F.array()), lambda x: x.cast("long")))).drop("bounds")


def _leads(code: DataFrame, handlers: DataFrame | None) -> DataFrame:
    """`code` with `leads`: whether a block begins there, which is at the first instruction, at goals, and behind a branch.

    One exchange by unit serves this and all windows over units.
    """
    before = F.lag("op").over(Window.partitionBy("unit").orderBy("off"))
    leads = before.isNull() | before.isin("cond", "jump") | F.array_contains("goals", F.col("off"))
    return _goals(code, handlers).withColumn("leads", leads).drop("goals")


def leaders(code: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """(unit, off) where a block begins. `handlers` (unit, start, end, pc, type, ord) is the exception table."""
    return _leads(code, handlers).filter("leads").select("unit", "off")


def numbered(code: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """The instructions with block_id, the running count of leaders from 0."""
    line = Window.partitionBy("unit").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    return _leads(code, handlers).withColumn("block_id", (F.sum(F.col("leads").cast("int")).over(line) - 1).cast("long")).drop("leads")


def blocks(code: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """unit, block_id, start_off, end_off (the next block's start, or the unit's end), last_op, last_target."""
    inside = numbered(code, handlers).groupBy("unit", "block_id").agg(F.min("off").alias("start_off"), F.max(F.struct("off", "op", "target")).alias("last"), F.max("n").alias("n"))
    following = F.lead("start_off").over(Window.partitionBy("unit").orderBy("block_id"))
    return inside.select("unit", "block_id", "start_off", F.coalesce(following, "n").alias("end_off"), F.col("last.op").alias("last_op"), F.col("last.target").alias("last_target"))


def handler_blocks(found: DataFrame, handlers: DataFrame) -> DataFrame:
    """unit, block_id, kind, catch_types of the blocks() where a handler begins.

    The last row of the table that names a block says what it is: `finally` without a type, else `catch`. catch_types has
    each type once (`any` for none), first seen first. Rows whose handler begins in no block are passed over.
    """
    starts = found.select("unit", F.col("start_off").alias("pc"), "block_id")
    kind = F.coalesce("type", F.lit("any"))
    once = handlers.groupBy("unit", F.col("pc").cast("long").alias("pc"), kind.alias("type")).agg(F.min("ord").alias("ord"), F.max("ord").alias("last"))
    per = once.groupBy("unit", "pc").agg(F.sort_array(F.collect_list(F.struct("ord", "type"))).alias("t"), F.max_by("type", "last").alias("last"))
    return per.join(starts, ["unit", "pc"]).select("unit", "block_id", F.when(F.col("last") == "any", "finally").otherwise("catch").alias("kind"), F.col("t.type").alias("catch_types"))


def edges(found: DataFrame) -> DataFrame:
    """unit, src, dst, ord of blocks(): the taken branch first, then the fall-through; an edge that comes twice stands once.

    Block ids count the starts of a unit in order, so a goal's place among them is its block; no exchange but that by unit.
    """
    starts = F.sort_array(F.collect_list("start_off").over(Window.partitionBy("unit")))
    taken = F.when(F.col("last_op").isin("cond", "jump") & F.col("last_target").isNotNull(), F.struct(F.lit(0).alias("ord"), F.col("last_target").alias("at")))
    falls = F.when(F.col("last_op") != "jump", F.struct(F.lit(1).alias("ord"), F.col("end_off").alias("at")))
    ways = found.withColumn("starts", starts).select("unit", F.col("block_id").alias("src"), "starts", F.explode(F.array_compact(F.array(taken, falls))).alias("way"))
    met = ways.select("unit", "src", (F.array_position("starts", F.col("way.at")) - 1).alias("dst"), "way.ord").filter("dst >= 0")
    return met.groupBy("unit", "src", "dst").agg(F.min("ord").alias("ord"))


def predecessors(links: DataFrame) -> DataFrame:
    return links.groupBy("unit", "dst").agg(F.sort_array(F.collect_set("src")).alias("preds"), (F.min("ord") == 0).alias("jump_target"))


def reachable(found: DataFrame, links: DataFrame, entries: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """(unit, node) reached over `links` from block 0 of every unit of blocks(), and from `entries` (unit, block_id), its
    handlers' blocks.

    A unit is a method, whose code is at most 64 KiB, so its edges fit a row: one shuffle, then a search per row. For
    units of any size, `wide` spreads each over the cluster and goes on round by round.
    """
    roots = found.filter("block_id = 0").select("unit", F.col("block_id").alias("node"))
    if entries is not None:
        roots = roots.unionByName(entries.select("unit", F.col("block_id").alias("node")))
    if wide:
        return closure(links.select("unit", "src", "dst"), roots, ["unit"])
    both = links.select("unit", "src", "dst").unionByName(roots.select("unit", F.lit(None).cast("long").alias("src"), F.col("node").alias("dst")))
    # a root is an edge from nowhere
    rows = both.groupBy("unit").agg(F.collect_list(F.coalesce("src", F.lit(-1))).alias("src"), F.collect_list("dst").alias("dst"))
    kind = links.schema["unit"].dataType.simpleString()
    return rows.mapInArrow(_search, f"unit {kind}, nodes array<long>").select("unit", F.explode("nodes").alias("node"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = []
        for src, dst in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            after: dict[int, list[int]] = {}
            for a, b in zip(src, dst):
                after.setdefault(a, []).append(b)
            seen, todo = set(), [-1]
            while todo:
                fresh = [b for b in after.get(todo.pop(), ()) if b not in seen]
                seen.update(fresh)
                todo += fresh
            nodes.append(list(seen))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.list_(pa.int64()))], ["unit", "nodes"])


def merge_handlers(rows: DataFrame) -> DataFrame:
    """unit, start, end, handlers: rows (unit, start, end, pc, type, ord) merged by range, each (pc, type) once, first seen first."""
    once = rows.groupBy("unit", "start", "end", "pc", "type").agg(F.min("ord").alias("ord"))
    return once.groupBy("unit", "start", "end").agg(F.sort_array(F.collect_list(F.struct("ord", "pc", "type"))).alias("handlers"))


def leaving(links: DataFrame, region: DataFrame, exits: DataFrame) -> DataFrame:
    """Edges that spoil a region: from inside to a block that is neither in it nor an exit."""
    inside = links.join(region.select("unit", F.col("block_id").alias("src")), ["unit", "src"], "left_semi")
    allowed = region.select("unit", "block_id").unionByName(exits.select("unit", "block_id")).withColumnRenamed("block_id", "dst")
    return inside.join(allowed, ["unit", "dst"], "left_anti")


def held_blocks(found: DataFrame, tries: DataFrame) -> DataFrame:
    """unit, block_id, first, last: the first range of `tries` (unit, first, last) that holds a whole block of blocks().

    Ranges of a unit are few and fit a row, so a unit is one row on that side and blocks spread as they are.
    """
    ranges = tries.groupBy("unit").agg(F.array_sort(F.collect_set(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))).alias("ranges"))
    fits = F.filter("ranges", lambda r: (r["first"] <= F.col("start_off")) & (F.col("end_off") <= r["last"]))
    return found.join(ranges, "unit").withColumn("t", F.try_element_at(fits, F.lit(1))).filter("t is not null").select("unit", "block_id", "t.first", "t.last")


def at_starts(found: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """blocks() with the first of `rows` (unit, `at`, ord, ...) that stands at their start: line numbers, or frames."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("unit", at).orderBy("ord"))).filter("__n = 1").drop("__n", "ord")
    return found.join(first.withColumnRenamed(at, "start_off"), ["unit", "start_off"], "left")


def next_live(order: DataFrame, consumed: DataFrame) -> DataFrame:
    """unit, block_id, next_live: behind each block of an order (unit, block_id, pos), the first block that `consumed`
    (unit, block_id) does not hold."""
    gone = consumed.select("unit", "block_id").distinct().withColumn("gone", F.lit(True))
    marked = order.join(gone, ["unit", "block_id"], "left")
    ahead = Window.partitionBy("unit").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return marked.select("unit", "block_id", F.first(F.when(F.col("gone").isNull(), F.col("block_id")), ignorenulls=True).over(ahead).alias("next_live"))


def slot_uses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., writes, read_first of rows (keys..., off, store): how often a slot is written, and whether it is read before."""
    used = rows.groupBy(*keys).agg(F.count_if("store").alias("writes"), F.min(F.when(F.col("store"), F.col("off"))).alias("w"), F.min(F.when(~F.col("store"), F.col("off"))).alias("r"))
    return used.select(*keys, "writes", F.coalesce(F.col("r") < F.col("w"), F.col("writes") == 0).alias("read_first"))


def name_uses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., reads, writes of rows (keys..., write: boolean, times)."""
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("write"), 0).otherwise(F.col("times"))).alias("reads"), F.sum(F.when(F.col("write"), F.col("times")).otherwise(0)).alias("writes"))
