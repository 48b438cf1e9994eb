"""What the operators share: reading tables, checkpoints in the cluster's shared folder, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

FEW = 1 << 17  # edges that one task joins: some tens of MB of its Python
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like `names` that no column of `df` has, whatever its case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names. A local session without one (tests) gets a temporary
    one; a cluster without one is an error, since its executors share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "bytefold-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, where it outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """cut(), whose shuffle files go as soon as its rows are in the shared folder. Spark keeps those of its last execution
    reachable, so that release() does not find them."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return cut(df.select("*"))  # a frame holds the setting that it was made under
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that nothing refers to any more. It finds them when the heaps of the driver's Python
    and JVM are collected, which a driver that only plans does too rarely for the disks of its executors."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows u, v of all edges -> node and the smallest node it reaches, by union-find."""
    parts = list(batches)
    if not sum(map(len, parts)):
        return
    u, v = (np.concatenate([part.column(k).to_numpy(zero_copy_only=False) for part in parts]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    least = nodes[[root(i) for i in range(len(nodes))]]
    kind = parts[0].schema.types[0]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(least, kind)], ["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst): component is the smallest node it reaches.

    Up to `few` distinct edges are joined by one task. More go through alternating large-star and small-star rounds, each
    an aggregate and a join, so that neither the driver nor one task holds a component; a round runs every shuffle partition
    several times, and each of these tasks costs the driver memory, however few its rows. Self-loops and repeated edges do
    no harm; nulls must be filtered before.
    """
    edges = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    if not now[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if now[0] <= few:
        kind = edges.schema["u"].dataType
        return edges.coalesce(1).mapInArrow(_joined, StructType([StructField("node", kind), StructField("component", kind)]))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        was, now = now, state(edges)
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return roots.unionByName(edges.select(F.col("v").alias("node")).distinct().join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
