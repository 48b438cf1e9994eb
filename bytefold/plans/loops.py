"""Iteration to a fixpoint over DataFrames: lineage is cut in the cluster's shared folder each round."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names. A local session without one (tests) gets a
    temporary one; a cluster without one is an error, since its executors share no temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "bytefold-checkpoints"))
    return df.checkpoint(eager=True)


def closure(edges: DataFrame, roots: DataFrame, keys: list[str], most_rounds: int = 10_000, stop: str | None = None) -> DataFrame:
    """Rows (keys..., node) reached from `roots` (keys..., node) over `edges` (keys..., src, dst), roots included.

    Keys that `edges` does not have share all of them. Rows for which `stop` holds are reached and not left again. Each
    round joins only the newest rows, so work is in proportion to the edges reached.
    """
    on = [*(k for k in keys if k in edges.columns), "node"]
    edges = cut(edges.withColumnRenamed("src", "node").distinct())
    fresh = cut(roots.distinct())
    seen = fresh
    for _ in range(most_rounds):
        going = fresh.filter(f"not ({stop})") if stop else fresh
        ahead = going.join(edges, on).select(*keys, F.col("dst").alias("node")).distinct()
        fresh = cut(ahead.join(seen, [*keys, "node"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
    raise RuntimeError("closure did not settle")
