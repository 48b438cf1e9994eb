"""Rename maps as text: renames sorted line by line, comments behind them in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N


def read_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(renames: kind, node, slot, alias, ord; comments: kind, node, line, text, ord). Blank lines, # lines and lines that are neither are passed over.

    A map is one text file, read whole, so `ord` is its line number (a folder's files each begin at 0).
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).select(F.trim("line").alias("line"), F.col("ord").cast("long"))
    lines = lines.filter("line <> '' and not startswith(line, '#')")
    comments = lines.filter("startswith(line, '@')").select(N.parse_comment(F.col("line")).alias("c"), "ord").filter("c is not null")
    renames = lines.filter("not startswith(line, '@')").select(N.parse_rename(F.col("line")).alias("r"), "ord").filter("r is not null")
    return renames.select("r.*", "ord"), comments.select("c.*", "ord")


def map_lines(renames: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """part (0 renames, 1 comments), ord, line; in that order they are the file. Equal renames stand once."""
    slot = F.col("slot") if "slot" in renames.columns else None
    first = renames.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), N.rename_line(F.col("kind"), F.col("node"), F.col("alias"), slot).alias("line")).distinct()
    if comments is None:
        return first
    return first.unionByName(comments.select(F.lit(1).alias("part"), F.col("ord").cast("long"), N.comment_line(F.col("kind"), F.col("node"), F.col("line"), F.col("text")).alias("line")))


def write_map(renames: DataFrame, path: str, comments: DataFrame | None = None) -> bool:
    """Write the map as one text file under `path`; an empty map writes nothing and returns False."""
    lines = map_lines(renames, comments)
    if lines.isEmpty():
        return False
    lines.orderBy("part", "ord", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
    return True
