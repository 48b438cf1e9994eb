"""Files as they arrive, through the same stateless kernels. An extension: the tables are those of a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.units import kind_of

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_units(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """unit_id, origin, name, kind, data of the files that come into a folder, each once; any kernel of plans.tables takes them."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.xxhash64("path").alias("unit_id"), F.col("path").alias("origin"), F.substring_index("path", "/", -1).alias("name"), kind_of(F.col("path"), F.col("content")).alias("kind"), F.col("content").alias("data"))
