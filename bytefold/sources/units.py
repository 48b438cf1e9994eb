"""Code units from files and blobs: classification, the directory rule and the archive explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each kind of input.
EXTENSIONS = {"class": ("class",), "dex": ("dex", "vdex"), "archive": ("jar", "zip", "aar", "aab", "apk", "xz", "gradle")}


def kind_of_path(path: Column) -> Column:
    """The kind that a path's extension names, or null where bytes must tell."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names), F.lit(kind)).otherwise(out)
    return out


def is_dex(data: Column) -> Column:
    """`dex`, line feed, three digits, zero."""
    return F.hex(F.substring(data, 1, 8)).rlike("^6465780A3[0-9]3[0-9]3[0-9]00$")


def kind_of_bytes(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "CAFEBABE", "class").when(is_dex(data), "dex").when(head == "504B0304", "archive").otherwise("resource")


def kind_of(path: Column, data: Column) -> Column:
    return F.coalesce(kind_of_path(path), kind_of_bytes(data))


def is_folder(spark, path: str) -> bool:
    """Whether a path is a folder; one that is not there is an error. Asked of the file system that the path names."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(jvm)
    if not found:
        raise FileNotFoundError(path)
    return all(x.isDirectory() for x in found)


def _files(spark, paths: list[str]):
    """The files that `paths` name: of folders those named *.class, at any depth; files as they are."""
    folders, named = [], []
    for path in paths:
        (folders if is_folder(spark, path) else named).append(path)
    parts = []
    if folders:
        parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.class").load(folders).withColumn("in_folder", F.lit(True)))
    if named:
        parts.append(spark.read.format("binaryFile").load(named).withColumn("in_folder", F.lit(False)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def list_files(spark, paths: list[str]):
    """origin, size of the files that `paths` name, by path; nothing is read."""
    return _files(spark, paths).select(F.col("path").alias("origin"), F.col("length").alias("size")).orderBy("origin")


def read_units(spark, paths: list[str]):
    """unit_id, origin, name, kind, data of files: `.class` files of folders, at any depth, and files named outright.

    Files in folders are classes whatever they hold; of others the extension tells, then the first bytes. A path that is
    not there, and folders without any class file, are errors. Rows come in no order: list_files() has them by path.
    """
    rows = _files(spark, paths)
    if rows.select("path").isEmpty():
        raise ValueError("no input files")
    kind = F.when(F.col("in_folder"), F.lit("class")).otherwise(kind_of(F.col("path"), F.col("content")))
    return rows.select(F.xxhash64("path").alias("unit_id"), F.col("path").alias("origin"), F.substring_index("path", "/", -1).alias("name"), kind.alias("kind"), F.col("content").alias("data"))


def blob_units(spark, blobs: dict[str, bytes]):
    """The same for named blobs: extensions first, magic numbers where they tell nothing."""
    rows = spark.createDataFrame(list(blobs.items()), "name string, data binary")
    return rows.select(F.xxhash64("name").alias("unit_id"), F.col("name").alias("origin"), "name", kind_of(F.col("name"), F.col("data")).alias("kind"), "data")
