"""Code units as a data source of their own: register() makes `spark.read.format("codeunits").load(path)` give them.

Other inputs plug in the same way, or as any table of unit_id, origin, name, kind, data.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .units import EXTENSIONS

SCHEMA = "unit_id long, origin string, name string, kind string, data binary"
FILES = 256  # of a partition


def kind_of_file(name: str, head: bytes) -> str:
    """units.kind_of() of one file: its extension, or its first eight bytes."""
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    for kind, known in EXTENSIONS.items():
        if ext in known:
            return kind
    if head[:4] == b"\xca\xfe\xba\xbe":
        return "class"
    if len(head) == 8 and head[:4] == b"dex\n" and head[4:7].isdigit() and not head[7]:
        return "dex"
    return "archive" if head[:4] == b"PK\x03\x04" else "resource"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class UnitReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        import os

        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), os.path.abspath(self.path))

    def partitions(self) -> list[Files]:
        """The files of a folder, at any depth, or one file; by path."""
        from pyarrow import fs

        store, root = self._store()
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        paths = sorted(x.path for x in found)
        return [Files(paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        import xxhash

        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            key = xxhash.xxh64(path.encode(), seed=42).intdigest()  # as xxhash64() of a column
            yield key - (1 << 64) if key >> 63 else key, path, path.rpartition("/")[2], kind_of_file(path, data[:8]), data


class CodeUnits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codeunits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> UnitReader:
        return UnitReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeUnits)
