"""File inventory: a batch data source that lists on the executors.

Built-in ``binaryFile`` drops zero-byte files, and an empty stream must be seen.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import file_name
from ..schemas import RAW_CHANGES

# Ship this module with the tasks, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COLUMNS = "path STRING, size BIGINT, modified_at TIMESTAMP"
_BATCH_ROWS = 8192


def open_filesystem(path: str):
    """File system and plain path of a local path or URI."""
    from pyarrow import fs

    if _is_remote(path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class _Folder(InputPartition):
    """A folder to list: with all below it or not, and which share of its files."""

    def __init__(self, path: str, recursive: bool, share: int, shares: int):
        self.path = path
        self.recursive = recursive
        self.share = share
        self.shares = shares


def _is_remote(path: str) -> bool:
    return "://" in path or path.startswith("file:")


def _entries(path: str, remote_root: str | None, wanted) -> Iterator:
    """(path, is_folder, size, time) of what lies in a folder.

    Of a mounted folder, names come first and only ``wanted`` files are looked
    up; an object store returns the sizes with the listing.
    """
    if remote_root is None:
        with os.scandir(path) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.path, True, 0, 0
                elif wanted(entry.path) and entry.is_file():
                    about = entry.stat()
                    yield entry.path, False, about.st_size, about.st_mtime_ns // 1000
    else:
        from pyarrow import fs

        system, _ = open_filesystem(remote_root)
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.Directory:
                yield info.path, True, 0, 0
            elif wanted(info.path):
                yield info.path, False, info.size, (info.mtime_ns or 0) // 1000


class _InventoryReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, shares: int):
        self.remote_root = root if _is_remote(root) else None
        self.root = open_filesystem(root)[1]
        self.suffix = suffix
        self.shares = 1 if self.remote_root else shares

    def partitions(self) -> list[InputPartition]:
        """The root itself, and each of its sub-directories with all below it.

        A folder may hold most of the files, so each is listed in several
        shares: all read the names, each looks up the files that hash to it.
        """
        nothing = _entries(self.root, self.remote_root, lambda path: False)
        below = sorted(path for path, is_folder, _, _ in nothing if is_folder)
        folders = [(self.root, False), *[(path, True) for path in below]]
        return [
            _Folder(path, recursive, share, self.shares)
            for path, recursive in folders
            for share in range(self.shares)
        ]

    def read(self, partition: _Folder) -> Iterator:
        import pyarrow as pa

        schema = pa.schema(
            [("path", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC"))]
        )

        def wanted(path: str) -> bool:
            return path.endswith(self.suffix) and (
                zlib.crc32(path.encode()) % partition.shares == partition.share
            )

        folders, found = [partition.path], []
        while folders:
            for path, is_folder, size, micros in _entries(folders.pop(), self.remote_root, wanted):
                if not is_folder:
                    found.append((path, size, micros))
                elif partition.recursive:
                    folders.append(path)
                if len(found) == _BATCH_ROWS:
                    yield _batch(found, schema)
                    found = []
        if found:
            yield _batch(found, schema)


def _batch(found: list, schema):
    import pyarrow as pa

    columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*found), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class FileInventory(DataSource):
    """``spark.read.format("file_inventory").option("path", dir)``."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _InventoryReader(
            self.options["path"],
            self.options.get("suffix", ""),
            int(self.options.get("shares", "4")),
        )


def file_inventory(spark: SparkSession, directory: str, suffix: str = ".mp4") -> DataFrame:
    """Path, name, size and time of every file below ``directory`` with the suffix."""
    spark.dataSource.register(FileInventory)
    listed = spark.read.format("file_inventory").option("path", directory).option("suffix", suffix)
    return listed.load().select(
        "path", file_name(F.col("path")).alias("file_name"), "size", "modified_at"
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, modified and deleted paths between two inventories."""
    before = old.select(
        "path", F.col("size").alias("old_size"), F.col("modified_at").alias("old_modified_at")
    )
    after = new.select(
        "path", F.col("size").alias("new_size"), F.col("modified_at").alias("new_modified_at")
    )
    same = F.col("old_size").eqNullSafe(F.col("new_size")) & F.col("old_modified_at").eqNullSafe(
        F.col("new_modified_at")
    )
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(~same, "modified")
    )
    return (
        before.withColumn("_old", F.lit(True))
        .join(after.withColumn("_new", F.lit(True)), "path", "full_outer")
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select("path", "kind", "old_size", "new_size")
    )


def change_feed(
    spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, **options: str
) -> DataFrame:
    """Raw change rows from files of a fixed schema, as a table or a stream."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be 'parquet' or 'json'")
    reader = spark.readStream if streaming else spark.read
    return reader.schema(RAW_CHANGES).format(fmt).options(**options).load(path)
