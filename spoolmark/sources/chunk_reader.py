"""Bytes of planned ranges, read where the task runs.

The plan is rows, made by ``plan_chunks`` on the executors; nothing about the
files passes through the driver. Files change while they are read: a range that
ends early or whose file has gone is a result with a status, not a failure.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.chunks import plan_chunks
from ..plans.running import with_running_in_order
from ..schemas import CHUNK_SIZE_BYTES
from ..session import new_folder
from .inventory import file_inventory, open_filesystem

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes handed back per Arrow batch, one chunk at least.
_BATCH_BYTES = 32 * 1024 * 1024
# Planned bytes that one task reads.
BYTES_PER_TASK = 256 * 1024 * 1024
_READ = T.StructType(
    [
        T.StructField("length", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("status", T.StringType()),
    ]
)


class _OpenFile:
    """The file last read from; ranges of one file are neighbours."""

    def __init__(self, root: str) -> None:
        self.system, _ = open_filesystem(root)
        self.path, self.handle = None, None

    def read(self, path: str, offset: int, length: int) -> tuple[int, bytes | None, str]:
        """(bytes read, data, status) of a range: ``ok``, ``short`` or ``missing``."""
        if path != self.path:
            self.close()
            try:
                self.path, self.handle = path, self.system.open_input_file(path)
            except FileNotFoundError:
                return 0, None, "missing"
        # A range beyond the end of the file is empty.
        size = self.handle.size()
        data = self.handle.read_at(length, offset) if offset < size else b""
        return len(data), data, "ok" if len(data) == length else "short"

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.path, self.handle = None, None


def _read_ranges(root: str, kept: list[str]):
    def read(batches) -> Iterator:
        import pyarrow as pa

        file = _OpenFile(root)
        names = [*kept, "length", "data", "status"]
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))))
            start, found, held = 0, [], 0
            for at, (path, offset, length) in enumerate(ranges):
                found.append(file.read(path, offset, length))
                held += found[-1][0]
                if held >= _BATCH_BYTES or at + 1 == len(ranges):
                    part = batch.slice(start, len(found))
                    columns = [
                        pa.array(list(values), kind)
                        for values, kind in zip(zip(*found), (pa.int64(), pa.binary(), pa.string()))
                    ]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names)
                    start, found, held = at + 1, [], 0
        file.close()

    return read


def fetch_chunks(planned: DataFrame, directory: str, tasks: int | None = None) -> DataFrame:
    """Add ``data`` and ``status`` to each planned range of the files below ``directory``.

    ``length`` becomes the bytes read. ``status`` is ``ok``, ``short`` where the
    file ends before the range does, or ``missing`` (null data) where it has gone.
    The number of reading tasks is stated: plan rows are tiny, and left to
    itself Spark would merge them into few tasks however many bytes they name.
    """
    session = planned.sparkSession
    kept = [f for f in planned.schema.fields if f.name != "length"]
    schema = T.StructType(kept + _READ.fields)
    if tasks is None:
        tasks = max(
            int(session.conf.get("spark.sql.shuffle.partitions")),
            session.sparkContext.defaultParallelism,
        )
    spread = planned.repartition(tasks, "path", "part_number")
    if not planned.isStreaming:
        # Neighbouring ranges share an open file.
        spread = spread.sortWithinPartitions("path", "offset")
    return spread.mapInArrow(_read_ranges(directory, [f.name for f in kept]), schema)


def _fetch_dealt(
    spark: SparkSession, files: DataFrame, directory: str, chunk_size: int, bytes_per_task: int
) -> DataFrame:
    """Ranges dealt to tasks by their bytes: the files one after another, cut evenly.

    A running total of sizes gives each file its place among all bytes, so every
    task reads as many, ``bytes_per_task`` at most, be they of one file or of thousands.
    """
    # One listing serves the totals and the plan, and a lost executor does not list again.
    listing = new_folder(spark, "listing")
    files.select("path", "size").write.parquet(listing)
    files = spark.read.schema("path STRING, size BIGINT").parquet(listing)
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ended = with_running_in_order(files, [], ["path"], sums={"ended": F.col("size")})
    planned = plan_chunks(ended, chunk_size)
    place = F.col("ended") - F.col("size") + F.col("offset")
    kept = ["path", "part_number", "offset", "length"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // bytes_per_task))
    share = max(1, -(-total // tasks))
    spread = (
        planned.withColumn("task", F.call_function("div", place, F.lit(share)).cast("int"))
        .repartitionById(tasks, "task")
        .sortWithinPartitions("path", "offset")
        .select(*kept)
    )
    fields = [f for f in spread.schema.fields if f.name != "length"]
    schema = T.StructType(fields + _READ.fields)
    return spread.mapInArrow(_read_ranges(directory, [f.name for f in fields]), schema)


def read_chunks(
    spark: SparkSession,
    directory: str,
    chunk_size: int = CHUNK_SIZE_BYTES,
    suffix: str = ".mp4",
    tasks: int | None = None,
    bytes_per_task: int = BYTES_PER_TASK,
) -> DataFrame:
    """One row per byte range of every file below ``directory``, with ``data`` and ``status``.

    Tasks read about ``bytes_per_task`` each, or there are ``tasks`` of them if given.
    """
    files = file_inventory(spark, directory, suffix).select(F.col("path"), F.col("size"))
    if tasks is not None:
        planned = plan_chunks(files, chunk_size).select("path", "part_number", "offset", "length")
        return fetch_chunks(planned, directory, tasks)
    return _fetch_dealt(spark, files, directory, chunk_size, bytes_per_task)
