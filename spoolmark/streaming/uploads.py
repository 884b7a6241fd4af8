"""Streaming forms of the chunk operators.

Growth of files is followed through an inventory log: each listing is appended
to a shared folder, with a row for every path that has gone since, and a stream
over that log keeps the committed offset of each path in Spark's state store.
Offsets are thus spread over the executors rather than held in one map on the
driver, and a replayed batch sees the sizes it saw at first.

A path that is deleted and made anew is a new generation of it, named by the
listing that saw it first, and is read whole from its first byte.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import file_name
from ..operators.chunks import plan_chunks
from ..operators.ledger import stream_totals
from ..schemas import CHUNK_SIZE_BYTES, INVENTORY_LOG
from ..sources.chunk_reader import fetch_chunks
from ..sources.inventory import file_inventory
from ..sources.sinks import write_ledger

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_GROWTH = "path STRING, generation BIGINT, size BIGINT, start_offset BIGINT, next_part INT, replaced BOOLEAN"
_POSITION = "generation BIGINT, committed BIGINT, next_part INT, listing BIGINT"


def log_inventory(
    spark: SparkSession,
    directory: str,
    log_dir: str,
    suffix: str = ".mp4",
    modified_since: datetime.datetime | str | None = None,
) -> None:
    """Append one listing of ``directory`` to the inventory log, and what has gone since the last.

    A path that an earlier listing has and this one lacks gets a row without a
    size. ``modified_since`` leaves out files untouched since then, so that a log of
    many listings grows with what changes and not with what is there. One writer
    keeps a log: listings are numbered from what it holds.
    """
    spark.createDataFrame([], INVENTORY_LOG).write.mode("ignore").parquet(log_dir)
    log = spark.read.schema(INVENTORY_LOG).parquet(log_dir)
    number = log.agg(F.coalesce(F.max("listing"), F.lit(0)) + 1).scalar()
    there = (
        log.groupBy("path")
        .agg(F.max_by(F.col("size").isNotNull(), "listing").alias("there"))
        .filter("there")
    )
    listed = file_inventory(spark, directory, suffix).withColumn("_listed", F.lit(True))
    both = listed.join(there, "path", "full_outer")
    if modified_since is not None:
        recent = F.col("modified_at") >= F.lit(modified_since).cast("timestamp")
        both = both.filter(F.col("_listed").isNull() | recent)
    both.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        "size",
        "modified_at",
        number.cast("bigint").alias("listing"),
    ).write.mode("append").parquet(log_dir)


def inventory_stream(spark: SparkSession, log_dir: str, **options: str) -> DataFrame:
    """The inventory log as a stream."""
    return spark.readStream.schema(INVENTORY_LOG).options(**options).parquet(log_dir)


def _advance(chunk_size: int):
    def advance(key, frames, state) -> Iterator[pd.DataFrame]:
        """Growth of each generation that the listings of one batch show.

        A file that has gone, or is shorter than what was read of it, ends its
        generation; what it had grown by in this batch can no longer be read.
        """
        generation, committed, part, last = state.get if state.exists else (None, 0, 1, 0)
        seen = sorted(
            (int(listing), None if pd.isna(size) else int(size))
            for frame in frames
            for listing, size in zip(frame["listing"], frame["size"])
        )
        made, grown = [], None

        def end(replaced: bool) -> None:
            if grown is not None and grown > committed:
                made.append((key[0], generation, grown, committed, part, replaced))

        for listing, size in seen:
            if listing <= last:
                continue
            last = listing
            reached = committed if grown is None else grown
            if generation is not None and (size is None or size < reached):
                end(True)
                generation, committed, part, grown = None, 0, 1, None
            if size is not None:
                generation = listing if generation is None else generation
                grown = size
        end(False)
        if generation is None:
            if state.exists:
                state.remove()
        elif grown is not None:
            part += max(0, -(-(grown - committed) // chunk_size))
            state.update((generation, max(committed, grown), part, last))
        if made:
            yield pd.DataFrame(
                made, columns=["path", "generation", "size", "start_offset", "next_part", "replaced"]
            )

    return advance


def tail_plan(inventory: DataFrame, chunk_size: int = CHUNK_SIZE_BYTES) -> DataFrame:
    """Byte ranges past the last committed offset of each generation of each listed file.

    ``replaced`` marks ranges whose file had gone or was made anew by the last listing
    of the batch. The state of a path is dropped when the path is.
    """
    grown = (
        inventory.select("path", "size", "listing")
        .groupBy("path")
        .applyInPandasWithState(_advance(chunk_size), _GROWTH, _POSITION, "append", "NoTimeout")
    )
    planned = plan_chunks(
        grown.withColumnRenamed("next_part", "first_part"),
        chunk_size,
        "start_offset",
        "first_part",
    )
    return planned.select("path", "generation", "part_number", "offset", "length", "replaced")


def tail_chunks(
    inventory: DataFrame,
    directory: str,
    chunk_size: int = CHUNK_SIZE_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """The bytes of ``tail_plan``'s ranges, read on the executors.

    ``status`` is that of ``fetch_chunks``, or ``replaced`` (null data) for ranges
    that were never read because their file was made anew or had gone.
    """
    planned = tail_plan(inventory, chunk_size)
    # A range of no bytes is asked of a replaced file, lest new bytes pass for old ones.
    asked = planned.withColumn("length", F.when(F.col("replaced"), 0).otherwise(F.col("length")))
    read = fetch_chunks(asked, directory, tasks)
    return read.select(
        "path",
        "generation",
        "part_number",
        "offset",
        "length",
        F.when(~F.col("replaced"), F.col("data")).alias("data"),
        F.when(F.col("replaced"), "replaced").otherwise(F.col("status")).alias("status"),
    )


def progress_stream(ledger: DataFrame) -> DataFrame:
    """``stream_totals`` kept up to date; write it in update or complete mode."""
    return stream_totals(ledger)


def ledger_sink(uploads: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch of uploads to the ledger folder, once.

    The id of the query, which its checkpoint keeps, names the writer.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        context = batch.sparkSession.sparkContext
        write_ledger(batch, directory, batch_id, context.getLocalProperty("sql.streaming.queryId"))

    return (
        uploads.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
