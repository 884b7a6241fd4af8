"""Byte-range planning, checksums and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import number_block
from ..schemas import CHUNK_SIZE_BYTES, PARTS_PER_PAGE

# Chunks planned per step, so that no array grows with the file.
_CHUNKS_PER_STEP = 10_000


def page_of(part_number: Column, parts_per_page: int = PARTS_PER_PAGE) -> Column:
    """Page of a part; numbers start at 1, and a page holds at most that many."""
    return number_block(part_number, parts_per_page, first=1)


def plan_chunks(
    files: DataFrame,
    chunk_size: int = CHUNK_SIZE_BYTES,
    start_offset: Column | str | None = None,
    next_part: Column | str | None = None,
) -> DataFrame:
    """Byte ranges left to read in each file; none when size ≤ offset.

    The columns of ``files`` are kept. The ranges of a file are exploded in two
    steps, so a file of any size needs only arrays of bounded length.
    """
    begin = _column(start_offset, 0).cast("bigint")
    first = _column(next_part, 1).cast("bigint")
    todo = files.withColumn("_begin", begin).withColumn("_first", first)
    todo = todo.filter(F.col("size") > F.col("_begin"))
    step_bytes = chunk_size * _CHUNKS_PER_STEP
    steps = F.sequence(F.col("_begin"), F.col("size") - 1, F.lit(step_bytes).cast("bigint"))
    in_steps = todo.withColumn("_step", F.explode(steps))
    step_end = F.least(F.col("size") - 1, F.col("_step") + F.lit(step_bytes - 1))
    offsets = F.sequence(F.col("_step"), step_end, F.lit(chunk_size).cast("bigint"))
    planned = in_steps.withColumn("offset", F.explode(offsets))
    done = F.col("offset") - F.col("_begin")
    return planned.select(
        *[F.col(c) for c in files.columns],
        (F.col("_first") + number_block(done, chunk_size)).cast("int").alias("part_number"),
        F.col("offset"),
        F.least(F.lit(chunk_size).cast("bigint"), F.col("size") - F.col("offset")).alias("length"),
    )


def slice_chunks(planned: DataFrame, data: str = "data") -> DataFrame:
    """Cut ``data``, the whole content of each file, into its planned ranges."""
    cut = F.substr(F.col(data), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return planned.withColumn(data, cut)


def chunk_checksums(chunks: DataFrame, data: str = "data") -> DataFrame:
    """Replace the bytes of each chunk by their tag."""
    return chunks.withColumn("etag", F.md5(F.col(data))).drop(data)


def assemble_objects(chunks: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Ordered concatenation of each stream's chunks, in segments.

    A segment holds the chunks that start within one stretch of ``max_bytes``,
    so no row exceeds that plus one chunk. A stream that fits has one segment;
    a longer one is whole when its segments are read in order.
    """
    segment = number_block(F.col("offset"), max_bytes).alias("segment")
    return chunks.groupBy("stream_id", segment).agg(
        F.min("offset").alias("offset"),
        F.sum("length").alias("length"),
        F.count("*").alias("chunk_count"),
        F.expr("listagg(data) WITHIN GROUP (ORDER BY offset)").alias("data"),
    )


def _column(value: Column | str | None, default: int) -> Column:
    if value is None:
        return F.lit(default)
    return F.col(value) if isinstance(value, str) else value
