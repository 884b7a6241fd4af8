"""Filters and projections: no shuffle unless the operator nests or sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata_key, object_key, present, stream_key
from ..schemas import PARTS_PER_PAGE
from .chunks import page_of
from .ledger import latest_parts


def filter_suffix(df: DataFrame, column: str, suffix: str = ".mp4") -> DataFrame:
    """Rows whose value ends with ``suffix``, case-sensitive; pushed to the scan."""
    return df.filter(F.col(column).endswith(suffix))


def valid_parts(ledger: DataFrame) -> DataFrame:
    """Parts that can be completed: a number and a non-empty etag."""
    return ledger.filter(present(F.col("etag")) & F.col("part_number").isNotNull())


def completion_manifest(ledger: DataFrame, parts_per_page: int = PARTS_PER_PAGE) -> DataFrame:
    """Ordered (number, etag) list of each stream, in pages of ``parts_per_page``.

    The last successful upload of each part counts: a failed retry leaves the
    part that was there. So a page is bounded and a stream within the
    object-store limit has exactly one.
    """
    return (
        latest_parts(valid_parts(ledger))
        .groupBy("stream_id", page_of(F.col("part_number"), parts_per_page).alias("page"))
        .agg(F.sort_array(F.collect_list(F.struct("part_number", "etag"))).alias("parts"))
    )


def list_parts(ledger: DataFrame) -> DataFrame:
    """Complete part rows in (stream, number) order; range-partitioned, not one task."""
    wanted = ["part_number", "etag", "size_bytes"]
    return (
        ledger.select("stream_id", *wanted)
        .dropna(subset=wanted)
        .orderBy("stream_id", *wanted)
    )


def object_keys(streams: DataFrame, path: str = "original_path") -> DataFrame:
    """Object key and metadata key of each stream."""
    key = object_key(F.col("stream_id"), F.col(path))
    return streams.withColumn("object_key", key).withColumn(
        "metadata_key", metadata_key(F.col("object_key"))
    )


def assign_stream_ids(events: DataFrame) -> DataFrame:
    """A stream id per (path, generation), from the values alone."""
    return events.withColumn("stream_id", stream_key(F.col("path"), F.col("generation")))


def init_stream_meta(
    creates: DataFrame, bucket: str, upload_id: Column | None = None
) -> DataFrame:
    """First state row of each created stream.

    ``upload_id`` is the id handed out by the object store; where there is none
    yet, the stream id stands in so that the row is complete.
    """
    stream = F.col("stream_id")
    return creates.select(
        stream,
        F.col("path").alias("original_path"),
        (upload_id if upload_id is not None else stream).alias("s3_upload_id"),
        F.lit(bucket).alias("s3_bucket"),
        object_key(stream, F.col("path")).alias("s3_key_prefix"),
        F.lit("active").alias("status"),
        F.col("ts").alias("started_at"),
        F.col("ts").alias("last_activity_at"),
        F.lit(None).cast("bigint").alias("total_bytes_expected"),
        F.lit(0).cast("bigint").alias("total_bytes_sent"),
        F.lit(1).alias("next_part_to_upload"),
        F.lit(None).cast("string").alias("failure_reason"),
    )
