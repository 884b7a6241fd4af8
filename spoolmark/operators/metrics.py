"""Counters, gauges and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seconds_between
from ..plans.running import ROWS_PER_BLOCK, with_running_in_order
from .state import with_failure_reason


def chunk_counters(uploads: DataFrame) -> DataFrame:
    """Chunks and bytes uploaded per stream, repeats included."""
    return uploads.groupBy("stream_id").agg(
        F.count("*").alias("chunks_uploaded"), F.sum("size_bytes").alias("bytes_uploaded")
    )


def operation_types(ops: DataFrame) -> DataFrame:
    """The failed-operation samples of each operation: none, one or two.

    Operations with an error handler of their own count their reason; marking
    the stream as failed counts once more. A file that vanishes while it is read
    and a chunk that gets no tag count without failing the stream.
    """
    handled = (
        (F.col("operation") == "init_checkpoint") & (F.col("error_class") != "FileNotFoundError")
    ) | F.col("operation").isin("write", "finalize")
    reason = F.col("failure_reason")
    samples = F.array(
        F.when(handled, reason),
        F.concat(F.lit("redis_set_failed_"), reason),
        F.when(
            (F.col("operation") == "write") & (F.col("error_class") == "FileNotFoundError"),
            "process_file_disappeared",
        ),
        F.when(F.col("operation") == "upload_part", "s3_upload_part"),
    )
    return with_failure_reason(ops).select(
        "stream_id", F.explode(F.array_compact(samples)).alias("operation_type")
    )


def failed_operations(ops: DataFrame) -> DataFrame:
    """Failed operations per stream and operation type."""
    return ops.groupBy("stream_id", "operation_type").agg(F.count("*").alias("failed_operations"))


def stream_outcomes(status_log: DataFrame) -> DataFrame:
    """How many streams completed and how many failed, each counted once."""
    per_stream = status_log.groupBy("stream_id").agg(
        F.max(F.when(F.col("status") == "completed_with_meta", 1).otherwise(0)).alias("_done"),
        F.max(F.when(F.col("status").startswith("failed_"), 1).otherwise(0)).alias("_failed"),
    )
    return per_stream.agg(
        F.coalesce(F.sum("_done"), F.lit(0)).cast("bigint").alias("streams_completed"),
        F.coalesce(F.sum("_failed"), F.lit(0)).cast("bigint").alias("streams_failed"),
    )


def active_gauge(
    routed: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    opening: Sequence[str] = ("open", "reopen", "resume"),
    closing: Sequence[str] = ("close", "finalize", "abort"),
) -> DataFrame:
    """Open streams after each action that opens or closes one.

    Takes the rows of ``route_events``, and any further actions in that shape.
    Rows are sorted block by block, and a busy moment is cut like any other. Only one
    row per block is ordered globally, a number with a fixed bound.
    """
    action = F.col("action")
    delta = F.when(action.isin(*opening), 1).when(action.isin(*closing), -1)
    changes = routed.select("seq", "ts", "path", delta.alias("delta")).filter(
        F.col("delta").isNotNull()
    )
    return with_running_in_order(
        changes,
        keys=[],
        order=("ts", "seq"),
        rows_per_block=rows_per_block,
        sums={"active_streams": F.col("delta")},
    )


def histogram(
    df: DataFrame, value: str, buckets: Sequence[float], labels: Sequence[str] = ()
) -> DataFrame:
    """Cumulative buckets per label: one row per bound plus +Inf, with sum and count.

    One aggregation over the rows, whatever the number of bounds.
    """
    v = F.col(value)
    totals = (
        df.filter(v.isNotNull())
        .groupBy(*labels)
        .agg(
            *[F.count_if(v <= b).alias(f"_le_{i}") for i, b in enumerate(buckets)],
            F.count("*").alias("observations"),
            F.sum(v).alias("observed_sum"),
        )
    )
    rows = F.array(
        *[
            F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_le_{i}").alias("bucket_count"))
            for i, b in enumerate(buckets)
        ],
        F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket_count")),
    )
    return totals.select(*labels, F.explode(rows).alias("_row"), "observations", "observed_sum").select(
        *labels, "_row.le", "_row.bucket_count", "observations", "observed_sum"
    )


def processing_time(state: DataFrame, log: DataFrame, started: str = "started_at") -> DataFrame:
    """Seconds from the start of each completed stream to its completion in the log.

    Of several completions the last counts; a stream whose status is another one
    by now has none, as has one without a start or a logged completion.
    """
    done = log.where(F.col("status") == "completed_with_meta")
    done = done.groupBy("stream_id").agg(F.max("ts").alias("_done"))
    return (
        state.where(F.col("status") == "completed_with_meta")
        .join(done, "stream_id")
        .select("stream_id", seconds_between(F.col("_done"), F.col(started)).alias("processing_seconds"))
        .filter(F.col("processing_seconds").isNotNull())
    )
