"""Per-stream state and failures, derived from an append-only status log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FINALIZE_ENDED_STATUSES

_PLACE = ("ts", "seq")

# Steps that fail with one reason, whatever the error.
STEP_REASONS = {
    "finalize_file_check": "finalize_file_missing",
    "complete_upload": "failed_s3_complete_internal",
    "metadata_generation": "failed_meta_generation",
    "metadata_upload": "failed_meta_upload",
}


def latest_state(status_log: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Current row of each stream: the last non-null value of every field.

    Combined map-side, so a busy stream sends one row per input task.
    """
    fields = fields or [c for c in status_log.columns if c not in ("stream_id", *_PLACE)]
    place = F.struct(*_PLACE)
    return status_log.groupBy("stream_id").agg(
        *[
            F.max(F.when(F.col(f).isNotNull(), F.struct(*_PLACE, f))).getField(f).alias(f)
            for f in fields
        ],
        F.max(place).getField("ts").alias("last_activity_at"),
    )


def _set_changes(status: Column) -> dict[str, Column]:
    """Per set: true where a status adds the stream, false where it removes it."""
    failed = status.startswith("failed_")
    ended = status.isin(*FINALIZE_ENDED_STATUSES)
    completed = status == "completed_with_meta"
    pending = status == "pending_completion"
    return {
        "active": F.when(status == "active", True).when(pending | failed | completed, False),
        "pending_completion": F.when(pending, True).when(failed | ended, False),
        "failed": F.when(failed, True),
        "completed": F.when(completed, True),
    }


def membership(status_log: DataFrame) -> DataFrame:
    """Which sets each stream is in: the last change per set decides.

    ``sets`` lists them by name, or is ``none``.
    """
    changes = _set_changes(F.col("status"))
    last = status_log.groupBy("stream_id").agg(
        *[
            F.max(F.when(change.isNotNull(), F.struct(*_PLACE, change.alias("member"))))
            .getField("member")
            .alias(f"_{name}")
            for name, change in changes.items()
        ]
    )
    flags = {name: F.coalesce(F.col(f"_{name}"), F.lit(False)) for name in changes}
    listed = F.concat_ws(",", *[F.when(flag, name) for name, flag in flags.items()])
    return last.select(
        "stream_id",
        *[flag.alias(f"in_{name}") for name, flag in flags.items()],
        F.when(listed == "", "none").otherwise(listed).alias("sets"),
    )


def streams_by_status(state: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Streams whose status is one of ``statuses``; pushed to the scan."""
    return state.filter(F.col("status").isin(*statuses))


def failure_reason(operation: Column, error_class: Column) -> Column:
    """Reason recorded for an error, or null where none is recorded.

    ``operation`` is one of open_stream, init_checkpoint, write, finalize,
    resume and task, or a step of finalization in ``STEP_REASONS``.
    """
    store = error_class.isin("S3OperationError", "RedisOperationError")
    handled = error_class.isin(
        "StreamInitializationError", "ChunkProcessingError", "StreamFinalizationError"
    )
    missing = error_class == "FileNotFoundError"
    by_operation = {
        "open_stream": F.when(
            store | (error_class == "StreamInitializationError"),
            "new_stream_unexpected_setup_failure",
        ),
        "init_checkpoint": F.when(missing, "file_missing_on_resume")
        .when(store, "init_checkpoint_client_failure")
        .otherwise("init_checkpoint_failure"),
        "write": F.when(missing, F.lit(None).cast("string"))
        .when(store, "chunk_processing_failure")
        .otherwise("chunk_processing_unexpected"),
        "finalize": F.when(error_class == "S3OperationError", "finalize_s3_failure")
        .when(error_class == "RedisOperationError", "finalize_redis_failure")
        .when(error_class == "FFprobeError", "finalize_ffprobe_failure")
        .otherwise("finalize_unexpected_failure"),
        "resume": F.when(
            ~(missing | (error_class == "StreamInitializationError")),
            "resume_init_unexpected_failure",
        ),
        "task": F.when(~handled, "task_unexpected_error"),
        **{step: F.lit(reason) for step, reason in STEP_REASONS.items()},
    }
    reason = F.when(error_class == "CancelledError", F.lit(None).cast("string"))
    for name, chosen in by_operation.items():
        reason = reason.when(operation == name, chosen)
    return reason


def with_failure_reason(ops: DataFrame) -> DataFrame:
    """``ops`` with the reason of each failed operation."""
    return ops.withColumn(
        "failure_reason", failure_reason(F.col("operation"), F.col("error_class"))
    )


def failure_records(ops: DataFrame) -> DataFrame:
    """Status-log rows of the failed operations; union them into the log.

    Through ``membership`` such a row enters the failed set and leaves the
    active and pending sets.
    """
    return (
        with_failure_reason(ops)
        .filter(F.col("failure_reason").isNotNull())
        .select(
            "stream_id",
            "ts",
            "seq",
            F.concat(F.lit("failed_"), "failure_reason").alias("status"),
            "failure_reason",
        )
    )


def first_and_last_failure(failures: DataFrame) -> DataFrame:
    """First and last failure reason of each stream, and how many there were."""
    entry = F.struct(*_PLACE, "failure_reason")
    return failures.groupBy("stream_id").agg(
        F.min(entry).getField("failure_reason").alias("first_reason"),
        F.max(entry).getField("failure_reason").alias("last_reason"),
        F.count("*").alias("failures"),
    )


def purge_completed(
    state: DataFrame, ledger: DataFrame, status: str = "completed_with_meta"
) -> tuple[DataFrame, DataFrame]:
    """State and ledger rows left once finished streams are removed."""
    finished = state.filter(F.col("status") == status).select("stream_id")
    return (
        state.filter(~F.col("status").eqNullSafe(status)),
        ledger.join(finished, "stream_id", "left_anti"),
    )
