"""Idle detection and the action for each stream: joins and CASE, no loops.

``state`` has one row per stream, ``files`` and ``tracked`` one row per path.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import present, seconds_between
from ..schemas import FINALIZE_STATUSES, STREAM_TIMEOUT_SECONDS, WRITE_STATUSES
from .filters import valid_parts


def _instant(as_of: datetime.datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def stale_streams(
    state: DataFrame,
    as_of: datetime.datetime | str | Column,
    timeout_seconds: float = STREAM_TIMEOUT_SECONDS,
) -> DataFrame:
    """Active streams idle for longer than the timeout at ``as_of``."""
    age = seconds_between(_instant(as_of), F.col("last_activity_at"))
    return state.filter((F.col("status") == "active") & (age > timeout_seconds)).withColumn(
        "idle_seconds", age
    )


def _with_lookups(streams: DataFrame, files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Add ``file_size`` and ``tracked_id`` of each stream's path."""
    sizes = files.select(F.col("path").alias("original_path"), F.col("size").alias("file_size"))
    owners = tracked.select(
        F.col("path").alias("original_path"), F.col("stream_id").alias("tracked_id")
    )
    return streams.join(sizes, "original_path", "left").join(owners, "original_path", "left")


def stale_actions(
    state: DataFrame,
    files: DataFrame,
    tracked: DataFrame,
    as_of: datetime.datetime | str | Column,
    timeout_seconds: float = STREAM_TIMEOUT_SECONDS,
    truncated: str = "finalize",
    active_ids: DataFrame | None = None,
) -> DataFrame:
    """Decision of the idle pass for each stream, the first match winning.

    ``active_ids`` lists the streams to look at, in case some have no state row.
    ``last_activity_at`` may be text; a value that is no time is quarantined
    alone. A file shorter than the bytes sent was truncated: ``"finalize"`` it,
    or ``"fail"`` it.
    """
    if truncated not in ("finalize", "fail"):
        raise ValueError("truncated must be 'finalize' or 'fail'")
    if active_ids is not None:
        state = active_ids.select("stream_id").join(state, "stream_id", "left")
    if isinstance(state.schema["last_activity_at"].dataType, T.StringType):
        present_time = present(F.col("last_activity_at"))
        moment = F.col("last_activity_at").try_cast("timestamp")
    else:
        present_time = F.col("last_activity_at").isNotNull()
        moment = F.col("last_activity_at")
    age = seconds_between(_instant(as_of), moment)
    sent = F.coalesce(F.col("total_bytes_sent"), F.lit(0))
    same = F.col("tracked_id").eqNullSafe(F.col("stream_id"))
    uploaded = sent >= F.col("file_size")

    def decide(action: str, reason: str | None = None) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason")
        )

    decision = (
        F.when(~F.col("status").eqNullSafe("active"), decide("skip"))
        .when(~present_time, decide("touch"))
        .when(moment.isNull(), decide("quarantine", "bad_last_activity"))
        .when(age <= timeout_seconds, decide("fresh"))
        .when(~F.coalesce(present(F.col("original_path")), F.lit(False)), decide("fail", "stale_no_path"))
        .when(F.col("file_size").isNull(), decide("fail", "stale_file_missing"))
    )
    if truncated == "fail":
        decision = decision.when(sent > F.col("file_size"), decide("fail", "stale_truncated"))
    decision = (
        decision.when(uploaded & same, decide("finalize"))
        .when(uploaded & F.col("tracked_id").isNotNull(), decide("fail", "stale_processor_mismatch"))
        .when(uploaded, decide("resume_finalize"))
        .when(same, decide("reprocess"))
        .otherwise(decide("resume_write"))
    )
    decided = _with_lookups(state, files, tracked).withColumn("_decision", decision)
    return decided.select(
        "stream_id",
        "status",
        F.col("_decision.action").alias("action"),
        F.col("_decision.reason").alias("reason"),
        (
            F.col("_decision.reason").eqNullSafe("stale_file_missing")
            & F.col("tracked_id").isNotNull()
        ).alias("abort_upload"),
    )


def resume_candidates(active: DataFrame, pending: DataFrame) -> DataFrame:
    """Ids that are active or pending, once each."""
    return active.select("stream_id").union(pending.select("stream_id")).distinct()


def resume_actions(
    candidates: DataFrame,
    meta: DataFrame,
    files: DataFrame,
    tracked: DataFrame,
    compat: bool = False,
) -> DataFrame:
    """What to do with each stream after a restart, the first match winning.

    ``candidates`` may have a boolean ``forced``: finalize whatever the status.
    Failed metadata steps are recognised by their failure reason; ``compat=True``
    compares the stored status alone, whose doubled ``failed_`` never matches.
    """
    if "forced" not in candidates.columns:
        candidates = candidates.withColumn("forced", F.lit(False))
    fields = ("original_path", "s3_upload_id", "s3_bucket", "s3_key_prefix")
    complete = F.lit(True)
    for name in fields:
        complete = complete & F.coalesce(present(F.col(name)), F.lit(False))
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    finalize = status.isin(*FINALIZE_STATUSES) | F.coalesce(F.col("forced"), F.lit(False))
    if not compat:
        finalize = finalize | (
            status.startswith("failed_")
            & F.coalesce(F.col("failure_reason").isin(*FINALIZE_STATUSES), F.lit(False))
        )
    known = meta.select(
        "stream_id", *fields, "status", "failure_reason", F.lit(True).alias("_has_state")
    )
    joined = _with_lookups(candidates.join(known, "stream_id", "left"), files, tracked)
    action = (
        F.when(F.col("_has_state").isNull(), "fail")
        .when(~complete, "fail")
        .when(F.col("tracked_id").isNotNull(), "skip")
        .when(F.col("file_size").isNull(), "fail")
        .when(finalize, "finalize")
        .when(status.isin(*WRITE_STATUSES), "write")
        .otherwise("none")
    )
    reason = (
        F.when(F.col("_has_state").isNull(), "resume_no_meta")
        .when(~complete, "resume_incomplete_meta")
        .when(F.col("tracked_id").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("file_size").isNull(), "file_missing_on_resume")
    )
    return joined.select("stream_id", "status", action.alias("action"), reason.alias("reason"))


def finalize_plan(state: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Complete, abort or fail each stream: the file is tested first, then the parts.

    ``ledger`` holds one row per (stream, part).
    """
    counted = valid_parts(ledger).groupBy("stream_id").agg(F.count("*").alias("_parts"))
    found = files.select(F.col("path").alias("original_path"), F.lit(True).alias("_found"))
    parts = F.coalesce("_parts", F.lit(0))
    return (
        state.select("stream_id", "original_path", "s3_key_prefix")
        .join(counted, "stream_id", "left")
        .join(found, "original_path", "left")
        .select(
            "stream_id",
            "s3_key_prefix",
            parts.cast("bigint").alias("parts"),
            F.when(F.col("_found").isNull(), "fail")
            .when(parts == 0, "abort_no_parts")
            .otherwise("complete")
            .alias("action"),
            F.when(F.col("_found").isNull(), "finalize_file_missing").alias("reason"),
        )
    )
