"""State, failures and metrics on small known inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from spoolmark import schemas
from spoolmark.operators import metrics, state

from helpers import at, rows

START = datetime.datetime(2023, 1, 1)


def log(spark, *records):
    """Status rows from (id, status[, reason]) in order of time."""
    data = [
        (r[0], START + datetime.timedelta(seconds=i), i, r[1], r[2] if len(r) > 2 else None)
        for i, r in enumerate(records)
    ]
    return spark.createDataFrame(data, schemas.STATUS_LOG)


def ops(spark, *pairs):
    data = [("s", o, e, START + datetime.timedelta(seconds=i), i) for i, (o, e) in enumerate(pairs)]
    return spark.createDataFrame(data, schemas.OPS)


def test_latest_state_keeps_last_value_of_each_field(spark):
    made = state.latest_state(log(spark, ("a", "active"), ("a", "failed_x", "x"), ("a", "pending_completion"), ("b", "active")))
    assert rows(made, "stream_id", "status", "failure_reason", "last_activity_at") == [
        ("a", "pending_completion", "x", at("00:00:02")),
        ("b", "active", None, at("00:00:03")),
    ]


@pytest.mark.parametrize(
    "statuses, sets",
    [
        (["active"], "active"),
        (["active", "pending_completion"], "pending_completion"),
        (["active", "pending_completion", "failed_x"], "failed"),
        (["active", "interrupted_shutdown_write"], "active"),
        (["active", "deleted_locally"], "active"),
        (["active", "pending_completion", "s3_completed"], "pending_completion"),
        (["active", "pending_completion", "s3_completed", "completed_with_meta"], "completed"),
        (["active", "pending_completion", "interrupted_cancelled_finalize"], "none"),
        (["active", "pending_completion", "aborted_no_parts"], "none"),
        (["failed_x", "active"], "active,failed"),
    ],
)
def test_membership(spark, statuses, sets):
    made = state.membership(log(spark, *[("s", status) for status in statuses]))
    assert rows(made, "sets") == [(sets,)]


REASONS = [
    ("open_stream", "S3OperationError", "new_stream_unexpected_setup_failure"),
    ("open_stream", "ValueError", None),
    ("init_checkpoint", "FileNotFoundError", "file_missing_on_resume"),
    ("init_checkpoint", "RedisOperationError", "init_checkpoint_client_failure"),
    ("init_checkpoint", "ValueError", "init_checkpoint_failure"),
    ("write", "S3OperationError", "chunk_processing_failure"),
    ("write", "FileNotFoundError", None),
    ("write", "ValueError", "chunk_processing_unexpected"),
    ("write", "CancelledError", None),
    ("finalize", "S3OperationError", "finalize_s3_failure"),
    ("finalize", "RedisOperationError", "finalize_redis_failure"),
    ("finalize", "FFprobeError", "finalize_ffprobe_failure"),
    ("finalize", "StreamFinalizationError", "finalize_unexpected_failure"),
    ("finalize", "CancelledError", None),
    ("resume", "ValueError", "resume_init_unexpected_failure"),
    ("resume", "FileNotFoundError", None),
    ("task", "StreamFinalizationError", None),
    ("task", "ValueError", "task_unexpected_error"),
    ("finalize_file_check", "StreamFinalizationError", "finalize_file_missing"),
    ("complete_upload", "StreamFinalizationError", "failed_s3_complete_internal"),
    ("metadata_generation", "StreamFinalizationError", "failed_meta_generation"),
    ("metadata_upload", "StreamFinalizationError", "failed_meta_upload"),
    ("upload_part", "ValueError", None),
]


def test_failure_reasons(spark):
    made = state.with_failure_reason(ops(spark, *[(o, e) for o, e, _ in REASONS])).orderBy("seq")
    assert [r["failure_reason"] for r in made.collect()] == [reason for _, _, reason in REASONS]


def test_failure_records_feed_the_log(spark):
    records = state.failure_records(ops(spark, ("finalize", "S3OperationError"), ("write", "CancelledError"), ("finalize", "ValueError")))
    assert rows(records, "seq", "status") == [(0, "failed_finalize_s3_failure"), (2, "failed_finalize_unexpected_failure")]
    assert rows(state.first_and_last_failure(records)) == [
        ("s", "finalize_s3_failure", "finalize_unexpected_failure", 2)
    ]
    whole = log(spark, ("s", "active"), ("s", "pending_completion")).unionByName(
        records.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    )
    assert rows(state.membership(whole), "sets") == [("failed",)]


def test_purge_completed(spark):
    now = state.latest_state(log(spark, ("a", "completed_with_meta"), ("b", "active")))
    parts = spark.createDataFrame([("a", 1, "e", 1, None), ("b", 1, "e", 1, None), ("c", 1, "e", 1, None)], schemas.PART_LEDGER)
    left_state, left_parts = state.purge_completed(now, parts)
    assert rows(left_state, "stream_id") == [("b",)]
    assert rows(left_parts, "stream_id") == [("b",), ("c",)]


def test_counters(spark):
    parts = spark.createDataFrame([("a", 1, "e", 5, None), ("a", 1, "f", 7, None), ("b", 1, "e", 1, None)], schemas.PART_LEDGER)
    assert rows(metrics.chunk_counters(parts)) == [("a", 2, 12), ("b", 1, 1)]
    failed = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "stream_id STRING, operation_type STRING")
    assert rows(metrics.failed_operations(failed)) == [("a", "x", 2), ("a", "y", 1)]
    outcomes = metrics.stream_outcomes(log(spark, ("a", "failed_x"), ("a", "failed_y"), ("b", "completed_with_meta"), ("c", "active")))
    assert rows(outcomes) == [(1, 1)]
    assert rows(metrics.stream_outcomes(log(spark, ("a", "active")).limit(0))) == [(0, 0)]


def test_histogram(spark):
    seen = spark.createDataFrame([("a", 15.0), ("a", 45.0), ("b", 5.0), ("b", None), ("b", 99.0)], "stream_id STRING, v DOUBLE")
    made = metrics.histogram(seen, "v", (5, 10, 25, 50), ["stream_id"])
    got = {(r["stream_id"], r["le"]): r["bucket_count"] for r in made.collect()}
    assert got == {
        ("a", "5"): 0, ("a", "10"): 0, ("a", "25"): 1, ("a", "50"): 2, ("a", "+Inf"): 2,
        ("b", "5"): 1, ("b", "10"): 1, ("b", "25"): 1, ("b", "50"): 1, ("b", "+Inf"): 2,
    }
    assert {tuple(r) for r in made.select("stream_id", "observations", "observed_sum").collect()} == {("a", 2, 60.0), ("b", 2, 104.0)}


def test_processing_time(spark):
    done, failed = "completed_with_meta", "failed_task_error"
    state = [("a", at("12:00"), done), ("b", at("12:00"), failed), ("c", None, done), ("d", at("12:00"), done)]
    log = [("a", at("12:01:30"), done), ("a", at("12:01"), done), ("a", at("12:09"), "active"), ("b", at("12:01"), done), ("c", at("12:01"), done)]
    taken = metrics.processing_time(
        spark.createDataFrame(state, "stream_id STRING, started_at TIMESTAMP, status STRING"),
        spark.createDataFrame(log, "stream_id STRING, ts TIMESTAMP, status STRING"),
    )
    assert rows(taken) == [("a", 90.0)]


def test_operation_types(spark):
    pairs = [("finalize", "S3OperationError"), ("write", "FileNotFoundError"), ("init_checkpoint", "FileNotFoundError"), ("task", "ValueError"), ("upload_part", "none"), ("write", "CancelledError")]
    assert [r[1] for r in rows(metrics.operation_types(ops(spark, *pairs)))] == [
        "finalize_s3_failure",
        "process_file_disappeared",
        "redis_set_failed_file_missing_on_resume",
        "redis_set_failed_finalize_s3_failure",
        "redis_set_failed_task_unexpected_error",
        "s3_upload_part",
    ]


def test_error_within_finalization_is_recorded_twice(spark):
    """The step fails, and the pass as a whole then fails with its own reason."""
    both = state.failure_records(ops(spark, ("metadata_upload", "StreamFinalizationError"), ("finalize", "StreamFinalizationError")))
    assert rows(state.first_and_last_failure(both)) == [("s", "failed_meta_upload", "finalize_unexpected_failure", 2)]
    assert rows(metrics.stream_outcomes(both)) == [(0, 1)]


def test_gauge_counts_resumes_and_finalizations(spark):
    acts = ["open", "process", "resume", "finalize", "abort", "none"]
    data = [(i, START + datetime.timedelta(hours=i), f"p{i}", a) for i, a in enumerate(acts)]
    made = metrics.active_gauge(spark.createDataFrame(data, "seq BIGINT, ts TIMESTAMP, path STRING, action STRING"))
    assert rows(made, "seq", "active_streams") == [(0, 1), (2, 2), (3, 1), (4, 0)]
