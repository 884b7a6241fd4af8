"""Explicit schemas and fixed vocabularies; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "BINARY": T.BinaryType(),
    "TIMESTAMP": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """A schema from ``name TYPE`` pairs, without needing a session."""
    named = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in named])


RAW_CHANGES = _schema("seq BIGINT, ts TIMESTAMP, path STRING, kind STRING")
LIFECYCLE_EVENTS = _schema("seq BIGINT, ts TIMESTAMP, path STRING, event STRING")
TRACKED = _schema("path STRING, stream_id STRING")
FILES = _schema("path STRING, file_name STRING, size BIGINT, modified_at TIMESTAMP")
# Listings of a folder, one after another; a path without a size had gone by then.
INVENTORY_LOG = _schema(
    "path STRING, file_name STRING, size BIGINT, modified_at TIMESTAMP, listing BIGINT"
)
STREAM_META = _schema(
    "stream_id STRING, original_path STRING, s3_upload_id STRING, s3_bucket STRING, "
    "s3_key_prefix STRING, status STRING, started_at TIMESTAMP, last_activity_at TIMESTAMP, "
    "total_bytes_expected BIGINT, total_bytes_sent BIGINT, next_part_to_upload INT, "
    "failure_reason STRING"
)
STATUS_LOG = _schema(
    "stream_id STRING, ts TIMESTAMP, seq BIGINT, status STRING, failure_reason STRING"
)
PART_LEDGER_RAW = _schema("stream_id STRING, part_key STRING, packed STRING")
PART_LEDGER = _schema(
    "stream_id STRING, part_number INT, etag STRING, size_bytes BIGINT, uploaded_at TIMESTAMP"
)
CHUNKS = _schema("stream_id STRING, part_number INT, offset BIGINT, length BIGINT, data BINARY")
PROBE_ROWS = _schema("path STRING, return_code INT, stdout STRING, stderr STRING")
OPS = _schema("stream_id STRING, operation STRING, error_class STRING, ts TIMESTAMP, seq BIGINT")
DURATIONS = _schema("path STRING, duration_seconds DOUBLE")

CHUNK = _schema("part_number INT, size_bytes BIGINT, etag STRING, uploaded_at TIMESTAMP")
METADATA_DOCUMENT = T.StructType(
    _schema(
        "stream_id STRING, original_file_path STRING, s3_bucket STRING, s3_key_prefix STRING, "
        "total_size_bytes BIGINT, duration_seconds DOUBLE, processed_at TIMESTAMP, "
        "stream_started_at TIMESTAMP, stream_completed_at TIMESTAMP"
    ).fields
    + [T.StructField("chunks", T.ArrayType(CHUNK))]
)

# The document as it is stored: times are named and written as UTC.
STORED_CHUNK = _schema("part_number INT, size_bytes BIGINT, etag STRING, uploaded_at_utc TIMESTAMP")
STORED_DOCUMENT = T.StructType(
    _schema(
        "stream_id STRING, original_file_path STRING, s3_bucket STRING, s3_key_prefix STRING, "
        "total_size_bytes BIGINT, duration_seconds DOUBLE, processed_at_utc TIMESTAMP, "
        "stream_started_at_utc TIMESTAMP, stream_completed_at_utc TIMESTAMP"
    ).fields
    + [T.StructField("chunks", T.ArrayType(STORED_CHUNK))]
)
STORED_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"

# Change kinds, event names and statuses.
CHANGE_KINDS = ("added", "modified", "deleted")
EVENT_NAMES = ("CREATE", "WRITE", "DELETE", "IDLE")
FINALIZE_STATUSES = (
    "pending_completion",
    "s3_completed",
    "failed_meta_upload",
    "failed_meta_generation",
)
WRITE_STATUSES = (
    "active",
    "processing",
    "interrupted_shutdown_write",
    "interrupted_cancelled_write",
    "unknown",
)
# Statuses at which a finalization pass has ended without a failure.
FINALIZE_ENDED_STATUSES = (
    "completed_with_meta",
    "aborted_no_parts",
    "interrupted_cancelled_finalize",
)

# Histogram bounds in seconds, sizes and times.
DURATION_BUCKETS = (5, 10, 30, 60, 120, 300, 600, 1800, 3600)
PROCESSING_TIME_BUCKETS = (10, 30, 60, 120, 300, 600, 1800, 3600, 7200)
CHUNK_SIZE_BYTES = 10_485_760
STREAM_TIMEOUT_SECONDS = 30

# The object-store limit on parts of one upload; larger ledgers are paged.
PARTS_PER_PAGE = 10_000
