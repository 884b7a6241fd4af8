"""One query per operator over the stand-in tables.

Nested results are flattened and times written as text, so that they compare
with the SQL of ``oracle`` by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunks, decisions, documents, events, filters, ledger, metrics, sessions, state
from ..functions import file_name
from ..schemas import DURATION_BUCKETS, PROCESSING_TIME_BUCKETS, RAW_CHANGES
from ..session import new_folder, stateful_session
from ..sources import chunk_reader, inventory, sinks
from ..streaming import lifecycle, uploads
from . import standins as s

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-08-01 00:00:00"
PROCESSED_AT = "2002-01-01 00:00:00"
CHUNK = 1024
SEGMENT = 16_384
GAP = 6 * 3600
# After the last change of any feed and its gap.
FEED_END = "2100-01-01 00:00:00"
FILE_CHUNK = 16 * 1024

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def times_as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _joined(array: str, *fields: str) -> Column:
    """An array of structs as ``a:b,a:b``."""
    return F.array_join(
        F.transform(array, lambda c: F.concat_ws(":", *[c[f].cast("string") for f in fields])), ","
    )


# Scans, sources, sinks


def _media(spark, sf_dir) -> str:
    """A folder of files made of the documents."""
    folder = new_folder(spark, "media")
    sinks.write_files(s.media_files(spark, sf_dir), folder)
    return folder


@query
def file_inventory(spark, sf_dir):
    """Files made of the documents, as listed."""
    return inventory.file_inventory(spark, _media(spark, sf_dir)).select("file_name", "size")


def _tagged(read: DataFrame, *columns: str) -> DataFrame:
    tagged = chunks.chunk_checksums(read).withColumn("file_name", file_name(F.col("path")))
    return tagged.select("file_name", *columns, "part_number", "offset", "length", "status", "etag")


@query
def read_chunks(spark, sf_dir):
    """Every byte of files made of the documents, read in ranges and tagged."""
    return _tagged(chunk_reader.read_chunks(spark, _media(spark, sf_dir), FILE_CHUNK))


@query
def tail_chunks(spark, sf_dir):
    """The same files followed while they are half written, whole, and, where their size
    is odd, made anew with the last quarter of their bytes."""
    log, out, mark, folder = (new_folder(spark, n) for n in ("inventory", "chunks", "mark", "media"))
    files = s.media_files(spark, sf_dir)
    size = F.octet_length("data")
    states = [
        files.withColumn("data", F.substr("data", F.lit(1), F.call_function("div", size, F.lit(2)).cast("int"))),
        files,
        files.filter(size % 2 == 1).withColumn("data", _last(F.col("data"), size, 4)),
    ]
    for files in states:
        sinks.write_files(files, folder)
        uploads.log_inventory(spark, folder, log)
        read = uploads.tail_chunks(uploads.inventory_stream(spark, log), folder, FILE_CHUNK)
        made = _drained(_tagged(read, "generation"), out, mark)
    return made


def _last(data: Column, size: Column, part: int) -> Column:
    """The last of ``part`` equal parts of the bytes."""
    kept = F.call_function("div", size, F.lit(part)).cast("int")
    return F.substr(data, size - kept + 1, kept)


@query
def change_feed(spark, sf_dir):
    """The raw feed written once and read back with its fixed schema."""
    folder = new_folder(spark, "feed")
    s.raw_changes(spark, sf_dir).write.parquet(folder)
    return times_as_text(inventory.change_feed(spark, folder))


@query
def snapshot_diff(spark, sf_dir):
    return inventory.snapshot_diff(*s.snapshots(spark, sf_dir))


@query
def write_ledger(spark, sf_dir):
    """Uploads streamed into the ledger folder and read back as its latest view."""
    out, mark = new_folder(spark, "ledger"), new_folder(spark, "mark")
    lines = s.table_stream(spark, sf_dir, "lineitem")
    uploads.ledger_sink(s.as_part_ledger(lines), out, mark).awaitTermination()
    return times_as_text(sinks.read_ledger(spark, out))


@query
def write_metadata_json(spark, sf_dir):
    """Documents written as JSON lines and read back."""
    out = new_folder(spark, "documents")
    sinks.write_metadata_json(_documents(spark, sf_dir), out)
    part = documents.flatten_chunks(sinks.read_metadata_json(spark, out))
    return part.groupBy("stream_id").agg(
        F.count("part_number").alias("chunk_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_size_bytes"),
        F.max("etag").alias("last_etag"),
    )


@query
def assemble_objects(spark, sf_dir):
    whole = chunks.assemble_objects(_document_chunks(spark, sf_dir), SEGMENT)
    return whole.select(
        "stream_id", "segment", "offset", "length", "chunk_count", F.md5("data").alias("data_md5")
    )


# Filters and projections


@query
def filter_suffix(spark, sf_dir):
    return filters.filter_suffix(s.table(spark, sf_dir, "pages"), "url", "#top").select(
        "page_id", "url"
    )


@query
def valid_parts(spark, sf_dir):
    return times_as_text(filters.valid_parts(s.upload_log(spark, sf_dir)))


@query
def completion_manifest(spark, sf_dir):
    made = filters.completion_manifest(s.upload_log(spark, sf_dir))
    return made.select(
        "stream_id",
        "page",
        F.size("parts").cast("bigint").alias("part_count"),
        _joined("parts", "part_number", "etag").alias("parts"),
    )


@query
def list_parts(spark, sf_dir):
    return filters.list_parts(s.upload_log(spark, sf_dir))


@query
def object_keys(spark, sf_dir):
    return filters.object_keys(
        s.stream_meta(spark, sf_dir).select("stream_id", "original_path")
    )


@query
def assign_stream_ids(spark, sf_dir):
    made = events.classify_changes(s.raw_changes(spark, sf_dir))
    return filters.assign_stream_ids(made.filter(F.col("event") == "CREATE")).select(
        "seq", "path", "generation", "stream_id"
    )


@query
def init_stream_meta(spark, sf_dir):
    made = events.classify_changes(s.raw_changes(spark, sf_dir))
    ids = filters.assign_stream_ids(made.filter(F.col("event") == "CREATE"))
    return times_as_text(filters.init_stream_meta(ids, s.BUCKET))


# Chunking and ledger


@query
def plan_chunks(spark, sf_dir):
    return chunks.plan_chunks(s.document_files(spark, sf_dir).drop("data"), CHUNK)


@query
def latest_parts(spark, sf_dir):
    return times_as_text(ledger.latest_parts(s.part_ledger(spark, sf_dir)))


@query
def parse_part_records(spark, sf_dir):
    parsed = ledger.parse_part_records(s.packed_parts(spark, sf_dir))
    return times_as_text(
        parsed.select(
            "stream_id",
            "part_key",
            "packed",
            F.when(F.col("reject_reason").isNull(), F.col("part_number")).alias("part_number"),
            F.when(F.col("reject_reason").isNull(), F.col("size_bytes")).alias("size_bytes"),
            F.when(F.col("reject_reason").isNull(), F.col("uploaded_at")).alias("uploaded_at"),
            "reject_reason",
        )
    )


@query
def chunk_checksums(spark, sf_dir):
    return chunks.chunk_checksums(_document_chunks(spark, sf_dir)).select(
        "stream_id", "part_number", "offset", "length", "etag"
    )


@query
def upload_progress(spark, sf_dir):
    return times_as_text(
        ledger.upload_progress(s.upload_log(spark, sf_dir)).select(
            "stream_id", "part_number", "bytes_sent", "next_part", "last_activity_at"
        )
    )


@query
def stream_totals(spark, sf_dir):
    return ledger.stream_totals(ledger.latest_parts(s.part_ledger(spark, sf_dir)))


@query
def resume_positions(spark, sf_dir):
    parts = ledger.latest_parts(s.part_ledger(spark, sf_dir))
    return ledger.resume_positions(s.stream_meta(spark, sf_dir), parts)


@query
def resume_positions_from_parts(spark, sf_dir):
    """The same with the sum of the parts where no counter is stored."""
    parts = ledger.latest_parts(s.part_ledger(spark, sf_dir))
    return ledger.resume_positions(s.stream_meta(spark, sf_dir), parts, strict=False)


@query
def audit_ledger(spark, sf_dir):
    return ledger.audit_ledger(
        s.part_ledger(spark, sf_dir), s.files(spark, sf_dir), s.stream_meta(spark, sf_dir)
    )


# Lifecycle events


@query
def classify_changes(spark, sf_dir):
    return times_as_text(events.classify_changes(s.raw_changes(spark, sf_dir)))


@query
def stream_generations(spark, sf_dir):
    return times_as_text(events.stream_generations(s.lifecycle_feed(spark, sf_dir)))


@query
def route_events(spark, sf_dir):
    return times_as_text(events.route_events(s.lifecycle_feed(spark, sf_dir)))


@query
def route_events_tracked(spark, sf_dir):
    """Every event judged against one snapshot of tracked paths."""
    return times_as_text(
        events.route_events(s.lifecycle_feed(spark, sf_dir), s.open_paths(spark, sf_dir))
    )


@query
def dedupe_creates(spark, sf_dir):
    counted = events.stream_generations(s.lifecycle_feed(spark, sf_dir))
    return times_as_text(events.dedupe_creates(counted))


@query
def untracked_events(spark, sf_dir):
    return times_as_text(
        events.untracked_events(s.lifecycle_feed(spark, sf_dir), s.open_paths(spark, sf_dir))
    )


@query
def closed_streams(spark, sf_dir):
    return times_as_text(
        events.closed_streams(s.lifecycle_feed(spark, sf_dir), s.open_paths(spark, sf_dir))
    )


# State and failures


@query
def latest_state(spark, sf_dir):
    return times_as_text(state.latest_state(s.status_log(spark, sf_dir)))


@query
def membership(spark, sf_dir):
    return state.membership(s.status_log(spark, sf_dir))


@query
def streams_by_status(spark, sf_dir):
    wanted = state.streams_by_status(
        s.stream_meta(spark, sf_dir), ["active", "pending_completion"]
    )
    return wanted.select("stream_id", "status")


@query
def failure_records(spark, sf_dir):
    return times_as_text(state.failure_records(s.failed_ops(spark, sf_dir)))


@query
def failure_reason(spark, sf_dir):
    return state.with_failure_reason(s.failed_ops(spark, sf_dir)).select(
        "seq", "operation", "error_class", "failure_reason"
    )


@query
def first_and_last_failure(spark, sf_dir):
    return state.first_and_last_failure(state.failure_records(s.failed_ops(spark, sf_dir)))


@query
def purge_completed(spark, sf_dir):
    """What is left of both tables, as one row set."""
    left_state, left_ledger = state.purge_completed(
        s.stream_meta(spark, sf_dir), s.part_ledger(spark, sf_dir), "s3_completed"
    )
    return left_state.select(
        F.lit("state").alias("kind"), "stream_id", F.lit(0).alias("part_number")
    ).unionAll(left_ledger.select(F.lit("ledger").alias("kind"), "stream_id", "part_number"))


# Idle detection, resume, finalization


@query
def stale_streams(spark, sf_dir):
    stale = decisions.stale_streams(s.stream_meta(spark, sf_dir), AS_OF)
    return stale.select("stream_id", F.col("idle_seconds").cast("bigint").alias("idle_seconds"))


@query
def stale_actions(spark, sf_dir):
    return decisions.stale_actions(
        s.stream_meta(spark, sf_dir), s.files(spark, sf_dir), s.tracked_streams(spark, sf_dir), AS_OF
    )


@query
def stale_actions_truncated(spark, sf_dir):
    """A file shorter than the bytes sent fails instead of being finalized."""
    return decisions.stale_actions(
        s.stream_meta(spark, sf_dir),
        s.files(spark, sf_dir),
        s.tracked_streams(spark, sf_dir),
        AS_OF,
        truncated="fail",
    )


def _candidates(spark, sf_dir) -> DataFrame:
    """Active and pending streams; the active ones come from the ledger, so some
    have no parts and some no state."""
    meta = s.stream_meta(spark, sf_dir)
    return decisions.resume_candidates(
        s.part_ledger(spark, sf_dir), state.streams_by_status(meta, ["pending_completion"])
    )


@query
def resume_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query
def resume_actions(spark, sf_dir):
    return decisions.resume_actions(
        _candidates(spark, sf_dir),
        s.stream_meta(spark, sf_dir),
        s.files(spark, sf_dir),
        s.tracked_streams(spark, sf_dir),
    )


@query
def resume_actions_compat(spark, sf_dir):
    """The stored status alone decides."""
    return decisions.resume_actions(
        _candidates(spark, sf_dir),
        s.stream_meta(spark, sf_dir),
        s.files(spark, sf_dir),
        s.tracked_streams(spark, sf_dir),
        compat=True,
    )


@query
def finalize_plan(spark, sf_dir):
    open_files, _ = s.snapshots(spark, sf_dir)
    good = filters.valid_parts(s.upload_log(spark, sf_dir))
    return decisions.finalize_plan(
        s.stream_meta(spark, sf_dir), ledger.latest_parts(good), open_files
    )


def _documents(spark, sf_dir) -> DataFrame:
    return documents.metadata_documents(
        s.stream_meta(spark, sf_dir),
        s.part_ledger(spark, sf_dir),
        s.durations(spark, sf_dir),
        PROCESSED_AT,
    )


@query
def metadata_documents(spark, sf_dir):
    return times_as_text(
        _documents(spark, sf_dir)
        .withColumn("chunk_count", F.size("chunks").cast("bigint"))
        .withColumn("chunks", _joined("chunks", "part_number", "size_bytes", "etag"))
    )


@query
def flatten_chunks(spark, sf_dir):
    return times_as_text(documents.flatten_chunks(_documents(spark, sf_dir)))


@query
def probe_results(spark, sf_dir):
    probed = documents.probe_results(s.probe_rows(spark, sf_dir))
    return probed.withColumn(
        "duration_seconds", F.col("duration_seconds").cast("decimal(12,2)").cast("string")
    )


# Sessions and streaming


@query
def activity_sessions(spark, sf_dir):
    return times_as_text(sessions.activity_sessions(s.raw_changes(spark, sf_dir), GAP))


def _event_stream(spark, sf_dir) -> DataFrame:
    return s.as_raw_changes(s.table_stream(spark, sf_dir, "events", maxBytesPerTrigger=str(1 << 30)))


def _drained(stream: DataFrame, out: str, mark: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote."""
    run = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", mark)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _whole_feed(spark, sf_dir, operator, label: str) -> DataFrame:
    """What an operator emits for the whole feed: run over it, close it, run on."""
    out, mark, closing = (new_folder(spark, f"{label}-{n}") for n in ("out", "mark", "closing"))
    spark.createDataFrame([], RAW_CHANGES).write.parquet(closing)
    beside = stateful_session(spark)
    _drained(operator(lifecycle.with_closing(_event_stream(beside, sf_dir), closing)), out, mark)
    lifecycle.close_feed(spark, closing, FEED_END)
    made = _drained(operator(lifecycle.with_closing(_event_stream(beside, sf_dir), closing)), out, mark)
    return spark.read.schema(made.schema).parquet(out)


@query
def idle_events(spark, sf_dir):
    """Every session of the feed, which is closed when all of it was read."""
    return times_as_text(
        _whole_feed(spark, sf_dir, lambda raw: lifecycle.idle_events(raw, GAP, "1 minute"), "idle")
    )


@query
def classify_stream(spark, sf_dir):
    return times_as_text(_whole_feed(spark, sf_dir, lifecycle.classify_stream, "events"))


@query
def progress_stream(spark, sf_dir):
    """Totals kept up to date batch by batch; the last value per stream."""
    out, mark = new_folder(spark, "progress"), new_folder(spark, "mark")
    lines = s.table_stream(spark, sf_dir, "lineitem")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run = (
        uploads.progress_stream(s.as_part_ledger(lines))
        .writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", mark)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    written = spark.read.parquet(out)
    newest = F.max(F.struct("batch_id", "parts", "total_size_bytes", "max_part")).alias("last")
    return written.groupBy("stream_id").agg(newest).select(
        "stream_id", "last.parts", "last.total_size_bytes", "last.max_part"
    )


# Metrics


@query
def chunk_counters(spark, sf_dir):
    return metrics.chunk_counters(s.part_ledger(spark, sf_dir))


@query
def failed_operations(spark, sf_dir):
    samples = metrics.operation_types(s.failed_ops(spark, sf_dir))
    return metrics.failed_operations(samples)


@query
def stream_outcomes(spark, sf_dir):
    return metrics.stream_outcomes(s.status_log(spark, sf_dir))


@query
def active_gauge(spark, sf_dir):
    routed = events.route_events(s.lifecycle_feed(spark, sf_dir))
    return times_as_text(metrics.active_gauge(routed))


@query
def duration_histogram(spark, sf_dir):
    probed = s.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("label"), F.col("value").cast("decimal(18,2)").alias("seconds")
    )
    return _sum_as_text(metrics.histogram(probed, "seconds", DURATION_BUCKETS, ["label"]))


@query
def processing_time(spark, sf_dir):
    taken = metrics.processing_time(*s.logged_streams(spark, sf_dir))
    return taken.withColumn("processing_seconds", F.floor("processing_seconds"))


@query
def processing_time_histogram(spark, sf_dir):
    taken = metrics.processing_time(*s.logged_streams(spark, sf_dir)).withColumn(
        "seconds", F.col("processing_seconds").cast("decimal(18,2)")
    )
    return _sum_as_text(metrics.histogram(taken, "seconds", PROCESSING_TIME_BUCKETS))


def _sum_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("observed_sum", F.col("observed_sum").cast("decimal(28,2)").cast("string"))


def _document_chunks(spark, sf_dir) -> DataFrame:
    return chunks.slice_chunks(chunks.plan_chunks(s.document_files(spark, sf_dir), CHUNK))
