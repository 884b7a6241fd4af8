"""Logical tables of the data model, read from the TPC-H-like test tables.

Every one covers its whole source table: values are mapped, no row is left out
but for a condition that has a meaning (an error event, an open order line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "media"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    """A table read as a stream. The pattern matches its exact name only; a stream
    over a plain path would have to be a folder."""
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema).options(**options)
    return stream.parquet(f"{sf_dir}/{name}.parque[t]")


def _path(key: str) -> Column:
    return F.concat(F.lit("/watch/"), F.col(key).cast("string"), F.lit(".mp4"))


def stream_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as streams, with gaps in the fields by order priority."""
    o = table(spark, sf_dir, "orders")
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    medium = F.col("o_orderpriority") == "3-MEDIUM"
    open_, pending = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "P"
    started = F.col("o_orderdate").cast("timestamp")
    busy = F.make_dt_interval(secs=F.floor("o_totalprice"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("stream_id"),
        F.when(open_ & (F.col("o_totalprice") < 10000), F.lit(None).cast("string"))
        .otherwise(_path("o_orderkey"))
        .alias("original_path"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.md5(F.col("o_orderkey").cast("string"))).alias(
            "s3_upload_id"
        ),
        F.lit(BUCKET).alias("s3_bucket"),
        F.concat(
            F.lit("streams/"),
            F.col("o_orderkey").cast("string"),
            F.lit("/"),
            F.col("o_orderkey").cast("string"),
            F.lit(".mp4"),
        ).alias("s3_key_prefix"),
        F.when(open_, "active")
        .when(pending, "pending_completion")
        .when(urgent, "failed_failed_meta_upload")
        .when(high, "s3_completed")
        .when(medium, "interrupted_shutdown_write")
        .otherwise("failed_chunk_processing_failure")
        .alias("status"),
        started.alias("started_at"),
        F.when(open_ & medium, F.lit(None).cast("timestamp"))
        .otherwise(started + busy)
        .alias("last_activity_at"),
        F.lit(None).cast("bigint").alias("total_bytes_expected"),
        F.when(~medium, F.floor(F.col("o_totalprice") / 1000)).cast("bigint").alias("total_bytes_sent"),
        F.when(~high, F.floor(F.col("o_totalprice") / 100000) + 1).cast("int").alias("next_part_to_upload"),
        F.when((F.col("o_orderstatus") == "F") & urgent, "failed_meta_upload")
        .when((F.col("o_orderstatus") == "F") & ~(high | medium), "chunk_processing_failure")
        .alias("failure_reason"),
    )


def as_part_ledger(lines: DataFrame) -> DataFrame:
    """Order lines as uploaded parts; also used on the streaming read."""
    return lines.select(
        F.col("l_orderkey").cast("string").alias("stream_id"),
        F.col("l_linenumber").alias("part_number"),
        F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")).alias("etag"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        F.col("l_shipdate").cast("timestamp").alias("uploaded_at"),
    )


def part_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as uploaded parts; a repeated line number is a re-upload."""
    return as_part_ledger(table(spark, sf_dir, "lineitem"))


def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with failed uploads: lines at the top tax rate have no etag."""
    li = table(spark, sf_dir, "lineitem")
    tag = F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("stream_id"),
        F.col("l_linenumber").alias("part_number"),
        F.when(~((F.col("l_tax") >= 0.08) & (F.col("l_returnflag") == "R")), tag).alias("etag"),
        F.col("l_quantity").cast("bigint").alias("size_bytes"),
        F.col("l_shipdate").cast("timestamp").alias("uploaded_at"),
    )


def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as packed strings, some legacy and some malformed."""
    li = table(spark, sf_dir, "lineitem")
    tag = F.md5(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"))
    size = F.col("l_quantity").cast("bigint").cast("string")
    when = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    line, returned = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_orderkey").cast("string").alias("stream_id"),
        F.when((line == 4) & returned, "abc").otherwise(line.cast("string")).alias("part_key"),
        F.when(line == 7, F.concat_ws(":", tag, size))
        .when((line == 6) & returned, tag)
        .when((line == 5) & returned, F.concat_ws(":", tag, F.lit("xyz"), when))
        .otherwise(F.concat_ws(":", tag, size, when))
        .alias("packed"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order with lines; all lines together are its size."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("size"),
        F.max("l_shipdate").cast("timestamp").alias("modified_at"),
    ).select(
        _path("l_orderkey").alias("path"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(".mp4")).alias("file_name"),
        "size",
        "modified_at",
    )


def tracked_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with an open stream: urgent orders, and high ones under another id."""
    o = table(spark, sf_dir, "orders").filter(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    other = F.col("o_orderpriority") == "2-HIGH"
    key = F.col("o_orderkey").cast("string")
    return o.select(
        _path("o_orderkey").alias("path"),
        F.when(other, F.concat(F.lit("other-"), key)).otherwise(key).alias("stream_id"),
    )


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        _path("user_id").alias("path"),
        "event_type",
    )


def as_raw_changes(feed: DataFrame) -> DataFrame:
    """Rows of ``events`` as raw changes; also used on the streaming read."""
    kind = (
        F.when(F.col("event_type") == "signup", "added")
        .when(F.col("event_type") == "error", "deleted")
        .otherwise("modified")
    )
    return feed.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        _path("user_id").alias("path"),
        kind.alias("kind"),
    )


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_changes(table(spark, sf_dir, "events"))


def lifecycle_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` taken as lifecycle events directly, so repeats and strays occur."""
    event = (
        F.when(F.col("event_type") == "signup", "CREATE")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("WRITE")
    )
    return _feed(spark, sf_dir).select("seq", "ts", "path", event.alias("event"))


def open_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose last event is a purchase: the ones that stay tracked."""
    last = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
        .filter(F.col("last.event_type") == "purchase")
    )
    return last.select(
        _path("user_id").alias("path"), F.col("user_id").cast("string").alias("stream_id")
    )


def _with_number(events: DataFrame) -> DataFrame:
    """The number in the properties, read once per row."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as status changes of one stream per user."""
    k, kind = F.col("k"), F.col("event_type")
    reason = F.when(kind == "error", F.when(k < 50, "finalize_s3_failure").otherwise("chunk_processing_failure"))
    return _with_number(table(spark, sf_dir, "events")).select(
        F.col("user_id").cast("string").alias("stream_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "active")
        .when(kind == "click", "pending_completion")
        .when(kind == "purchase", "completed_with_meta")
        .when(kind == "view", "interrupted_cancelled_finalize")
        .otherwise(F.concat(F.lit("failed_"), reason))
        .alias("status"),
        reason.alias("failure_reason"),
    )


def logged_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Streams with their first time and last status, and the log that names both."""
    log = status_log(spark, sf_dir)
    state = log.groupBy("stream_id").agg(
        F.min("ts").alias("started_at"), F.max_by("status", F.struct("ts", "seq")).alias("status")
    )
    return state, log


def failed_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as failed operations, by the number in their properties."""
    k = F.col("k")
    e = _with_number(table(spark, sf_dir, "events").filter(F.col("event_type") == "error"))
    return e.select(
        F.col("user_id").cast("string").alias("stream_id"),
        F.when(k < 15, "open_stream")
        .when(k < 30, "init_checkpoint")
        .when(k < 50, "write")
        .when(k < 75, "finalize")
        .when(k < 82, "resume")
        .when(k < 86, "task")
        .when(k < 89, "finalize_file_check")
        .when(k < 92, "complete_upload")
        .when(k < 95, "metadata_generation")
        .when(k < 98, "metadata_upload")
        .otherwise("upload_part")
        .alias("operation"),
        F.when(k % 7 == 0, "S3OperationError")
        .when(k % 7 == 1, "RedisOperationError")
        .when(k % 7 == 2, "FFprobeError")
        .when(k % 7 == 3, "FileNotFoundError")
        .when(k % 7 == 4, "CancelledError")
        .when(k % 7 == 5, "StreamInitializationError")
        .otherwise("ValueError")
        .alias("error_class"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as media-probe runs with good, empty, wrong and failed output."""
    kind = F.col("event_type")
    number = F.col("value").cast("decimal(12,2)").cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/watch/e"), F.col("event_id").cast("string"), F.lit(".mp4")).alias("path"),
        F.when(kind == "error", 1).otherwise(0).alias("return_code"),
        F.when(kind == "view", "")
        .when(kind == "click", "N/A")
        .otherwise(F.concat(F.lit(" "), number, F.lit("\n")))
        .alias("stdout"),
        F.when(kind == "error", " no such file\n").otherwise("").alias("stderr"),
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed seconds of the order files; some files were never probed."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") != "5-LOW")
    return o.select(
        _path("o_orderkey").alias("path"),
        F.floor(F.col("o_totalprice") / 100).cast("double").alias("duration_seconds"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with their bytes."""
    data = F.encode("text", "utf-8")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("stream_id"),
        F.octet_length("text").cast("bigint").alias("size"),
        data.alias("data"),
    )


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of up to a thousand ids of one source, in the order of ids."""
    d = table(spark, sf_dir, "documents")
    block = F.call_function("div", F.col("doc_id"), F.lit(1000)).cast("string")
    return (
        d.filter(F.col("text").isNotNull())
        .groupBy(F.concat_ws("-", F.coalesce("source", F.lit("none")), block, F.lit("f")).alias("stem"))
        .agg(F.expr("listagg(encode(text, 'utf-8')) WITHIN GROUP (ORDER BY doc_id)").alias("data"))
        .select(F.concat("stem", F.lit(".mp4")).alias("file_name"), "data")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two inventories of the same files: by an early date, and of open lines."""
    li = table(spark, sf_dir, "lineitem")

    def inventory(rows: DataFrame) -> DataFrame:
        return rows.groupBy("l_orderkey").agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("size"),
            F.max("l_shipdate").cast("timestamp").alias("modified_at"),
        ).select(_path("l_orderkey").alias("path"), "size", "modified_at")

    early = li.filter(F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"))
    return inventory(early), inventory(li.filter(F.col("l_linestatus") == "O"))
