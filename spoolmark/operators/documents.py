"""Metadata documents of finished streams, and media-probe results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import BLANKS, all_present, metadata_key
from ..schemas import CHUNK, METADATA_DOCUMENT, PARTS_PER_PAGE, STORED_DOCUMENT, STORED_TIME
from .chunks import page_of
from .ledger import latest_parts


def metadata_documents(
    state: DataFrame,
    ledger: DataFrame,
    durations: DataFrame,
    processed_at: datetime.datetime | str | Column,
    parts_per_page: int = PARTS_PER_PAGE,
) -> DataFrame:
    """One nested document per stream; no state row, no document.

    The last upload of each part counts; ``durations`` has one row per path. A
    stream within the object-store limit on parts has one row (``page`` 0). A
    longer one has one row per page of parts, so that no row grows without
    bound; the totals on every page are those of the whole stream.
    """
    entry = F.struct("part_number", "size_bytes", "etag", "uploaded_at")
    page = F.coalesce(page_of(F.col("part_number"), parts_per_page), F.lit(0))
    parts = latest_parts(ledger.filter(all_present("stream_id", "part_number")))
    # Spread by page, not by stream. The totals are taken from the pages, so that
    # both read one shuffle and the ledger is deduplicated once.
    pages = (
        parts.withColumn("page", page)
        .repartition("stream_id", "page")
        .groupBy("stream_id", "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("chunks"))
    )
    page_bytes = F.aggregate(
        "chunks",
        F.lit(0).cast("bigint"),
        lambda total, chunk: total + F.coalesce(chunk["size_bytes"], F.lit(0)),
    )
    totals = (
        pages.select("stream_id", "page", page_bytes.alias("_bytes"), F.size("chunks").alias("_parts"))
        .groupBy("stream_id")
        .agg(
            F.sum("_bytes").alias("total_size_bytes"),
            F.sum("_parts").alias("total_chunks"),
            F.max("page").alias("_last_page"),
        )
    )
    timings = durations.select(F.col("path").alias("original_path"), "duration_seconds")
    heads = (
        state.select(
            "stream_id",
            "original_path",
            "s3_bucket",
            "s3_key_prefix",
            "started_at",
            "last_activity_at",
        )
        .join(timings, "original_path", "left")
        .join(totals, "stream_id", "left")
        .withColumn(
            "page",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last_page", F.lit(0)))),
        )
    )
    moment = processed_at if isinstance(processed_at, Column) else F.lit(processed_at)
    # A page of a stream may be absent from the ledger; only page 0 stands for
    # the stream itself and stays without chunks.
    return (
        heads.join(pages, ["stream_id", "page"], "left")
        .filter((F.col("page") == 0) | F.col("chunks").isNotNull())
        .select(
            "stream_id",
            "page",
            F.col("original_path").alias("original_file_path"),
            "s3_bucket",
            "s3_key_prefix",
            F.coalesce("total_size_bytes", F.lit(0)).cast("bigint").alias("total_size_bytes"),
            F.coalesce("total_chunks", F.lit(0)).cast("bigint").alias("total_chunks"),
            "duration_seconds",
            moment.cast("timestamp").alias("processed_at"),
            F.col("started_at").alias("stream_started_at"),
            F.col("last_activity_at").alias("stream_completed_at"),
            F.coalesce("chunks", F.array().cast(f"array<{CHUNK.simpleString()}>")).alias("chunks"),
        )
    )


def stored_form(documents: DataFrame) -> DataFrame:
    """Key and page of each document, and the document with its stored names."""
    fields = [
        F.col(ours.name).cast(stored.dataType).alias(stored.name)
        for ours, stored in zip(METADATA_DOCUMENT.fields, STORED_DOCUMENT.fields)
    ]
    first = metadata_key(F.col("s3_key_prefix"))
    later = F.concat(first, F.lit(".page"), F.col("page").cast("string"))
    return documents.select(
        F.when(F.col("page") > 0, later).otherwise(first).alias("metadata_key"),
        "page",
        F.struct(*fields).alias("document"),
    )


def document_json(documents: DataFrame) -> DataFrame:
    """The stored form with the document as JSON text, nulls kept."""
    options = {"ignoreNullFields": "false", "timestampFormat": STORED_TIME}
    return stored_form(documents).withColumn("document", F.to_json("document", options))


def from_stored_form(stored: DataFrame) -> DataFrame:
    """Documents back from their stored form, as text or nested."""
    if isinstance(stored.schema["document"].dataType, T.StringType):
        parsed = F.from_json("document", STORED_DOCUMENT, {"timestampFormat": STORED_TIME})
        stored = stored.withColumn("document", parsed)
    fields = [
        F.col(f"document.{kept.name}").cast(ours.dataType).alias(ours.name)
        for ours, kept in zip(METADATA_DOCUMENT.fields, STORED_DOCUMENT.fields)
    ]
    return stored.select(*fields)


def flatten_chunks(documents: DataFrame) -> DataFrame:
    """One row per chunk of each document; one row of nulls where it has none.

    Takes documents, or their stored form.
    """
    if "chunks" not in documents.columns:
        documents = from_stored_form(documents)
    return documents.select("stream_id", F.explode_outer("chunks").alias("_chunk")).select(
        "stream_id", *[F.col(f"_chunk.{f.name}").alias(f.name) for f in CHUNK.fields]
    )


#: A decimal number, or a name of one that is not finite; no type suffix as in 1.0d.
NUMBER = r"^(?i)[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def probe_results(rows: DataFrame) -> DataFrame:
    """Duration or error text of each media-probe run.

    Exit code 0 and some output are required; the trimmed output must be a number.
    """
    text = F.btrim(F.col("stdout"), F.lit(BLANKS))
    answered = (F.col("return_code") == 0) & (F.length(F.coalesce("stdout", F.lit(""))) > 0)
    duration = F.when(answered & text.rlike(NUMBER), text.try_cast("double"))
    failed = F.concat(
        F.lit("ffprobe error (return code "),
        F.coalesce(F.col("return_code").cast("string"), F.lit("unknown")),
        F.lit("): "),
        F.btrim(F.coalesce("stderr", F.lit("")), F.lit(BLANKS)),
    )
    invalid = F.concat(F.lit("ffprobe output is not a valid float: "), text)
    return rows.select(
        "path",
        duration.alias("duration_seconds"),
        F.when(~F.coalesce(answered, F.lit(False)), failed)
        .when(duration.isNull(), invalid)
        .alias("error"),
    )
