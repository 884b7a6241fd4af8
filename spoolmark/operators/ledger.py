"""The chunk ledger: parse, dedupe, order, total, checkpoint, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import number_block, present
from ..plans.running import with_running
from ..schemas import PARTS_PER_PAGE

# Last write wins; equal times fall back to the values, so the order is total.
UPLOAD_ORDER = ("uploaded_at", "etag", "size_bytes")


def latest_parts(
    ledger: DataFrame,
    keys: Sequence[str] = ("stream_id", "part_number"),
    order: Sequence[str] = UPLOAD_ORDER,
) -> DataFrame:
    """One row per (stream, part): the last upload.

    The rank filter becomes a group limit before the shuffle, so a part that was
    uploaded any number of times sends one row per input task.
    """
    last_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    ranked = ledger.withColumn("_rank", F.row_number().over(last_first))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def parse_part_records(raw: DataFrame) -> DataFrame:
    """Typed columns of packed ``etag:size:time`` strings, in one pass.

    ``reject_reason`` is null on good rows; see ``accepted`` and ``quarantined``.
    The time may itself hold colons; without a second colon it is absent.
    """
    fields = raw.withColumn("_fields", F.split(F.col("packed"), ":", 3))
    texts = fields.select(
        *[F.col(c) for c in raw.columns],
        F.col("part_key").try_cast("int").alias("part_number"),
        F.get("_fields", F.lit(0)).alias("etag"),
        F.get("_fields", F.lit(1)).alias("_size"),
        F.get("_fields", F.lit(2)).alias("uploaded_at_text"),
    )
    typed = texts.withColumn("size_bytes", F.col("_size").try_cast("bigint")).withColumn(
        "uploaded_at", F.col("uploaded_at_text").try_cast("timestamp")
    )
    return typed.withColumn(
        "reject_reason",
        F.when(F.col("_size").isNull(), "no_size_field")
        .when(F.col("part_number").isNull(), "bad_part_number")
        .when(F.col("size_bytes").isNull(), "bad_size"),
    ).drop("_size")


def accepted(parsed: DataFrame) -> DataFrame:
    """The good rows of ``parse_part_records`` as a part ledger."""
    return parsed.filter(F.col("reject_reason").isNull()).select(
        "stream_id", "part_number", "etag", "size_bytes", "uploaded_at", "uploaded_at_text"
    )


def quarantined(parsed: DataFrame) -> DataFrame:
    """The rejected rows of ``parse_part_records`` with the reason."""
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        "stream_id", "part_key", "packed", "reject_reason"
    )


def upload_progress(uploads: DataFrame, parts_per_block: int = PARTS_PER_PAGE) -> DataFrame:
    """Bytes sent, next part and last activity after each committed part.

    ``uploads`` is the upload log; an upload without an etag failed. Only the
    prefix before a stream's first failed part counts. The last success of a part
    decides, and a part has failed only without one, so a block holds at most
    ``parts_per_block`` rows.
    """
    tried = uploads.withColumn("_good", F.coalesce(present(F.col("etag")), F.lit(False)))
    parts = latest_parts(tried, order=("_good", *UPLOAD_ORDER)).drop("_good")
    progress = with_running(
        parts,
        keys=["stream_id"],
        block=number_block(F.col("part_number"), parts_per_block, first=1),
        order=["part_number"],
        sums={
            "bytes_sent": F.col("size_bytes"),
            "_failed": F.when(present(F.col("etag")), 0).otherwise(1),
        },
        maxima={"last_activity_at": F.col("uploaded_at")},
    )
    return (
        progress.filter(F.col("_failed") == 0)
        .drop("_failed")
        .withColumn("next_part", F.col("part_number") + 1)
    )


def stream_totals(ledger: DataFrame) -> DataFrame:
    """Parts, bytes and highest part of each stream."""
    return ledger.groupBy("stream_id").agg(
        F.count("*").alias("parts"),
        F.sum("size_bytes").alias("total_size_bytes"),
        F.max("part_number").alias("max_part"),
    )


def resume_positions(meta: DataFrame, ledger: DataFrame, strict: bool = True) -> DataFrame:
    """Offset and next part each stream continues from.

    Stored values win over those derived from the parts. A missing byte counter
    reads as 0 when ``strict``, and as the sum of the parts otherwise.
    """
    derived_offset = F.lit(0) if strict else F.coalesce("total_size_bytes", F.lit(0))
    stored = meta.select("stream_id", "total_bytes_sent", "next_part_to_upload")
    return stored.join(stream_totals(ledger), "stream_id", "left").select(
        "stream_id",
        F.coalesce("total_bytes_sent", derived_offset).cast("bigint").alias("resume_offset"),
        F.coalesce("next_part_to_upload", F.col("max_part") + 1, F.lit(1))
        .cast("int")
        .alias("next_part"),
        F.coalesce("parts", F.lit(0)).cast("bigint").alias("known_parts"),
    )


def audit_ledger(ledger: DataFrame, files: DataFrame, meta: DataFrame) -> DataFrame:
    """Gaps, repeats, size mismatch and counter mismatch of each stream.

    Every part also asks for its successor; a number asked for but not present
    starts a gap. That finds gaps by one grouping on (stream, number) and never
    sorts a whole stream. ``meta`` names each stream's file and byte counter.
    """
    parts = ledger.groupBy("stream_id", "part_number").agg(
        F.count("*").alias("uploads"),
        F.max(F.struct(*UPLOAD_ORDER)).getField("size_bytes").alias("size_bytes"),
    )
    marks = F.array(
        F.struct(F.col("part_number").alias("n"), F.col("uploads"), F.col("size_bytes")),
        F.struct(
            (F.col("part_number") + 1).alias("n"),
            F.lit(0).cast("bigint").alias("uploads"),
            F.lit(0).cast("bigint").alias("size_bytes"),
        ),
    )
    numbered = (
        parts.select("stream_id", F.explode(marks).alias("_mark"))
        .groupBy("stream_id", F.col("_mark.n").alias("n"))
        .agg(F.sum("_mark.uploads").alias("uploads"), F.sum("_mark.size_bytes").alias("size_bytes"))
    )
    here = F.col("uploads") > 0
    per_stream = numbered.groupBy("stream_id").agg(
        F.sum("uploads").alias("uploads"),
        F.count_if(here).alias("distinct_parts"),
        F.max(F.when(here, F.col("n"))).alias("max_part"),
        F.min(F.when(here, F.col("n"))).alias("min_part"),
        F.min(F.when(~here, F.col("n"))).alias("first_absent"),
        F.sum("size_bytes").alias("ledger_bytes"),
    )
    known = meta.select("stream_id", F.col("original_path").alias("path"), "total_bytes_sent")
    sizes = files.select("path", F.col("size").alias("file_bytes"))
    first_gap = F.when(F.col("min_part") > 1, F.lit(1)).otherwise(
        F.when(F.col("first_absent") < F.col("max_part"), F.col("first_absent"))
    )
    return (
        known.join(per_stream, "stream_id", "left")
        .join(sizes, "path", "left")
        .select(
            "stream_id",
            F.coalesce("uploads", F.lit(0)).cast("bigint").alias("uploads"),
            F.coalesce("distinct_parts", F.lit(0)).cast("bigint").alias("distinct_parts"),
            F.coalesce(F.col("uploads") - F.col("distinct_parts"), F.lit(0))
            .cast("bigint")
            .alias("repeats"),
            F.coalesce(F.col("max_part") - F.col("distinct_parts"), F.lit(0))
            .cast("bigint")
            .alias("missing_parts"),
            first_gap.cast("int").alias("first_gap"),
            F.coalesce("ledger_bytes", F.lit(0)).cast("bigint").alias("ledger_bytes"),
            F.col("file_bytes"),
            (~F.coalesce("ledger_bytes", F.lit(0)).eqNullSafe(F.col("file_bytes"))).alias(
                "size_mismatch"
            ),
            (
                ~F.coalesce("ledger_bytes", F.lit(0)).eqNullSafe(
                    F.coalesce("total_bytes_sent", F.lit(0))
                )
            ).alias("counter_mismatch"),
        )
    )
