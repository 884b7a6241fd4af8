"""Bursts of activity, split by the idle timeout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MICROS
from ..plans.running import ROWS_PER_BLOCK, SPREAD, spread_over_time


def activity_sessions(
    events: DataFrame, gap_seconds: int, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Sessions per path; events exactly one gap apart belong together.

    The same sessions as a session window with that gap. A session window sorts
    every event of a path in one task; here events of one instant are counted
    together first, a busy path is cut into blocks and each block into bursts, and
    only one row per block is ordered per path, to tell which bursts continue
    across a block's edge. Events without a path or a time are in no session;
    ``events.unplaced_events`` returns them.
    """
    gap = gap_seconds * MICROS
    in_block = Window.partitionBy("path", "_block").orderBy("ts")
    instants = events.groupBy("path", "ts").agg(F.count("*").alias("_n"))
    spread = spread_over_time(instants, ["path"], "ts", rows_per_block)
    stepped = spread.withColumnRenamed(SPREAD, "_block").withColumn(
        "_pause", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(in_block))
    )
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.col("_pause") > gap, 1).otherwise(0)
    bursts = (
        stepped.withColumn("_burst", F.sum(starts).over(so_far))
        .groupBy("path", "_block", "_burst")
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.sum("_n").alias("_events"))
    )
    blocks = bursts.groupBy("path", "_block").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_burst").alias("_inner")
    )
    by_block = Window.partitionBy("path").orderBy("_block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    edge = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(by_block))
    carried = (
        blocks.withColumn("_head", F.when(edge <= gap, 0).otherwise(1))
        .withColumn(
            "_base",
            F.coalesce(F.sum(F.col("_head") + F.col("_inner")).over(before), F.lit(0))
            + F.col("_head"),
        )
        .select("path", "_block", "_base")
    )
    numbered = bursts.join(carried, ["path", "_block"])
    return numbered.groupBy(
        "path", (F.col("_base") + F.col("_burst")).cast("bigint").alias("session_no")
    ).agg(
        F.min("_from").alias("session_start"),
        (F.max("_to") + F.make_dt_interval(secs=F.lit(gap_seconds))).alias("session_end"),
        F.sum("_events").alias("events"),
    )
