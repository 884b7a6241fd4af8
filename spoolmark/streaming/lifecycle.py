"""Streaming forms of the event operators.

They go by event time: ``delay`` is how late a row may come, and what they emit
follows from the rows alone, not from the batches they came in. The last ``delay``
of a feed stays pending until the feed goes on or is closed (``close_feed``).
"""

from __future__ import annotations

import bisect
import datetime
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.running import unplaced
from ..schemas import RAW_CHANGES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EVENTS = "seq BIGINT, micros BIGINT, path STRING, generation BIGINT, step INT, event STRING"
_STATE = "known BOOLEAN, generation BIGINT, micros ARRAY<BIGINT>, seqs ARRAY<BIGINT>, kinds ARRAY<STRING>"
#: Kind of the row that closes a feed; it is of no path.
END_OF_FEED = "end"


def close_feed(spark: SparkSession, closing_dir: str, as_of: datetime.datetime | str) -> None:
    """Say that a feed is complete up to ``as_of``: what is pending before then is released.

    The row is read by ``with_closing``. It is to be written after the feed's own
    rows were taken in, since rows that come later than it are late.
    """
    end = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("seq"),
        F.lit(as_of).cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("path"),
        F.lit(END_OF_FEED).alias("kind"),
    )
    end.write.mode("append").parquet(closing_dir)


def with_closing(raw: DataFrame, closing_dir: str) -> DataFrame:
    """A feed and the rows of ``close_feed``; the folder may be empty as yet."""
    closing = raw.sparkSession.readStream.schema(RAW_CHANGES).parquet(closing_dir)
    return raw.select(*RAW_CHANGES.fieldNames()).unionByName(closing)


def _placed(raw: DataFrame, delay: str) -> DataFrame:
    """Rows with a place in the order, below a watermark that closing rows raise too."""
    marked = raw.withWatermark("ts", delay)
    # One test of both columns: a test of the path alone would move below the
    # watermark and hide the closing rows from it.
    both = F.array_compact(F.array("path", F.col("ts").cast("string")))
    return marked.filter(F.size(both) == 2)


def _walk(rows: list, path: str, known: bool, generation: int) -> tuple[list, bool, int]:
    """Events of ordered rows of one path, given what is known of it."""
    made = []
    for micros, seq, kind in rows:
        deleted = kind == "deleted"
        steps = ["CREATE"] if not deleted and not known else []
        if deleted or kind == "modified":
            steps.append("DELETE" if deleted else "WRITE")
        made += [(seq, micros, path, generation, n, event) for n, event in enumerate(steps)]
        known, generation = not deleted, generation + deleted
    return made, known, generation


def _classify_path(key, frames, state) -> Iterator[pd.DataFrame]:
    """Hold the rows of a path until the watermark has passed them, then walk them in order."""
    known, generation, *held = state.get if state.exists else (False, 0, [], [], [])
    rows = list(zip(*held))
    if not state.hasTimedOut:
        for frame in frames:
            rows += zip(*(frame[c].tolist() for c in ("micros", "seq", "kind")))
    rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
    passed = state.getCurrentWatermarkMs()
    ready = bisect.bisect_right(rows, passed * 1000, key=lambda r: r[0])
    made, known, generation = _walk(rows[:ready], key[0], known, generation)
    waiting = rows[ready:]
    columns = [list(c) for c in zip(*waiting)] or [[], [], []]
    state.update((bool(known), int(generation), *columns))
    if waiting:
        state.setTimeoutTimestamp(max(-(-waiting[0][0] // 1000), passed + 1))
    if made:
        yield pd.DataFrame(made, columns=["seq", "micros", "path", "generation", "step", "event"])


def classify_stream(raw: DataFrame, delay: str = "1 minute") -> DataFrame:
    """``classify_changes`` over a stream, whatever the batches and the order of arrival.

    Rows wait in the state of their path and are walked in (ts, seq) order once the
    watermark, ``delay`` behind the latest row, has passed them; a row that comes
    later than that is dropped by the watermark, as in any windowed stream. A task
    holds what one path changed within ``delay`` and one batch. A path keeps one
    small row of state for good: forgetting it would turn its next change into a
    CREATE, and its next generation into a repeat of the first. Rows without a path
    or a time are returned by ``unplaced_stream``.
    """
    placed = _placed(raw, delay).select("ts", "path", F.unix_micros("ts").alias("micros"), "seq", "kind")
    made = placed.groupBy("path").applyInPandasWithState(
        _classify_path, _EVENTS, _STATE, "append", "EventTimeTimeout"
    )
    return made.select("seq", F.timestamp_micros("micros").alias("ts"), "path", "generation", "step", "event")


def unplaced_stream(raw: DataFrame) -> DataFrame:
    """Rows of a feed that no operator here can order, with ``reject_reason``; no state."""
    return unplaced(raw, ["path"], ["ts"]).filter(~F.col("kind").eqNullSafe(END_OF_FEED))


def dedupe_creates_stream(events: DataFrame, delay: str) -> DataFrame:
    """Repeated CREATEs of a (path, generation) dropped; others pass through.

    A repeat is recognised while it lies within ``delay`` of the first.
    """
    creates = events.filter(F.col("event") == "CREATE").withWatermark("ts", delay)
    others = events.filter(F.col("event") != "CREATE")
    return creates.dropDuplicatesWithinWatermark(["path", "generation"]).unionByName(others)


def idle_events(events: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """An IDLE event per path once a burst of activity has closed.

    Emitted when the watermark, ``delay`` behind the latest event, passes the
    end of the session. The last session of a path stays pending until the feed
    goes on or is closed ``delay`` and ``gap_seconds`` after it. With the settings
    ``session.STATEFUL`` events of one partition are merged into sessions before
    the shuffle, so a busy path sends its bursts rather than its events.
    """
    return (
        _placed(events, delay)
        .groupBy("path", F.session_window("ts", f"{gap_seconds} seconds").alias("session"))
        .agg(F.count("*").alias("events"))
        .select(
            "path",
            F.lit("IDLE").alias("event"),
            F.col("session.start").alias("session_start"),
            F.col("session.end").alias("idle_at"),
            "events",
        )
    )
