"""Lifecycle events of paths, in batch form.

Events are ordered by (ts, seq). A busy path is cut into blocks of about
``rows_per_block`` events, also within one instant, so the work on it spreads over
tasks. Events without a path or a time have no place in that order: ``unplaced_events``
returns them with the reason, so that no row vanishes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.running import ROWS_PER_BLOCK, unplaced, with_running_in_order

ORDER = ("ts", "seq")


def known_before(previous: Column, removed: str) -> Column:
    """A path is known when something came before and it was not a removal."""
    return previous.isNotNull() & (previous != removed)


def unplaced_events(events: DataFrame) -> DataFrame:
    """Rows of a feed that no operator here can order, with ``reject_reason``."""
    return unplaced(events, ["path"], ORDER)


def classify_changes(raw: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """CREATE, WRITE and DELETE events of a raw change feed.

    A raw row gives none, one or two events; ``step`` orders the two. Each event
    carries the generation of its path, counted in the same pass.
    """
    seen = with_running_in_order(
        raw.select("seq", "ts", "path", "kind"),
        ["path"],
        ORDER,
        rows_per_block,
        sums={"_removals": F.when(F.col("kind") == "deleted", 1).otherwise(0)},
        previous={"_previous": F.col("kind")},
    )
    known = known_before(F.col("_previous"), "deleted")
    names = (
        F.when(F.col("kind") == "deleted", F.array(F.lit("DELETE")))
        .when((F.col("kind") == "modified") & known, F.array(F.lit("WRITE")))
        .when(F.col("kind") == "modified", F.array(F.lit("CREATE"), F.lit("WRITE")))
        .when((F.col("kind") == "added") & ~known, F.array(F.lit("CREATE")))
    )
    own = F.when(F.col("kind") == "deleted", 1).otherwise(0)
    return seen.select(
        "seq",
        "ts",
        "path",
        (F.col("_removals") - own).cast("bigint").alias("generation"),
        F.posexplode(names).alias("step", "event"),
    )


def stream_generations(events: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Which re-creation of its path an event belongs to.

    A DELETE belongs to the generation it closes; repeated CREATEs do not count.
    """
    own = F.when(F.col("event") == "DELETE", 1).otherwise(0)
    counted = with_running_in_order(
        events,
        ["path"],
        ORDER,
        rows_per_block,
        sums={"_removals": own},
    )
    return counted.withColumn("generation", (F.col("_removals") - own).cast("bigint")).drop(
        "_removals"
    )


def route_events(
    events: DataFrame, tracked: DataFrame | None = None, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """What each event leads to.

    With ``tracked`` every event is judged against that snapshot; without it,
    a path is tracked when its previous event was not a DELETE.
    """
    if tracked is None:
        placed = with_running_in_order(
            events,
            ["path"],
            ORDER,
            rows_per_block,
            previous={"_previous": F.col("event")},
        )
        placed = placed.withColumn("_open", known_before(F.col("_previous"), "DELETE")).drop(
            "_previous"
        )
    else:
        open_paths = tracked.select("path", "stream_id").withColumn("_open", F.lit(True))
        placed = events.join(open_paths, "path", "left").withColumn(
            "_open", F.coalesce("_open", F.lit(False))
        )
    is_open = F.col("_open")
    action = (
        F.when((F.col("event") == "CREATE") & is_open, "ignore")
        .when(F.col("event") == "CREATE", "open")
        .when((F.col("event") == "WRITE") & is_open, "process")
        .when(F.col("event") == "WRITE", "reopen")
        .when((F.col("event") == "DELETE") & is_open, "close")
        .otherwise("none")
    )
    return placed.withColumn("action", action).drop("_open")


def dedupe_creates(events: DataFrame) -> DataFrame:
    """Events without the repeated CREATEs of a (path, generation).

    Only CREATE rows are ranked; the rank filter limits each group before the
    shuffle. The other events pass through.
    """
    first = Window.partitionBy("path", "generation").orderBy(*ORDER)
    creates = events.filter(F.col("event") == "CREATE")
    kept = creates.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") == 1)
    others = events.filter(~F.col("event").eqNullSafe("CREATE"))
    return kept.drop("_rank").unionByName(others)


def untracked_events(events: DataFrame, tracked: DataFrame) -> DataFrame:
    """WRITE and DELETE events of paths without an open stream."""
    return events.filter(F.col("event").isin("WRITE", "DELETE")).join(
        tracked.select("path"), "path", "left_anti"
    )


def closed_streams(events: DataFrame, tracked: DataFrame) -> DataFrame:
    """Status rows of tracked streams whose file was deleted.

    The first DELETE of a path closes its stream; a later one finds none. The
    deletes are combined to one per path before they meet ``tracked``.
    """
    deleted = (
        events.filter(F.col("event") == "DELETE")
        .groupBy("path")
        .agg(F.min(F.struct(*ORDER)).alias("_first"))
    )
    return tracked.join(deleted, "path").select(
        "stream_id",
        "path",
        F.col("_first.ts").alias("ts"),
        F.col("_first.seq").alias("seq"),
        F.lit("deleted_locally").alias("status"),
    )
