"""Running values per key without one task per key.

A plain window partitioned by the key sends every row of that key to one task,
and one key may hold a third of the table. Here the order is cut into blocks:
each (key, block) is sorted on its own, a summary of one row per (key, block) is
combined map-side, and only the summaries are ordered per key to carry values
from block to block.

Cuts come from a sample of places in the whole order, ties included: see
``spread_in_order``. So a burst within one instant is cut like any other stretch,
and there are at most ``MAX_BLOCKS`` cuts in all, whatever the table. Work
without a key (one run over everything) carries that many summaries at most.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import all_present

BLOCK = "_block"
SPREAD = "_spread"
# Places drawn from a whole table, in strata of their hash, and the fewest in a block.
SAMPLED = 16_384
_STRATA = 64
_LEAST_SAMPLES = 4
MAX_BLOCKS = SAMPLED // _LEAST_SAMPLES
# Rows of one key that a task sorts, where the table is not larger than as many blocks.
ROWS_PER_BLOCK = 1_000_000


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add running columns to ``df``.

    ``block`` must not decrease along ``order``, and ``order`` must be total
    within a key. ``sums`` and ``maxima`` include the current row; ``previous``
    is the value on the row before, null on the first. A row without a key or
    without a place in the order belongs to no run and is left out. ``whole`` says
    that each key has one block, so that nothing needs to be carried.
    """
    sums, maxima, previous = dict(sums or {}), dict(maxima or {}), dict(previous or {})
    # Stated for both branches below, so that they share their input's shuffles.
    tagged = df.filter(all_present(*keys, order[0])).withColumn(BLOCK, block)
    for name, value in {**sums, **maxima, **previous}.items():
        tagged = tagged.withColumn(f"_in_{name}", value)
    place = F.struct(*[F.col(c) for c in order])

    summary = tagged.groupBy(*keys, BLOCK).agg(
        *[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_max_{n}") for n in maxima],
        *(
            [F.max_by(F.struct(*[F.col(f"_in_{n}") for n in previous]), place).alias("_last")]
            if previous
            else []
        ),
    )
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        BLOCK,
        *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in sums],
        *[F.max(f"_max_{n}").over(before).alias(f"_carry_{n}") for n in maxima],
        *([F.lag("_last").over(by_block).alias("_carry_last")] if previous else []),
    )

    in_block = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.select(
        "*",
        *[F.sum(f"_in_{n}").over(so_far).alias(f"_here_{n}") for n in sums],
        *[F.max(f"_in_{n}").over(so_far).alias(f"_here_{n}") for n in maxima],
        *[F.lag(f"_in_{n}").over(in_block).alias(f"_here_{n}") for n in previous],
        *([F.row_number().over(in_block).alias("_nth")] if previous else []),
    )
    if whole:
        return local.select(
            *[F.col(c) for c in df.columns],
            *[F.col(f"_here_{n}").alias(n) for n in (*sums, *maxima, *previous)],
        )
    joined = local.join(carried, [*keys, BLOCK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            (F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) + F.col(f"_here_{n}")).alias(n)
            for n in sums
        ],
        *[F.greatest(F.col(f"_carry_{n}"), F.col(f"_here_{n}")).alias(n) for n in maxima],
        *[
            F.when(F.col("_nth") == 1, F.col("_carry_last").getField(f"_in_{n}"))
            .otherwise(F.col(f"_here_{n}"))
            .alias(n)
            for n in previous
        ],
    )


def _places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the least hashes, ``SAMPLED`` at most: a retried task draws the same ones."""
    spot = F.xxhash64(*keys, *order)
    drawn = df.select(*keys, *order, spot.alias("_spot"), F.pmod(spot, F.lit(_STRATA)).alias("_stratum"))
    least = Window.partitionBy("_stratum").orderBy("_spot")
    return drawn.withColumn("_rank", F.row_number().over(least)).filter(F.col("_rank") <= SAMPLED // _STRATA)


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int) -> dict[tuple, list]:
    """The places, sorted, at which the rows of each busy key are cut.

    The sample comes to the driver, which its size bounds. The largest hash in it
    tells what share of the rows it is, so nothing has to be counted.
    """
    drawn = _places(df, keys, order).toArrow().to_pydict()
    tops: dict[int, list[int]] = {}
    places: dict[tuple, list[tuple]] = {}
    for row in zip(*(drawn[c] for c in (*keys, *order)), drawn["_stratum"], drawn["_spot"]):
        tops.setdefault(row[-2], []).append(row[-1])
        places.setdefault(row[: len(keys)], []).append(row[len(keys) : -2])
    full = [max(spots) for spots in tops.values() if len(spots) == SAMPLED // _STRATA]
    step = rows_per_block
    if full:
        share = sum((top + 2**63) / 2**64 for top in full) / len(full)
        step = max(_LEAST_SAMPLES, math.ceil(share * rows_per_block))
    return {
        key: sorted(found, key=lambda p: [(v is not None, v) for v in p])[step::step]
        for key, found in places.items()
        if len(found) > step
    }


def _block_of(place: Column, starts: Column) -> Column:
    """How many of the sorted ``starts`` are not after ``place``, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(SAMPLED.bit_length()))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(starts, at + step - 1) <= place, at + step).otherwise(at)
    )
    return F.when(starts.isNull(), F.lit(0)).otherwise(found)


def spread_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``_spread``: the block of each row, non-decreasing along ``order`` per key.

    A key has one block unless it holds more than ``rows_per_block`` rows, and more
    than the share of one of ``MAX_BLOCKS`` blocks; then it is cut where a sample of
    its rows lies, so that blocks hold about that many rows however these crowd.
    The list of cuts is bounded by its definition, and is broadcast. A row
    without a key or without a place in the order is left out. The sample is drawn
    when this is called, so a stream has to come batch by batch.
    """
    return _spread(df, keys, order, rows_per_block)[0]


def _spread(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int
) -> tuple[DataFrame, bool]:
    """``spread_in_order``, and whether any key was cut."""
    placed = df.filter(all_present(*keys, order[0]))
    cuts = _cuts(placed, keys, order, rows_per_block)
    if not cuts:
        # Of one run over everything the planner must not see that there is one block,
        # or it would order rows in place of summaries.
        one = F.lit(0) if keys else F.pmod(F.hash(*order), F.lit(1))
        return placed.withColumn(SPREAD, one), False
    types = placed.select(*keys, F.array(F.struct(*order)).alias("_starts")).schema
    busy = df.sparkSession.createDataFrame([(*key, starts) for key, starts in cuts.items()], types)
    if keys:
        known = placed.join(F.broadcast(busy), list(keys), "left")
    else:
        known = placed.withColumn("_starts", busy.select("_starts").scalar())
    spread = known.withColumn(SPREAD, _block_of(F.struct(*order), F.col("_starts")))
    return spread.drop("_starts"), True


def spread_over_time(
    df: DataFrame, keys: Sequence[str], ts: str, rows_per_block: int
) -> DataFrame:
    """``spread_in_order`` by a time alone: rows of one instant share a block."""
    return spread_in_order(df, keys, [ts], rows_per_block)


def with_running_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
    **running: Mapping[str, Column],
) -> DataFrame:
    """``with_running`` along any total order, busy keys cut into blocks of about that size."""
    spread, cut = _spread(df, keys, order, rows_per_block)
    whole = bool(keys) and not cut
    return with_running(spread, keys, F.col(SPREAD), order, **running, whole=whole).drop(SPREAD)


def unplaced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that running values leave out, with ``reject_reason``.

    Together with the rows that are placed they are all rows of ``df``.
    """
    reasons = [F.when(F.col(k).isNull(), F.lit(f"no {k}")) for k in (*keys, order[0])]
    return df.withColumn("reject_reason", F.coalesce(*reasons)).filter(F.col("reject_reason").isNotNull())
