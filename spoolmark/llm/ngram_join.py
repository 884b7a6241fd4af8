"""Near duplicates by a join on word shingles, vertically partitioned.

All shingles have one global order: rare ones by hash, then the most frequent
ones. Texts with equal shingle sets count as one. Two sets that are similar
enough share a shingle within a prefix of each, so only texts that meet in such
a bucket are compared. The order is cut into fragments; each text's set is cut
with it; a pair's overlap is counted in each fragment on its own and summed.
Sizes, places in the order and sketches rule out most pairs of a bucket.

Long sets have prefixes of hundreds of shingles, of which many are common in any
large table, and sketches that are full. They are cut by hash into more parts than
two similar sets can differ in, so that some part is equal in both, and meet where
a whole part is equal: see ``_parts``.

``near_duplicates`` joins sets by representatives. In each round a bucket names
one of its sets, and those not yet linked to it by any chain are compared with
it alone; what links merges. The first round looks at the first places of each
set only, where most copies meet already. At the end the sets outside a
bucket's largest component are compared with those of all its other components,
where a link is not ruled out. So no link between two components is lost, and a
family of copies costs about as many comparisons as it has texts.

``links`` compares all pairs that are not ruled out, block by block, for tables
whose families are small: a family of n different texts costs n^2 / 2.
"""

from __future__ import annotations

import sys
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolmark.llm import tables
from spoolmark.llm.components import connected_components
from spoolmark.llm.shingles import encoded, mix, shingles_of_all
from spoolmark.llm.tables import Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FREQUENT = 1 << 16  # most shingles that are ordered by their count
SEEN = 4  # times in one slice of a task from which a shingle is counted
FRAGMENTS = 4
FILTER_BITS = 1 << 23  # of the filter for texts that have met others
SKETCH = 512
LONG = 512  # shingles above which a set has a wide sketch, as the other one fills up, and meets by parts
WIDE = 16_384
SMALL = 64  # sets of a block in ``links``
FIRST = 4  # places or parts of a set that the first round looks at
ROUNDS = 2  # of representatives; what is left is compared exhaustively
REMEMBERED = 1 << 20  # sets that a task remembers to have seen

#: The largest size of each class of sizes; each is about 1.3 times the one before.
_CLASSES = np.cumprod(np.full(120, 1.3)).astype(np.int64)

_DOCS = (
    "doc_id BIGINT, n BIGINT, node BIGINT, check BIGINT, sketch ARRAY<BIGINT>, "
    "shingle BIGINT, times BIGINT, digest STRING, wide ARRAY<BIGINT>"
)


class _Order(NamedTuple):
    """What all tasks know of all sets: the frequent shingles, and numbers that clash."""

    often: np.ndarray  # ascending
    place: np.ndarray  # of each of them among the last
    clashed: frozenset[int]  # first numbers that differing sets have in common


def _nodes(sets: list[np.ndarray]) -> tuple[list, list]:
    """Two numbers for each set, equal for equal sets; null for empty ones."""
    both = [
        np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else None
        for s in sets
    ]
    return [None if b is None else int(b[0]) for b in both], [
        None if b is None else int(b[1]) for b in both
    ]


def _named_sets(sets: list[np.ndarray], order: _Order):
    """The sets with their numbers: the first, or where that clashes the second."""
    for node, check, hashes in zip(*_nodes(sets), sets, strict=True):
        yield (check if node in order.clashed else node), hashes


def _clashes(rows: DataFrame) -> list[int]:
    """Numbers of differing sets: about n^2 / 2^65 of n sets, three of 10^10."""
    checks = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("check").alias("low"), F.max("check").alias("high")
    )
    return checks.where("low <> high").select("node").toArrow()["node"].to_pylist()


def _sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The parity of the set's hashes in each of ``size`` cells."""
    cells = (hashes >> np.uint64(20)) % np.uint64(size)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=size) & 1).view(np.int64)


def _read(docs: DataFrame, size: int, digest: Column) -> DataFrame:
    """One row per document with ``digest``, and rows of shingles seen often in a slice."""

    def frequent(sets):
        whole = np.concatenate(sets)
        whole.sort()
        # Few are seen often; no counts of all the others are made.
        found = np.unique(whole[: 1 - SEEN][whole[SEEN - 1 :] == whole[: 1 - SEEN]])
        times = np.searchsorted(whole, found, "right") - np.searchsorted(whole, found)
        n = len(found)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(n, pa.list_(pa.int64()))]
            + [pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))]
            + [pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int64()))],
            names=names,
        )

    names = "doc_id n node check sketch shingle times digest wide".split()

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sets = list(shingles_of_all(encoded(part.column(1)), size))
                node, check = _nodes(sets)
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.array(check, pa.int64()),
                        pa.array([_sketch(s) for s in sets], pa.list_(pa.int64())),
                        none,
                        none,
                        part.column(2),
                        pa.array(
                            [_sketch(s, WIDE) if len(s) > LONG else None for s in sets],
                            pa.list_(pa.int64()),
                        ),
                    ],
                    names=names,
                )
                held += sets
                count += sum(map(len, sets))
                if count > 2_000_000:
                    yield frequent(held)
                    held, count = [], 0
        if held:
            yield frequent(held)

    columns = F.col("doc_id").cast("bigint"), tables.text_of(), digest.cast("string")
    return docs.select(*columns).mapInArrow(run, _DOCS)


def _sorted(hashes: np.ndarray, order: _Order) -> tuple[np.ndarray, int]:
    """A set in the global order, and how many of its hashes are frequent."""
    often, place, _ = order
    at = np.searchsorted(often, hashes)
    at[at == len(often)] = 0
    known = often[at] == hashes if len(often) else np.zeros(len(hashes), bool)
    last = hashes[known][np.argsort(place[at[known]])]
    return np.concatenate((hashes[~known], last)), len(last)


def _parts(hashes: np.ndarray, last: int, low: int):
    """Numbers and places of the parts at which a long set meets those it may link with.

    ``hashes`` ends with ``last`` frequent ones. Sizes have classes; a set is cut for
    each class in which the larger set of a linked pair may be. Linked sets of a class
    differ in ``most`` hashes at most, so of 1 + ``most`` + ``spare`` parts more than
    ``spare`` are equal. So ``spare`` parts of each set may be left out: those with the
    fewest rare hashes, by which unlike sets could meet. The order is by content, so the
    last of the equal parts is among those that stay in both sets.
    """
    mixed = mix(hashes)
    rare = len(hashes) - last
    smallest, largest = np.searchsorted(_CLASSES, [len(hashes), 100 * len(hashes) // low])
    for k in range(smallest, largest + 1):
        most = 2 * int(_CLASSES[k]) * (100 - low) // (100 + low)
        spare = 3 * (1 + most) // 10
        count = 1 + most + spare
        place = (mixed % np.uint64(count)).astype(np.int64)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, place, mixed)
        names = mix(sums + mix(np.arange(count, dtype=np.uint64) + np.uint64(int(k) << 48)))
        stay = np.lexsort((names, np.bincount(place[:rare], minlength=count)))[spare:]
        yield names[stay], stay


def _postings(docs: DataFrame, size: int, low: int, order: _Order) -> DataFrame:
    """(shingle, node, n, at, first) for the prefix, or parts, of every different set of a task.

    Two sets of at most ``LONG`` shingles meet by prefixes; of a pair with a longer one, both have parts.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000).column(0)
                out: list = [[], [], [], [], []]
                sets = [s for s in shingles_of_all(encoded(part), size) if len(s)]
                for node, hashes in _named_sets(sets, order):
                    if node in seen:
                        continue
                    if len(seen) == REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    n = len(hashes)
                    hashes, last = _sorted(hashes, order)
                    met = []
                    if n <= LONG:
                        prefix = n - -(-low * n // 100) + 1
                        places = np.arange(prefix)
                        met.append((hashes[:prefix], places, places < FIRST))
                    if 100 * n > low * LONG:
                        for names, places in _parts(hashes, last, low):
                            met.append((names, np.zeros(len(names), np.int64), places < FIRST))
                    for names, places, first in met:
                        out[0].append(names)
                        out[1].append(np.full(len(names), node))
                        out[2].append(np.full(len(names), n))
                        out[3].append(places)
                        out[4].append(first)
                if out[0]:
                    columns = [np.concatenate(c) for c in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(columns[0].view(np.int64)),
                            *[pa.array(c.astype(np.int64)) for c in columns[1:4]],
                            pa.array(columns[4]),
                        ],
                        names=["shingle", "node", "n", "at", "first"],
                    )

    return docs.select(tables.text_of()).mapInArrow(
        run, "shingle BIGINT, node BIGINT, n BIGINT, at BIGINT, first BOOLEAN"
    )


def _filter(nodes: DataFrame) -> np.ndarray:
    """Bits that let all of ``nodes`` pass, and few others while they are few.

    Its size is ``FILTER_BITS`` whatever the number of nodes; it saves work, and
    the exact join that follows decides.
    """
    bit = F.pmod("node", F.lit(FILTER_BITS).cast("bigint"))
    words = nodes.select(F.shiftright(bit, 5).alias("word"), F.pmod(bit, F.lit(32)).alias("bit"))
    words = words.select("word", F.expr("shiftleft(1L, cast(bit AS INT))").alias("mask"))
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    return bits


def _segments(docs: DataFrame, nodes: DataFrame, size: int, order: _Order) -> DataFrame:
    """(node, fragment, part) of the sets of ``nodes``: a set cut along the global order."""
    members = nodes.select("node").distinct()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list = [[], [], []]
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000).column(0)
                sets = [s for s in shingles_of_all(encoded(part), size) if len(s)]
                for node, hashes in _named_sets(sets, order):
                    if node in seen or not wanted(node):
                        continue
                    if len(seen) == REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    hashes, last = _sorted(hashes, order)
                    rare = hashes[: len(hashes) - last]
                    cuts = np.searchsorted(rare, bounds)
                    parts = [*np.split(rare, cuts), hashes[len(rare) :]]
                    for fragment, piece in enumerate(parts):
                        if len(piece):
                            out[0].append(node)
                            out[1].append(fragment)
                            out[2].append(piece.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.list_(pa.int64())),
                ],
                names=["node", "fragment", "part"],
            )

    bounds = (np.arange(1, FRAGMENTS - 1) * (2**64 // (FRAGMENTS - 1))).astype(np.uint64)
    bits = _filter(members)

    def wanted(node: int) -> bool:
        at = node % FILTER_BITS
        return bool(bits[at >> 5] >> np.uint32(at & 31) & np.uint32(1))

    made = docs.select(tables.text_of()).mapInArrow(
        run, "node BIGINT, fragment BIGINT, part ARRAY<BIGINT>"
    )
    return made.join(members, "node", "left_semi").dropDuplicates(["node", "fragment"])


def _possible(a: str, b: str, low: int) -> Column:
    """Not ruled out by the sizes, the places of the shared shingle or the sketches."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    # Overlap that a link needs: the least o with 100 o >= low (n + m - o).
    need = F.ceil((n + m) * low / F.lit(100.0 + low) - F.lit(1e-9))
    after = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    apart = F.lit(0)
    for k in range(SKETCH // 64):
        apart = apart + F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k]))
    return (
        (F.least(n, m) * 100 >= F.greatest(n, m) * low)
        & (after >= need)
        & (apart <= n + m - 2 * need)
    )


def _closer(pairs: DataFrame, rows: DataFrame, low: int) -> DataFrame:
    """The ``pairs`` that wide sketches do not rule out."""
    wide = rows.where(F.col("n") > LONG).groupBy("node").agg(F.min("wide").alias("wide"))
    both = pairs.join(wide.toDF("a", "own"), "a", "left").join(wide.toDF("b", "other"), "b", "left")
    apart = F.aggregate(
        F.zip_with("own", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, x: total + x,
    )
    need = F.ceil((F.col("n") + F.col("m")) * low / F.lit(100.0 + low) - F.lit(1e-9))
    near = apart <= F.col("n") + F.col("m") - 2 * need
    return both.where(F.coalesce(near, F.lit(True))).select("a", "b", "n", "m")


def _linked(pairs: DataFrame, segments: DataFrame, low: int) -> DataFrame:
    """The (a, b, n, m, o) of ``pairs`` that link, with their overlap o: partial overlaps by fragment, summed."""
    own = segments.select(F.col("node").alias("a"), "fragment", F.col("part").alias("own"))
    other = segments.select(F.col("node").alias("b"), "fragment", F.col("part").alias("other"))
    partial = (
        pairs.join(own, "a")
        .join(other, ["b", "fragment"])
        .select("a", "b", "n", "m", F.size(F.array_intersect("own", "other")).alias("overlap"))
    )
    total = partial.groupBy("a", "b", "n", "m").agg(F.sum("overlap").alias("o"))
    return total.where(F.col("o") * 100 >= (F.col("n") + F.col("m") - F.col("o")) * low)


def _pairs(joined: DataFrame) -> DataFrame:
    """Distinct pairs of the sides x and y, the smaller node first."""
    first = F.col("x.node") < F.col("y.node")
    return joined.select(
        F.least("x.node", "y.node").alias("a"),
        F.greatest("x.node", "y.node").alias("b"),
        F.when(first, F.col("x.n")).otherwise(F.col("y.n")).alias("n"),
        F.when(first, F.col("y.n")).otherwise(F.col("x.n")).alias("m"),
    ).distinct()


def near_duplicates(docs: DataFrame, size: int, low: int) -> DataFrame:
    """doc_id, n_shingles, component_id of all ``docs`` (doc_id, text).

    Words are runs outside [\\x20\\x09-\\x0D], with A-Z lower-cased. A document's
    set has its distinct runs of ``size`` words; with fewer words, all of them
    as one. Two documents link when 100 * intersection >= ``low`` * union;
    component_id is the smallest doc_id reachable by links. A null, empty or
    blank text has no set and is linked with nothing; equal texts are linked;
    a null doc_id is kept and never names a component that has another; rows
    that repeat an id are each a document; an empty table gives no rows;
    further columns are ignored.
    """
    work = Workspace(docs.sparkSession, "ngram-join")
    rows, met, order = _met(docs, size, low, work)
    return _named(rows, _components(docs, rows, met, size, low, order, work))


def _components(
    docs: DataFrame, rows: DataFrame, met: DataFrame, size: int, low: int, order: _Order, work: Workspace
) -> DataFrame:
    """(node, component) of all sets that have links, by links to representatives."""
    segments = links = None
    parts = met.withColumn("component", F.col("node"))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            close = _with_pivots(parts.where("first") if turn == 0 else parts, turn, low)
        else:
            close = _with_others(parts, low)
        pairs = work.keep(_closer(_pairs(close), rows, low), "pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if segments is not None:
            nodes = nodes.join(segments.select("node"), "node", "left_anti")
        nodes = work.keep(nodes, "nodes")
        if not nodes.isEmpty():
            more = work.keep(_segments(docs, nodes, size, order), "segments")
            segments = more if segments is None else segments.union(more)
        if segments is None:  # nor are there pairs
            found = pairs.select("a", "b")
        else:
            found = work.keep(_linked(pairs, segments, low).select("a", "b"), "links")
        links = found if links is None else links.union(found)
        if turn < ROUNDS and not found.isEmpty():
            parts = _labelled(met, links, work)
    return connected_components(links, work)


def _with_pivots(parts: DataFrame, turn: int, low: int) -> DataFrame:
    """Sets x with the set y that their bucket names, where no chain of links joins them yet.

    A bucket's choice is by hash, so the buckets of a family tend to name the same set.
    """
    pivot = parts.groupBy("shingle").agg(
        F.min_by(
            F.struct("node", "n", "at", "sketch", "component"),
            F.struct(F.xxhash64("node", F.lit(turn)), "node"),
        ).alias("pivot"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    pivot = pivot.where("low <> high").select("shingle", "pivot.*")
    return parts.alias("x").join(
        pivot.alias("y"),
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component"))
        & _possible("x", "y", low),
    )


def _with_others(parts: DataFrame, low: int) -> DataFrame:
    """Sets x outside the largest component of their bucket with the sets y of its others."""
    counts = parts.groupBy("shingle", "component").agg(F.count("*").alias("times"))
    main = counts.groupBy("shingle").agg(
        F.max_by("component", F.struct("times", "component")).alias("main"),
        F.count("*").alias("components"),
    )
    parts = parts.join(main.where("components > 1"), "shingle")
    return parts.where("component <> main").alias("x").join(
        parts.alias("y"),
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component"))
        & ((F.col("y.component") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & _possible("x", "y", low),
    )


def _met(docs: DataFrame, size: int, low: int, work: Workspace, digest: Column | None = None):
    """Rows of all documents, and of the sets that meet others in buckets; the order."""
    read = work.keep(_read(docs, size, F.lit(None) if digest is None else digest), "read")
    often = (
        read.where("shingle IS NOT NULL")
        .groupBy("shingle")
        .agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "shingle")
        .limit(FREQUENT)
        .toArrow()
    )
    names = often["shingle"].to_numpy().view(np.uint64)
    # Ascending counts: the most frequent shingle comes last of all.
    place = np.empty(len(names), np.int64)
    by_name = np.argsort(names)
    place[:] = np.arange(len(names), 0, -1)[by_name]
    names = names[by_name]
    rows = read.where("shingle IS NULL").select("doc_id", "n", "node", "check", "sketch", "digest", "wide")
    clashed = _clashes(rows)
    if clashed:
        again = F.col("node").isin(clashed)
        rows = rows.withColumn("node", F.when(again, F.col("check")).otherwise(F.col("node")))
        if _clashes(rows):
            raise ValueError("two sets have the same 128 bits, or a second number is another's first")

    # Alone in a bucket, or among texts of other sizes, a text meets nobody there.
    bucket = Window.partitionBy("shingle")
    sized = bucket.orderBy("n")
    order = _Order(names, place, frozenset(clashed))
    met = _postings(docs, size, low, order)
    met = met.repartition("shingle").dropDuplicates(["shingle", "node"]).select(
        "*",
        F.count("*").over(bucket).alias("size"),
        F.lag("n").over(sized).alias("less"),
        F.lead("n").over(sized).alias("more"),
    )
    met = met.where((F.col("less") * 100 >= F.col("n") * low) | (F.col("n") * 100 >= F.col("more") * low))
    met = work.keep(met.drop("less", "more"), "met")
    sketches = (
        rows.where("node IS NOT NULL")
        .join(met.select("node").distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.min("sketch").alias("sketch"))
    )
    met = work.keep(met.join(sketches, "node"), "sketched")
    return rows, met, order


def _labelled(met: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    component = connected_components(links, work)
    return met.join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _links(docs: DataFrame, met: DataFrame, size: int, low: int, order: _Order, work: Workspace) -> DataFrame:
    """(a, b, overlap) of all pairs of different sets that link.

    A set of a large bucket is in one block of about ``SMALL`` sets, and each
    block meets the whole bucket, so that no task has to pair a whole bucket.
    """
    blocks = F.ceil(F.col("size") / SMALL)
    own = met.withColumn("block", F.pmod(F.xxhash64("node", "shingle"), blocks))
    other = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    close = own.alias("x").join(
        other.alias("y"),
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.node") < F.col("y.node"))
        & _possible("x", "y", low),
    )
    pairs = work.keep(_pairs(close), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    segments = work.keep(_segments(docs, work.keep(nodes, "nodes"), size, order), "segments")
    found = _linked(pairs, segments, low).select("a", "b", F.col("o").alias("overlap"))
    return work.keep(found, "links")


def links(docs: DataFrame, size: int, low: int) -> DataFrame:
    """(a, b, overlap) of all pairs of different shingle sets of ``docs`` that link.

    a and b are the sets' numbers, the smaller one first; equal texts are one set.
    """
    work = Workspace(docs.sparkSession, "ngram-links")
    _, met, order = _met(docs, size, low, work)
    return _links(docs, met, size, low, order, work)


def linked_documents(docs: DataFrame, size: int, low: int) -> DataFrame:
    """``near_duplicates`` by all links, and n_links: to how many documents each is linked.

    Documents of equal texts that are not blank count among them.
    """
    work = Workspace(docs.sparkSession, "ngram-links")
    rows, met, order = _met(docs, size, low, work)
    made = _links(docs, met, size, low, order, work)
    times = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("times"))
    ends = made.select(F.col("a").alias("node"), F.col("b").alias("other"))
    ends = ends.union(ends.select("other", "node"))
    others = ends.join(times.withColumnRenamed("node", "other"), "other")
    others = others.groupBy("node").agg(F.sum("times").alias("others"))
    n_links = F.col("times") - 1 + F.coalesce("others", F.lit(0))
    counted = times.join(others, "node", "left").select("node", n_links.alias("n_links"))
    rows = rows.join(counted, "node", "left").fillna(0, ["n_links"])
    return _named(rows, connected_components(made.select("a", "b"), work), "n_links")


def _named(rows: DataFrame, component: DataFrame, *more: str) -> DataFrame:
    """Every row with the smallest doc_id of its component, and columns ``more``."""
    sets = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    sets = sets.join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    sets = sets.join(least, "component").select("node", "component_id")
    return rows.join(sets, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *more,
    )


def one_of_each(docs: DataFrame, size: int, low: int) -> DataFrame:
    """One document of every component, with all columns of ``docs``.

    The one with the smallest id stays; where rows of a component share that id,
    one of them does. Rows are told apart by id and shingle set, so two texts
    that share an id are judged each on its own. Texts without words stay, and
    so do rows without an id whose component has no other; of several such rows
    one stays. Columns of ``docs`` may have any names.
    """
    work = Workspace(docs.sparkSession, "one-of-each")
    digest = F.sha2(F.encode(tables.text_of(), "UTF-8"), 256)
    rows, met, order = _met(docs, size, low, work, digest)
    component = _components(docs, rows, met, size, low, order, work)
    sets = rows.where("node IS NOT NULL").join(component, "node", "left")
    sets = sets.select("doc_id", "digest", F.coalesce("component", "node").alias("component"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best")
    sets = sets.join(sets.groupBy("component").agg(best), "component")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    judged = sets.groupBy("doc_id", "digest").agg(
        F.max(stays).alias("stays"), F.count("*").alias("times")
    )
    judged = work.keep(judged.where("NOT stays OR times > 1"), "judged")
    named = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), digest.alias("name")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("name") == F.col("digest"))
    left = named.join(judged, same, "left_anti")
    if not judged.where("stays").isEmpty():
        again = named.join(judged.where("stays"), same, "left_semi")
        left = left.union(again.dropDuplicates(["id", "name"]))
    return left.select("row.*")
