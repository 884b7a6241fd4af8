"""Trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. Nearly all nodes of a large table belong to one conversation,
so each (conversation, depth) row is first held against a count-min sketch of the
digests of all prefixes. A cell counts at least what each of its prefixes counts,
so an estimate of one proves a singleton: its node is emitted where it is read,
with no grouping. Only rows that may be shared are shuffled and grouped exactly,
and a row that the sketch could not clear loses nothing but time.

A prefix digest is made of two exact sums over its turns of 64 bits of a SHA-256
each, over position, role and text. Sums add up along a conversation, so that long
conversations are digested in blocks by several tasks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolmark.functions import number_block
from spoolmark.llm.tables import Workspace
from spoolmark.plans.running import with_running

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of the sketch, and most cells of each; a set bit is a cell that counted two or more.
SKETCH_ROWS = 3
MAX_CELLS = 1 << 25
_PAGE_BITS = 32768
#: Turns that one task orders at once, and conversation ids in one piece of a list.
TURNS_PER_BLOCK = 10_000
IDS_PER_PIECE = 100_000
_ROOT = "0-0-0"


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): position from 1, by turn, null first, then role and text."""
    plain = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").isNotNull().cast("int").alias("has_turn"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    block = F.struct("has_turn", number_block(F.col("turn"), TURNS_PER_BLOCK))
    return with_running(
        plain,
        ["conv_id"],
        block,
        ["has_turn", "turn", "role", "text"],
        sums={"position": F.lit(1).cast("bigint")},
    ).select("conv_id", "position", "role", "text")


def rebuilt(turns: DataFrame, family: int = 5, span: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from the first of their family.

    Returns (conv_id, length) of all conversations, turnless ones too, and
    (conv_id, depth, role, text) of their turns. Conversation c takes its first
    crc32(c) modulo ``span`` turns from c - c % family; its own follow after as many.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = own.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    plan = (
        own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % span)
        .withColumn("first", F.col("conv_id") - F.col("conv_id") % family)
        .join(heads, "first", "left")
        .withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
        .select("conv_id", "first", "h", "taken", "n")
    )
    lengths = plan.select(
        "conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    heads = turns.where(F.col("position") < span).withColumnRenamed("conv_id", "first")
    begun = heads.join(plan.select("conv_id", "first", "taken"), "first").where("position <= taken")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("position > h")
    columns = ["conv_id", "depth", "role", "text"]
    whole = begun.withColumn("depth", F.col("position")).select(*columns)
    return lengths, whole.union(
        rest.withColumn("depth", F.col("position") - F.col("h") + F.col("taken")).select(*columns)
    )


def _half(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")


def _key(depth: Column, one: Column, two: Column) -> Column:
    return F.concat_ws("-", depth.cast("string"), one.cast("string"), two.cast("string"))


def prefixes(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, bytes, ends) of every turn of every conversation."""
    text = F.concat_ws("\n", F.col("depth").cast("string"), F.length("role").cast("string"), "role", "text")
    light = turns.select(
        "conv_id", "depth", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2(text, 256).alias("d")
    )
    light = light.select("conv_id", "depth", "bytes", _half(F.col("d"), 1).alias("u"), _half(F.col("d"), 17).alias("v"))
    block = number_block(F.col("depth"), TURNS_PER_BLOCK, first=1)
    summed = with_running(
        light, ["conv_id"], block, ["depth"], sums={"one": F.col("u"), "two": F.col("v")}
    )
    return summed.join(lengths, "conv_id").select(
        "conv_id",
        "depth",
        _key(F.col("depth"), F.col("one"), F.col("two")).alias("node"),
        _key(F.col("depth") - 1, F.col("one") - F.col("u"), F.col("two") - F.col("v")).alias("parent"),
        "bytes",
        (F.col("depth") == F.col("length")).alias("ends"),
    )


def _cell(name: str, seed: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(cells))


def count_min(rows: DataFrame, cells: int) -> np.ndarray:
    """Bits (SKETCH_ROWS x cells) of the sketch's cells that counted two or more prefixes.

    Cells are counted with a combine before the shuffle and come to the driver as
    packed pages: SKETCH_ROWS * MAX_CELLS / 8 bytes at most, whatever the table.
    """
    spots = F.array(*[(_cell("node", i, cells) + F.lit(i * cells)) for i in range(SKETCH_ROWS)])
    full = (
        rows.select(F.explode(spots).alias("cell"))
        .groupBy("cell")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )
    page, place = F.floor(F.col("cell") / _PAGE_BITS), F.col("cell") % _PAGE_BITS + 1
    pages = full.groupBy(page.alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    bits = np.zeros(-(-SKETCH_ROWS * cells // _PAGE_BITS) * _PAGE_BITS, "uint8")
    for batch in pages.toArrow().to_batches():
        for number, found in zip(batch.column("page").to_pylist(), batch.column("bits").to_pylist()):
            start = number * _PAGE_BITS
            bits[start : start + _PAGE_BITS] = np.unpackbits(
                np.frombuffer(found, "uint8"), bitorder="little"
            )
    return np.packbits(bits)


def _screen(sketch, cells: int):
    def screen(batches) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            flags = []
            for name in ("own", "above"):
                shared = np.ones(batch.num_rows, bool)
                for i in range(SKETCH_ROWS):
                    at = batch.column(f"{name}{i}").to_numpy(zero_copy_only=False) + i * cells
                    shared &= (bits[at >> 3] >> (7 - (at & 7))) & 1 > 0
                flags.append(pa.array(shared))
            kept = ["conv_id", "depth", "node", "parent", "bytes", "ends"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], *flags], [*kept, "shared", "shared_above"]
            )

    return screen


def screened(rows: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``rows`` with ``shared`` and ``shared_above``: whether a node and its parent may have more members."""
    cells = 1
    wanted = 4 * rows.count()
    while cells < min(wanted, max_cells):
        cells *= 2
    sketch = rows.sparkSession.sparkContext.broadcast(count_min(rows, cells))
    spots = [_cell(n, i, cells).alias(f"{a}{i}") for n, a in (("node", "own"), ("parent", "above")) for i in range(SKETCH_ROWS)]
    schema = "conv_id BIGINT, depth BIGINT, node STRING, parent STRING, bytes BIGINT, ends BOOLEAN, shared BOOLEAN, shared_above BOOLEAN"
    return rows.select("*", *spots).mapInArrow(_screen(sketch, cells), schema)


def _hash_lists(batches) -> Iterator[pa.RecordBatch]:
    """One digest per node of rows sorted by (node, piece); a list is never held whole."""
    node, digest, names, values = None, None, [], []
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name != node:
                if node is not None:
                    names.append(node)
                    values.append(digest.hexdigest())
                node, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["node", "ends_sha256"])
        names, values = [], []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the ids in order, joined by commas.

    Ids are joined in pieces of a bounded id range first, so a node with a third of
    all conversations reaches its last task as few rows.
    """
    pieces = ends.groupBy("node", number_block(F.col("conv_id"), IDS_PER_PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return dealt.mapInArrow(_hash_lists, "node STRING, ends_sha256 STRING")


def build_trie(
    conversations: DataFrame,
    work: Workspace,
    family: int = 5,
    span: int = 9,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Rows without conv_id belong to no conversation and are left out. Null turns
    come first; equal turns are ordered by role and text, and repeated rows are as
    many turns. Other columns are not read. An empty table has no conversation and
    gives no row, not even the root.

    Sums over a subtree need no walk: each node hands its value to its smallest
    member at its depth, sums run up each conversation, and each node adds up its members.
    """
    empty = hashlib.sha256(b"").hexdigest()
    turns = work.keep(turns_in_order(conversations), "turns")
    lengths, whole = rebuilt(turns, family, span)
    lengths = work.keep(lengths, "lengths")
    rows = work.keep(prefixes(lengths, whole), "prefixes")
    rows = work.keep(screened(rows, max_cells), "screened")
    shared = rows.where("shared")

    # Exact groups, and their children: nodes below, and first turns of proven singletons.
    groups = work.keep(
        shared.groupBy("depth", "node").agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.first("parent").alias("parent"),
            F.first("bytes").alias("bytes"),
        ),
        "groups",
    )
    below = (
        groups.select("parent")
        .union(rows.where("NOT shared AND (shared_above OR depth = 1)").select("parent"))
        .groupBy(F.col("parent").alias("node"))
        .agg(F.count("*").alias("n_children"))
    )
    groups = work.keep(groups.join(below, "node", "left").na.fill(0, ["n_children"]), "children")

    # What each node gives, at its smallest member's row; proven singletons give a leaf only.
    given = groups.select(
        "conv_id",
        "depth",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saving"),
    )
    tails = rows.where("NOT shared AND ends").select(
        "conv_id", F.lit(1).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saving")
    )
    up = shared.select("conv_id", "depth", "node").join(given, ["conv_id", "depth"], "left")
    up = up.join(tails.select("conv_id", F.col("leaf").alias("tail")), "conv_id", "left").na.fill(
        0, ["leaf", "saving", "tail"]
    ).withColumn("up", -F.col("depth"))
    summed = with_running(
        up,
        ["conv_id"],
        number_block(F.col("up"), TURNS_PER_BLOCK),
        ["up"],
        sums={"leaves": F.col("leaf"), "saved": F.col("saving")},
    )
    subtrees = summed.groupBy("node").agg(
        F.sum(F.col("leaves") + F.col("tail")).alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    digests = list_digests(shared.where("ends").select("node", "conv_id"))
    names = groups.select(F.col("node").alias("parent"), F.col("conv_id").alias("named"))
    lowest = lengths.agg(F.min("conv_id").alias("lowest"), F.count("*").alias("all"))

    def parent_of(frame: DataFrame) -> DataFrame:
        """The smallest member of each row's parent, which is the root, a group or its own."""
        return frame.join(names, "parent", "left").withColumn(
            "parent_conv_id",
            F.when(F.col("depth") == 1, lowest.select("lowest").scalar())
            .when(F.col("named").isNotNull(), F.col("named"))
            .otherwise(F.col("conv_id")),
        )

    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    many = (
        parent_of(groups)
        .join(subtrees, "node")
        .join(digests, "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
        .select(*columns)
    )
    single = rows.where("NOT shared")
    # Below another proven singleton the parent is the same conversation.
    alone = (
        parent_of(single.where("shared_above OR depth = 1"))
        .select("conv_id", "depth", "parent_conv_id", "ends")
        .union(single.where("NOT shared_above AND depth > 1").select("conv_id", "depth", "conv_id", "ends"))
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            F.lit(1).cast("bigint").alias("n_convs"),
            (~F.col("ends")).cast("bigint").alias("n_children"),
            F.lit(1).cast("bigint").alias("n_leaves"),
            F.lit(0).cast("bigint").alias("saved_tokens"),
            F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
        )
    )
    first = groups.where("depth = 1")
    tops = rows.where("NOT shared AND depth = 1")
    leaves = given.agg(F.sum("leaf").alias("n")).union(tails.agg(F.sum("leaf").alias("n")))
    leaves = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("leaves"))
    saved = given.agg(F.coalesce(F.sum("saving"), F.lit(0)).alias("saved_tokens"))
    children = first.select("node").union(tops.select("node")).agg(F.count("*").alias("n_children"))
    turnless = list_digests(
        lengths.where("length = 0").select(F.lit(_ROOT).alias("node"), "conv_id")
    ).select(F.max("ends_sha256").alias("found"))
    root = lowest.where("all > 0").select(
        F.col("lowest").alias("conv_id"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.col("all").alias("n_convs"),
        children.scalar().alias("n_children"),
        F.greatest(leaves.scalar(), F.lit(1)).cast("bigint").alias("n_leaves"),
        saved.scalar().alias("saved_tokens"),
        F.coalesce(turnless.scalar(), F.lit(empty)).alias("ends_sha256"),
    )
    return many.union(alone).union(root)
