"""Chat formatting with shared turns emitted once.

Conversations that start with the same turns share the nodes of a prefix tree.
A node is named by a hash of all turns up to it. Conversations are ordered by
their shared nodes at all depths, so that a walk over them meets the tree depth
first. A chain of nodes that the same number of conversations pass is one step
of that order, as it does not branch. Each block of that order is one sequence of text, in which a node stands
once. A segment carries its place, the position of its first character on its
own path, and the intervals of its ancestors and itself, which are what it may
attend to; intervals that touch are one.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
a backslash is doubled, ``<|`` becomes ``<\\|``, and inside roles a line break
becomes ``\\n``, so no text can end a turn, and all of it can be read back.
The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
import sys
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolmark.llm.tables import Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START, END = "<|im_start|>", "<|im_end|>\n"
BLOCK_TURNS = 2000  # turns of a block, about, while there are fewer blocks than partitions

_TURNS = "conv_id BIGINT, turn_no BIGINT, node STRING, role STRING, text STRING"
_SEGMENTS = (
    "conv_id BIGINT, turn_no BIGINT, node STRING, block BIGINT, start BIGINT, end BIGINT, "
    "position BIGINT, attends ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, "
    "loss_start BIGINT, loss_end BIGINT, text STRING"
)
_READ = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, "
    "loss_sha256 STRING, formatted_chars BIGINT"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends in it."""
    head = f"{START}{escape(role)}\n".replace("\n", "\\\n", role.count("\n"))
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    inside = turn[len(START) : -len(END)]
    head = re.match(r"(?s)((?:[^\\\n]|\\.)*)\n", inside)
    return unescape(head[1]), unescape(inside[head.end() :])


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows, schema: pa.Schema, size: int = 1000, most: int = 1 << 22):
    """Record batches of rows, bounded in rows and in characters of their last column."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1] or "") if isinstance(row[-1], str) else 8
        if len(held) >= size or weight > most:
            yield _batch(held, schema)
            held, weight = [], 0
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _named(batches):
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn_no", pa.int64())]
        + [(n, pa.string()) for n in ("node", "role", "text")]
    )

    def rows():
        at, number, node = object(), 0, b""
        for conv, _, role, text in _rows(batches):
            if conv != at:
                at, number, node = conv, 0, b""
            data = f"{len(role)}:{role}{text}".encode()
            node = blake2b(node + data, digest_size=16).digest()
            yield conv, number, node.hex(), role, text
            number += 1

    yield from _batches(rows(), schema)


def _walked(batches):
    """Segments of a block: rows in depth-first order of (conversation, turn)."""
    interval = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    numbers = ["conv_id", "turn_no", "block", "start", "end", "position", "loss_start", "loss_end"]
    schema = pa.schema(
        [(n, pa.int64()) for n in numbers[:2]]
        + [("node", pa.string())]
        + [(n, pa.int64()) for n in numbers[2:6]]
        + [("attends", pa.list_(interval))]
        + [(n, pa.int64()) for n in numbers[6:]]
        + [("text", pa.string())]
    )
    block = TaskContext.get().partitionId()

    def rows():
        # The path of the last conversation: (node, start, end, position, attends, loss).
        path: list[tuple] = []
        offset, at, same = 0, object(), True
        for _, conv, number, node, role, text in _rows(batches):
            if conv != at:
                at, same = conv, True
            same = same and number < len(path) and path[number][0] == node
            if same:
                _, start, end, position, attends, loss = path[number]
                yield (conv, number, node, block, start, end, position, attends, *loss, None)
                continue
            del path[number:]
            turn, first, last = formatted(role, text)
            above = path[-1] if path else None
            position = above[3] + above[2] - above[1] if above else 0
            start, end = offset, offset + len(turn)
            attends = list(above[4]) if above else []
            if attends and attends[-1]["end"] == start:
                attends[-1] = {"start": attends[-1]["start"], "end": end}
            else:
                attends.append({"start": start, "end": end})
            loss = (start + first, start + last) if role == "assistant" else (None, None)
            path.append((node, start, end, position, attends, loss))
            offset = end
            yield (conv, number, node, block, start, end, position, attends, *loss, turn)

    yield from _batches(rows(), schema)


def _read_back(batches):
    """One row per conversation, from its segments in order."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def rows():
        at, held = object(), None
        for conv, _, start, loss_start, loss_end, turn in _rows(batches):
            if conv != at:
                if held:
                    yield done(at, held)
                at, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parsed(turn)
            held[0] += 1
            held[1].update(f"{role}\n{text}\n".encode())
            if loss_start is not None:
                under = unescape(turn[loss_start - start : loss_end - start])
                held[2] += len(under)
                held[3].update(under.encode())
            held[4] += len(turn)
        if held:
            yield done(at, held)

    def done(conv, held):
        return conv, held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4]

    yield from _batches(rows(), schema)


def _numbered(batches):
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        ranks = pa.array(range(number, number + batch.num_rows), pa.int64())
        number += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), ranks], names=["key_id", "rank"])


def _ranks(named: DataFrame, parts: int) -> DataFrame:
    """key_id and rank, in depth-first order, of the conversations with shared nodes."""
    nodes = named.select("conv_id", "turn_no", F.xxhash64("node").alias("name"))
    shared = nodes.groupBy("name").agg(F.count("*").alias("times")).where("times > 1")
    path = F.array_sort(F.collect_list(F.struct("turn_no", "name", "times")))
    keys = nodes.join(shared, "name").groupBy("conv_id").agg(path.alias("path"))
    # Below a branch fewer conversations pass, so equal counts are one chain.
    first = "filter(path, (p, i) -> i = 0 OR p.times <> get(path, i - 1).times)"
    keys = keys.select("conv_id", F.expr(f"transform({first}, p -> p.name)").alias("key"))
    keys = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return keys.select("conv_id").mapInArrow(_numbered, "key_id BIGINT, rank BIGINT")


def format_conversations(turns: DataFrame, work: Workspace) -> DataFrame:
    """Segments of all ``turns`` (conv_id, turn, role, text) as a written table.

    One row per turn of a conversation: its node, the block and the place of
    its segment there, position, attended intervals, the place of the loss
    mask, and text: the formatted turn, null where an earlier row of the block
    emitted the node. Turns of equal number are ordered by role and text, a
    null number comes first, a null role or text is empty, and rows without a
    conv_id are one conversation; repeated rows are turns each; an empty table
    gives no rows; further columns are ignored. Rows of one conversation are
    read in order by one task, which holds its path but no texts.
    """
    order = ["conv_id", "turn", "role", "text"]
    plain = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = plain.repartition(parts, "conv_id").sortWithinPartitions(*order)
    named = work.keep(named.mapInArrow(_named, _TURNS), "turns")
    ranks = work.keep(_ranks(named, parts), "ranks")
    walk = named.join(ranks, F.col("conv_id").eqNullSafe(F.col("key_id")), "left").select(
        F.coalesce("rank", F.lit(-1)).alias("rank"), "conv_id", "turn_no", "node", "role", "text"
    )
    # A block is a range of this order; where one ends, its path starts anew.
    blocks = min(parts, 1 + named.count() // BLOCK_TURNS)
    walk = walk.repartitionByRange(blocks, "rank", "conv_id")
    walk = walk.sortWithinPartitions("rank", "conv_id", "turn_no")
    return work.keep(walk.mapInArrow(_walked, _SEGMENTS), "segments")


def read_back(segments: DataFrame) -> DataFrame:
    """n_turns, digests and lengths of every conversation, from the formatted text alone."""
    columns = ["conv_id", "turn_no", "start", "loss_start", "loss_end", "text"]
    own = segments.where("text IS NOT NULL")
    pointing = segments.where("text IS NULL").drop("text")
    found = pointing.join(own.select("block", "start", "text"), ["block", "start"])
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.select(*columns).union(found.select(*columns))
    both = both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn_no")
    return both.mapInArrow(_read_back, _READ)
