"""Vector bin packing of token sequences.

Each example is a demand vector: tokens, segments and loss-bearing tokens. An
open sequence takes, again and again, the waiting example whose demand has the
largest dot product with what the sequence has left, all in parts of the
limits. So scarce room draws the examples that need little of it.

Packing runs where the texts are read: a task keeps a pool of at most ``pool``
waiting pieces, each shorter than a sequence, and nothing is shuffled. Full
sequences of long documents are cut off at once. Where nothing in the pool fits
the room that is left, the best piece is cut to fill it. The last sequence of a
task is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolmark.llm import tables
from spoolmark.llm.subwords import ByteLevelTokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 1024
SEGMENTS = 256
POOL = 128

PIECES = (
    "doc_id BIGINT, start BIGINT, length BIGINT, doc_tokens BIGINT, sequence_id BIGINT, "
    "offset BIGINT, segment BIGINT, loss_tokens BIGINT, token_ids BINARY"
)


class Packer:
    """Places pieces in sequences; ``add`` and ``finish`` yield placed pieces.

    A piece is (doc_id, start, ids, doc_tokens, bearing): ``ids`` an array of
    token ids, ``bearing`` as many booleans, True where the token bears loss.
    ``limits`` are tokens, segments and loss-bearing tokens of one sequence.
    Sequences are numbered from ``first``.
    """

    def __init__(self, limits: tuple[int, int, int], pool: int, first: int) -> None:
        self.limits = np.array(limits, float)
        self.pool, self.next = pool, first
        self.waiting: list = [None] * pool
        self.demand = np.zeros((3, pool))
        self.count = 0
        self._open(int(limits[0]))

    def _open(self, length: int) -> None:
        self.left = np.minimum(self.limits, (length, self.limits[1], self.limits[2]))
        self.offset = self.segment = 0
        self.number = self.next
        self.next += 1

    def _put(self, piece) -> None:
        self.waiting[self.count] = piece
        self.demand[:, self.count] = (len(piece[2]), 1, int(piece[4].sum()))
        self.count += 1

    def _take(self, at: int):
        piece, self.count = self.waiting[at], self.count - 1
        self.waiting[at] = self.waiting[self.count]
        self.demand[:, at] = self.demand[:, self.count]
        return piece

    def _place(self, piece) -> tuple:
        doc, start, ids, whole, bearing = piece
        loss = int(bearing.sum())
        row = (doc, start, len(ids), whole, self.number, self.offset, self.segment, loss, ids)
        self.left -= (len(ids), 1, loss)
        self.offset += len(ids)
        self.segment += 1
        return row

    @staticmethod
    def _cut(piece, length: int):
        doc, start, ids, whole, bearing = piece
        return (
            (doc, start, ids[:length], whole, bearing[:length]),
            (doc, start + length, ids[length:], whole, bearing[length:]),
        )

    def _fitting(self, piece) -> int:
        """Tokens at the piece's start that the open sequence can take."""
        bearing = piece[4][: int(self.left[0])]
        return int(np.searchsorted(np.cumsum(bearing), self.left[2], "right"))

    def add(self, doc, ids: np.ndarray, bearing: np.ndarray) -> Iterator[tuple]:
        length = int(self.limits[0])
        rest = (doc, 0, ids, len(ids), bearing)
        while len(rest[2]) >= length and int(rest[4][:length].sum()) <= self.limits[2]:
            full, rest = self._cut(rest, length)
            yield (*full[:2], length, full[3], self.next, 0, 0, int(full[4].sum()), full[2])
            self.next += 1
        while len(rest[2]):
            part, rest = self._cut(rest, length - 1)
            if self.count == self.pool:
                yield self._step()
                while self.count == self.pool:
                    yield self._step()
            self._put(part)

    def _step(self, length: int | None = None) -> tuple:
        """Places one waiting piece, or the start of one."""
        while True:
            demand, left = self.demand[:, : self.count], self.left
            if left[0] >= 1 and left[1] >= 1:
                score = (left / self.limits**2) @ demand
                fits = (demand[0] <= left[0]) & (demand[2] <= left[2])
                at = int((score * fits).argmax())
                if fits[at]:
                    return self._place(self._take(at))
                at = int(score.argmax())
                if size := self._fitting(self.waiting[at]):
                    front, rest = self._cut(self._take(at), size)
                    self._put(rest)
                    return self._place(front)
            self._open(length or int(self.limits[0]))

    def finish(self) -> Iterator[tuple]:
        """Places all that waits; what can't fill a sequence ends at powers of two."""
        length, total = int(self.limits[0]), lambda: int(self.demand[0, : self.count].sum())
        while self.count and total() + self.offset >= length:
            yield self._step()
        if self.offset:
            self.left[0] = min(self.left[0], (1 << (self.offset - 1).bit_length()) - self.offset)
        while self.count:
            yield self._step(1 << (total().bit_length() - 1))


def packed(
    rows: Iterator[tuple], limits: tuple[int, int, int], pool: int, first: int
) -> Iterator[list[tuple]]:
    """Placed pieces of (doc_id, ids, bearing) rows, in lists of bounded size."""
    packer, out = Packer(limits, pool, first), []
    for doc, ids, bearing in rows:
        for row in packer.add(doc, ids, bearing):
            out.append(row)
            if len(out) >= 2048:
                yield out
                out = []
    out.extend(packer.finish())
    yield out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 9
    ids = [np.ascontiguousarray(x, "<u4").tobytes() for x in columns[8]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:8]] + [pa.array(ids, pa.binary())],
        names="doc_id start length doc_tokens sequence_id offset segment loss_tokens "
        "token_ids".split(),
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    segments: int = SEGMENTS,
    loss_tokens: int | None = None,
    pool: int = POOL,
    end_id: int = 0,
) -> DataFrame:
    """Token ids of all ``docs`` (doc_id, text) packed into sequences.

    ``tokenizer`` is the path of a byte-level tokenizer file that every
    executor can read. Each document is its ids and then ``end_id``; all but
    its first token bear loss, as the first has nothing to be predicted from.
    A sequence holds at most ``length`` tokens, ``segments`` pieces and
    ``loss_tokens`` loss-bearing tokens (``length`` if none are given). One row
    per piece: doc_id, start, length, doc_tokens, sequence_id, offset, segment,
    loss_tokens and token_ids (little-endian unsigned 32-bit). A piece lies at
    ``offset`` of its sequence, without gaps.

    A null or empty text is the end id alone; a null doc_id is kept; repeated
    rows are packed each; an empty table gives no rows; further columns are
    ignored.
    """
    limits = (length, segments, loss_tokens or length)

    def tokenised(batches):
        encode = ByteLevelTokens.of(tokenizer)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(encode.ids(text.as_py()), "<u4")
                ids = np.append(ids, np.uint32(end_id))
                bearing = np.ones(len(ids), bool)
                bearing[0] = False
                yield doc, ids, bearing

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for rows in packed(tokenised(batches), limits, pool, first):
            yield _batch(rows)

    columns = docs.select(F.col("doc_id").cast("bigint"), tables.text_of())
    return columns.mapInArrow(run, PIECES)
