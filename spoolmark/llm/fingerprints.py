"""Threshold-scaled sketches of documents.

A sketch keeps every shingle hash below a fixed fraction of all hashes, so it
grows with the document, sketches of parts merge by union, and the share of a
small document in a large one can be estimated. A document none of whose
shingles lies below the fraction is named by its smallest hash, which takes
part in no estimate but that of equality.

The edited text of a document needs the next one. Documents are dealt into
ranges of their id, each a partition that is read in order; the first document
of each range is also given to the range before. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolmark.llm import tables
from spoolmark.llm.shingles import shingles, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
FRACTION = 4  # one hash in so many is kept
_LOWEST = -(2**63)

MADE = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, "
    "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE, "
    "contained_in_edited DOUBLE, contained_in_next DOUBLE"
)


def sketch(text: str, words: int = WORDS, fraction: int = FRACTION) -> np.ndarray:
    """The upper halves of all shingle hashes below the fraction, or the smallest alone."""
    hashes = shingles(word_hashes(text.encode()), words) >> np.uint64(32)
    kept = hashes[hashes < 2**32 // fraction]
    return np.unique(kept if len(kept) else hashes[:1]).astype(np.uint32)


def _true(kept: np.ndarray, fraction: int = FRACTION) -> bool:
    return len(kept) > 0 and int(kept[0]) < 2**32 // fraction


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; of two without a kept hash, whether they are equal."""
    if not _true(a) and not _true(b):
        return float(np.array_equal(a, b))
    if not _true(a) or not _true(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first one's shingles that the second has."""
    if not _true(a):
        return float(np.array_equal(a, b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if _true(b) else 0.0


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[both < 2**32 // FRACTION]
    return kept if len(kept) else both[:1]


def fingerprint(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    changed = edited(text, following)
    new = sketch(changed)
    return (
        doc,
        len(text),
        hashlib.sha256(changed.encode()).hexdigest(),
        fingerprint(own),
        fingerprint(new),
        likeness(own, new),
        likeness(own, after),
        containment(own, new),
        containment(own, after),
    )


def _ranges(docs: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of at most ``parts`` id ranges, and the first id in each.

    Two numbers for each range reach the driver, whatever the table's size.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("id"))
    asked = [k / parts for k in range(1, parts)]
    cuts = ids.approxQuantile("id", asked, 1 / (20 * parts)) if asked else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))

    def heads(batches):
        for batch in batches:
            found = batch.column(0).to_numpy()
            at = np.searchsorted(bounds, found, "right")
            order = np.lexsort((found, at))
            first = np.unique(at[order], return_index=True)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[order][first]), pa.array(found[order][first])], names=["at", "id"]
            )

    rows = ids.mapInArrow(heads, "at BIGINT, id BIGINT")
    found = rows.groupBy("at").agg(F.min("id").alias("id")).toArrow().sort_by("at")
    return bounds, found["id"].to_numpy()


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text) and of their edited texts.

    The next document is that with the next larger id, after the last the
    first. ``parts`` is the number of id ranges (the session's shuffle
    partitions if not given). A null or empty text is empty, with an empty
    fingerprint; a null id counts as smaller than all; rows with equal ids
    follow each other by text; a table of one row is its own next; an empty
    table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, heads = _ranges(docs, parts)

    def deal(batches):
        for batch in batches:
            ids = batch.column(1).to_numpy()
            at = np.searchsorted(bounds, ids, "right")
            first = np.flatnonzero(np.isin(ids, heads))
            place = np.searchsorted(heads, ids[first])
            # Ranges are numbered by their heads, so that none is empty.
            own = np.searchsorted(heads, ids, "right") - 1
            guest = (place - 1) % len(heads)
            rows = np.concatenate((np.arange(len(ids)), first))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((own, guest))),
                    pa.array(np.concatenate((np.zeros(len(at), bool), np.ones(len(first), bool)))),
                    *taken.columns,
                ],
                names=["range", "guest", "doc_id", "id", "text"],
            )

    def run(batches):
        before, at, done = None, None, False
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for k, (place, guest, doc, _) in enumerate(zip(*columns, strict=True)):
                if place == at and done:
                    continue
                text = batch.column(4)[k].as_py()
                kept = sketch(text)
                if place == at:
                    out.append(_row(*before, text, kept))
                before, at, done = (doc, text, kept), place, guest
            yield _batch(out)

    dealt = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("id"),
        tables.text_of().alias("text"),
    ).mapInArrow(deal, "range BIGINT, guest BOOLEAN, doc_id BIGINT, id BIGINT, text STRING")
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "guest", "id", "text")
    return ordered.mapInArrow(run, MADE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 9
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=[c.split(" ")[0] for c in MADE.split(", ")],
    )
