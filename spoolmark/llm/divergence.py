"""Divergence of sources: term rates of each source against the other sources and its language.

Kept terms are found by iceberg prefix refinement. A term is at least as frequent
as none of its prefixes: a document with the term has the prefix too. So prefixes
of ``first`` bytes are counted first, then those of twice as many bytes below the
prefixes that passed, and so on. A closed term ends with a blank, which no term
holds, so a term and a longer one that starts with it are different prefixes.
The long tail of rare terms is dropped where it is read and never shuffled.

Each batch of rows is counted in its task before anything is shuffled: a term or
prefix of a batch becomes one row, whose counts by source lie in arrays.

Terms are held with one character per UTF-8 byte, so that lengths are bytes.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolmark.llm.tables import Workspace, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = " "
#: Bytes of the prefixes of the first level; each level doubles them.
FIRST_BYTES = 8
#: Sources that are compared with each other in one block.
BLOCK = 64
SCALE = 1_000_000_000
#: Rows whose terms a task holds as Python strings at once, and rows that it counts together.
_ROWS, _COUNTED_ROWS = 500, 4000
_TERMS = "lang STRING, source STRING, terms ARRAY<STRING>, counts ARRAY<BIGINT>"
_FOUND = "lang STRING, term STRING, block INT, at ARRAY<INT>, n ARRAY<BIGINT>"
#: A to Z to lower case, letters and all bytes of other alphabets kept, the rest to blanks.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def _count_terms(batches) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(start, _ROWS)
            terms, counts, ends = [], [], [0]
            for text in batch.column("text"):
                # Only bytes are split at ASCII blanks alone.
                found = Counter(text.as_buffer().to_pybytes().translate(_FOLD).split())
                if found:
                    # In order, terms with a common prefix are neighbours.
                    own = sorted(found)
                    counts += map(found.__getitem__, own)
                    terms += (b" \n".join(own) + b" ").decode("latin-1").split("\n")
                ends.append(len(terms))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("source"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.string())),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64())),
                ],
                ["lang", "source", "terms", "counts"],
            )


def document_terms(docs: DataFrame) -> DataFrame:
    """Different terms of each row, in order, with their counts; a null is as good as empty."""
    plain = docs.select(*[text_of(c).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(_count_terms, _TERMS)


def _parts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _COUNTED_ROWS):
            yield batch.slice(start, _COUNTED_ROWS)


def _rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of each element of flattened lists."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _prefix_counts(width: int, before: int):
    def count(batches) -> Iterator[pa.RecordBatch]:
        """Rows of a batch with each prefix of ``width`` bytes, of terms over ``before`` bytes."""
        for batch in _parts(batches):
            langs = batch.column("lang").dictionary_encode()
            row, terms = _rows_of(batch.column("terms")), batch.column("terms").flatten()
            if before:
                long = pc.greater(pc.utf8_length(terms), before)
                row, terms = row[long.to_numpy(zero_copy_only=False)], terms.filter(long)
            cut = pc.utf8_slice_codeunits(terms, 0, width).dictionary_encode()
            code = cut.indices.to_numpy(zero_copy_only=False).astype("int64")
            new = _changes(row, code) if len(row) else np.zeros(0, bool)
            lang = langs.indices.to_numpy(zero_copy_only=False).astype("int64")[row[new]]
            keys, rows = np.unique(lang * max(len(cut.dictionary), 1) + code[new], return_counts=True)
            lang, code = np.divmod(keys, max(len(cut.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), cut.dictionary.take(pa.array(code)), pa.array(rows)],
                ["lang", "prefix", "docs"],
            )

    return count


def kept_terms(
    terms: DataFrame, work: Workspace, min_docs: int, first: int = FIRST_BYTES
) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` rows of their language."""
    width, parents, kept = first, None, None
    while True:
        before = 0 if parents is None else width // 2
        rows = terms.select("lang", "terms").mapInArrow(
            _prefix_counts(width, before), "lang STRING, prefix STRING, docs BIGINT"
        )
        if parents is not None:
            rows = rows.withColumn("parent", F.substring("prefix", 1, before)).join(
                parents.select("lang", F.col("prefix").alias("parent")), ["lang", "parent"], "left_semi"
            )
        frequent = work.keep(
            rows.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(f"docs >= {min_docs}"),
            f"prefixes-{width}",
        )
        closed = frequent.where(F.endswith("prefix", F.lit(END)))
        closed = closed.select("lang", F.col("prefix").alias("term"))
        kept = closed if kept is None else kept.union(closed)
        parents = frequent.where(~F.endswith("prefix", F.lit(END)))
        if parents.isEmpty():
            return kept
        width *= 2


def _lists(keys: list[np.ndarray], at: np.ndarray, n: np.ndarray):
    """Equal (keys, at) summed, and one list per (keys, block): first places, blocks, lists."""
    order = np.lexsort((at, *reversed(keys)))
    keys, at, n = [k[order] for k in keys], at[order], n[order]
    starts = np.flatnonzero(_changes(*keys, at))
    n = np.add.reduceat(n, starts)
    keys, at, order = [k[starts] for k in keys], at[starts], order[starts]
    firsts = np.flatnonzero(_changes(*keys, at // BLOCK))
    ends = pa.array(np.append(firsts, len(at)), pa.int32())
    return (
        order[firsts],
        pa.array(at[firsts] // BLOCK, pa.int32()),
        pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
        pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())),
    )


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term of a batch by source."""
    for batch in _parts(batches):
        row, terms = _rows_of(batch.column("terms")), batch.column("terms").flatten().dictionary_encode()
        if not len(row):
            continue
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)[row]
        code = terms.indices.to_numpy(zero_copy_only=False)
        at = batch.column("at").to_numpy(zero_copy_only=False)[row]
        first, block, ats, ns = _lists([lang, code], at, batch.column("counts").flatten().to_numpy())
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(lang[first])), terms.dictionary.take(pa.array(code[first])), block, ats, ns],
            ["lang", "term", "block", "at", "n"],
        )


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """Rows of one (lang, term) made one per block; they arrive in order.

    The last term of a batch may go on in the next one, so it is held back, merged.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        ids = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in ("lang", "term")]
        group = np.cumsum(_changes(*ids)) - 1
        row = _rows_of(batch.column("at"))
        first, block, ats, ns = _lists(
            [group[row]], batch.column("at").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
        )
        place = row[first]
        made = pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(place)), batch.column("term").take(pa.array(place)), block, ats, ns],
            schema=batch.schema,
        )
        done = int(np.searchsorted(group[place], group[-1]))
        held = made.slice(done)
        if done:
            yield made.slice(0, done)
    if held is not None:
        yield held


def term_counts(terms: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, block, at, n): occurrences of kept terms, by the numbers of their sources."""
    numbered = terms.join(groups.select("lang", "source", "at"), ["lang", "source"])
    packed = numbered.select("lang", "at", "terms", "counts").mapInArrow(_pack, _FOUND)
    packed = packed.join(kept, ["lang", "term"], "left_semi")
    dealt = packed.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.select("lang", "term", "block", "at", "n").mapInArrow(_merge, _FOUND)


def _rates(count, total, vocabulary) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 vocabulary)), exact whatever the counts."""
    count, under = np.asarray(count), np.asarray(total) + 5 * np.asarray(vocabulary)
    if len(count) and count.max() > 9 * 10**8:
        count, under = count.astype(object), under.astype(object)
    return (1 + (SCALE * (count + 5)) // under).astype("int64")


def _prominent(top: int):
    def find(batches) -> Iterator[pa.RecordBatch]:
        """Terms that a source uses more than its language: the best of each batch."""
        for batch in batches:
            row = _rows_of(batch.column("at"))
            at, n = (batch.column(c).flatten().to_numpy() for c in ("at", "n"))
            block, lang_n, lang_total, v = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "lang_n", "lang_total", "v")
            )
            sizes = pc.list_value_length(batch.column("totals")).to_numpy(zero_copy_only=False)
            own = (np.cumsum(sizes) - sizes)[row] + at - block[row] * BLOCK
            total = batch.column("totals").flatten().to_numpy()[own]
            value = _rates(n, total, v[row]) - _rates(lang_n, lang_total, v)[row]
            more = value > 0
            table = pa.table(
                {
                    "lang": batch.column("lang").take(pa.array(row[more])),
                    "at": at[more],
                    "value": value[more],
                    "term": batch.column("term").take(pa.array(row[more])),
                }
            )
            table = table.sort_by([("lang", "ascending"), ("at", "ascending"), ("value", "descending"), ("term", "ascending")])
            if table.num_rows:
                ids = table["lang"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(_changes(ids, table["at"].to_numpy()))
                place = np.arange(table.num_rows) - np.repeat(starts, np.diff(np.append(starts, table.num_rows)))
                table = table.take(pa.array(np.flatnonzero(place < top)))
            yield from table.combine_chunks().to_batches()

    return find


def _pair_sums(batches) -> Iterator[pa.RecordBatch]:
    """Sums over terms of |p - q| less what two absent terms give, per two sources of a block."""
    sums: dict = {}
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("part", pa.int64())])

    def flush():
        for (lang, low, high), total in sums.items():
            a, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(a), pa.string()),
                    pa.array(a + low * BLOCK, pa.int32()),
                    pa.array(b + high * BLOCK, pa.int32()),
                    pa.array(total[a, b], pa.int64()),
                ],
                schema=schema,
            )
        sums.clear()

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "low", "high"))))
        places: dict = {}
        for place, key in enumerate(keys):
            places.setdefault(key, []).append(place)
        for key, rows in places.items():
            part = batch.take(pa.array(rows))
            row = _rows_of(part.column("at"))
            at, n = (part.column(c).flatten().to_numpy() for c in ("at", "n"))
            v = part.column("v")[0].as_py()
            sides = []
            for block, name in ((key[1], "low_totals"), (key[2], "high_totals")):
                totals = part.column(name)[0].values.to_numpy()
                base = _rates(np.zeros(len(totals), "int64"), totals, v)
                rate = np.repeat(base[None, :], len(rows), 0)
                own = at // BLOCK == block
                place = at[own] - block * BLOCK
                rate[row[own], place] = _rates(n[own], totals[place], v)
                sides.append((base, rate))
            (left, p), (right, q) = sides
            if len(sums) >= 256 and key not in sums:
                yield from flush()
            total = sums.setdefault(key, np.zeros((len(left), len(right)), "int64"))
            total -= len(rows) * np.abs(left[:, None] - right)
            for a in range(len(left)):
                total[a] += np.abs(p[:, a : a + 1] - q).sum(0)
    yield from flush()


def _pairs(groups: DataFrame, found: DataFrame, totals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all two sources of one language.

    Sources are numbered within their language and compared block by block: a
    term's row holds the counts of two blocks at most, however many sources there are.
    """
    blocks = totals.groupBy("lang").agg(F.max("block").alias("last"))
    dealt = (
        found.join(blocks, "lang")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    # At most the lists of two blocks meet.
    both = dealt.groupBy("lang", "low", "high", "term").agg(
        F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("n")).alias("n")
    )
    whole = (
        both.join(totals.toDF("lang", "low", "low_totals"), ["lang", "low"])
        .join(totals.toDF("lang", "high", "high_totals"), ["lang", "high"])
        .join(vocabulary, "lang")
        .select("lang", "low", "high", "at", "n", "low_totals", "high_totals", "v")
    )
    sums = whole.mapInArrow(_pair_sums, "lang STRING, a INT, b INT, part BIGINT")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    # Blocks are compared one way only.
    turned = sums.where(F.floor(F.col("a") / BLOCK) != F.floor(F.col("b") / BLOCK))
    sums = sums.union(turned.select("lang", "b", "a", "part"))
    left = groups.select("lang", "source", F.col("at").alias("a"), F.col("base").alias("p"), "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("base").alias("q"))
    absent = F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")), F.lit(0))
    return (
        left.join(right, "lang")
        .where("a <> b")
        .join(sums, ["lang", "a", "b"], "left")
        .select(
            "lang", "source", "item", (absent + F.coalesce("part", F.lit(0))).cast("bigint").alias("value")
        )
    )


def _term(column):
    """The term itself: no closing blank, bytes as UTF-8."""
    return F.decode(F.encode(F.rtrim(column), "ISO-8859-1"), "UTF-8")


def audit_sources(
    docs: DataFrame, work: Workspace, min_docs: int = 30, top: int = 50, first: int = FIRST_BYTES
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source departs.

    Part ``pair`` has every other source of the language by the sum of rate
    differences; part ``term`` the ``top`` kept terms that a source uses more than
    its language. Every row of ``docs`` counts as a document, so repeated rows
    and ids count each time. Null text, lang or source is as good as empty; a
    group without terms is there too; an empty table gives an empty result.
    Other columns are not read. A task holds the terms of one text whole.
    """
    terms = work.keep(document_terms(docs), "terms")
    kept = kept_terms(terms, work, min_docs, first)
    number = Window.partitionBy("lang").orderBy("source")
    groups = terms.select("lang", "source").distinct()
    groups = work.keep(groups.withColumn("at", F.row_number().over(number) - 1), "groups")
    found = work.keep(term_counts(terms, groups, kept), "counts")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = (
        found.select("lang", F.explode(F.arrays_zip("at", "n")).alias("e"))
        .groupBy("lang", "e.at")
        .agg(F.sum("e.n").alias("total"))
    )
    over = F.lit(5 * SCALE).cast("decimal(20,0)")
    under = (F.col("total") + 5 * F.col("v")).cast("decimal(20,0)")
    groups = (
        groups.join(vocabulary, "lang", "left")
        .join(sizes, ["lang", "at"], "left")
        .na.fill(0, ["v", "total"])
        .withColumn("base", F.when(F.col("v") > 0, F.call_function("div", over, under) + 1))
    )
    groups = work.keep(groups, "sizes")
    block = F.floor(F.col("at") / BLOCK).cast("int")
    totals = groups.groupBy("lang", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "total"))).alias("list")
    )
    totals = totals.select("lang", "block", F.col("list.total").alias("totals"))
    langs = found.groupBy("lang", "term").agg(
        F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("lang_n")
    )
    lang_sizes = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("v"))
    marked = (
        found.join(langs, ["lang", "term"])
        .join(lang_sizes, "lang")
        .join(totals, ["lang", "block"])
        .select("lang", "term", "block", "at", "n", "lang_n", "lang_total", "v", "totals")
        .mapInArrow(_prominent(top), "lang STRING, at INT, value BIGINT, term STRING")
    )
    # Terms are in the order of their bytes as they are held; names join the best alone.
    best = Window.partitionBy("lang", "at").orderBy(F.desc("value"), "term")
    marked = (
        marked.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .join(groups.select("lang", "at", "source"), ["lang", "at"])
        .select(
            "lang", "source", F.lit("term").alias("part"), _term(F.col("term")).alias("item"), "value", "rank"
        )
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, found, totals, vocabulary)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return marked.union(pairs.withColumn("rank", F.row_number().over(order)))
