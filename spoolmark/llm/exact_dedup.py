"""Exact duplicates by a stream with keyed state on disk.

Texts are equal when equal after deleting every character of [\\x20\\x09-\\x0D].
The stream reads the document files and keeps, for each digest of a normalised
text and for good, the row that stays: its length, its stable id and its
locator (file and id). The state store is disk-backed, its size follows the
number of different texts, and nothing expires. A digest is only a hint: every
row that hits another row's digest is compared with that row's text, byte for
byte, and rows that differ make groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolmark.llm import tables
from spoolmark.llm.tables import Workspace

#: State on disk, of which only changes are copied to the checkpoint; no room is
#: set aside in advance, as there may be many small stores. Names of the engine.
_STATE = "spark.sql.streaming.stateStore."
DISK_STATE = {
    _STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STATE + "rocksdb.changelogCheckpointing.enabled": "true",
    _STATE + "rocksdb.allowFAllocate": "false",
}
SPREAD = 2000  # rows of one group that are compared in one task, about


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t-\\r]", "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _prepared(docs: DataFrame, digest: Callable[[Column], Column], locator: Column) -> DataFrame:
    text = tables.text_of()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        digest(normalised(text)).alias("digest"),
        F.length(text).cast("bigint").alias("points"),
        locator.alias("locator"),
    )


def keepers(
    spark: SparkSession,
    folder: str,
    work: Workspace,
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """(digest, keep_id, keep_points, locator, group_size) after all files of ``folder``.

    Runs the stream over what it has not read yet: with a ``checkpoint`` of
    an earlier run only new files are read and the result has the digests
    they touch. The row that stays has the most code points, then the
    smallest id, a null id last.
    """
    schema = spark.read.parquet(folder).select("doc_id", "text").schema
    # A session of its own, so that the caller's settings stay as they are.
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    for name, value in DISK_STATE.items():
        session.conf.set(name, value)
    reader = session.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, the path may also be that of a single file.
    folder = folder.rstrip("/")
    read = reader.parquet(f"{folder[:-1]}[{folder[-1]}]")
    rows = _prepared(read, digest, F.col("_metadata.file_path"))
    best = F.max_by(
        F.struct("doc_id", "points", "locator"),
        F.struct("points", F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0))),
    )
    state = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    made = work.path("state")
    out = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])

    def append(batch: DataFrame, number: int) -> None:
        path = f"{made}/part={number}"
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(path)

    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint or work.path("stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.lastProgress is None:
        told = spark.createDataFrame([], out)
    else:
        told = spark.read.schema(out).option("recursiveFileLookup", "true").parquet(made)
    # A digest is told again by each batch that touches it; the last tells all.
    last = told.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
    return last.select(
        "digest",
        F.col("s.best.doc_id").alias("keep_id"),
        F.col("s.best.points").alias("keep_points"),
        F.col("s.best.locator").alias("locator"),
        F.col("s.group_size").alias("group_size"),
    )


def _differing(docs: DataFrame, rows: DataFrame, kept: DataFrame, digest: Callable) -> DataFrame:
    """Digests under which some row's bytes differ from those of the row that stays.

    A group is compared in as many tasks as its size asks for; only the row
    that stays is copied for that, and only rows that hit are shuffled again.
    """
    hits = rows.join(kept.where("group_size > 1"), "digest").select(
        "doc_id",
        "digest",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("stays"),
        F.ceil(F.col("group_size") / SPREAD).alias("shares"),
    )
    own = docs.select(F.col("doc_id").cast("bigint").alias("own_id"), tables.text_of().alias("text"))
    texts = (
        own.join(hits.distinct().hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")))
        .withColumn("bytes", normalised(F.col("text")))
        .where(digest(F.col("bytes")) == F.col("digest"))
        .select("doc_id", "digest", "stays", "shares", "bytes")
    )
    stays = (
        texts.where("stays")
        .dropDuplicates(["digest"])
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), F.col("bytes").alias("whole"))
    )
    others = texts.where("NOT stays").select(
        "digest", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"), "bytes"
    )
    return others.join(stays, ["digest", "share"]).where("bytes <> whole").select("digest").distinct()


def _flagged(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Every row with its group; of repeated rows that stay, the first."""
    one = rows.groupBy("doc_id", key, "points", "text_sha256").agg(F.count("*").alias("times"))
    each = one.join(groups, key).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return each.select(
        "doc_id", "keep_id", "group_size", (stays & (F.col("time") == 1)).alias("kept"), "text_sha256", "points", "locator"
    )


def deduplicate(
    spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Every row of the document files in ``folder`` (doc_id, text) with its group.

    Returns doc_id, keep_id (id of the row that stays: most code points, then
    smallest id), group_size, kept, text_sha256 (of the normalised text), points and
    locator (file of the row that stays). A null text is empty, and all empty
    texts are one group; of rows with equal ids and texts one is kept; a null
    id is the largest; an empty table gives no rows; further columns are not
    read. ``digest`` names texts in the state; whatever it is, groups are exact.
    """
    work = Workspace(spark, "exact-dedup")
    docs = spark.read.parquet(folder)
    kept = work.keep(keepers(spark, folder, work, digest), "kept")
    text = tables.text_of()
    columns = {
        "doc_id": F.col("doc_id").cast("bigint"),
        "digest": digest(normalised(text)),
        "points": F.length(text).cast("bigint"),
        "text_sha256": sha256(normalised(text)),
    }
    rows = work.keep(docs.select(*[c.alias(n) for n, c in columns.items()]), "rows")
    differing = work.keep(_differing(docs, rows, kept, digest), "differing")
    if differing.isEmpty():
        return _flagged(rows, kept, "digest")
    sound = differing.select("digest")
    right = _flagged(rows.join(sound, "digest", "left_anti"), kept, "digest")
    columns |= {"bytes": normalised(text), "locator": F.col("_metadata.file_path")}
    apart = docs.select(*[c.alias(n) for n, c in columns.items()])
    apart = apart.join(sound, "digest", "left_semi")
    best = F.max_by(
        F.struct("doc_id", "points", "locator"),
        F.struct("points", F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0))),
    )
    groups = apart.groupBy("bytes").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(
        "bytes",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.points").alias("keep_points"),
        F.col("best.locator").alias("locator"),
        "group_size",
    )
    return right.union(_flagged(apart.drop("locator"), groups, "bytes"))


def folder_of(docs: DataFrame, work: Workspace) -> str:
    """The folder whose files ``docs`` reads whole, else one that they are written to."""
    spark, files = docs.sparkSession, set(docs.inputFiles())
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(folders) == 1:
        folder = folders.pop()
        if set(spark.read.parquet(folder).inputFiles()) == files:
            return folder
    return work.keep(docs.select("doc_id", "text"), "docs").inputFiles()[0].rsplit("/", 1)[0]


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns of ``docs``, which reads files.

    The row with the most code points stays, then that of the smallest id; a null
    id is the largest; of rows with equal ids and texts one stays. Null, empty and
    blank texts are one group. Columns of ``docs`` may have any names; an empty
    table stays empty.
    """
    spark = docs.sparkSession
    found = deduplicate(spark, folder_of(docs, Workspace(spark, "distinct")))
    kept = found.where("kept").select("doc_id", "text_sha256", "points")
    text = tables.text_of()
    named = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        sha256(normalised(text)).alias("digest"),
        F.length(text).cast("bigint").alias("length"),
    )
    same = (
        (F.col("digest") == F.col("text_sha256"))
        & F.col("id").eqNullSafe(F.col("doc_id"))
        & (F.col("length") == F.col("points"))
    )
    left = named.join(kept, same, "left_semi").dropDuplicates(["digest"])
    return left.select("row.*")
