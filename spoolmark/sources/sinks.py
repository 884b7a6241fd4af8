"""Sinks: the append-only ledger, the metadata documents and plain files."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import stored_form
from ..operators.ledger import latest_parts
from ..schemas import PART_LEDGER, STORED_DOCUMENT, STORED_TIME
from .inventory import open_filesystem

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _names(directory: str) -> list[str]:
    """What lies in a folder, by name; nothing if it is not there."""
    from pyarrow import fs

    system, root = open_filesystem(directory)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found)


def _committed(directory: str, *levels: str) -> list[str]:
    """Folders ``level=value/...`` that a finished job wrote, relative to ``directory``."""
    below = [""]
    for level in levels:
        below = [f"{b}/{n}" for b in below for n in _names(directory + b) if n.startswith(f"{level}=")]
    return [b.lstrip("/") for b in below if "_SUCCESS" in _names(directory + b)]


# The ledger: deltas by writer and batch, folded from time to time into a base.


def write_ledger(batch: DataFrame, directory: str, batch_id: int, writer: str) -> None:
    """Append one batch of uploads; the same batch of the same writer replaces itself.

    Writers never touch each other's batches, so each needs a name of its own: a
    stream with a new checkpoint is a new writer, although its batches are
    numbered from 0 again.
    """
    if not writer or "/" in writer:
        raise ValueError("a writer needs a name, without a slash")
    columns = [f.name for f in PART_LEDGER.fields]
    target = f"{directory}/deltas/writer={writer}/batch_id={batch_id}"
    batch.select(*columns).write.mode("overwrite").parquet(target)


def _ledger_files(spark: SparkSession, directory: str) -> tuple[int, list[str], list[str], list[str]]:
    """(version, base folders, live delta folders, folded delta folders) of the last manifest."""
    written = _committed(f"{directory}/deltas", "writer", "batch_id")
    versions = [n for n in _names(f"{directory}/manifests") if n.endswith(".json")]
    if not versions:
        return 0, [], written, []
    last = spark.read.schema(_MANIFEST).json(f"{directory}/manifests/{versions[-1]}").first()
    folded = set(last["folded"])
    return int(versions[-1].split(".")[0]), [last["base"]], [d for d in written if d not in folded], sorted(folded)


_MANIFEST = "base STRING, folded ARRAY<STRING>"


def read_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """The upserted view of the ledger: the last upload of each part.

    Reads the last base and the deltas since, so the cost follows the live parts.
    """
    _, base, live, _ = _ledger_files(spark, directory)
    folders = [f"{directory}/base/{b}" for b in base] + [f"{directory}/deltas/{d}" for d in live]
    if not folders:
        return spark.createDataFrame([], PART_LEDGER)
    return latest_parts(spark.read.schema(PART_LEDGER).parquet(*folders))


def compact_ledger(spark: SparkSession, directory: str) -> None:
    """Fold all batches into a new base, which a new manifest names.

    The manifest appears in one step, after the base is whole: a compaction that
    dies before then leaves an unnamed folder and the ledger as it was, and batches
    written meanwhile stay live. ``vacuum_ledger`` removes what no manifest needs.
    """
    version, _, live, folded = _ledger_files(spark, directory)
    if not live:
        return
    base = f"{version + 1}-{uuid.uuid4().hex}"
    read_ledger(spark, directory).write.parquet(f"{directory}/base/{base}")
    line = json.dumps({"base": base, "folded": sorted({*folded, *live})})
    _put(f"{directory}/manifests/{version + 1:012}.json", line.encode())


def vacuum_ledger(spark: SparkSession, directory: str) -> None:
    """Remove folded batches, old bases and old manifests; readers that began before may fail."""
    _, base, _, folded = _ledger_files(spark, directory)
    if not base:
        return
    system, root = open_filesystem(directory)
    written = _committed(f"{directory}/deltas", "writer", "batch_id")
    unused = [f"deltas/{d}" for d in written if d in set(folded)]
    unused += [f"base/{b}" for b in _names(f"{directory}/base") if b not in base]
    for folder in unused:
        system.delete_dir(f"{root}/{folder}")
    for name in _names(f"{directory}/manifests")[:-1]:
        system.delete_file(f"{root}/manifests/{name}")


def _put(path: str, data: bytes) -> None:
    """Write a small file that appears whole."""
    system, target = open_filesystem(path)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    staged = f"{target}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(staged) as out:
        out.write(data)
    system.move(staged, target)


# Metadata documents: pages by run, and a manifest of the pages of each stream in a
# folder that plain reads of the documents pass over.

_LINE = T.StructType(
    [
        T.StructField("metadata_key", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("document", STORED_DOCUMENT),
    ]
)
_PAGES = "stream_id STRING, pages BIGINT, run BIGINT, attempt STRING"


def write_metadata_json(documents: DataFrame, directory: str, run: int | None = None) -> None:
    """One JSON line per document, with its target key and page; nulls kept.

    Each run adds a folder of its own, and earlier documents stay. A run counts
    once its manifest, the number of pages of each of its streams, is written; a
    run that counts is not written again, so a retry changes nothing. Without
    ``run`` it is the one after the last that counts. The pages are gzipped.
    """
    done = {int(f.split("/")[0].removeprefix("run=")) for f in _committed(f"{directory}/_manifests", "run", "attempt")}
    run = max(done, default=0) + 1 if run is None else run
    if run in done:
        return
    attempt = uuid.uuid4().hex
    pages = f"{directory}/run={run}/attempt={attempt}"
    lines = stored_form(documents).write.option("compression", "gzip")
    lines.option("ignoreNullFields", "false").option("timestampFormat", STORED_TIME).json(pages)
    written = _lines(documents.sparkSession, [pages])
    written.groupBy(F.col("document.stream_id").alias("stream_id")).agg(
        F.count("*").alias("pages")
    ).withColumn("run", F.lit(run).cast("bigint")).withColumn("attempt", F.lit(attempt)).write.parquet(
        f"{directory}/_manifests/run={run}/attempt={attempt}"
    )


def _lines(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(_LINE).option("timestampFormat", STORED_TIME).json(folders)


def read_metadata_json(spark: SparkSession, directory: str) -> DataFrame:
    """The lines of ``write_metadata_json`` in their stored form: all pages of the last
    run of each stream, and none of earlier runs.

    Nothing replaces the newest run, so its lines are read as they are; only those of
    the runs before it are joined with the manifests.
    """
    runs = _committed(f"{directory}/_manifests", "run", "attempt")
    if not runs:
        return spark.createDataFrame([], _LINE)
    newest = max(runs, key=_run_and_attempt)
    lines = _lines(spark, [f"{directory}/{newest}"])
    earlier = [r for r in runs if r != newest]
    if not earlier:
        return lines
    named = spark.read.schema(_PAGES).parquet(*[f"{directory}/_manifests/{r}" for r in runs])
    last = named.groupBy("stream_id").agg(F.max(F.struct("run", "attempt")).alias("last"))
    from_file = F.regexp_extract(F.input_file_name(), "/run=([0-9]+)/attempt=([0-9a-f]+)/", 2)
    older = _lines(spark, [f"{directory}/{r}" for r in earlier]).withColumn("_attempt", from_file)
    current = last.select(F.col("stream_id").alias("_stream"), F.col("last.attempt").alias("_current"))
    same = F.col("document.stream_id").eqNullSafe(F.col("_stream")) & (F.col("_attempt") == F.col("_current"))
    return lines.unionByName(older.join(current, same).select(*lines.columns))


def _run_and_attempt(folder: str) -> tuple[int, str]:
    run, attempt = folder.split("/")
    return int(run.removeprefix("run=")), attempt


def _write_each(directory: str):
    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, root = open_filesystem(directory)
        system.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, data in zip(batch.column("file_name"), batch.column("data")):
                path = f"{root}/{name.as_py()}"
                data = data.as_py()
                # A file appears whole; a retried task puts the same bytes in its place.
                staged = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(staged) as out:
                    out.write(data)
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    system.delete_file(path)
                system.move(staged, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return write


def write_files(files: DataFrame, directory: str) -> int:
    """One file below ``directory`` per (file_name, data); the bytes written."""
    written = files.select("file_name", "data").mapInArrow(_write_each(directory), "path STRING, size BIGINT")
    return written.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
