"""Files on disk: inventory, ranged reads, feeds and sinks."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoolmark import schemas
from spoolmark.operators import chunks, documents, ledger
from spoolmark.plans import catalog
from spoolmark.sources import chunk_reader, inventory, sinks

from helpers import at, rows


@pytest.fixture
def media(tmp_path):
    """A folder of files, one empty, one nested, one of another kind."""
    content = {
        "a.mp4": bytes(range(256)) * 4,
        "empty.mp4": b"",
        "sub/deep/b.mp4": b"0123456789" * 3,
        "sub/c.MP4": b"no",
        "text.mp4": b"just text, named as media",
        "d.txt": b"no",
    }
    for name, data in content.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    return tmp_path, {n: d for n, d in content.items() if n.endswith(".mp4")}


def test_inventory_lists_every_file_once(spark, media):
    folder, content = media
    made = inventory.file_inventory(spark, str(folder))
    assert rows(made, "path", "file_name", "size") == sorted(
        (str(folder / n), n.rsplit("/", 1)[-1], len(d)) for n, d in content.items()
    )
    assert made.filter("modified_at IS NULL").count() == 0


def test_inventory_by_uri(spark, media):
    folder, content = media
    made = inventory.file_inventory(spark, f"file://{folder}")
    assert rows(made, "path", "size") == sorted((str(folder / n), len(d)) for n, d in content.items())


def test_inventory_shares_agree(spark, media):
    folder, _ = media
    spark.dataSource.register(inventory.FileInventory)
    listed = [
        rows(spark.read.format("file_inventory").option("path", str(folder)).option("shares", n).load())
        for n in (1, 7)
    ]
    assert listed[0] == listed[1]
    assert len(listed[0]) == 6


def test_read_chunks_returns_every_byte(spark, media):
    folder, content = media
    made = chunk_reader.read_chunks(spark, str(folder), 100)
    got = {}
    for r in made.orderBy("path", "part_number").collect():
        assert r["length"] == len(r["data"])
        assert r["offset"] == len(got.get(r["path"], b""))
        got[r["path"]] = got.get(r["path"], b"") + bytes(r["data"])
    assert got == {str(folder / n): d for n, d in content.items() if d}
    tags = chunks.chunk_checksums(made).filter(F.col("path").endswith("b.mp4")).first()["etag"]
    assert tags == hashlib.md5(b"0123456789" * 3).hexdigest()


def test_reading_tasks_do_not_shrink_with_the_plan(spark, media):
    made = chunk_reader.read_chunks(spark, str(media[0]), 100, tasks=5)
    made.collect()
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    assert made.rdd.getNumPartitions() == 5


def test_short_and_vanished_files_end_quietly(spark, media):
    folder, content = media
    files = inventory.file_inventory(spark, str(folder)).select("path", "size").collect()
    planned = chunks.plan_chunks(spark.createDataFrame(files), 100)
    (folder / "a.mp4").write_bytes(b"x" * 130)
    (folder / "text.mp4").unlink()
    made = chunk_reader.fetch_chunks(planned.select("path", "part_number", "offset", "length"), str(folder))
    got = rows(made, F.substring_index("path", "/", -1).alias("f"), "part_number", "length", "status")
    assert got[:3] == [("a.mp4", 1, 100, "ok"), ("a.mp4", 10, 0, "short"), ("a.mp4", 11, 0, "short")]
    assert ("a.mp4", 2, 30, "short") in got and ("text.mp4", 1, 0, "missing") in got
    assert [r["data"] for r in made.filter("status = 'missing'").collect()] == [None]
    assert len(got) == planned.count()


def test_ranges_are_dealt_by_bytes(spark, tmp_path):
    sizes = {"big": 10_000, "a": 0, "z": 500, **{f"s{n:02}": 37 for n in range(40)}}
    for name, size in sizes.items():
        (tmp_path / f"{name}.mp4").write_bytes(bytes(size))
    made = chunk_reader.read_chunks(spark, str(tmp_path), 100, bytes_per_task=1000)
    total = sum(sizes.values())
    by_task = made.groupBy(F.spark_partition_id().alias("t")).agg(F.sum("length").alias("bytes"))
    loads = [r["bytes"] for r in by_task.collect()]
    assert sum(loads) == total and len(loads) == -(-total // 1000) and max(loads) <= 1100


def test_snapshot_diff(spark):
    def listing(*records):
        return spark.createDataFrame([(p, p, s, t) for p, s, t in records], schemas.FILES)

    old = listing(("gone", 1, at("12:00")), ("same", 1, at("12:00")), ("grown", 1, at("12:00")), ("touched", 1, at("12:00")))
    new = listing(("same", 1, at("12:00")), ("grown", 2, at("12:00")), ("touched", 1, at("12:01")), ("fresh", 0, at("12:00")))
    assert rows(inventory.snapshot_diff(old, new)) == [
        ("fresh", "added", None, 0),
        ("gone", "deleted", 1, None),
        ("grown", "modified", 1, 2),
        ("touched", "modified", 1, 1),
    ]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_change_feed_batch_and_stream(spark, tmp_path, fmt):
    folder = str(tmp_path / "feed")
    data = [(1, at("12:00"), "p", "added"), (2, at("12:01"), "p", "deleted")]
    spark.createDataFrame(data, schemas.RAW_CHANGES).write.format(fmt).save(folder)
    assert rows(inventory.change_feed(spark, folder, fmt)) == data
    stream = inventory.change_feed(spark, folder, fmt, streaming=True, maxFilesPerTrigger="1")
    made = catalog._drained(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    assert rows(made) == data
    with pytest.raises(ValueError):
        inventory.change_feed(spark, folder, "csv")


def test_ledger_batches_replace_and_upsert(spark, tmp_path):
    folder = str(tmp_path / "ledger")

    def batch(*records):
        return spark.createDataFrame(list(records), schemas.PART_LEDGER)

    sinks.write_ledger(batch(("s", 1, "a", 1, at("12:00"))), folder, 0, "w")
    sinks.write_ledger(batch(("s", 1, "b", 2, at("12:01")), ("s", 2, "c", 3, at("12:01"))), folder, 1, "w")
    expected = [("s", 1, "b", 2), ("s", 2, "c", 3)]
    columns = ("stream_id", "part_number", "etag", "size_bytes")
    assert rows(sinks.read_ledger(spark, folder), *columns) == expected
    sinks.write_ledger(batch(("s", 1, "b", 2, at("12:01")), ("s", 2, "c", 3, at("12:01"))), folder, 1, "w")
    assert spark.read.parquet(folder).count() == 3
    assert rows(sinks.read_ledger(spark, folder), *columns) == expected
    assert ledger.stream_totals(sinks.read_ledger(spark, folder)).first()["total_size_bytes"] == 5


def test_ledger_writers_and_compaction(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ledger")
    columns = ("stream_id", "part_number", "etag")

    def put(batch_id, writer, *records):
        data = [(stream, part, tag, 1, at(when)) for stream, part, tag, when in records]
        sinks.write_ledger(spark.createDataFrame(data, schemas.PART_LEDGER), folder, batch_id, writer)

    def view():
        return rows(sinks.read_ledger(spark, folder), *columns)

    assert view() == []
    with pytest.raises(TypeError):
        sinks.write_ledger(spark.createDataFrame([], schemas.PART_LEDGER), folder, 0)
    # Two batch jobs with the same number keep out of each other's way.
    put(0, "one", ("s", 1, "a", "12:00"))
    put(0, "two", ("s", 2, "b", "12:00"))
    put(1, "one", ("s", 1, "a2", "12:05"))
    expected = [("s", 1, "a2"), ("s", 2, "b")]
    assert view() == expected
    # A compaction that dies before its manifest, and one that is completed.
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sinks.compact_ledger(spark, folder)
    assert view() == expected
    sinks.compact_ledger(spark, folder)
    assert view() == expected
    read = sinks.read_ledger(spark, folder).inputFiles()
    assert read and all("/base/" in f for f in read)
    # Late and repeated batches after it.
    put(1, "one", ("s", 1, "a2", "12:05"))
    put(2, "one", ("s", 2, "old", "11:00"), ("t", 1, "c", "12:10"))
    expected.append(("t", 1, "c"))
    assert view() == expected
    sinks.vacuum_ledger(spark, folder)
    assert view() == expected
    sinks.compact_ledger(spark, folder)
    sinks.vacuum_ledger(spark, folder)
    sinks.compact_ledger(spark, folder)
    assert view() == expected
    assert len(list((tmp_path / "ledger" / "base").iterdir())) == 1
    assert not list((tmp_path / "ledger" / "deltas").glob("*/*"))


def test_documents_of_a_later_run_replace_all_pages(spark, tmp_path):
    folder = str(tmp_path / "documents")
    assert sinks.read_metadata_json(spark, folder).count() == 0

    def put(parts, run=None, stream="s"):
        state = spark.createDataFrame([(stream, "/p", "b", "k", at("12:00"))], "stream_id STRING, original_path STRING, s3_bucket STRING, s3_key_prefix STRING, started_at TIMESTAMP")
        for field in schemas.STREAM_META.fields:
            if field.name not in state.columns:
                state = state.withColumn(field.name, F.lit(None).cast(field.dataType))
        ledger_rows = [(stream, n, "e", 1, at("12:00")) for n in range(1, parts + 1)]
        made = documents.metadata_documents(
            state.select(*schemas.STREAM_META.fieldNames()),
            spark.createDataFrame(ledger_rows, schemas.PART_LEDGER),
            spark.createDataFrame([], schemas.DURATIONS),
            "2024-01-01",
            parts_per_page=1,
        )
        sinks.write_metadata_json(made, folder, run)

    def view():
        part = documents.flatten_chunks(sinks.read_metadata_json(spark, folder))
        return rows(part, "stream_id", "part_number")

    put(5)
    put(1, stream="t")
    put(2)
    expected = [("s", 1), ("s", 2), ("t", 1)]
    assert view() == expected
    # A retried run changes nothing, and one without its manifest does not count.
    put(4, run=3)
    assert view() == expected
    put(7)
    (tmp_path / "documents" / "_manifests" / "run=4").rename(tmp_path / "lost")
    assert view() == expected
    put(3, run=4)
    assert view() == [("s", 1), ("s", 2), ("s", 3), ("t", 1)]


def test_documents_of_one_run_are_read_without_a_shuffle(spark, tmp_path):
    """One run replaces nothing: its lines, a stream without an id too, are read as written."""
    folder = str(tmp_path / "documents")
    names = [*schemas.METADATA_DOCUMENT.fieldNames(), "page"]
    row = ("/p", "b", "k", 1, 1.0, at("12:00"), at("12:00"), at("12:00"), [(1, 1, "e", at("12:00"))], 0)
    table = T.StructType([*schemas.METADATA_DOCUMENT.fields, T.StructField("page", T.LongType())])

    def put(*streams):
        made = spark.createDataFrame([(s, *row) for s in streams], table)
        sinks.write_metadata_json(made.select(*names), folder)

    def view():
        return rows(documents.flatten_chunks(sinks.read_metadata_json(spark, folder)), "stream_id", "part_number")

    put("s", "s", None, "t")
    plan = sinks.read_metadata_json(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert view() == [(None, 1), ("s", 1), ("s", 1), ("t", 1)]
    written = list((tmp_path / "documents").glob("run=*/*/part-*"))
    assert written and all(f.name.endswith(".json.gz") for f in written)
    put(None, "s")
    assert view() == [(None, 1), ("s", 1), ("t", 1)]
