"""Chunk planning and the ledger, on small known inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spoolmark import schemas
from spoolmark.operators import chunks, filters, ledger

from helpers import at, rows

MB = 10_485_760


def files(spark, *sizes):
    data = [(f"/w/{i}.mp4", f"{i}.mp4", size, at("12:00")) for i, size in enumerate(sizes)]
    return spark.createDataFrame(data, schemas.FILES)


def parts(spark, *records):
    return spark.createDataFrame(list(records), schemas.PART_LEDGER)


def meta(spark, *records):
    """State rows from (id, bytes sent, next part)."""
    full = [
        (i, f"/w/{i}.mp4", "u", "b", f"streams/{i}/{i}.mp4", "active", at("11:00"), at("11:00"), None, sent, part, None)
        for i, sent, part in records
    ]
    return spark.createDataFrame(full, schemas.STREAM_META)


@pytest.mark.parametrize(
    "size, chunk, expected",
    [
        (0, 10, []),
        (MB // 2, MB, [(1, 0, MB // 2)]),
        (MB + MB // 2, MB, [(1, 0, MB), (2, MB, MB // 2)]),
        (25, 10, [(1, 0, 10), (2, 10, 10), (3, 20, 5)]),
        (20, 10, [(1, 0, 10), (2, 10, 10)]),
        (1, 10, [(1, 0, 1)]),
    ],
)
def test_plan_chunks(spark, size, chunk, expected):
    made = chunks.plan_chunks(files(spark, size), chunk)
    assert rows(made, "part_number", "offset", "length") == expected


@pytest.mark.parametrize("size", [10, 9, 0])
def test_plan_chunks_nothing_left(spark, size):
    assert rows(chunks.plan_chunks(files(spark, size), 4, F.lit(10), F.lit(3))) == []


def test_plan_chunks_continues(spark):
    made = chunks.plan_chunks(files(spark, 25), 10, F.lit(7), F.lit(4))
    assert rows(made, "part_number", "offset", "length") == [(4, 7, 10), (5, 17, 8)]


def test_plan_chunks_many_steps(spark):
    made = chunks.plan_chunks(files(spark, 25_003), 1)
    got = made.agg(
        F.count("*"), F.min("part_number"), F.max("part_number"), F.sum("length"), F.max("offset")
    ).first()
    assert tuple(got) == (25_003, 1, 25_003, 25_003, 25_002)


def test_assemble_is_whole_in_segments(spark):
    text = bytes(range(256)) * 5
    planned = chunks.plan_chunks(files(spark, len(text)), 100).withColumn("stream_id", F.lit("s"))
    cut = chunks.slice_chunks(planned.withColumn("data", F.lit(text)))
    made = chunks.assemble_objects(cut, max_bytes=500).orderBy("offset").collect()
    assert [r["segment"] for r in made] == [0, 1, 2]
    assert b"".join(bytes(r["data"]) for r in made) == text
    assert sum(r["length"] for r in made) == len(text)


def test_chunk_checksums(spark):
    one = spark.createDataFrame([("s", 1, 0, 3, b"abc")], schemas.CHUNKS)
    assert rows(chunks.chunk_checksums(one), "etag") == [(hashlib.md5(b"abc").hexdigest(),)]


def test_parse_part_records(spark):
    raw = spark.createDataFrame(
        [
            ("s", "1", "etag1:100:2023-01-01T12:00:00+00:00"),
            ("s", "2", "etag2:200"),
            ("s", "3", "totally_malformed"),
            ("t", "abc", "etag1:100:2023-01-01T12:00:00+00:00"),
            ("t", "1", "etag2:xyz:2023-01-01T12:00:00+00:00"),
            ("t", "2", "e:1_000"),
            ("t", "3", ":5:"),
            ("t", "4", None),
        ],
        schemas.PART_LEDGER_RAW,
    )
    parsed = ledger.parse_part_records(raw)
    assert rows(ledger.accepted(parsed), "stream_id", "part_number", "etag", "size_bytes", "uploaded_at") == [
        ("s", 1, "etag1", 100, at("12:00")),
        ("s", 2, "etag2", 200, None),
        ("t", 3, "", 5, None),
    ]
    assert rows(ledger.quarantined(parsed), "stream_id", "part_key", "reject_reason") == [
        ("s", "3", "no_size_field"),
        ("t", "1", "bad_size"),
        ("t", "2", "bad_size"),
        ("t", "4", "no_size_field"),
        ("t", "abc", "bad_part_number"),
    ]
    assert "2023-01-01T12:00:00+00:00" in [r[0] for r in rows(ledger.accepted(parsed), "uploaded_at_text")]


def test_latest_parts(spark):
    made = ledger.latest_parts(
        parts(
            spark,
            ("s", 1, "a", 1, at("12:00")),
            ("s", 1, "b", 2, at("12:01")),
            ("s", 2, "x", 3, at("12:00")),
            ("s", 2, "y", 3, at("12:00")),
            ("s", 3, "n", 4, None),
        )
    )
    assert rows(made, "part_number", "etag") == [(1, "b"), (2, "y"), (3, "n")]


def test_upload_progress(spark):
    log = parts(
        spark,
        ("lost", 1, None, 100, at("12:00")),
        ("cut", 1, "a", MB, at("12:00")),
        ("mid", 1, "a", 10, at("12:05")),
        ("mid", 2, "b", 20, at("12:04")),
        ("mid", 3, None, 30, at("12:06")),
        ("mid", 4, "d", 40, at("12:07")),
        ("retried", 1, None, 5, at("12:00")),
        ("retried", 1, "a", 5, at("12:01")),
        ("spoilt", 1, "a", 7, at("12:00")),
        ("spoilt", 1, None, 7, at("12:02")),
        ("spoilt", 2, "b", 8, at("12:03")),
    )
    expected = [
        ("cut", 1, MB, 2, at("12:00")),
        ("mid", 1, 10, 2, at("12:05")),
        ("mid", 2, 30, 3, at("12:05")),
        ("retried", 1, 5, 2, at("12:01")),
        ("spoilt", 1, 7, 2, at("12:00")),
        ("spoilt", 2, 15, 3, at("12:03")),
    ]
    for block in (1, 2, 10_000):
        made = ledger.upload_progress(log, parts_per_block=block)
        assert rows(made, "stream_id", "part_number", "bytes_sent", "next_part", "last_activity_at") == expected


def test_resume_positions(spark):
    four = parts(spark, *[("a", n, f"e{n}", 2048, at("12:00")) for n in (1, 2, 3, 4)])
    five = four.unionByName(parts(spark, *[("b", n, f"e{n}", 2048, at("12:00")) for n in (1, 2, 3, 4)]))
    stored = meta(spark, ("a", 10240, 5), ("b", None, None), ("c", None, None))
    strict = ledger.resume_positions(stored, five)
    assert rows(strict, "stream_id", "resume_offset", "next_part") == [("a", 10240, 5), ("b", 0, 5), ("c", 0, 1)]
    loose = ledger.resume_positions(stored, five, strict=False)
    assert rows(loose, "stream_id", "resume_offset", "next_part") == [("a", 10240, 5), ("b", 8192, 5), ("c", 0, 1)]


def test_audit_ledger(spark):
    log = parts(
        spark,
        ("gap", 1, "a", 5, at("12:00")),
        ("gap", 3, "c", 5, at("12:00")),
        ("ok", 1, "a", 5, at("12:00")),
        ("ok", 2, "b", 5, at("12:00")),
        ("again", 1, "a", 9, at("12:00")),
        ("again", 1, "b", 4, at("12:01")),
        ("late", 2, "b", 4, at("12:01")),
    )
    on_disk = spark.createDataFrame(
        [(f"/w/{i}.mp4", f"{i}.mp4", size, at("12:00")) for i, size in [("gap", 15), ("ok", 10), ("again", 4)]],
        schemas.FILES,
    )
    stored = meta(spark, *[(i, sent, 1) for i, sent in [("gap", 10), ("ok", 10), ("again", 13), ("late", 4), ("none", None)]])
    made = ledger.audit_ledger(log, on_disk, stored)
    assert rows(
        made, "stream_id", "uploads", "repeats", "missing_parts", "first_gap", "ledger_bytes", "size_mismatch", "counter_mismatch"
    ) == [
        ("again", 2, 1, 0, None, 4, False, True),
        ("gap", 2, 0, 1, 2, 10, True, False),
        ("late", 1, 0, 1, 1, 4, True, False),
        ("none", 0, 0, 0, None, 0, True, False),
        ("ok", 2, 0, 0, None, 10, False, False),
    ]


def test_valid_and_listed_parts(spark):
    log = parts(spark, ("s", 3, "c", 1, None), ("s", 1, "", 1, None), ("s", 2, None, 1, None), ("s", 4, "d", None, None), ("s", None, "e", 1, None))
    assert rows(filters.valid_parts(log), "part_number") == [(3,), (4,)]
    assert [tuple(r) for r in filters.list_parts(log).collect()] == [("s", 1, "", 1), ("s", 3, "c", 1)]


def test_manifest_pages(spark):
    log = parts(spark, *[("s", n, f"e{n}", 1, None) for n in (5, 3, 1, 2, 4)], ("t", 1, "e", 1, None))
    whole = filters.completion_manifest(log)
    assert rows(whole, "stream_id", "page", F.col("parts.part_number").alias("n")) == [("s", 0, [1, 2, 3, 4, 5]), ("t", 0, [1])]
    paged = filters.completion_manifest(log, parts_per_page=2)
    assert rows(paged, "stream_id", "page", F.col("parts.part_number").alias("n")) == [
        ("s", 0, [1, 2]),
        ("s", 1, [3, 4]),
        ("s", 2, [5]),
        ("t", 0, [1]),
    ]


def test_suffix_and_keys(spark):
    names = spark.createDataFrame([("a.mp4",), ("b.MP4",), ("c.txt",)], "path STRING")
    assert rows(filters.filter_suffix(names, "path")) == [("a.mp4",)]
    one = spark.createDataFrame([("id", "/w/x/a b.mp4")], "stream_id STRING, original_path STRING")
    assert rows(filters.object_keys(one), "object_key", "metadata_key") == [
        ("streams/id/a b.mp4", "streams/id/a b.mp4.metadata.json")
    ]
