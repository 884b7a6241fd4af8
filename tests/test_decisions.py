"""Every branch of the idle, resume and finalize decisions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from spoolmark import schemas
from spoolmark.operators import decisions, documents
from spoolmark.sources import sinks

from helpers import at, rows

AS_OF = "2023-01-01 12:00:00"


def state_rows(spark, **streams):
    """State rows from id → overrides of a complete active stream, idle an hour."""
    data = []
    for i, given in streams.items():
        row = {
            "stream_id": i,
            "original_path": f"/w/{i}.mp4",
            "s3_upload_id": "u",
            "s3_bucket": "b",
            "s3_key_prefix": f"streams/{i}/{i}.mp4",
            "status": "active",
            "started_at": at("10:00"),
            "last_activity_at": at("11:00"),
            "total_bytes_expected": None,
            "total_bytes_sent": 0,
            "next_part_to_upload": 1,
            "failure_reason": None,
            **given,
        }
        data.append(tuple(row[f.name] for f in schemas.STREAM_META.fields))
    return spark.createDataFrame(data, schemas.STREAM_META)


def on_disk(spark, **sizes):
    data = [(f"/w/{i}.mp4", f"{i}.mp4", size, at("11:00")) for i, size in sizes.items()]
    return spark.createDataFrame(data, schemas.FILES)


def tracked(spark, **owners):
    return spark.createDataFrame([(f"/w/{i}.mp4", o) for i, o in owners.items()], schemas.TRACKED)


@pytest.fixture
def stale_world(spark):
    streams = state_rows(
        spark,
        done={"total_bytes_sent": 1000},
        other={"total_bytes_sent": 1000},
        orphan={"total_bytes_sent": 1000},
        behind={"total_bytes_sent": 100},
        behind_other={"total_bytes_sent": 100},
        behind_alone={"total_bytes_sent": None},
        cut={"total_bytes_sent": 2000},
        gone={},
        gone_tracked={},
        no_path={"original_path": None},
        blank_path={"original_path": ""},
        never={"last_activity_at": None},
        edge={"last_activity_at": at("11:59:30")},
        just_over={"last_activity_at": datetime.datetime(2023, 1, 1, 11, 59, 29, 999999), "total_bytes_sent": 1000},
        waiting={"status": "pending_completion"},
        stopped={"status": "interrupted_shutdown_write"},
        empty={},
    )
    names = ["done", "other", "orphan", "behind", "behind_other", "behind_alone", "cut", "edge", "just_over", "waiting", "stopped"]
    files = on_disk(spark, **{n: 1000 for n in names}, empty=0)
    owners = tracked(spark, done="done", other="x", behind="behind", behind_other="x", cut="cut", gone_tracked="gone_tracked")
    return streams, files, owners


EXPECTED_STALE = {
    "done": ("finalize", None),
    "other": ("fail", "stale_processor_mismatch"),
    "orphan": ("resume_finalize", None),
    "behind": ("reprocess", None),
    "behind_other": ("resume_write", None),
    "behind_alone": ("resume_write", None),
    "cut": ("finalize", None),
    "gone": ("fail", "stale_file_missing"),
    "gone_tracked": ("fail", "stale_file_missing"),
    "no_path": ("fail", "stale_no_path"),
    "blank_path": ("fail", "stale_no_path"),
    "never": ("touch", None),
    "edge": ("fresh", None),
    "just_over": ("resume_finalize", None),
    "waiting": ("skip", None),
    "stopped": ("skip", None),
    "empty": ("resume_finalize", None),
}


def test_stale_actions(stale_world):
    made = decisions.stale_actions(*stale_world, AS_OF)
    assert {r["stream_id"]: (r["action"], r["reason"]) for r in made.collect()} == EXPECTED_STALE
    assert rows(made.filter("abort_upload"), "stream_id") == [("gone_tracked",)]


def test_stale_actions_truncated(stale_world):
    made = decisions.stale_actions(*stale_world, AS_OF, truncated="fail")
    got = {r["stream_id"]: (r["action"], r["reason"]) for r in made.collect()}
    assert got == {**EXPECTED_STALE, "cut": ("fail", "stale_truncated")}
    with pytest.raises(ValueError):
        decisions.stale_actions(*stale_world, AS_OF, truncated="ignore")


def test_stale_actions_of_listed_ids_and_text_times(spark):
    streams = state_rows(spark, a={}, b={}, c={}).withColumn(
        "last_activity_at",
        F.when(F.col("stream_id") == "a", "2023-01-01T11:00:00+00:00")
        .when(F.col("stream_id") == "b", "yesterday")
        .otherwise(""),
    )
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("nobody",)], "stream_id STRING")
    made = decisions.stale_actions(streams, on_disk(spark, a=5), tracked(spark), AS_OF, active_ids=ids)
    assert {r["stream_id"]: r["action"] for r in made.collect()} == {
        "a": "resume_write", "b": "quarantine", "c": "touch", "nobody": "skip",
    }


def test_stale_streams_is_strict(stale_world):
    stale = {r["stream_id"] for r in decisions.stale_streams(stale_world[0], AS_OF).collect()}
    assert "edge" not in stale and "just_over" in stale and "never" not in stale and "waiting" not in stale


def test_resume_candidates(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "stream_id STRING")
    more = spark.createDataFrame([("b",), ("c",)], "stream_id STRING")
    assert rows(decisions.resume_candidates(ids, more)) == [("a",), ("b",), ("c",)]


RESUME = {
    "no_upload": ({"s3_upload_id": ""}, ("fail", "resume_incomplete_meta")),
    "no_path": ({"original_path": None}, ("fail", "resume_incomplete_meta")),
    "no_bucket": ({"s3_bucket": None}, ("fail", "resume_incomplete_meta")),
    "held": ({}, ("skip", None)),
    "gone": ({}, ("fail", "file_missing_on_resume")),
    "pending": ({"status": "pending_completion"}, ("finalize", None)),
    "stored": ({"status": "s3_completed"}, ("finalize", None)),
    "plain_meta": ({"status": "failed_meta_upload"}, ("finalize", None)),
    "active": ({}, ("write", None)),
    "processing": ({"status": "processing"}, ("write", None)),
    "shut": ({"status": "interrupted_shutdown_write"}, ("write", None)),
    "cancelled": ({"status": "interrupted_cancelled_write"}, ("write", None)),
    "no_status": ({"status": None}, ("write", None)),
    "deleted": ({"status": "deleted_locally"}, ("none", None)),
    "meta_failed": ({"status": "failed_failed_meta_upload", "failure_reason": "failed_meta_upload"}, ("finalize", None)),
    "chunk_failed": ({"status": "failed_chunk_processing_failure", "failure_reason": "chunk_processing_failure"}, ("none", None)),
}


@pytest.mark.parametrize("compat", [False, True])
def test_resume_actions(spark, compat):
    streams = state_rows(spark, **{i: given for i, (given, _) in RESUME.items()})
    ids = streams.select("stream_id").union(spark.createDataFrame([("nobody",)], "stream_id STRING"))
    files = on_disk(spark, **{i: 10 for i in RESUME if i != "gone"})
    made = decisions.resume_actions(ids, streams, files, tracked(spark, held="x"), compat=compat)
    expected = {i: outcome for i, (_, outcome) in RESUME.items()} | {"nobody": ("fail", "resume_no_meta")}
    if compat:
        expected["meta_failed"] = ("none", None)
    assert {r["stream_id"]: (r["action"], r["reason"]) for r in made.collect()} == expected


def test_resume_forced_finalizes_any_status(spark):
    streams = state_rows(spark, a={}, b={"status": "deleted_locally"})
    ids = spark.createDataFrame([("a", True), ("b", True)], "stream_id STRING, forced BOOLEAN")
    made = decisions.resume_actions(ids, streams, on_disk(spark, a=1, b=1), tracked(spark))
    assert rows(made, "stream_id", "action") == [("a", "finalize"), ("b", "finalize")]


def test_finalize_plan(spark):
    streams = state_rows(spark, full={}, bare={}, untagged={}, gone={}, gone_bare={})
    parts = spark.createDataFrame(
        [("full", 1, "e", 1, None), ("full", 2, "f", 1, None), ("untagged", 1, "", 1, None), ("gone", 1, "e", 1, None)],
        schemas.PART_LEDGER,
    )
    made = decisions.finalize_plan(streams, parts, on_disk(spark, full=2, bare=0, untagged=1))
    assert rows(made, "stream_id", "parts", "action", "reason") == [
        ("bare", 0, "abort_no_parts", None),
        ("full", 2, "complete", None),
        ("gone", 1, "fail", "finalize_file_missing"),
        ("gone_bare", 0, "fail", "finalize_file_missing"),
        ("untagged", 0, "abort_no_parts", None),
    ]


@pytest.fixture
def document_world(spark):
    streams = state_rows(
        spark,
        two={"started_at": at("11:50"), "last_activity_at": at("11:55")},
        bare={},
        mixed={},
    )
    parts = spark.createDataFrame(
        [
            ("two", 1, "e1", 1024, at("11:51")),
            ("two", 2, "e2", 2048, at("11:52")),
            ("mixed", 3, "c", 3, None),
            ("mixed", 1, "a", 1, None),
            ("mixed", 2, "b", 2, None),
            ("unknown", 1, "z", 9, None),
        ],
        schemas.PART_LEDGER,
    )
    timings = spark.createDataFrame([("/w/two.mp4", 120.5)], schemas.DURATIONS)
    return streams, parts, timings


def test_metadata_documents(document_world):
    made = {r["stream_id"]: r for r in documents.metadata_documents(*document_world, AS_OF).collect()}
    assert set(made) == {"two", "bare", "mixed"}
    two = made["two"]
    assert (two["total_size_bytes"], two["duration_seconds"], two["page"]) == (3072, 120.5, 0)
    assert (two["stream_started_at"], two["stream_completed_at"], two["processed_at"]) == (at("11:50"), at("11:55"), at("12:00"))
    assert [tuple(c) for c in two["chunks"]] == [(1, 1024, "e1", at("11:51")), (2, 2048, "e2", at("11:52"))]
    assert (made["bare"]["total_size_bytes"], made["bare"]["chunks"], made["bare"]["duration_seconds"]) == (0, [], None)
    assert [c["part_number"] for c in made["mixed"]["chunks"]] == [1, 2, 3]


def test_metadata_documents_in_pages(document_world):
    made = documents.metadata_documents(*document_world, AS_OF, parts_per_page=2)
    assert rows(made, "stream_id", "page", "total_size_bytes", "total_chunks", F.size("chunks").alias("n")) == [
        ("bare", 0, 0, 0, 0),
        ("mixed", 0, 6, 3, 2),
        ("mixed", 1, 6, 3, 1),
        ("two", 0, 3072, 2, 2),
    ]


def test_flatten_inverts(document_world):
    made = documents.metadata_documents(*document_world, AS_OF)
    flat = rows(documents.flatten_chunks(made), "stream_id", "part_number", "size_bytes")
    assert flat == [("bare", None, None), ("mixed", 1, 1), ("mixed", 2, 2), ("mixed", 3, 3), ("two", 1, 1024), ("two", 2, 2048)]
    text = documents.document_json(made)
    assert rows(documents.flatten_chunks(text), "stream_id", "part_number", "size_bytes") == flat


def test_stored_documents_round_trip(spark, document_world, tmp_path):
    made = documents.metadata_documents(*document_world, "2023-01-01 12:00:00.000001")
    sinks.write_metadata_json(made, str(tmp_path / "docs"))
    back = sinks.read_metadata_json(spark, str(tmp_path / "docs"))
    fields = [f.name for f in schemas.METADATA_DOCUMENT.fields]
    assert rows(documents.from_stored_form(back)) == rows(made, *fields)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "docs")).collect()]
    bare = next(line for line in lines if line["document"]["stream_id"] == "bare")
    assert bare["metadata_key"] == "streams/bare/bare.mp4.metadata.json"
    assert bare["document"]["duration_seconds"] is None
    assert bare["document"]["chunks"] == []
    assert bare["document"]["processed_at_utc"] == "2023-01-01T12:00:00.000001+00:00"
    two = next(line for line in lines if line["document"]["stream_id"] == "two")
    assert two["document"]["chunks"][0] == {
        "part_number": 1, "size_bytes": 1024, "etag": "e1", "uploaded_at_utc": "2023-01-01T11:51:00.000000+00:00",
    }


def test_probe_results(spark):
    data = [("a", 0, " 12.5\n", ""), ("b", 0, "N/A", ""), ("c", 0, "", "x "), ("d", 1, "9", "bad\n"), ("e", 0, " \n", ""), ("f", 0, None, None), ("g", None, "9", ""), ("h", 0, "1.0d", ""), ("i", 0, "-1.5E+2", ""), ("j", 0, "2f", "")]
    made = documents.probe_results(spark.createDataFrame(data, schemas.PROBE_ROWS))
    assert rows(made) == [
        ("a", 12.5, None),
        ("b", None, "ffprobe output is not a valid float: N/A"),
        ("c", None, "ffprobe error (return code 0): x"),
        ("d", None, "ffprobe error (return code 1): bad"),
        ("e", None, "ffprobe output is not a valid float: "),
        ("f", None, "ffprobe error (return code 0): "),
        ("g", None, "ffprobe error (return code unknown): "),
        ("h", None, "ffprobe output is not a valid float: 1.0d"),
        ("i", -150.0, None),
        ("j", None, "ffprobe output is not a valid float: 2f"),
    ]
