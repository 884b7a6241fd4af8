"""Streaming forms against their batch twins, with restarts and replays."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from spoolmark import schemas
from spoolmark.operators import events, ledger, sessions
from spoolmark.plans.catalog import _drained
from spoolmark.sources import chunk_reader, inventory, sinks
from spoolmark.streaming import lifecycle, uploads

from helpers import rows

START = datetime.datetime(2023, 1, 1)


class Feed:
    """A folder of raw-change files that a stream takes one per batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, str(folder), 0

    def add(self, data, schema=schemas.RAW_CHANGES):
        staged = f"{self.folder}-staged-{self.files}"
        self.spark.createDataFrame(data, schema).coalesce(1).write.parquet(staged)
        os.makedirs(self.folder, exist_ok=True)
        part = next(n for n in os.listdir(staged) if n.endswith(".parquet"))
        target = f"{self.folder}/{self.files:03}.parquet"
        os.link(f"{staged}/{part}", target)
        os.utime(target, (1_700_000_000 + self.files, 1_700_000_000 + self.files))
        self.files += 1

    def stream(self, schema=schemas.RAW_CHANGES):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def table(self, schema=schemas.RAW_CHANGES):
        return self.spark.read.schema(schema).parquet(self.folder)


def random_changes(n, seed):
    rng = random.Random(seed)
    return [
        (i, START + datetime.timedelta(seconds=i // 2), rng.choice("ppppqr"), rng.choice(schemas.CHANGE_KINDS))
        for i in range(n)
    ]


@pytest.fixture
def closing(spark, tmp_path):
    folder = str(tmp_path / "closing")
    spark.createDataFrame([], schemas.RAW_CHANGES).write.parquet(folder)
    return folder


COLUMNS = ("seq", "ts", "path", "generation", "step", "event")


def test_classify_stream_with_restart(spark, tmp_path, closing):
    feed = Feed(spark, tmp_path / "feed")
    data = random_changes(240, 3)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def follow():
        return _drained(lifecycle.classify_stream(lifecycle.with_closing(feed.stream(), closing)), out, mark)

    for part in (data[:50], data[50:60]):
        feed.add(part)
    follow()
    for part in (data[60:61], data[61:240]):
        feed.add(part)
    # The last minute of the feed may still be followed by earlier rows.
    held = follow().agg(F.max("ts")).first()[0]
    assert held <= data[-1][1] - datetime.timedelta(minutes=1)
    lifecycle.close_feed(spark, closing, "2030-01-01")
    made = follow()
    assert rows(made, *COLUMNS) == rows(events.classify_changes(feed.table()), *COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_classify_stream_goes_by_event_time(spark, tmp_path, closing, seed):
    """Files out of order, one a batch, rows of one instant dealt over files."""
    feed = Feed(spark, tmp_path / "feed")
    data = random_changes(300, seed)
    rng = random.Random(seed)
    # Each row lies up to 40 seconds (80 rows) from its place.
    moved = sorted(data, key=lambda r: r[0] + rng.uniform(0, 80))
    cuts = sorted(rng.sample(range(1, 300), 6))
    for start, end in zip([0, *cuts], [*cuts, 300]):
        feed.add(moved[start:end])
    feed.add([(900, None, "p", "modified"), (901, START, None, "added")])
    run = lambda: _drained(
        lifecycle.classify_stream(lifecycle.with_closing(feed.stream(), closing), "90 seconds"),
        str(tmp_path / "out"),
        str(tmp_path / "mark"),
    )
    run()
    lifecycle.close_feed(spark, closing, "2030-01-01")
    assert rows(run(), *COLUMNS) == rows(events.classify_changes(feed.table()), *COLUMNS)
    rejected = _drained(lifecycle.unplaced_stream(lifecycle.with_closing(feed.stream(), closing)), str(tmp_path / "bad"), str(tmp_path / "bad-mark"))
    assert rows(rejected, "seq", "reject_reason") == [(900, "no ts"), (901, "no path")]


def test_idle_events_of_a_closed_feed_are_all_sessions(spark, tmp_path, closing):
    feed = Feed(spark, tmp_path / "feed")
    feed.add(random_changes(90, 8))
    feed.add([(500, START + datetime.timedelta(minutes=30), "late", "added")])
    run = lambda: _drained(
        lifecycle.idle_events(lifecycle.with_closing(feed.stream(), closing), 20, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "mark")
    )
    assert "late" not in {r["path"] for r in run().collect()}
    lifecycle.close_feed(spark, closing, START + datetime.timedelta(hours=1))
    made = rows(run(), "path", "session_start", "idle_at", "events")
    assert made == rows(sessions.activity_sessions(feed.table(), 20), "path", "session_start", "session_end", "events")


def test_dedupe_creates_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "feed")
    schema = "seq BIGINT, ts TIMESTAMP, path STRING, event STRING, generation BIGINT"
    data = [(0, START, "p", "CREATE", 0), (1, START, "p", "CREATE", 0), (2, START, "p", "WRITE", 0), (3, START, "p", "DELETE", 0), (4, START, "p", "CREATE", 1)]
    feed.add(data, schema)
    made = _drained(
        lifecycle.dedupe_creates_stream(feed.stream(schema), "1 minute"), str(tmp_path / "out"), str(tmp_path / "mark")
    )
    got = rows(made, "event", "generation")
    assert got == [("CREATE", 0), ("CREATE", 1), ("DELETE", 0), ("WRITE", 0)]


def test_idle_events_are_the_closed_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path / "feed")
    rng = random.Random(5)
    moments = sorted(rng.sample(range(4000), 300))
    data = [(i, START + datetime.timedelta(seconds=s), rng.choice("ppq"), "modified") for i, s in enumerate(moments)]
    for part in (data[:100], data[100:220], data[220:]):
        feed.add(part)
    made = _drained(lifecycle.idle_events(feed.stream(), 40, "5 seconds"), str(tmp_path / "out"), str(tmp_path / "mark"))
    closed_by = data[-1][1] - datetime.timedelta(seconds=5)
    batch = sessions.activity_sessions(feed.table(), 40).filter(F.col("session_end") <= F.lit(closed_by))
    got = rows(made, "path", "session_start", "idle_at", "events")
    assert got == rows(batch, "path", "session_start", "session_end", "events")
    assert len(got) > 5


def test_progress_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "feed")
    for n in range(3):
        feed.add([("s", 2 * n + k, "e", 10 * n + k, None) for k in (1, 2)] + [("t", n + 1, "e", 1, None)], schemas.PART_LEDGER)
    out = str(tmp_path / "out")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    totals = uploads.progress_stream(feed.stream(schemas.PART_LEDGER))
    run = totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    newest = spark.read.parquet(out).groupBy("stream_id").agg(F.max(F.struct("batch_id", "parts", "total_size_bytes", "max_part")).alias("last"))
    assert rows(newest.select("stream_id", "last.parts", "last.total_size_bytes", "last.max_part")) == rows(
        ledger.stream_totals(feed.table(schemas.PART_LEDGER))
    )


def test_ledger_sink_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "feed")
    out, mark = str(tmp_path / "ledger"), str(tmp_path / "mark")
    feed.add([("s", 1, "a", 1, START)], schemas.PART_LEDGER)
    uploads.ledger_sink(feed.stream(schemas.PART_LEDGER), out, mark).awaitTermination()
    feed.add([("s", 1, "b", 2, START + datetime.timedelta(seconds=1)), ("s", 2, "c", 3, START)], schemas.PART_LEDGER)
    for _ in range(2):
        uploads.ledger_sink(feed.stream(schemas.PART_LEDGER), out, mark).awaitTermination()
    assert rows(sinks.read_ledger(spark, out), "part_number", "etag") == [(1, "b"), (2, "c")]
    assert spark.read.parquet(out).count() == 3
    # Without its checkpoint the stream is a new writer, and the old rows stay.
    uploads.ledger_sink(feed.stream(schemas.PART_LEDGER), out, str(tmp_path / "other")).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    assert rows(sinks.read_ledger(spark, out), "part_number", "etag") == [(1, "b"), (2, "c")]


@pytest.fixture
def growing(tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    return folder


def test_tail_chunks_reads_only_what_is_new(spark, tmp_path, growing):
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    a, b = growing / "a.mp4", growing / "b.mp4"

    def follow():
        uploads.log_inventory(spark, str(growing), log)
        tail = uploads.tail_chunks(uploads.inventory_stream(spark, log), str(growing), 10)
        return _drained(tail, out, mark)

    def ranges(made):
        return rows(made, F.substring_index("path", "/", -1).alias("f"), "part_number", "offset", "length")

    a.write_bytes(b"0123456789abcde")
    b.write_bytes(b"")
    first = [("a.mp4", 1, 0, 10), ("a.mp4", 2, 10, 5)]
    assert ranges(follow()) == first
    assert ranges(follow()) == first
    a.write_bytes(b"0123456789abcdefghij")
    b.write_bytes(b"xyz")
    made = follow()
    assert ranges(made) == [*first, ("a.mp4", 3, 15, 5), ("b.mp4", 1, 0, 3)]
    whole = {}
    for r in made.orderBy("path", "part_number").collect():
        whole[r["path"]] = whole.get(r["path"], b"") + bytes(r["data"])
    assert whole == {str(a): a.read_bytes(), str(b): b.read_bytes()}
    assert {r["generation"] for r in made.filter(F.col("path") == str(a)).collect()} == {1}


def test_tail_chunks_of_files_made_anew(spark, tmp_path, growing):
    """Shorter files, deleted ones and both at once: nothing of what is there is lost."""
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))

    def listing():
        uploads.log_inventory(spark, str(growing), log)

    def follow():
        tail = uploads.tail_chunks(uploads.inventory_stream(spark, log), str(growing), 10)
        return _drained(tail, out, mark)

    def whole(made):
        found = {}
        for r in made.orderBy("path", "generation", "part_number").collect():
            key = (os.path.basename(r["path"]), r["generation"])
            found[key] = found.get(key, b"") + (bytes(r["data"]) if r["data"] is not None else r["status"].encode())
        return found

    def put(name, data):
        (growing / f"{name}.mp4").write_bytes(data)

    put("shrunk", b"0123456789abcde")
    put("gone", b"first life")
    put("stays", b"abc")
    listing()
    follow()
    put("shrunk", b"new")
    (growing / "gone.mp4").unlink()
    listing()
    follow()
    put("gone", b"second life, longer")
    put("shrunk", b"new, grown")
    listing()
    made = follow()
    assert whole(made) == {
        ("shrunk.mp4", 1): b"0123456789abcde",
        ("shrunk.mp4", 2): b"new, grown",
        ("gone.mp4", 1): b"first life",
        ("gone.mp4", 3): b"second life, longer",
        ("stays.mp4", 1): b"abc",
    }
    # Two listings in one batch: a file grows, then is made anew before it was read.
    put("stays", b"abcdefgh")
    put("brief", b"x" * 25)
    listing()
    put("stays", b"z")
    (growing / "brief.mp4").unlink()
    listing()
    made = follow()
    assert whole(made)[("stays.mp4", 1)] == b"abc" + b"replaced"
    assert whole(made)[("stays.mp4", 5)] == b"z"
    assert whole(made)[("brief.mp4", 4)] == b"replaced" * 3
    # A repeated listing changes nothing, and paths that have gone keep no state.
    before = rows(made, "path", "generation", "part_number", "status")
    for file in list(growing.iterdir()):
        file.unlink()
    listing()
    listing()
    assert rows(follow(), "path", "generation", "part_number", "status") == before
    state = spark.read.format("statestore").load(mark)
    assert state.count() == 0


def test_tail_of_full_files_equals_batch(spark, tmp_path, growing):
    for n in range(5):
        (growing / f"{n}.mp4").write_bytes(bytes(n * 37))
    log = str(tmp_path / "log")
    uploads.log_inventory(spark, str(growing), log)
    tail = uploads.tail_chunks(uploads.inventory_stream(spark, log), str(growing), 16)
    made = _drained(tail, str(tmp_path / "out"), str(tmp_path / "mark"))
    columns = ("path", "part_number", "offset", "length", "data")
    assert rows(made, *columns) == rows(chunk_reader.read_chunks(spark, str(growing), 16), *columns)
    assert inventory.file_inventory(spark, str(growing)).count() == 5


def test_inventory_log_of_recent_files_only(spark, tmp_path, growing):
    for name, when in (("old.mp4", 1_600_000_000), ("new.mp4", 1_700_000_000)):
        (growing / name).write_bytes(b"x")
        os.utime(growing / name, (when, when))
    log = str(tmp_path / "log")
    uploads.log_inventory(spark, str(growing), log, modified_since="2023-01-01")
    assert rows(spark.read.parquet(log), "file_name") == [("new.mp4",)]
