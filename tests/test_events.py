"""Lifecycle events: truth tables, blocks, and a plain loop as the check."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spoolmark import schemas
from spoolmark.operators import events, filters, metrics, sessions
from spoolmark.plans.running import spread_in_order, spread_over_time

from helpers import at, rows

START = datetime.datetime(2023, 1, 1)


def raw(spark, *kinds, path="p"):
    data = [(i, START + datetime.timedelta(seconds=i), path, k) for i, k in enumerate(kinds)]
    return spark.createDataFrame(data, schemas.RAW_CHANGES)


def feed(spark, *names, path="p"):
    data = [(i, START + datetime.timedelta(seconds=i), path, k) for i, k in enumerate(names)]
    return spark.createDataFrame(data, schemas.LIFECYCLE_EVENTS)


def busy(kinds, paths=("hot", "cold", "rare"), n=600, seed=7):
    """Random rows of which most belong to one path, with equal times."""
    rng = random.Random(seed)
    return [
        (i, START + datetime.timedelta(seconds=rng.randrange(n // 2)), rng.choices(paths, (8, 2, 1))[0], rng.choice(kinds))
        for i in range(n)
    ]


def walk(data):
    """The events of the raw rows, one after the other."""
    known, closed, made = set(), {}, []
    for seq, ts, path, kind in sorted(data, key=lambda r: (r[1], r[0])):
        generation = closed.get(path, 0)
        if kind == "deleted":
            made.append((seq, path, generation, 0, "DELETE"))
            known.discard(path)
            closed[path] = generation + 1
            continue
        step = 0
        if path not in known:
            made.append((seq, path, generation, 0, "CREATE"))
            step = 1
        if kind == "modified":
            made.append((seq, path, generation, step, "WRITE"))
        known.add(path)
    return sorted(made, key=lambda r: [str(v) for v in r])


@pytest.mark.parametrize(
    "kinds, expected",
    [
        (["added", "modified", "deleted", "modified"], ["CREATE", "WRITE", "DELETE", "CREATE", "WRITE"]),
        (["added", "added"], ["CREATE"]),
        (["deleted"], ["DELETE"]),
        (["deleted", "deleted", "added"], ["DELETE", "DELETE", "CREATE"]),
        (["modified", "modified"], ["CREATE", "WRITE", "WRITE"]),
    ],
)
def test_classify_changes(spark, kinds, expected):
    made = events.classify_changes(raw(spark, *kinds)).orderBy("ts", "seq", "step")
    assert [r["event"] for r in made.collect()] == expected


@pytest.mark.parametrize("rows_per_block", [1, 7, 60, 10**6])
def test_classify_matches_loop_at_any_block(spark, rows_per_block):
    data = busy(schemas.CHANGE_KINDS)
    made = events.classify_changes(spark.createDataFrame(data, schemas.RAW_CHANGES), rows_per_block)
    assert rows(made, "seq", "path", "generation", "step", "event") == walk(data)


def test_generations(spark):
    made = events.stream_generations(feed(spark, "CREATE", "CREATE", "DELETE", "CREATE", "DELETE"), 2)
    assert [r[1] for r in rows(made, "seq", "generation")] == [0, 0, 0, 1, 1]


def test_route_events(spark):
    names = ["WRITE", "CREATE", "WRITE", "DELETE", "DELETE", "CREATE", "CREATE"]
    made = events.route_events(feed(spark, *names), rows_per_block=3)
    assert [r[1] for r in rows(made, "seq", "action")] == [
        "reopen", "ignore", "process", "close", "none", "open", "ignore",
    ]


def test_route_events_against_snapshot(spark):
    both = feed(spark, "CREATE", "WRITE", "DELETE").unionByName(feed(spark, "CREATE", "WRITE", "DELETE", path="q"))
    tracked = spark.createDataFrame([("p", "id")], schemas.TRACKED)
    made = events.route_events(both, tracked)
    assert rows(made, "path", "seq", "action", "stream_id") == [
        ("p", 0, "ignore", "id"),
        ("p", 1, "process", "id"),
        ("p", 2, "close", "id"),
        ("q", 0, "open", None),
        ("q", 1, "reopen", None),
        ("q", 2, "none", None),
    ]


def test_dedupe_creates_keeps_recreation(spark):
    counted = events.stream_generations(feed(spark, "CREATE", "CREATE", "WRITE", "DELETE", "CREATE", "CREATE"))
    assert [r[0] for r in rows(events.dedupe_creates(counted), "seq")] == [0, 2, 3, 4]


def test_untracked_and_closed(spark):
    both = feed(spark, "WRITE", "DELETE", "DELETE").unionByName(feed(spark, "CREATE", "WRITE", "DELETE", path="q"))
    tracked = spark.createDataFrame([("p", "id"), ("r", "other")], schemas.TRACKED)
    assert rows(events.untracked_events(both, tracked), "path", "event") == [("q", "DELETE"), ("q", "WRITE")]
    assert rows(events.closed_streams(both, tracked), "stream_id", "seq", "status") == [("id", 1, "deleted_locally")]


def test_ids_differ_by_generation_and_repeat(spark):
    made = events.classify_changes(raw(spark, "added", "deleted", "added"))
    creates = filters.assign_stream_ids(made.filter(F.col("event") == "CREATE"))
    first, second = rows(creates, "stream_id"), rows(creates, "stream_id")
    assert first == second
    assert len(set(first)) == 2
    begun = filters.init_stream_meta(creates, "media")
    assert begun.schema.fieldNames() == schemas.STREAM_META.fieldNames()
    row = begun.orderBy("started_at").first()
    assert (row["status"], row["total_bytes_sent"], row["next_part_to_upload"]) == ("active", 0, 1)
    assert row["s3_key_prefix"] == f"streams/{row['stream_id']}/p"
    assert row["started_at"] == row["last_activity_at"] == START


def activity(spark, *seconds, path="p"):
    data = [(i, START + datetime.timedelta(seconds=s), path, "modified") for i, s in enumerate(seconds)]
    return spark.createDataFrame(data, schemas.RAW_CHANGES)


def test_sessions_touching_at_the_gap_merge(spark):
    made = sessions.activity_sessions(activity(spark, 0, 30, 61), 30)
    assert rows(made, "session_no", "session_start", "session_end", "events") == [
        (1, at("00:00:00"), at("00:01:00"), 2),
        (2, at("00:01:01"), at("00:01:31"), 1),
    ]


@pytest.mark.parametrize("rows_per_block", [1, 10, 45, 1000])
def test_sessions_match_the_built_in_window(spark, rows_per_block):
    data = [(s, t, p, k) for s, t, p, k in busy(("modified",), n=400)]
    log = spark.createDataFrame(data, schemas.RAW_CHANGES)
    made = sessions.activity_sessions(log, 3, rows_per_block)
    built_in = log.groupBy("path", F.session_window("ts", "3 seconds").alias("w")).agg(F.count("*").alias("events"))
    assert rows(made, "path", "session_start", "session_end", "events") == rows(
        built_in.select("path", F.col("w.start").alias("s"), F.col("w.end").alias("e"), "events")
    )
    numbers = made.groupBy("path").agg(F.max("session_no").alias("top"), F.count("*").alias("n"))
    assert all(top == n for top, n in rows(numbers, "top", "n"))


@pytest.mark.parametrize("block_seconds", [1, 20, 3600])
def test_active_gauge(spark, block_seconds):
    data = busy(("CREATE", "WRITE", "DELETE"), n=300)
    routed = events.route_events(spark.createDataFrame(data, schemas.LIFECYCLE_EVENTS))
    open_paths, expected = set(), []
    for seq, ts, path, event in sorted(data, key=lambda r: (r[1], r[0])):
        before = len(open_paths)
        (open_paths.discard if event == "DELETE" else open_paths.add)(path)
        if len(open_paths) != before:
            expected.append((seq, len(open_paths)))
    made = metrics.active_gauge(routed, block_seconds)
    assert sorted(rows(made, "seq", "active_streams")) == sorted(expected)


@pytest.mark.parametrize("rows_per_block", [1, 25, 10**6])
def test_only_busy_paths_are_cut(spark, rows_per_block):
    log = spark.createDataFrame(busy(schemas.CHANGE_KINDS), schemas.RAW_CHANGES)
    spread = spread_over_time(log, ["path"], "ts", rows_per_block)
    assert spread.count() == 600
    blocks = spread.groupBy("path").agg(F.count_distinct("_spread").alias("blocks"), F.count("*").alias("n"))
    for path, cut, n in rows(blocks, "path", "blocks", "n"):
        assert (cut > 1) == (n > rows_per_block), path
        assert cut <= -(-n // rows_per_block)
    ordered = spread.orderBy("path", "ts").select("path", "_spread").collect()
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])


def test_an_instant_is_cut_like_any_stretch(spark):
    """Two thirds of all rows are of one path and one instant; several tasks sort them."""
    n = 120_000
    log = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 > 0, F.lit(START)).otherwise(F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5000)).alias("path"),
        F.when(F.col("id") % 7 == 0, "deleted").otherwise("modified").alias("kind"),
    )
    spread = spread_in_order(log, ["path"], ["ts", "seq"], 5000)
    blocks = {r[0]: r[1:] for r in spread.groupBy("path", "_spread").count().groupBy("path").agg(F.count("*"), F.max("count")).collect()}
    assert 8 <= blocks["hot"][0] <= 32 and blocks["hot"][1] <= 15_000
    assert all(cut == 1 for path, (cut, _) in blocks.items() if path != "hot")
    made = events.classify_changes(log, 5000)
    plain = F.sum(F.when(F.col("kind") == "deleted", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("ts", "seq"))
    wanted = log.withColumn("g", plain - F.when(F.col("kind") == "deleted", 1).otherwise(0))
    assert made.join(wanted, ["seq", "path"]).filter("generation <> g").isEmpty()
    assert made.select("seq").distinct().count() == n
    gauge = metrics.active_gauge(events.route_events(events.classify_changes(log)), 5000)
    assert gauge.count() > 0
    plan = gauge._jdf.queryExecution().executedPlan().toString()
    for below in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in below.split("\n")[1]


def test_rows_are_placed_or_quarantined(spark):
    odd = [(100, None, "p", "added"), (101, START, None, "modified"), (102, None, None, "deleted"), (None, START, "q", "added")]
    log = spark.createDataFrame(busy(schemas.CHANGE_KINDS) + odd, schemas.RAW_CHANGES)
    rejected = events.unplaced_events(log)
    assert rows(rejected, "seq", "reject_reason") == [(100, "no ts"), (101, "no path"), (102, "no path")]
    placed = spread_in_order(log, ["path"], ["ts", "seq"], 7)
    assert placed.count() + rejected.count() == log.count()
    routed = events.route_events(log.withColumnRenamed("kind", "event"))
    assert routed.count() + rejected.count() == log.count()
