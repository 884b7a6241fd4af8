"""Properties of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from spoolmark.operators import filters, ledger, metrics
from spoolmark.plans import catalog, standins

SF_DIR = "/root/testdata/sf0.001"
WRITES = {
    "tail_chunks", "change_feed", "write_ledger", "write_metadata_json", "idle_events", "classify_stream", "progress_stream",
}
READS_FILES = {"read_chunks", "file_inventory"}
# One row per block, per label or in all reaches the single partition.
SINGLE = {"active_gauge", "read_chunks", "stream_outcomes", "processing_time_histogram"}
# Keys that a sample found to hold fewer rows than a block are not cut.
SAMPLED = {
    "classify_changes", "assign_stream_ids", "init_stream_meta", "stream_generations", "route_events", "dedupe_creates",
    "activity_sessions",
}
BATCH = sorted(set(catalog.all_queries()) - WRITES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(catalog.all_queries()[n](spark, SF_DIR)) for n in BATCH}


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_and_no_python(plans, name):
    assert "CartesianProduct" not in plans[name]
    assert "BroadcastNestedLoopJoin" not in plans[name]
    if name not in READS_FILES:
        assert "Python" not in plans[name] and "InArrow" not in plans[name]


@pytest.mark.parametrize("name", sorted(set(BATCH) - SINGLE))
def test_no_single_partition(plans, name):
    assert "SinglePartition" not in plans[name]


@pytest.mark.parametrize("name", sorted(SINGLE))
def test_single_partition_only_after_aggregation(plans, name):
    for below in re.split(r"Exchange SinglePartition", plans[name])[1:]:
        assert re.match(r"[^\n]*\n[^\n]*HashAggregate", below)


def test_windows_never_span_a_whole_key(plans):
    """Every window is over a block, over block summaries, or is a limited rank.

    Windows of sampled operators are tested with busy keys among the events.
    """
    for name, plan in plans.items():
        if name in SAMPLED | {"active_gauge"}:
            continue
        for line in re.findall(r"^.*\bWindow \[.*$", plan, re.M):
            parts = re.search(r"\], (?:\[([^\]]*)\], )?\[([^\]]*)\]$", line)
            keys, order = parts.group(1) or "", parts.group(2)
            rank = "_rank" in line and "WindowGroupLimit" in plan
            assert "_block" in keys or order.startswith("_block") or rank, (name, line)


def test_latest_parts_limits_before_the_shuffle(plans):
    above, below = plans["latest_parts"].split("Exchange hashpartitioning", 1)
    assert "row_number(), 1, Final" in above
    assert "row_number(), 1, Partial" in below


def test_counts_combine_before_the_shuffle(spark):
    for df in (
        ledger.stream_totals(standins.part_ledger(spark, SF_DIR)),
        metrics.chunk_counters(standins.part_ledger(spark, SF_DIR)),
    ):
        assert "partial_sum" in plan_of(df).split("Exchange", 1)[1]


def test_suffix_is_pushed_to_the_scan(plans):
    assert "StringEndsWith(url,#top)" in plans["filter_suffix"]


def test_scans_read_only_what_is_needed(plans):
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plans["chunk_counters"]))
    assert read == {"l_orderkey:bigint,l_quantity:double"}
    assert "html" not in plans["filter_suffix"]


def test_state_filter_is_pushed(spark, tmp_path):
    folder = str(tmp_path / "state")
    standins.stream_meta(spark, SF_DIR).write.parquet(folder)
    kept = filters.valid_parts(spark.createDataFrame([("s", 1, "e")], "stream_id STRING, part_number INT, etag STRING"))
    assert kept.count() == 1
    wanted = spark.read.parquet(folder).filter(F.col("status").isin("active", "failed"))
    assert "In(status, [active,failed])" in plan_of(wanted)


def test_documents_read_the_ledger_once(spark):
    df = catalog.all_queries()["metadata_documents"](spark, SF_DIR)
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("l_linenumber,l_quantity") == 1 or "ReusedExchange" in final


def test_nothing_is_broadcast_by_force():
    import pathlib

    root = pathlib.Path(catalog.__file__).resolve().parents[1]
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
    # The one exception is the list of cuts of busy keys, bounded by its definition.
    assert text.count("broadcast(") == text.count("F.broadcast(busy)") == 1
    assert "localCheckpoint" not in text
    assert ".collect()" not in text and ".toPandas()" not in text
