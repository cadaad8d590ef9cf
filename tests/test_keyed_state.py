"""The revision gate over keyed map state: against the batch twin on events, what its state holds, timers and restarts."""

import pytest
from pyspark.sql import functions as F

from glossmill.plans import catalog
from glossmill.streaming import revisions as R
from tests.test_revisions import ROWS, STATUSES, requests, run

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, R.ROCKS)
    yield spark
    spark.conf.set(key, before)


def feed(spark, rows, tmp_path, n, **options):
    """One more file of input, answered by a query that starts from its checkpoint."""
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    gated = R.keyed_gate(stream, **options)
    run(gated.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    return {r.seq: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def state(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck"))


def test_keyed_gate(rocks, tmp_path):
    got = feed(rocks, requests(rocks, ROWS), tmp_path, 0)
    assert [got[i] for i in range(len(ROWS))] == STATUSES
    newest = {r.key.root_id: (r.value.page_epoch, r.value.root_revision) for r in state(rocks, tmp_path, "newest").collect()}
    assert newest == {"a": (1, 0), "b": (0, 5)}


def test_events_equal_the_batch_twin(rocks, tmp_path):
    """Events in five micro-batches, with planted invalid requests and control rows, against gate() over all of them."""
    rows = catalog.event_requests(rocks, SF)
    rows = rows.withColumn("analysis_key", F.when(F.col("seq") % 97 == 0, F.concat("analysis_key", F.lit("x"))).otherwise(F.col("analysis_key")))
    gone = rows.where("seq % 41 = 7")
    control = gone.withColumns({"phase": F.lit("cancel"), "seq": -F.col("seq") - 1})
    want = {r.seq: r.status for r in R.gate(rows, gone.select("request_id", "root_id", "page_epoch")).collect()}
    assert set(want.values()) == {"ok", "stale", "duplicate", "invalid", "cancelled"} - ({"duplicate"} - set(want.values()))
    cut = sorted(want)[:: len(want) // 5 + 1][1:] + [10**9]
    lower = -1
    for n, upper in enumerate(cut):
        part = rows.where(F.col("seq").between(lower + 1, upper))
        got = feed(rocks, part.unionByName(control) if n == 0 else part, tmp_path, n)
        lower = upper
    assert got == want
    # Of every root only the newest epoch's cancellations and the newest revision's keys are left.
    newest = {r.key.root_id: (r.value.page_epoch, r.value.root_revision) for r in state(rocks, tmp_path, "newest").collect()}
    left = state(rocks, tmp_path, "gone").collect()
    assert left and all(r.user_map_key.page_epoch >= newest[r.key.root_id][0] for r in left if r.key.root_id in newest)
    seen = state(rocks, tmp_path, "seen").select(F.col("key.root_id").alias("root_id"), F.col("user_map_value.seq").alias("seq"))
    at = {r.seq: (r.root_id, r.page_epoch, r.root_revision) for r in rows.collect()}
    assert all(at[r.seq] == (r.root_id, *newest[r.root_id]) for r in seen.collect())


def test_cancellations_of_old_epochs_go(rocks, tmp_path):
    first = requests(rocks, [(0, "a", 1, "cancel", "x"), (1, "a", 1, "cancel", "x"), (0, "a", 1, "lexical", "x")])
    feed(rocks, first, tmp_path, 0)
    assert state(rocks, tmp_path, "gone").count() == 2
    got = feed(rocks, requests(rocks, [(1, "a", 0, "lexical", "y")]).withColumn("seq", F.lit(9).cast("long")), tmp_path, 1)
    assert got == {2: "ok", 9: "ok"}
    assert [r.user_map_key.page_epoch for r in state(rocks, tmp_path, "gone").collect()] == [1]
    assert [r.user_map_value.seq for r in state(rocks, tmp_path, "seen").collect()] == [9]


def test_silent_roots_are_cleared_by_their_timer(rocks, tmp_path):
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        feed(rocks, requests(rocks, [(0, "a", 5, "lexical", "x")]), tmp_path, 0, keep_ms=1)
        feed(rocks, requests(rocks, [(0, "b", 1, "lexical", "x")]).withColumn("seq", F.lit(1).cast("long")), tmp_path, 1, keep_ms=1)
        got = feed(rocks, requests(rocks, [(0, "a", 5, "lexical", "x")]).withColumn("seq", F.lit(2).cast("long")), tmp_path, 2, keep_ms=1)
    finally:
        rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got == {0: "ok", 1: "ok", 2: "ok"}
