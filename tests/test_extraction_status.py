import random
import time
from datetime import datetime, timedelta

from lexigraph.operators import graph
from lexigraph.sources.snapshots import SnapshotStore
from lexigraph.streaming import extraction

SCHEMA = "chunk_id string, at timestamp, status string, entity_count int, error_message string"
COLUMNS = ["chunk_id", "status", "attempts", "entity_count", "error_message", "updated_at"]


def answers():
    random.seed(5)
    start = datetime(2024, 1, 1)
    kinds = [("completed", 3, None), ("error", 0, "connection refused"), ("error", None, "no such model"), ("error", 0, "timeout"), ("completed", 4, None)]
    return [(f"c{random.randrange(9)}", start + timedelta(seconds=random.randrange(30)), *random.choice(kinds)) for _ in range(60)]


def shown(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def until(query, done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end and query.isActive:
        time.sleep(0.5)


def test_the_last_answer_wins_and_waits_grow(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(seconds=i), "error", 0, "timeout") for i in range(3)] + [("b", t, "error", 0, "timeout"), ("b", t, "completed", 2, None), ("c", t, "error", 0, "no such model"), ("d", t, "error", None, None)]
    got = {r["chunk_id"]: (r["status"], r["attempts"], r["wait_seconds"]) for r in graph.status_upsert(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": ("error", 3, 4), "b": ("completed", 2, None), "c": ("error", 1, None), "d": ("error", 1, None)}
    assert graph.status_upsert(spark.createDataFrame(rows[:3], SCHEMA), 3).first()["wait_seconds"] is None
    assert graph.status_upsert(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_wait_of_a_row_is_that_of_the_table(spark):
    rows = [(f"c{i}", datetime(2024, 1, 1), s, 0, m) for i, (s, m) in enumerate([("error", x) for x in ("Timeout!", "connection reset", "unexpected end of JSON", "model not found", "", None)] + [("completed", None), ("completed", "timeout")])]
    for r in graph.status_upsert(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["wait_seconds"] == graph.wait_of(r["status"], r["error_message"], 1)


def test_stream_and_table_agree_over_a_restart(spark, tmp_path):
    rows = answers()
    store = SnapshotStore(spark, f"file://{tmp_path}/store")

    def run(wanted):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = extraction.track(store, stream, f"file://{tmp_path}/check")
        try:
            until(query, lambda: store.latest() and shown(store.read("status")) == wanted)
        finally:
            query.stop()
        return shown(store.read("status"))

    for part in range(2):  # out of order, in two runs of the stream
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        wanted = shown(graph.status_upsert(spark.createDataFrame(rows[: part * 30 + 30], SCHEMA)))
        assert run(wanted) == wanted
    assert spark.conf.get(extraction.PROVIDER) != extraction.ROCKS


def test_a_failure_is_due_after_its_wait(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t, "error", 0, "timeout"), ("b", t, "error", 0, "no such model"), ("c", t, "completed", 1, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    query = extraction.track(store, spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/check")
    try:
        until(query, lambda: store.latest() and store.read("status").filter("due").count())
        version = store.latest()
        time.sleep(3)
        assert store.latest() == version  # batches without changes
    finally:
        query.stop()
    assert {r["chunk_id"] for r in store.read("status").filter("due").collect()} == {"a"}
    assert store.read("status").count() == 3
