"""The status of each chunk's extraction as state: answers come as a stream, the last one wins, failures are due again after a growing wait.

Each key holds its last answer and the number of its answers. An answer that is late, by its own time, counts as an attempt but doesn't replace a later one. Waits are timers of the state; when one ends, its chunk is marked as due.
The table that the stream keeps has the rows that ``graph.status_upsert`` gives of all answers at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import graph
from ..sources.shared import fresh_folder
from ..sources.snapshots import SnapshotStore

LAST = "at long, status string, entity_count int, error_message string, attempts int, timer long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        best = tuple(held[:4]) if held else None
        attempts, timer = (held[4], held[5]) if held else (0, -1)
        for r in rows:
            attempts += 1
            mine = (r["at"], r["status"], r["entity_count"], r["error_message"])
            if best is None or graph.answer_order(mine) > graph.answer_order(best):
                best = mine
        if timer >= 0:
            self.handle.deleteTimer(timer)
            timer = -1
        wait = graph.wait_of(best[1], best[3], attempts, self.most)
        if wait is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * wait
            self.handle.registerTimer(timer)
        self.last.update((*best, attempts, timer))
        yield Row(chunk_id=key[0], at=best[0], status=best[1], entity_count=best[2], error_message=best[3], attempts=attempts, due=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, status, count, message, attempts, _ = self.last.get()
        self.last.update((at, status, count, message, attempts, -1))
        yield Row(chunk_id=key[0], at=at, status=status, entity_count=count, error_message=message, attempts=attempts, due=True)

    def close(self) -> None:
        pass


def statuses(answers: DataFrame, most: int = graph.ATTEMPTS) -> DataFrame:
    """A stream ``chunk_id, status, attempts, entity_count, error_message, updated_at, due`` of the stream ``answers (chunk_id, at, status, entity_count, error_message)``: a chunk's row whenever it changes."""
    kind = answers.schema["chunk_id"].dataType.simpleString()
    plain = answers.select("chunk_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "status", F.col("entity_count").cast("int").alias("entity_count"), "error_message")
    schema = f"chunk_id {kind}, at long, status string, entity_count int, error_message string, attempts int, due boolean"
    out = plain.groupBy("chunk_id").transformWithState(Attempts(most), schema, "Update", "ProcessingTime")
    return out.select("chunk_id", "status", "attempts", "entity_count", "error_message", F.timestamp_micros("at").alias("updated_at"), "due")


def track(store: SnapshotStore, answers: DataFrame, checkpoint: str, most: int = graph.ATTEMPTS, every: str = "1 second") -> StreamingQuery:
    """A stream that keeps the table ``status`` of ``store``; it goes on from its checkpoint, and a batch that comes again isn't applied again.

    Waits end whether or not there are new answers, so it runs a batch at each interval until it is stopped; batches without changes make no version.
    """
    spark, found = store.spark, statuses(answers, most)

    def put(batch: DataFrame, number: int) -> None:
        seen, path = Observation(), fresh_folder(spark, "status")
        batch.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        if seen.get["n"]:
            rows = spark.read.schema(batch.schema).parquet(path)
            store.change({"status": rows}, {"status": rows.select("chunk_id")}, f"status:{number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # timers need it; the stream keeps the setting that it starts with
    try:
        return found.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.set(PROVIDER, before)
