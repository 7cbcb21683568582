"""Watched folders: new files come as a stream, changes and deletions from a listing, both into a versioned store.

The stream is Spark's file source; every micro-batch is one change of the store, committed under the source and the batch's number, so a batch that is run again after a stop is not applied again. The file source reports a path once
only, and no empty file. ``sweep`` therefore compares the names, sizes and times of all files with the store: files that changed are read again, and documents whose files are gone are removed. It is meant to be called now and then, and opens no file
but those that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index
from ..plans import ingest
from ..sources import files
from ..sources.snapshots import SnapshotStore

BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Paths of changed files that one read names.
PATHS = 10_000


def _put(store: SnapshotStore, documents: DataFrame, gone: DataFrame | None, batch: str | None, embed: ingest.Embedder | None) -> tuple[int, dict[str, int]]:
    """Commit documents with their chunks and vectors, and removals; the version, and numbers of documents that came and of files that couldn't be read, counted by the job that writes them."""
    if batch is not None and (done := store.manifests.of_batch(batch)) is not None:
        return done, {}
    seen = Observation()
    path = ingest.fresh_folder(store.spark, "documents")
    unread = F.col("content").isNull()
    documents.observe(seen, F.count_if(~unread).alias("put"), F.count_if(unread).alias("error")).filter(~unread).write.parquet(path)
    fresh = store.spark.read.schema(documents.schema).parquet(path)
    chunks = index.chunk_table(fresh)
    put = {"documents": fresh, "chunks": chunks} | ({"vectors": ingest.embedded(chunks, embed)} if embed else {})
    keys = fresh.select("document_id") if gone is None else fresh.select("document_id").unionByName(gone)
    return store.change(put, {t: keys for t in ("documents", "chunks", "vectors")}, batch), seen.get


def opened(store: SnapshotStore) -> SnapshotStore:
    """The store, with empty tables if it has none."""
    if not store.latest():
        t = ingest.Tables.empty(store.spark)
        store.commit({"documents": t.documents, "chunks": t.chunks, "vectors": t.vectors})
    return store


def watch(store: SnapshotStore, source: Row, checkpoint: str, embed: ingest.Embedder | None = None, files_per_batch: int = 1000, **trigger) -> StreamingQuery:
    """A stream that puts the new files of ``source`` into the store; it goes on from its checkpoint. ``trigger`` is that of a stream: ``availableNow=True``, or ``processingTime="1 minute"``."""
    opened(store)
    new = store.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(source["path"])
    found = files.chosen(new, source["path"], source["patterns"], source["excludes"])

    def put(batch: DataFrame, number: int) -> None:
        _put(store, files.documents(batch, source["source_id"]), None, f"{source['source_id']}:{number}", embed)

    return found.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def sweep(store: SnapshotStore, source: Row, embed: ingest.Embedder | None = None) -> dict[str, int]:
    """Bring the store up to the files that changed or vanished; numbers of documents by what became of them."""
    opened(store)
    spark = store.spark
    listed = files.scan(spark, source["path"], source["patterns"], source["excludes"], content=False).select("path", F.col("size").alias("_size"), F.col("modified_at").alias("_at"), F.lit(True).alias("_there"))
    known = store.read("documents").filter(F.col("source_id") == source["source_id"]).select("document_id", "path", "size", "modified_at")
    both = listed.join(known, "path", "full_outer")
    status = F.when(F.col("_there").isNull(), "deleted").when(F.col("document_id").isNull(), "added").when((F.col("_at") != F.col("modified_at")) | (F.col("_size") != F.col("size")), "updated")
    path = ingest.fresh_folder(spark, "listing")
    both.select("path", "document_id", status.alias("status")).filter("status is not null").write.parquet(path)
    diff = spark.read.schema("path string, document_id string, status string").parquet(path)
    counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    if not counts:
        return {}
    names = diff.filter("status <> 'deleted'").select("path")
    documents, held = None, []

    def some() -> DataFrame:
        return files.documents(files.scan(spark, source["path"], source["patterns"], source["excludes"], paths=held), source["source_id"])

    for r in names.toLocalIterator():
        held.append(r["path"])
        if len(held) == PATHS:
            documents, held = (some() if documents is None else documents.unionByName(some())), []
    if held:
        documents = some() if documents is None else documents.unionByName(some())
    if documents is None:
        documents = store.read("documents").limit(0)
    gone = diff.filter("status = 'deleted'").select("document_id")
    return counts | {k: v for k, v in _put(store, documents.select(*store.read("documents").columns), gone, None, embed)[1].items() if k == "error"}
