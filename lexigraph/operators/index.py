"""Indexed collections: synchronisation with a scan, upserts and cascading deletes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


STATUSES = ("added", "updated", "unchanged", "deleted", "error")


def sync_diff(scan: DataFrame, known: DataFrame, rebuild: bool = False, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``path, status``: added, updated, unchanged, deleted or error. Of several sources, ``keys`` names a path's source as well.

    ``scan (path, hash)``: a null hash is a file that could not be read; it is an error, not a deletion.
    ``known (path, hash)``. With ``rebuild`` all files that are known and readable are updated.
    """
    both = scan.select(*keys, F.col("hash").alias("new"), F.lit(True).alias("seen")).join(known.select(*keys, F.col("hash").alias("old"), F.lit(True).alias("held")), list(keys), "full_outer")
    status = (
        F.when(F.col("seen").isNull(), "deleted").when(F.col("new").isNull(), "error").when(F.col("held").isNull(), "added").when((F.col("new") != F.col("old")) | F.lit(rebuild), "updated").otherwise("unchanged")
    )
    return both.select(*keys, status.alias("status"))


def sync_summary(diff: DataFrame) -> DataFrame:
    """One row: the number of paths of each status."""
    return diff.agg(*sync_counts())


def sync_counts() -> list[Column]:
    """The number of rows of each status, as aggregates."""
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key isn't in ``new``, and those of ``new``."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key isn't in ``gone``."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def delete_source(source_id: str, sources: DataFrame, documents: DataFrame, *below: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without a source, its documents and what hangs on them by ``document_id``."""
    gone = documents.filter(F.col("source_id") == source_id).select("document_id")
    return (sources.filter(F.col("source_id") != source_id), documents.filter(F.col("source_id") != source_id), *(delete(t, gone, "document_id") for t in below))


def chunk_table(documents: DataFrame, size: int = 1000, overlap: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fixed windows of ``documents (document_id, content)``: ``document_id, chunk_id, chunk_index, start_char, end_char, content``, and the documents' columns that are to be carried."""
    cut = documents.select("document_id", *carry, F.explode(T.fixed_chunks(F.col("content"), size, overlap)).alias("c"))
    return cut.select(
        "document_id",
        T.chunk_id(F.col("document_id"), F.col("c.index"), F.col("c.content")).alias("chunk_id"),
        F.col("c.index").alias("chunk_index"),
        F.col("c.begin").alias("start_char"),
        F.col("c.end").alias("end_char"),
        F.col("c.content").alias("content"),
        *carry,
    )


def chunk_rows(documents: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``search_rows`` of all chunks of ``documents``, which get what their documents say where they are cut: no text is shuffled."""
    facts = tuple(c for c in ("title", "path", "source_id", "mime_type") if c in documents.columns)
    return chunk_table(documents, size, overlap, facts).select("document_id", "chunk_id", "chunk_index", "content", *facts)


def search_rows(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with what a search needs of their documents: ``chunk_id, document_id, chunk_index, content, title, path, source_id, mime_type``."""
    facts = documents.select("document_id", *(c for c in ("title", "path", "source_id", "mime_type") if c in documents.columns))
    return chunks.select("chunk_id", "document_id", "chunk_index", "content").join(facts, "document_id")


def index_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, sources and size of an index."""
    rows = documents.select(F.lit(1).alias("d"), F.lit(0).alias("c"), "source_id", F.col("size").cast("long").alias("size")).unionByName(
        chunks.select(F.lit(0).alias("d"), F.lit(1).alias("c"), F.lit(None).cast("string").alias("source_id"), F.lit(0).cast("long").alias("size"))
    )
    return rows.agg(F.sum("d").alias("documents"), F.sum("c").alias("chunks"), F.countDistinct("source_id").alias("sources"), F.sum("size").alias("total_bytes"))


def source_rollup(documents: DataFrame) -> DataFrame:
    """Documents and bytes of each source, and of all (where ``source_id`` is null)."""
    return documents.rollup("source_id").agg(F.count(F.lit(1)).alias("doc_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """``content_hash, copies, first_document`` of contents that several documents share."""
    hashed = documents.select("document_id", F.sha2("content", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first_document")).filter("copies > 1")
