"""Sources, ingest and the tables of a collection: register, scan, compare, clean, chunk, embed, write.

Tables are DataFrames; every function returns new ones and changes none. A row that is put replaces the row of its key, and what hangs on a document goes with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import embedding, index
from ..sources import files
from ..sources.shared import fresh_folder, written  # noqa: F401  for callers

SOURCES = "source_id string, path string, name string, patterns array<string>, excludes array<string>, sync_mode string, status string"
DOCUMENTS = "document_id string, source_id string, path string, title string, mime_type string, size long, modified_at timestamp, hash string, content string"
CHUNKS = "document_id string, chunk_id string, chunk_index int, start_char int, end_char int, content string"
VECTORS = "vec_id string, document_id string, embedding array<float>"
#: Makes an array of floats of a text column: a model's own, or the hashing stand-in.
Embedder = Callable[[Column], Column]


@dataclass
class Tables:
    """The tables of a collection."""

    sources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> "Tables":
        return cls(*(spark.createDataFrame([], s) for s in (SOURCES, DOCUMENTS, CHUNKS, VECTORS)))

    def written(self, spark: SparkSession, folder: str) -> "Tables":
        """Write all tables, documents by source, and read them back: what comes next starts from files."""
        out = {}
        for name in ("sources", "documents", "chunks", "vectors"):
            df = getattr(self, name)
            files.write_table(df, f"{folder}/{name}", "source_id" if name == "documents" else None)
            out[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        return Tables(**out)


# sources


def register_source(sources: DataFrame, path: str, name: str | None = None, patterns: list[str] | None = None, excludes: list[str] | None = None, sync_mode: str = "manual") -> DataFrame:
    """``sources`` with the folder ``path``; its id follows from the path, so a folder is registered once."""
    if sync_mode not in ("manual", "watch", "scheduled"):
        raise ValueError(f"unknown mode {sync_mode!r}")
    path = path.rstrip("/")
    globs = ["*" + p if p.startswith(".") else p for p in patterns or V.DEFAULT_PATTERNS]
    row = sources.sparkSession.createDataFrame([("", path, name or path.rsplit("/", 1)[-1], globs, V.DEFAULT_EXCLUDES if excludes is None else excludes, sync_mode, "active")], SOURCES)
    return index.upsert(sources, row.withColumn("source_id", T.hash_id("src_", F.col("path"))), "source_id")


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("name", "source_id")


def get_source(sources: DataFrame, source_id: str) -> Row:
    found = sources.filter(F.col("source_id") == source_id).first()
    if found is None:
        raise KeyError(f"no source {source_id!r}")
    return found


def remove_source(tables: Tables, source_id: str) -> tuple[Tables, int]:
    """The tables without a source and all that hangs on it; and how many documents went."""
    get_source(tables.sources, source_id)
    gone = tables.documents.filter(F.col("source_id") == source_id).count()
    return Tables(*index.delete_source(source_id, tables.sources, tables.documents, tables.chunks, tables.vectors)), gone


def refresh_stats(tables: Tables) -> DataFrame:
    """Sources with ``doc_count, chunk_count, size_bytes``; a source without documents has zeros."""
    per_document = tables.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    counts = tables.documents.select("source_id", "document_id", "size").join(per_document, "document_id", "left").groupBy("source_id")
    counts = counts.agg(F.count(F.lit(1)).alias("doc_count"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunk_count"), F.sum("size").alias("size_bytes"))
    return tables.sources.join(counts, "source_id", "left").fillna(0, ["doc_count", "chunk_count", "size_bytes"])


# documents, chunks, vectors


def put_documents(tables: Tables, documents: DataFrame, embed: Embedder | None = None, size: int = 1000, overlap: int = 100) -> Tables:
    """The tables with some documents, their chunks and, where texts can be embedded, vectors, in the place of what they held of these documents."""
    rest = remove_documents(tables, documents.select("document_id"))
    chunks = index.chunk_table(documents, size, overlap)
    vectors = rest.vectors if embed is None else upsert_vectors(rest.vectors, embedded(chunks, embed))
    return replace(tables, documents=rest.documents.unionByName(documents, allowMissingColumns=True), chunks=rest.chunks.unionByName(chunks), vectors=vectors)


def remove_documents(tables: Tables, ids: DataFrame) -> Tables:
    return replace(tables, **{t: index.delete(getattr(tables, t), ids, "document_id") for t in ("documents", "chunks", "vectors")})


def get_chunks(tables: Tables, document_id: str) -> DataFrame:
    """A document's chunks in order."""
    return tables.chunks.filter(F.col("document_id") == document_id).orderBy("chunk_index")


def with_metadata(chunks: DataFrame, documents: DataFrame, metadata: Column) -> DataFrame:
    """Chunks with a map ``metadata``: their own, if they have one, over that of their document (a map of its columns)."""
    facts = documents.select("document_id", metadata.alias("_of_document"))
    own = F.col("metadata") if "metadata" in chunks.columns else F.create_map().cast("map<string,string>")
    keep = F.map_filter("_of_document", lambda k, v: ~F.map_contains_key("_own", k))
    return chunks.withColumn("_own", F.coalesce(own, F.create_map().cast("map<string,string>"))).join(facts, "document_id", "left").withColumn("metadata", F.map_concat(F.coalesce(keep, F.create_map().cast("map<string,string>")), "_own")).drop("_own", "_of_document")


def embedded(chunks: DataFrame, embed: Embedder) -> DataFrame:
    """``vec_id, document_id, embedding`` of chunks."""
    return chunks.select(F.col("chunk_id").alias("vec_id"), "document_id", embed(F.make_valid_utf8("content")).alias("embedding"))


def upsert_vectors(vectors: DataFrame, new: DataFrame, key: str = "vec_id", order: str | None = None) -> DataFrame:
    """``vectors`` with new ones in the place of those of the same key; of new ones of one key the last by ``order`` counts, without it any."""
    rest = [c for c in new.columns if c != key]
    last = new.groupBy(key).agg((F.max_by(F.struct(*rest), order) if order else F.any_value(F.struct(*rest))).alias("_r")).select(key, "_r.*")
    return index.upsert(vectors, last.select(*vectors.columns), key)


def delete_vectors(vectors: DataFrame, **where) -> tuple[DataFrame, int]:
    """The vectors without those whose columns have the given values (lists: any of them); and how many went."""
    hit = F.lit(True)
    for column, value in where.items():
        hit = hit & F.col(column).isin(value if isinstance(value, list) else [value])
    return vectors.filter(~F.coalesce(hit, F.lit(False))), vectors.filter(hit).count()


def backfill(tables: Tables, embed: Embedder) -> Tables:
    """The tables with vectors of all chunks that have none."""
    missing = tables.chunks.join(tables.vectors.select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_anti")
    return replace(tables, vectors=tables.vectors.unionByName(embedded(missing, embed)))


def vectorize(tables: Tables, load: Callable[[], embedding.Model], name: str, size: int = 20, isolate: bool = False) -> tuple[Tables, embedding.Vectorized]:
    """The tables with vectors of those chunks that have none and that the model ``name`` could embed; and its vectors, failures and counts. What failed is taken again by the next call."""
    missing = tables.chunks.join(tables.vectors.select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_anti")
    done = embedding.vectorize(missing, load, name, carry=["document_id"], size=size, isolate=isolate)
    return replace(tables, vectors=tables.vectors.unionByName(done.vectors)), done


def vector_stats(vectors: DataFrame, model: str = "hashing") -> DataFrame:
    """One row: ``vectors, dimension, model, status``."""
    counted = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimension"))
    return counted.select("vectors", F.coalesce("dimension", F.lit(0)).alias("dimension"), F.lit(model).alias("model"), F.when(F.col("vectors") > 0, "ready").otherwise("empty").alias("status"))


# synchronisation


def _found(spark: SparkSession, source: Row) -> str:
    """Where the cleaned documents of a source's folder were written: the folder is scanned once, and what is compared is what is put."""
    found = files.documents(files.scan(spark, source["path"], source["patterns"], source["excludes"]), source["source_id"])
    path = fresh_folder(spark, "found")
    found.withColumn("hash", F.when(F.col("content").isNotNull(), F.col("hash"))).write.parquet(path)
    return path


def _synchronised(tables: Tables, found: dict[str, str], rebuild: bool, embed: Embedder | None) -> tuple[Tables, DataFrame, dict[str, int]]:
    """The tables brought up to the written documents of some sources (by source id), the written status of each path, and the numbers of paths by status, which the job that writes them counts.

    A path that several of the sources have changed or added goes to the one of the greatest id.
    """
    every = tables.documents.sparkSession.read.schema(DOCUMENTS).parquet(*found.values())
    mine = tables.documents.filter(F.col("source_id").isin(list(found)))
    seen = Observation()
    diff = written(index.sync_diff(every, mine, rebuild, ("source_id", "path")).observe(seen, *index.sync_counts()), "status")
    gone = mine.join(diff.filter("status = 'deleted'"), ["source_id", "path"], "left_semi").select("document_id")
    owners = diff.filter("status in ('added', 'updated')").groupBy("path").agg(F.max("source_id").alias("source_id"))
    fresh = every.join(owners, ["source_id", "path"], "left_semi")
    return put_documents(remove_documents(tables, gone), fresh.select(*tables.documents.columns), embed), diff, seen.get


def sync_source(tables: Tables, source_id: str, rebuild: bool = False, embed: Embedder | None = None) -> tuple[Tables, DataFrame]:
    """Bring the tables up to a source's folder: files are scanned once, cleaned and compared by hash; new and changed ones are chunked and put, vanished ones removed. And the numbers of paths by status."""
    source = get_source(tables.sources, source_id)
    spark = tables.documents.sparkSession
    after, _, counts = _synchronised(tables, {source_id: _found(spark, source)}, rebuild, embed)
    return after, spark.createDataFrame([tuple(counts[s] for s in index.STATUSES)], ", ".join(f"{s} long" for s in index.STATUSES))


def sync_all(tables: Tables, rebuild: bool = False, embed: Embedder | None = None) -> tuple[Tables, dict[str, Row | Exception]]:
    """All active sources: each folder is scanned once, and all are compared and put in one plan; a source that fails keeps its rows, and the error stands in its place in the results."""
    results: dict[str, Row | Exception] = {}
    spark = tables.documents.sparkSession
    found: dict[str, str] = {}
    for source in list_sources(tables.sources.filter("status = 'active'")).collect():  # folders that someone registered
        try:
            found[source["source_id"]] = _found(spark, source)
        except Exception as error:  # a folder that can't be read must not stop the others
            results[source["source_id"]] = error
    if not found:
        return tables, results
    after, diff, _ = _synchronised(tables, found, rebuild, embed)
    counted = {r["source_id"]: r for r in diff.groupBy("source_id").agg(*index.sync_counts()).collect()}  # one row a source
    none = Row(*index.STATUSES)(*(0 for _ in index.STATUSES))
    return after, results | {s: Row(**{k: counted[s][k] for k in index.STATUSES}) if s in counted else none for s in found}
