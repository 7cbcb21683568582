"""Semantic search: exact cosine neighbours of a table of query vectors.

Components are accumulated as doubles. Null vectors and vectors of length zero have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors with their length; those that can't be compared are left out."""
    return vectors.withColumn("norm", F.sqrt(dot(F.col(vector), F.col(vector)))).filter(F.col("norm") > 0)


#: Query vectors of one block: it is broadcast, so a block holds at most so many, and a longer table makes several.
BLOCK = 4096


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a column of vectors: for each length, the places and a matrix of unit rows; null vectors, those with null or NaN components, and those of length zero are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == n)
        m = values[starts[places][:, None] + np.arange(n)].astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        good = norm > 0
        out[n] = (places[good], m[good] / norm[good][:, None])
    return out


def plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that can be compared and sorted: whole numbers, or objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), dtype=object)


class Best:
    """The best rows of each query that a task has met: higher scores first, ties (to nine digits) by the smaller id."""

    def __init__(self, most: int):
        self.most, self.held, self.size, self.limit = most, [], 0, 1 << 18

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> None:
        self.held.append((query, score, ids, np.zeros(len(ids), dtype=np.int64) if more is None else more))
        self.size += len(query)
        if self.size > self.limit:
            self.held, self.size = [self.rows()], 0
            self.size = len(self.held[0][0])
            self.limit = max(1 << 18, 2 * self.size)

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        query, score, ids, more = (np.concatenate(c) for c in zip(*self.held))
        place = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place, -np.round(score, 9), query))
        query = query[order]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=bool)
        start = np.flatnonzero(first)
        keep = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query)))) < self.most
        order = order[keep]
        return query[keep], score[order], ids[order], more[order]


def top_of(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``most`` highest scores of each row, and of all that tie with the last of them to nine digits."""
    if scores.shape[1] > most:
        last = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
        return np.nonzero((scores >= last[:, None] - 1e-9) & np.isfinite(scores))
    return np.nonzero(np.isfinite(scores))


def _blocks(queries: DataFrame) -> Iterator:
    """The query vectors in broadcast blocks of bounded size: ids, and matrices by length."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    for b in range(blocks):
        mine = queries.select("query_id", "vector")
        rows = (mine if blocks == 1 else mine.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        yield spark.sparkContext.broadcast((plain(rows.column(0)), unit_rows(rows.column(1).combine_chunks())))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, offset: int = 0, least: float | None = None, skip_own: bool = False) -> DataFrame:
    """``query_id, vec_id, score, rank``: for each of ``queries (query_id, vector)`` its nearest of ``vectors (vec_id, embedding)`` by cosine.

    Queries go out in blocks of bounded size; each task multiplies a block with its vectors, batch by batch, and hands on the best of each query. Ties go to the smaller id.
    """
    kinds = {f.name: f.dataType for f in (*queries.schema, *vectors.schema)}
    schema = f"query_id {kinds['query_id'].simpleString()}, vec_id {kinds['vec_id'].simpleString()}, score double"
    found = None
    for shared in _blocks(queries):
        part = vectors.select("vec_id", "embedding").mapInArrow(_nearest(shared, to_arrow_type(kinds["query_id"]), k + offset, least, skip_own), schema)
        found = part if found is None else found.unionByName(part)
    return page(found, k, offset)


def page(found: DataFrame, k: int, offset: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def _nearest(shared, kind: pa.DataType, most: int, least: float | None, skip_own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, blocks = shared.value
        best, id_kind = Best(most), pa.int64()
        for batch in batches:
            names, id_kind = plain(batch.column(0)), batch.column(0).type
            for n, (places, m) in unit_rows(batch.column(1)).items():
                if n not in blocks:
                    continue
                of, q = blocks[n]
                scores = q @ m.T
                if skip_own:
                    scores[asked[of][:, None] == names[places][None, :]] = -np.inf
                if least is not None:
                    scores[scores < least] = -np.inf
                row, col = top_of(scores, most)
                best.add(of[row], scores[row, col], names[places[col]])
        query, score, ids, _ = best.rows()
        yield pa.record_batch([pa.array(asked[query].tolist(), kind), pa.array(ids.tolist(), id_kind), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def band_counts(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, band, n``: how many vectors lie in each band of similarity to each query; batches send counts, not pairs."""
    kind = queries.schema["query_id"].dataType

    def counter(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, blocks = shared.value
            for batch in batches:
                for n, (_, m) in unit_rows(batch.column(0)).items():
                    of, q = blocks.get(n, (np.zeros(0, dtype=np.int64), np.zeros((0, n))))
                    scores = q @ m.T
                    high, medium = (scores >= 0.8).sum(axis=1), ((scores >= 0.6) & (scores < 0.8)).sum(axis=1)
                    counts = [high, medium, scores.shape[1] - high - medium]
                    ids = pa.array(asked[of].tolist() * 3, to_arrow_type(kind))
                    yield pa.record_batch([ids, pa.array([b for b in ("high", "medium", "low") for _ in of]), pa.array(np.concatenate(counts).astype(np.int64))], names=["query_id", "band", "n"])

        return run

    parts = [vectors.select("embedding").mapInArrow(counter(shared), f"query_id {kind.simpleString()}, band string, n long") for shared in _blocks(queries)]
    return reduce(DataFrame.unionByName, parts).filter("n > 0").groupBy("query_id", "band").agg(F.sum("n").alias("n"))


def band(score: Column) -> Column:
    """Confidence of a similarity."""
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def centroids(vectors: DataFrame, by: str, dimension: int) -> DataFrame:
    """``query_id, vector``: the mean vector of each group."""
    means = [F.round(F.avg(F.get("embedding", F.lit(i)).cast("double")), 9) for i in range(dimension)]
    return vectors.groupBy(by).agg(F.array(*means).alias("vector")).withColumnRenamed(by, "query_id")


def hashing_embedder(dimension: int = 64):
    """A deterministic stand-in for an embedding model: signed counts of hashed tokens, as an array column of a text column."""
    from ..functions.text import tokens

    @F.arrow_udf("array<float>")
    def summed(codes: pa.Array) -> pa.Array:
        flat, row = codes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(codes)), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
        out = np.bincount(row * dimension + (flat >> 1), weights=1.0 - 2.0 * (flat & 1), minlength=len(codes) * dimension).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * dimension), pa.array(out))

    def embed(c: Column) -> Column:
        # A token's slot, and in the last bit whether it counts as less; a text is split once.
        return summed(F.transform(tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)) * 2 + F.pmod(F.hash(t), F.lit(2))))

    return embed


def entity_text(name: Column, description: Column) -> Column:
    """What is embedded of an entity."""
    return F.concat_ws(": ", name, F.nullif(description, F.lit("")))


def entity_vectors(entities: DataFrame, embed) -> DataFrame:
    """``vec_id, type, embedding`` of entities ``(entity_id, name, type, description)``."""
    return entities.select(F.col("entity_id").alias("vec_id"), "type", embed(entity_text(F.col("name"), F.col("description"))).alias("embedding"))


def entity_knn(vectors: DataFrame, queries: DataFrame, types: list[str] | None = None, limit: int = 20, least: float = 0.0) -> DataFrame:
    """``query_id, entity_id, score, rank``: the nearest entities, of some types only where asked."""
    mine = vectors.filter(F.col("type").isin(types)) if types else vectors
    return knn(mine, queries, limit, least=least).withColumnRenamed("vec_id", "entity_id")
