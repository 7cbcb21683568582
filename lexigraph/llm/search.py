"""Exact top-k inner-product search: tiles of queries and candidates, partial selection, merged lists.

Queries are broadcast in batches of bounded size. Each task multiplies a batch with its candidates, tile by tile, keeps
the k best of each query, and hands on only those; lists are then merged in two levels, first within groups of tasks.

Vectors that are null, empty of an id, or hold null or non-finite components take no part, on either side. Vectors only meet vectors of their own
length. Repeated candidates count each; repeated queries (equal id and vector) are one, and a query never meets its own id. Equal
scores go to the smaller id. Scores beyond 64 bits are held at the limits of the type. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTS = "part int, query_id long, query_no int, vec_id long, score long"
_MOST = (1 << 63) - 1


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, q``: floor(scale * x) of each component of the vectors that take part."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q")
    )


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of an array column: for each length, the rows and their components as an integer matrix."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    return {int(n): (rows, flat[starts[rows][:, None] + np.arange(n)[None, :]]) for n in np.unique(lengths) for rows in [np.flatnonzero(lengths == n)]}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floating point only where it can't round."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the left."""
    if k > 16 or scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    scores = scores.copy()
    found = np.empty((len(scores), k), dtype=np.int64)
    rows = np.arange(len(scores))
    for j in range(k):
        found[:, j] = scores.argmax(axis=1)
        scores[rows, found[:, j]] = -_MOST - 1
    return found


def top_k(vectors: DataFrame, queries: Column, k: int = 5, batch: int = 1 << 15, tile: int = 4096, strip: int = 512, fan: int = 16) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors (vec_id, embedding)`` for each row for which ``queries`` holds."""
    spark = vectors.sparkSession
    candidates = quantized(vectors)
    asked = quantized(vectors.filter(queries)).distinct()
    batches = max(1, -(-asked.count() // batch))
    lists = None
    for b in range(batches):
        mine = asked if batches == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", "q"), F.lit(batches)) == b)
        got = mine.toArrow()
        blocks = {}
        if got.num_rows:
            ids = got.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
            for n, (rows, m) in matrix(got.column("q").combine_chunks()).items():
                order = np.lexsort((*m.T[::-1], ids[rows])) if n else np.argsort(ids[rows], kind="stable")
                blocks[n] = (ids[rows][order], m[order])
        found = candidates.mapInArrow(_searcher(spark.sparkContext.broadcast(blocks), k, tile, strip, b), LISTS)
        lists = found if lists is None else lists.unionByName(found)
    for level in ([F.col("part") % fan] if fan else []) + [None]:
        by = ["query_id", "query_no"] + ([] if level is None else ["_group"])
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        lists = (lists if level is None else lists.withColumn("_group", level)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searcher(shared, k: int, tile: int, strip: int, number: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        part = TaskContext.get().partitionId()
        tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for record in parts:
            ids = record.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, m) in matrix(record.column(1)).items():
                if n not in blocks:
                    continue
                order = np.argsort(ids[rows], kind="stable")
                own, m = ids[rows][order], m[order]
                asked, q = blocks[n]
                if n not in tops:
                    tops[n] = (np.full((len(asked), k), -_MOST - 1, dtype=np.int64), np.full((len(asked), k), _MOST, dtype=np.int64))
                score, vec = tops[n]
                for s in range(0, len(asked), strip):
                    for t in range(0, len(own), tile):
                        p = products(q[s : s + strip], m[t : t + tile])
                        p[asked[s : s + strip, None] == own[None, t : t + tile]] = -_MOST - 1
                        at = best(p, k)
                        new, new_ids = np.take_along_axis(p, at, 1), own[t : t + tile][at]
                        both = np.concatenate([score[s : s + strip], new], axis=1)
                        both_ids = np.concatenate([vec[s : s + strip], new_ids], axis=1)
                        order = np.lexsort((both_ids, -np.maximum(both, -_MOST)), axis=1)[:, :k]
                        score[s : s + strip] = np.take_along_axis(both, order, 1)
                        vec[s : s + strip] = np.take_along_axis(both_ids, order, 1)
        for n, (score, vec) in tops.items():
            row, col = np.nonzero(score > -_MOST - 1)
            columns = [np.full(len(row), part, dtype=np.int32), blocks[n][0][row], (row + (number << 20)).astype(np.int32), vec[row, col], score[row, col]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["part", "query_id", "query_no", "vec_id", "score"])

    return run
