"""A stored inverted-file index of vectors: k-means cells, product-quantised residuals, probing of the nearest cells, exact rerank.

Vectors are compared by cosine, so all are unit rows here. Cells and codebooks are fitted by distributed k-means rounds over a sample of bounded size; every vector is then assigned to its cell and stored in the cell's partition, once
as a code of a few bytes with its payload, once whole. A search reads the codes of the cells that its queries probe and nothing else, ranks them by inner products with the codes, and reads the whole vectors of the best for their
exact scores. The exact mode needs no codes: it reads the nearest cells first, then each cell that, by its angle to the query and its radius, could hold a vector that is better than the worst one found.

Null vectors, those with null or NaN components and those of length zero have no neighbours and are not stored. Vectors of other lengths than the index's are stored apart, and answer queries of their length by a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .vector import BLOCK, Best, knn, page, plain, top_of, unit_rows

#: Vectors that cells and codebooks are fitted on, as expected; cells at most, bytes of their matrix at most; codes of a codebook.
SAMPLE, MOST_CELLS, MATRIX_BYTES, CODES = 1 << 18, 1 << 16, 1 << 28, 256
SUMS = "slot long, n long, total binary"
#: Vectors whose true neighbours tell how many cells must be read, numbers of neighbours that are looked at, and the share of them that must be met.
TRIALS, DEPTHS, RECALL = 256, (16, 128, 1024), 0.985


def nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(m), dtype=np.int64)
    for at in range(0, len(m), 4096):
        out[at : at + 4096] = np.argmax(m[at : at + 4096] @ centres.T - half, axis=1)
    return out


def _sums(shared, parts: int):
    """Of each task's vectors: number and sum by part and nearest centre; ``shared`` has the centres of every part, and cells whose centres are taken off first, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, cells = shared.value
        count, width = centres.shape[1:]
        n, total = np.zeros((parts, count), dtype=np.int64), np.zeros((parts, count, width))
        for batch in batches:
            for size, (_, m) in unit_rows(batch.column(0)).items():
                if size != parts * width:
                    continue
                if cells is not None:
                    m = m - cells[nearest(m, cells)]
                for p in range(parts):
                    own = m[:, p * width : (p + 1) * width]
                    to = nearest(own, centres[p])
                    n[p] += np.bincount(to, minlength=count)
                    np.add.at(total[p], to, own)
        slot = np.flatnonzero(n.ravel())
        yield pa.record_batch([pa.array(slot), pa.array(n.ravel()[slot]), pa.array([x.tobytes() for x in total.reshape(-1, width)[slot]], pa.binary())], names=["slot", "n", "total"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for slot, n, total in zip(*(c.to_pylist() for c in batch.columns)):
            if slot in held:
                held[slot][0] += n
                held[slot][1] += np.frombuffer(total)
            else:
                held[slot] = [n, np.frombuffer(total).copy()]
    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], names=["slot", "n", "total"])


def fit(sample: DataFrame, first: np.ndarray, rounds: int, cells: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's rounds from the centres ``first (part, centre, component)``; without ``cells`` centres are unit rows. Only sums by centre come to the driver; a centre without vectors stays."""
    spark, centres = sample.sparkSession, first
    parts, count, width = first.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centres, cells))
        sums = sample.select("embedding").mapInArrow(_sums(shared, parts), SUMS).repartition("slot").mapInArrow(_merged, SUMS).toArrow()
        centres = centres.copy().reshape(-1, width)
        for slot, n, total in zip(*(c.to_pylist() for c in sums.columns)):
            centre = np.frombuffer(total) / n
            norm = np.sqrt(centre @ centre)
            centres[slot] = centre if cells is not None else centre / norm if norm > 0 else centres[slot]
        centres = centres.reshape(first.shape)
    return centres


@dataclass
class VectorIndex:
    """An index in a folder: ``codes`` and ``vectors`` by cell, ``cells`` with centre, radius and size, ``books``, ``probes`` (its calibration), and ``rest``."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, parts: int = 16, rounds: int = 6, sample: int = SAMPLE) -> VectorIndex:
        """Index ``vectors (vec_id, embedding, payload...)`` in a new folder. ``cells``: by default four times the square root of the number of vectors; ``parts``: bytes of a code."""
        spark = vectors.sparkSession
        sizes = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).filter("n > 0").orderBy(F.desc("rows"), "n").first()
        width, rows = (sizes["n"], sizes["rows"]) if sizes else (1, 0)
        if cells is None:
            cells = max(1, min(MOST_CELLS, MATRIX_BYTES // (8 * width), int(4 * rows**0.5)))
        if cells * width * 8 > MATRIX_BYTES:
            raise ValueError(f"{cells} cells of {width} components are more than {MATRIX_BYTES} bytes")
        while width % parts:
            parts -= 1
        place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
        mine = vectors.filter(F.size("embedding") == width)
        kept = mine.select("embedding", place.alias("place")).filter(F.col("place") <= int(min(1.0, sample / max(rows, 1)) * (1 << 30)))
        kept.write.parquet(f"{folder}/sample")
        kept = spark.read.parquet(f"{folder}/sample")
        begin = unit_rows(kept.orderBy("place", "embedding").limit(max(cells, CODES)).select("embedding").toArrow().column(0).combine_chunks()).get(width, (None, np.zeros((0, width))))[1]
        begin = begin if len(begin) else np.eye(1, width)
        centres = fit(kept, begin[None, :cells], rounds)[0]
        near = (begin - centres[nearest(begin, centres)])[:CODES]
        books = fit(kept, np.stack([near[:, i : i + width // parts] for i in range(0, width, width // parts)]), rounds, centres)

        shared = spark.sparkContext.broadcast((centres, books))
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema]
        assigned = vectors.mapInArrow(_assigner(shared, width, vectors.columns.index("embedding")), ", ".join([*kinds, "cell int", "angle double", "code binary"]))
        assigned.write.parquet(f"{folder}/assigned")
        assigned = spark.read.parquet(f"{folder}/assigned")
        inside = assigned.filter("cell >= 0")
        # Large cells are dealt to several tasks, small ones together, by their size.
        inside.drop("angle", "embedding").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/codes")
        inside.drop("angle", "code").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/vectors")
        assigned.filter("cell < 0").drop("cell", "angle", "code").write.parquet(f"{folder}/rest")
        facts = inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        table.join(facts, "cell", "left").fillna(0, ["n", "radius"]).write.parquet(f"{folder}/cells")
        spark.createDataFrame([(width, parts, books.shape[1], books.ravel().tolist())], "width int, parts int, codes int, books array<double>").write.parquet(f"{folder}/books")
        out = cls(spark, folder)
        out._calibrate(begin)
        return out

    def _calibrate(self, begin: np.ndarray) -> None:
        """Write how many cells hold RECALL of the nearest 16, 128 and 1,024 neighbours of some vectors, by an exact search for them."""
        centres, _, sizes, _ = self._tables()
        asked = begin[:TRIALS]
        queries = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
        total = int(sizes.sum())
        depths = [d for d in DEPTHS if d < total] or [max(total - 1, 1)]
        near = knn(self.read("vectors").select("vec_id", "embedding"), queries, depths[-1] + 1).join(self.read("vectors").select("vec_id", "cell"), "vec_id").filter("rank > 1").select("query_id", "rank", "cell").toArrow()
        like = np.where(sizes > 0, asked @ centres.T, -np.inf)
        place = np.argsort(np.argsort(-like, axis=1, kind="stable"), axis=1) + 1
        rank = near.column("rank").to_numpy()
        needed = place[near.column("query_id").to_numpy(), near.column("cell").to_numpy()] if len(rank) else np.ones(1, dtype=np.int64)
        rows = [(d, int(np.quantile(needed[rank <= d + 1] if len(rank) else needed, RECALL, method="higher"))) for d in depths]
        self.spark.createDataFrame(rows, "neighbours int, cells int").write.parquet(f"{self.folder}/probes")

    def probes(self, neighbours: float) -> int:
        """The cells that a search for so many neighbours must read, by calibration; between and beyond its depths by the power that joins the nearest two."""
        known = [(r["neighbours"], r["cells"]) for r in self.read("probes").orderBy("neighbours").collect()]
        if neighbours <= known[0][0] or len(known) == 1:
            return known[0][1] if neighbours <= known[0][0] else 1 << 30
        (a, p), (b, q) = next(((x, y) for x, y in zip(known, known[1:]) if neighbours <= y[0]), known[-2:])
        return int(np.ceil(p * (neighbours / a) ** (np.log(q / p) / np.log(b / a))))

    def read(self, name: str) -> DataFrame:
        """``codes``, ``vectors``, ``cells``, ``books``, ``sample`` or ``rest``."""
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _tables(self):
        cells = self.read("cells").orderBy("cell").toArrow()  # bounded by MATRIX_BYTES
        b = self.read("books").first()
        centres = cells.column("centre").combine_chunks().flatten().to_numpy().reshape(-1, b["width"])
        return centres, cells.column("radius").to_numpy(), cells.column("n").to_numpy(), np.array(b["books"]).reshape(b["parts"], b["codes"], b["width"] // b["parts"])

    def search(self, queries: DataFrame, k: int = 10, offset: int = 0, least: float | None = None, where: Column | str | None = None, probes: int | None = None, rerank: int = 8, exact: bool = False) -> DataFrame:
        """``query_id, vec_id, score, rank`` of ``queries (query_id, vector)``; ``where`` is a condition on the payload and holds before the nearest are taken.

        ``probes`` cells are read for each query, by default as many as calibration asks for; a condition makes neighbours rarer, so its share of the rows is counted first. The exact scores of the best ``rerank * (k + offset)``
        by their codes decide. With ``exact`` all vectors are considered.
        """
        centres, radius, sizes, books = self._tables()
        most = k + offset
        kept = lambda df: df if where is None else df.filter(where)
        if probes is None:
            share = 1.0 if where is None else kept(self.read("codes")).count() / max(int(sizes.sum()), 1)
            probes = self.probes(most / share) if share else 1
        probes = max(1, min(len(centres), probes))
        kind = queries.schema["query_id"].dataType
        id_kind = self.read("vectors").schema["vec_id"].dataType
        schema = f"query_id {kind.simpleString()}, vec_id {id_kind.simpleString()}, score double"
        found = []
        blocks = max(1, -(-queries.count() // BLOCK))
        for b in range(blocks):
            mine = queries.select("query_id", "vector")
            rows = (mine if blocks == 1 else mine.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
            names, by_length = plain(rows.column(0)), unit_rows(rows.column(1).combine_chunks())
            if other := {n: v for n, v in by_length.items() if n != centres.shape[1]}:
                share = self.spark.sparkContext.broadcast((names, other))
                found.append(kept(self.read("rest")).select("vec_id", "embedding").mapInArrow(_scan(share, to_arrow_type(kind), most, least), schema))
            places, q = by_length.get(centres.shape[1], (np.zeros(0, dtype=np.int64), np.zeros((0, centres.shape[1]))))
            if not len(q):
                continue
            like = q @ centres.T
            order = np.argsort(-np.where(sizes > 0, like, -np.inf), axis=1, kind="stable")[:, :probes]
            visited = np.zeros(like.shape, dtype=bool)
            np.put_along_axis(visited, order, True, axis=1)
            visited &= sizes > 0
            if not exact:
                found.append(self._by_codes(names[places], q, visited, centres, books, kept, most, max(1, rerank) * most, least, schema))
                continue
            first = self._whole(names[places], q, visited, kept, most, least, schema, None)
            first.write.parquet(path := f"{self.folder}/found-{np.random.default_rng().integers(1 << 62)}")
            first = self.spark.read.schema(first.schema).parquet(path)
            # The score that a vector must reach to change a query's page: its worst, or nothing where the page isn't full.
            worst = page(first, most, 0).filter(F.col("rank") == most).select("query_id", "score").toArrow()
            floor = dict(zip(plain(worst.column(0)).tolist(), worst.column(1).to_pylist()))
            bar = np.array([floor.get(x, -2.0 if least is None else least) for x in names[places].tolist()])
            angle = np.arccos(np.clip(like, -1, 1))
            bound = np.cos(np.maximum(angle - radius[None, :] - 1e-6, 0))
            found += [first, self._whole(names[places], q, (bound >= bar[:, None] - 1e-9) & ~visited & (sizes > 0), kept, most, least, schema, None)]
        if not found:
            found = [self.spark.createDataFrame([], schema)]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return page(out, k, offset)

    def _cells_of(self, df: DataFrame, visited: np.ndarray) -> DataFrame:
        """Only the partitions of visited cells."""
        return df.filter(F.col("cell").isin(np.flatnonzero(visited.any(axis=0)).tolist()))

    def _whole(self, names, q, visited, kept, most: int, least: float | None, schema: str, only: DataFrame | None) -> DataFrame:
        """Exact scores of the vectors of visited cells, or only of those pairs that ``only`` names."""
        shared = self.spark.sparkContext.broadcast((names, q, visited))
        rows = kept(self._cells_of(self.read("vectors"), visited)).select("vec_id", "embedding", "cell")
        kind = to_arrow_type(self.spark.createDataFrame([], schema).schema["query_id"].dataType)
        if only is not None:
            rows = rows.join(only.groupBy("vec_id").agg(F.collect_set("query_no").alias("asked")), "vec_id")  # at most the queries of a block
        return rows.mapInArrow(_exact(shared, kind, most, least, only is not None), schema)

    def _by_codes(self, names, q, visited, centres, books, kept, most: int, short: int, least: float | None, schema: str) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((q, visited, centres, books))
        id_kind = schema.split(", ")[1].split(" ", 1)[1]
        ranked = kept(self._cells_of(self.read("codes"), visited)).select("vec_id", "code", "cell").mapInArrow(_codes(shared, short), f"query_id long, vec_id {id_kind}, score double")
        listed = page(ranked, short, 0).select(F.col("query_id").alias("query_no"), "vec_id")
        return self._whole(names, q, visited, kept, most, least, schema, listed)


def _assigner(shared, width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        step = books.shape[2]
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -2, dtype=np.int32), np.zeros(batch.num_rows)
            codes: list[bytes | None] = [None] * batch.num_rows
            for n, (places, m) in unit_rows(batch.column(at)).items():
                cell[places] = -1
                if n == width:
                    to = nearest(m, centres)
                    cell[places] = to
                    angle[places] = np.arccos(np.clip((m * centres[to]).sum(axis=1), -1, 1))
                    rest = m - centres[to]
                    code = np.stack([nearest(rest[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
                    for i, c in zip(places, code):
                        codes[i] = c.tobytes()
            keep = pa.array(cell > -2)
            out = pa.record_batch([*batch.columns, pa.array(cell), pa.array(angle), pa.array(codes, pa.binary())], names=[*batch.schema.names, "cell", "angle", "code"])
            yield out.filter(keep)

    return run


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]])) if len(values) else []
    for own in np.split(order, start[1:]) if len(values) else ():
        yield int(values[own[0]]), own


def _codes(shared, most: int):
    """The best of each query by its codes, over a task's rows ``vec_id, code, cell``; queries go by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, visited, centres, books = shared.value
        parts, _, width = books.shape
        best, kind = Best(most), pa.int64()
        for batch in batches:
            names, kind = plain(batch.column(0)), batch.column(0).type
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, parts)
            for cell, own in _groups(batch.column(2).to_numpy()):
                asking = np.flatnonzero(visited[:, cell])
                for at in range(0, len(asking), 256):
                    some = asking[at : at + 256]
                    scores = np.repeat((q[some] @ centres[cell])[:, None], len(own), axis=1)
                    for p in range(parts):
                        scores += (q[some, p * width : (p + 1) * width] @ books[p].T)[:, codes[own, p]]
                    row, col = top_of(scores, most)
                    best.add(some[row], scores[row, col], names[own[col]])
        query, score, ids, _ = best.rows()
        yield pa.record_batch([pa.array(query), pa.array(ids.tolist(), kind), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _exact(shared, kind: pa.DataType, most: int, least: float | None, listed: bool):
    """The best of each query over a task's rows ``vec_id, embedding, cell``; with ``listed`` a fourth column names the queries of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, visited = shared.value
        best, id_kind = Best(most), pa.int64()
        for batch in batches:
            ids, id_kind = plain(batch.column(0)), batch.column(0).type
            places, m = unit_rows(batch.column(1)).get(q.shape[1], (np.zeros(0, dtype=np.int64), None))
            if not len(places):
                continue
            if listed:
                asking = batch.column(3)
                counts = asking.value_lengths().to_numpy()
                row, col = asking.flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)
                where = np.full(batch.num_rows, -1)
                where[places] = np.arange(len(places))
                score = (q[row] * m[where[col]]).sum(axis=1)
                keep = score >= (-2 if least is None else least)
                best.add(row[keep], score[keep], ids[col[keep]])
                continue
            for cell, own in _groups(batch.column(2).to_numpy()[places]):
                asking = np.flatnonzero(visited[:, cell])
                scores = q[asking] @ m[own].T
                if least is not None:
                    scores[scores < least] = -np.inf
                row, col = top_of(scores, most)
                best.add(asking[row], scores[row, col], ids[places[own[col]]])
        query, score, found, _ = best.rows()
        yield pa.record_batch([pa.array(names[query].tolist(), kind), pa.array(found.tolist(), id_kind), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _scan(shared, kind: pa.DataType, most: int, least: float | None):
    from .vector import _nearest

    return _nearest(shared, kind, most, least, False)
