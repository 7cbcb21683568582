"""A lexical index that follows its collection: immutable segments, tombstones, merges, and exact top-k by block-max skipping.

A put writes one new segment with its documents and marks the older rows of the same keys as dead; a removal only marks. Nothing that exists is rewritten but by ``merge``. Each version of the index is a manifest: its segments with
their numbers and lengths of documents, and the tombstones; readers pin one.

Within a segment documents are in shards of bounded size, runs of the tasks that read them (or, after a merge, dealt by key), and numbered in order of their keys. The postings of a token in a shard are cut into blocks, each with its first and last document, its largest weight and its shortest
document. A search scores intervals of documents in the order of the most that their blocks could give, and stops at the first interval that can't reach the worst of the page; blocks of intervals that are never reached stay packed.
Scores, document frequencies and lengths are those of the living documents, so a search finds what it would find in an index built afresh.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shuffles_dropped
from ..sources.snapshots import Manifests
from . import inverted
from .inverted import BLOCKS
from .lexical import B, FIELD_WEIGHTS, K1, LEAST_IDF, _keys, query_terms
from .vector import page

BLOCK = 128
#: Documents of a shard, as expected; queries that are answered together.
SHARD, QUERIES = 1 << 16, 4096
UNITS = "segment int, shard int, term_no int, plain boolean, n int, first int, last int, most double, shortest double, places binary, tfs binary, lengths binary"
HITS = "query_no long, segment int, shard int, place long, score double, scored long, postings long"


def part_of(idf: float, tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows ``token, shard, place, tf, dl`` that come sorted by these."""
    held: list[pa.RecordBatch] = []

    def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        token, shard = t.column(0).combine_chunks(), t.column(1).to_numpy()
        code = token.dictionary_encode().indices.to_numpy()
        place, tf, dl = t.column(2).to_numpy().astype("<i4"), t.column(3).to_numpy().astype("<f8"), t.column(4).to_numpy().astype("<f8")
        start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])]))
        within = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code))))
        cut = np.flatnonzero(within % BLOCK == 0)
        ends = np.append(cut[1:], len(code))
        columns = [
            pa.array(shard[cut].astype(np.int32)), token.take(pa.array(cut)), pa.array((within[cut] // BLOCK).astype(np.int32)), pa.array((ends - cut).astype(np.int32)), pa.array(place[cut]), pa.array(place[ends - 1]),
            pa.array(np.maximum.reduceat(tf, cut)), pa.array(np.minimum.reduceat(dl, cut)), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for x in (place, tf, dl)),
        ]
        yield pa.record_batch(columns, names=[f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        # Whole lists are packed; the last one of a batch may go on in the next.
        last = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py())
        same = np.asarray(pc.equal(batch.column(0), last[0]).to_numpy(zero_copy_only=False)) & (batch.column(1).to_numpy() == last[1])
        split = int(np.flatnonzero(same)[0])
        if split:
            yield from packed(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = []
        elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != last:
            yield from packed(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(split))
    if held:
        yield from packed(pa.Table.from_batches(held))


@dataclass
class SegmentedIndex:
    """The index in a folder, at a version; a new object sees the last one."""

    spark: SparkSession
    folder: str
    version: int = -1
    state: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.version < 0:
            self.version, self.state = Manifests(self.spark, self.folder).latest()
        elif not self.state:
            self.state = Manifests(self.spark, self.folder).state(self.version)

    @classmethod
    def create(cls, spark: SparkSession, folder: str, key: str = "chunk_id", stem: bool = True, weights: dict[str, float] = FIELD_WEIGHTS) -> SegmentedIndex:
        """An empty index; stems or words, and the weights of the fields, are part of it."""
        state = {"key": key, "stem": stem, "weights": weights, "segments": [], "tombstones": [], "next": 0}
        return cls(spark, folder, Manifests(spark, folder).commit(0, state), state)

    def _commit(self, state: dict, batch: str | None = None) -> SegmentedIndex:
        return SegmentedIndex(self.spark, self.folder, Manifests(self.spark, self.folder).commit(self.version, state, batch), state)

    def _path(self, label: str) -> str:
        return f"{self.folder}/{label}-{uuid.uuid4().hex}"

    def _read(self, name: str) -> DataFrame | None:
        """``blocks``, ``documents`` or ``tokens`` of all segments, with their number."""
        out = None
        for s in self.state["segments"]:
            if name == "blocks":  # a segment that was put has packed runs, a merged one has blocks
                df = self.spark.read.schema(BLOCKS).parquet(self._blocks_of(s["path"])).filter("token is not null")
            else:
                df = self.spark.read.parquet(f"{s['path']}/{name}")
            df = df.withColumn("segment", F.lit(s["number"]))
            out = df if out is None else out.unionByName(df)
        return out

    def _blocks_of(self, path: str) -> str:
        jvm = self.spark.sparkContext._jvm
        packed = jvm.org.apache.hadoop.fs.Path(f"{path}/packed")
        return f"{path}/packed" if packed.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(packed) else f"{path}/blocks"

    def tombstones(self) -> DataFrame:
        """``segment, shard, place, dl`` of the dead documents."""
        paths = [t["path"] for t in self.state["tombstones"]]
        schema = "segment int, shard int, place int, dl long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """``key, dl`` of the living documents, with their places."""
        every = self._read("documents")
        if every is None:
            raise ValueError("the index is empty")
        return every.join(self.tombstones().drop("dl"), ["segment", "shard", "place"], "left_anti")

    def counts(self) -> tuple[int, float]:
        """Number and mean length of the living documents, from the manifest alone."""
        n = sum(s["documents"] for s in self.state["segments"]) - sum(t["documents"] for t in self.state["tombstones"])
        length = sum(s["length"] for s in self.state["segments"]) - sum(t["length"] for t in self.state["tombstones"])
        return n, length / n if n else 0.0

    def _tombstone(self, keys: DataFrame) -> list[dict]:
        """Tombstones of the living documents with some keys, written; none if there are no such documents."""
        if not self.state["segments"]:
            return []
        path = self._path("tombstones")
        self.documents().join(keys.select(F.col(keys.columns[0]).alias("key")).distinct(), "key", "left_semi").select("segment", "shard", "place", "dl").write.parquet(path)
        dead = self.spark.read.schema("segment int, shard int, place int, dl long").parquet(path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return [{"path": path, "documents": dead["n"], "length": dead["length"]}] if dead["n"] else []

    def remove(self, keys: DataFrame, batch: str | None = None) -> SegmentedIndex:
        """The index without the documents whose keys are in the first column of ``keys``."""
        return self._commit(self.state | {"tombstones": self.state["tombstones"] + self._tombstone(keys)}, batch)

    def put(self, documents: DataFrame, batch: str | None = None) -> SegmentedIndex:
        """The index with ``documents`` (the key, and the fields), in the place of what it holds of these keys. Keys are unique."""
        key = self.state["key"]
        path = self._path("segment")
        inverted.write(documents, path, key, self.state["weights"], self.state["stem"], BLOCK, SHARD)
        entry = self._entry(path, self.spark.read.parquet(f"{path}/packed"))
        return self._commit(self.state | {"segments": [*self.state["segments"], entry], "tombstones": self.state["tombstones"] + self._tombstone(documents.select(key)), "next": self.state["next"] + 1}, batch)

    def _place(self, documents: DataFrame, path: str) -> None:
        n = documents.count()
        shards = max(-(-n // SHARD), min(self.spark.sparkContext.defaultParallelism, -(-n // 1000)), 1)
        dealt = documents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        dealt.withColumn("place", (F.row_number().over(Window.partitionBy("shard").orderBy("key")) - 1).cast("int")).select("key", F.col("dl").cast("long").alias("dl"), "shard", "place").write.parquet(f"{path}/documents")

    def _blocks(self, rows: DataFrame, path: str) -> dict:
        """The blocks of ``rows (token, shard, place, tf, dl)`` and the tokens of a segment whose documents are written; its entry in the manifest."""
        rows.repartitionByRange("token", "shard").sortWithinPartitions("token", "shard", "place").mapInArrow(_pack, BLOCKS).write.parquet(f"{path}/blocks")
        return self._entry(path, self.spark.read.parquet(f"{path}/blocks"))

    def _entry(self, path: str, blocks: DataFrame) -> dict:
        blocks.filter("token is not null").groupBy("token").agg(F.sum("n").alias("df")).repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/tokens")
        facts = self.spark.read.parquet(f"{path}/documents").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        return {"number": self.state["next"], "path": path, "documents": facts["n"], "length": facts["length"]}

    def merge(self, most: int | None = None, batch: str | None = None) -> SegmentedIndex:
        """The index with its smallest segments (``most`` of them, by default all) as one, without their dead documents."""
        mine = sorted(self.state["segments"], key=lambda s: (s["documents"], s["number"]))[:most]
        numbers = [s["number"] for s in mine]
        if not mine:
            return self
        path = self._path("segment")
        living = self.documents().filter(F.col("segment").isin(numbers))
        self._place(living.select("key", "dl"), path)
        postings = self._read("blocks").filter(F.col("segment").isin(numbers)).select("segment", "shard", "token", "places", "tfs").mapInArrow(_unpacked, "segment int, shard int, token string, place int, tf double")
        kept = postings.join(living.select("segment", "shard", "place", "key"), ["segment", "shard", "place"]).select("key", "token", "tf")
        entry = self._blocks(kept.join(self.spark.read.parquet(f"{path}/documents"), "key").select("token", "shard", "place", "tf", "dl"), path)
        left = self._path("tombstones")
        self.tombstones().filter(~F.col("segment").isin(numbers)).write.parquet(left)
        rest = self.spark.read.schema("segment int, shard int, place int, dl long").parquet(left).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).first()
        state = self.state | {"segments": [s for s in self.state["segments"] if s["number"] not in numbers] + [entry], "next": self.state["next"] + 1}
        return self._commit(state | {"tombstones": [{"path": left, "documents": rest["n"], "length": rest["length"]}] if rest["n"] else []}, batch)

    def search(self, queries: DataFrame, k: int = 10, offset: int = 0, require_all: bool = True, prefix: bool = True) -> DataFrame:
        """``query_id, key, score, rank`` of ``queries (query_id, query)``: a page of documents with all (or any) of the terms."""
        return self.search_counted(queries, k, offset, require_all, prefix)[0]

    def search_counted(self, queries: DataFrame, k: int = 10, offset: int = 0, require_all: bool = True, prefix: bool = True) -> tuple[DataFrame, DataFrame]:
        """The page, and one row ``postings, scored``: the postings of the terms, and how many of them were unpacked for their scores, summed over the queries."""
        key, kind = self.state["key"], queries.schema["query_id"].dataType.simpleString()
        found = None
        if self.state["segments"]:
            blocks = max(1, -(-queries.count() // QUERIES))
            for b in range(blocks):
                mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
                part = self._search_block(mine.select("query_id", "query"), k + offset, require_all, prefix)
                found = part if found is None or part is None else found.unionByName(part)
        if found is None:
            none = self.spark.createDataFrame([], f"query_id {kind}, {key} string, score double, rank int")
            return none, self.spark.createDataFrame([(0, 0)], "postings long, scored long")
        places = self._read("documents").select("segment", "shard", F.col("place").cast("long").alias("place"), "key")
        hits = found.filter("place >= 0").join(places, ["segment", "shard", "place"]).select("query_id", F.col("key").alias("vec_id"), "score")
        return page(hits, k, offset).withColumnRenamed("vec_id", key), found.filter("place < 0").agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored"))

    def _search_block(self, queries: DataFrame, most: int, require_all: bool, prefix: bool) -> DataFrame | None:
        terms = query_terms(queries, prefix)
        if self.state["stem"]:
            from ..functions.stemmer import stemmed

            stems = terms.select("query_id", stemmed(F.col("term")).alias("term"), "is_prefix").distinct()
            terms = stems.join(stems.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id")
        rows = terms.select("query_id", "term", "is_prefix").toArrow().to_pylist()  # of a bounded number of queries
        if not rows:
            return None
        number: dict[tuple, int] = {}
        asked: dict = {}
        for r in rows:
            asked.setdefault(r["query_id"], []).append(number.setdefault((r["term"], r["is_prefix"]), len(number)))
        named = self.spark.createDataFrame([(t, p, i) for (t, p), i in number.items()], "term string, is_prefix boolean, term_no int")
        # A block of queries has a bounded number of terms: they select their blocks where these are read. Both passes below read what was found.
        exact = [t for t, p in number if not p]
        begun = [t for t, p in number if p]
        lengths = sorted({len(t) for t in begun})
        answers = F.filter(_keys(F.col("token"), lengths), lambda k: F.when(k["is_prefix"], k["term"].isin(begun)).otherwise(k["term"].isin(exact)))
        mine = reduce(lambda a, b: a | b, [F.col("token").isin(exact), *(F.substring("token", 1, n).isin([t for t in begun if len(t) == n]) for n in lengths)])
        blocks = self._read("blocks").filter(mine).select("*", F.explode(answers).alias("k")).select("*", "k.term", "k.is_prefix").join(F.broadcast(named), ["term", "is_prefix"])
        looked = self._path("looked-up")
        blocks.withColumn("plain", ~F.col("is_prefix")).select(*(f.split()[0] for f in UNITS.split(", "))).write.option("compression", "zstd").parquet(looked)
        units = self.spark.read.schema(UNITS).parquet(looked)
        dead = self.tombstones().groupBy("segment", "shard").agg(F.sort_array(F.collect_list("place")).alias("p"))  # at most the documents of a shard
        gone = dead.select("segment", "shard", F.lit(-1).alias("term_no"), F.lit(False).alias("plain"), F.size("p").alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0.0).alias("most"), F.lit(0.0).alias("shortest"), F.to_binary(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit("hex")).alias("places"), F.lit(b"").alias("tfs"), F.lit(b"").alias("lengths"))
        dealt = units.unionByName(gone).repartition("segment", "shard").sortWithinPartitions("segment", "shard", "term_no", "first")
        with shuffles_dropped(self.spark):
            df = {r["term_no"]: r["n"] for r in dealt.mapInArrow(_frequencies, "term_no int, n long").groupBy("term_no").agg(F.sum("n").alias("n")).collect()}  # one row for each term of the block
        n, mean = self.counts()
        idf = {t: max(float(np.log((n - d + 0.5) / (d + 0.5))), LEAST_IDF) for t, d in df.items() if d}
        ids = list(asked)
        shared = self.spark.sparkContext.broadcast(([asked[q] for q in ids], idf, mean, most, require_all))
        out = dealt.mapInArrow(_searcher(shared), HITS)
        path = self._path("hits")
        with shuffles_dropped(self.spark):
            out.write.parquet(path)
        out = self.spark.read.schema(HITS).parquet(path)
        names = self.spark.createDataFrame(list(enumerate(ids)), f"query_no long, query_id {queries.schema['query_id'].dataType.simpleString()}")
        return out.join(names, "query_no", "left").select("query_id", "segment", "shard", "place", "score", "scored", "postings")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, tfs = batch.column("places").to_pylist(), batch.column("tfs").to_pylist()
        row = pa.array(np.repeat(np.arange(len(places)), [len(p) // 4 for p in places]))
        columns = [batch.column(c).take(row) for c in ("segment", "shard", "token")]
        yield pa.record_batch([*columns, pa.array(np.frombuffer(b"".join(places), dtype="<i4")), pa.array(np.frombuffer(b"".join(tfs), dtype="<f8"))], names=["segment", "shard", "token", "place", "tf"])


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, dict[int, list[dict]]]]:
    """Of each segment and shard: its dead places, and the blocks of each term in order."""
    key, dead, terms = None, np.zeros(0, dtype=np.int64), {}
    for batch in batches:
        for row in batch.to_pylist():
            if (now := (row["segment"], row["shard"])) != key:
                if key is not None:
                    yield key, dead, terms
                key, dead, terms = now, np.zeros(0, dtype=np.int64), {}
            if row["term_no"] < 0:
                dead = np.frombuffer(row["places"], dtype=">i4").astype(np.int64)
            else:
                terms.setdefault(row["term_no"], []).append(row)
    if key is not None:
        yield key, dead, terms


class Term:
    """The postings of a term in a shard: blocks with bounds; a block is unpacked when it is asked for."""

    def __init__(self, rows: list[dict], dead: np.ndarray):
        self.rows, self.dead, self.held = rows, dead, {}
        if not rows[0]["plain"]:  # a beginning: the lists of its tokens become one
            places, tfs, lengths = (np.concatenate([np.frombuffer(r[c], dtype=k) for r in rows]) for c, k in (("places", "<i4"), ("tfs", "<f8"), ("lengths", "<f8")))
            places, first, inverse = np.unique(places, return_index=True, return_inverse=True)
            tf, dl = np.bincount(inverse, weights=tfs), lengths[first]
            cut = np.arange(0, len(places), BLOCK)
            self.held = {i: (places[a : a + BLOCK].astype(np.int64), tf[a : a + BLOCK], dl[a : a + BLOCK]) for i, a in enumerate(cut)}
            self.rows = [{"n": len(p), "first": int(p[0]), "last": int(p[-1]), "most": t.max(), "shortest": d.min()} for p, t, d in self.held.values()]
        self.first, self.last, self.most, self.shortest = (np.array([r[c] for r in self.rows]) for c in ("first", "last", "most", "shortest"))
        self.n = sum(r["n"] for r in self.rows)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.held:
            r = self.rows[i]
            self.held[i] = (np.frombuffer(r["places"], dtype="<i4").astype(np.int64), np.frombuffer(r["tfs"], dtype="<f8"), np.frombuffer(r["lengths"], dtype="<f8"))
        return self.held[i]

    def living(self) -> int:
        """Documents of the term that aren't dead."""
        if not len(self.dead):
            return self.n
        return self.n - sum(int(np.isin(self.block(i)[0], self.dead, assume_unique=True).sum()) for i in range(len(self.rows)) if np.searchsorted(self.dead, self.first[i]) < np.searchsorted(self.dead, self.last[i], "right"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for _, dead, terms in _by_unit(batches):
        for t, rows in terms.items():
            total[t] = total.get(t, 0) + Term(rows, dead).living()
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["term_no", "n"])


def best_places(terms: list[Term], idf: list[float], mean: float, most: int, require_all: bool, dead: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """The places and scores of the best documents, and the number of postings that were scored. Intervals between the bounds of blocks are taken in order of the most that they could give; those that
    can't reach ``floor``, or the page, or could only tie with its last document from places behind it, are left out.
    """
    bounds = np.unique(np.concatenate([np.concatenate([t.first, t.last + 1]) for t in terms]))
    block, most_of = np.empty((len(terms), len(bounds)), dtype=np.int64), np.zeros((len(terms), len(bounds)))
    for i, t in enumerate(terms):
        at = np.searchsorted(t.first, bounds, "right") - 1
        inside = (at >= 0) & (t.last[np.maximum(at, 0)] >= bounds)
        block[i] = np.where(inside, at, -1)
        most_of[i] = np.where(inside, part_of(idf[i], t.most, t.shortest, mean)[np.maximum(at, 0)], 0)
    total = most_of.sum(axis=0)
    usable = (block >= 0).all(axis=0) if require_all else (block >= 0).any(axis=0)
    order = np.flatnonzero(usable)[np.argsort(-total[usable], kind="stable")]
    places, scores, scored = np.zeros(0, dtype=np.int64), np.zeros(0), 0
    step, at = 4, 0
    while at < len(order):
        some = order[at : at + step]
        at, step = at + step, step * 2
        could = np.round(total[some] + 1e-12, 9)
        reach = could >= np.round(floor, 9)
        if len(scores) >= most:
            last = np.round(scores[-1], 9)
            reach &= (could > last) | (could == last) & (bounds[some] < places[-1])
            if could[0] < last:
                break
        some = some[reach]
        if not len(some):
            continue
        found, parts = [], []
        for i, t in enumerate(terms):
            for s in some:
                if (b := block[i, s]) >= 0:
                    p, tf, dl = t.block(b)
                    low, high = np.searchsorted(p, bounds[s]), np.searchsorted(p, bounds[s + 1]) if s + 1 < len(bounds) else len(p)
                    found.append(p[low:high])
                    parts.append(part_of(idf[i], tf[low:high], dl[low:high], mean))
                    scored += high - low
        p, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        s = np.bincount(inverse, weights=np.concatenate(parts), minlength=len(p))
        keep = counts == len(terms) if require_all else counts > 0
        if len(dead):
            keep &= ~np.isin(p, dead, assume_unique=True)
        places, scores = np.concatenate([places, p[keep]]), np.concatenate([scores, s[keep]])
        best = np.lexsort((places, -np.round(scores, 9)))[:most]
        places, scores = places[best], scores[best]
    return places, scores, scored


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, mean, most, require_all = shared.value
        names = [f.split()[0] for f in HITS.split(", ")]
        tops = [np.zeros(0)] * len(queries)  # the best scores of the task's shards so far
        for (segment, shard), dead, rows in _by_unit(batches):
            terms = {t: Term(r, dead) for t, r in rows.items() if t in idf}
            out: list[list] = [[] for _ in range(5)]
            postings = scored = 0
            for q, own in enumerate(queries):
                mine = [t for t in own if t in terms]
                if not mine or require_all and len(mine) < len(own):
                    continue
                places, scores, n = best_places([terms[t] for t in mine], [idf[t] for t in mine], mean, most, require_all, dead, tops[q][0] if len(tops[q]) >= most else -np.inf)
                tops[q] = np.sort(np.concatenate([tops[q], scores]))[-most:]
                postings, scored = postings + sum(terms[t].n for t in mine), scored + n
                for c, x in zip(out, ([q] * len(places), places, scores)):
                    c.extend(x)
            n = len(out[0]) + 1
            columns = [[*out[0], -1], [segment] * n, [shard] * n, [*out[1], -1], [*out[2], 0.0], [0] * (n - 1) + [scored], [0] * (n - 1) + [postings]]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=names)

    return run
