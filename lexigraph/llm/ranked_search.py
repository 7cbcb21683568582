"""Ranked lexical search with Fagin's threshold algorithm: the k best documents of every item.

Texts are read once for a block of items: a document's row in the forward index holds its length and its counts of the items' terms. Statistics (documents, terms, document frequencies) are sums over all rows of it.
Then each task turns its share of the forward index into runs of documents with, for each term, a list sorted by falling impact. For an item it goes down all its lists in turn, looks the documents that it meets up in the forward
index for their full score, and stops when the sum of the impacts at its depth, which no unseen document can exceed, is strictly below the k-th score; equal scores are thus all seen, and ties go to the smaller id.
The k best so far are carried from run to run, so later runs often stop at their first entries. The tasks' lists are merged in two levels.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Null texts and texts without terms are in no result. A null doc_id is ranked behind equal scores; repeated rows are ranked each.
Equal items (id and text) are one; texts that share an id are ranked apart. Items without terms, or whose terms no document holds, give no rows, and so do empty tables. Other columns are not looked at. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, slices, stored
from .decontaminate import _batches as item_batches

#: Byte by byte: what belongs to no term becomes a space, capitals become small.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
FORWARD = "doc_id long, n long, terms binary, tfs binary"
RANKED = "part int, item_no long, item_id long, doc_id long, score long"
#: Postings of one run of documents, and entries of each list that are read at first.
RUN_POSTINGS, FIRST_DEPTH = 1 << 20, 32
FAN = 64


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def forward_index(docs: DataFrame, shared) -> DataFrame:
    """Of each document with a term: its length, and the numbers and counts of the terms in the broadcast dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        number = shared.value
        for ids, texts in slices((pa.record_batch([b.column(0), b.column(1).cast(pa.binary())], names=["d", "t"]) for b in batches), 1, limit=1 << 22):
            split = [terms_of(t) if t else [] for t in texts]
            found = [np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int64, count=len(words)) for words in split]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            owner, flat = owner[flat >= 0], flat[flat >= 0]
            keys, tfs = np.unique(owner << 32 | flat, return_counts=True)
            bounds = np.searchsorted(keys >> 32, np.arange(len(found) + 1))
            terms, tfs = (keys & 0xFFFFFFFF).astype("<u4"), tfs.astype("<u4")
            rows = [(d, len(words), terms[i:j].tobytes(), tfs[i:j].tobytes()) for d, words, i, j in zip(ids, split, bounds, bounds[1:]) if words]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FORWARD)


def statistics(forward: DataFrame) -> dict[int, int]:
    """Document frequencies by term number; at -1 the documents, at -2 all their terms. One row for each term of the dictionary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("terms").to_pylist()), dtype="<u4")
            for t, c in zip(*(x.tolist() for x in np.unique(flat, return_counts=True))):
                held[t] = held.get(t, 0) + c
            held[-1] = held.get(-1, 0) + b.num_rows
            held[-2] = held.get(-2, 0) + int(np.sum(b.column("n").to_numpy()))
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    return {r["term"]: r["n"] for r in forward.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def weight(documents: int, df: int) -> int:
    return floor(1000 * log((2 * documents + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence list adds to a score, in whole numbers."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Run:
    """Some documents: a forward index by document, and lists by term, sorted by falling impact and then by document."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int):
        order = np.lexsort((ids, nameless))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        owner = place[np.repeat(np.arange(len(ids)), sizes)]
        by_doc = np.argsort(owner, kind="stable")
        self.ids, self.nameless = ids[order], nameless[order]
        self.owner, self.terms = owner[by_doc], terms[by_doc].astype(np.int64)
        m = 75 + (25 * n[order] * documents) // total
        self.impact = impacts(weights[self.terms], tfs[by_doc].astype(np.int64), m[self.owner])
        self.bounds = np.searchsorted(self.owner, np.arange(len(ids) + 1))
        ranked = np.lexsort((self.owner, -self.impact, self.terms))
        self.listed, self.listed_impact = self.owner[ranked], self.impact[ranked]
        self.starts = np.searchsorted(self.terms[ranked], np.arange(len(weights) + 1))
        self.seen = np.zeros(len(ids), dtype=bool)

    def scores(self, documents: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Full scores, looked up in the forward index; ``counts`` holds how often the item has each term."""
        begin, size = self.bounds[documents], self.bounds[documents + 1] - self.bounds[documents]
        first = np.cumsum(size) - size
        at = np.repeat(begin - first, size) + np.arange(size.sum())
        return np.add.reduceat(counts[self.terms[at]] * self.impact[at], first)

    def search(self, terms: np.ndarray, times: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, ...], k: int) -> tuple[tuple[np.ndarray, ...], int]:
        """The best of ``top (score, nameless, id)`` and of this run, best first; and the depth reached in the lists."""
        begins, ends = self.starts[terms], self.starts[terms + 1]
        depth, step = 0, FIRST_DEPTH
        self.seen[:] = False
        while True:
            here = begins + depth
            open_ = here < ends
            if not open_.any():
                break
            if len(top[0]) == k and int(np.sum(times[open_] * self.listed_impact[here[open_]])) < top[0][-1]:
                break
            met = np.unique(np.concatenate([self.listed[a : min(a + step, b)] for a, b in zip(here[open_], ends[open_])]))
            met = met[~self.seen[met]]
            self.seen[met] = True
            depth, step = depth + step, step * 2
            if len(met):
                score = self.scores(met, counts)
                good = score > 0 if len(top[0]) < k else score >= max(1, top[0][-1])
                both = [np.concatenate(x) for x in zip(top, (score[good], self.nameless[met[good]], self.ids[met[good]]))]
                best = np.lexsort((both[2], both[1], -both[0]))[:k]
                top = tuple(x[best] for x in both)
        return top, depth


def _searcher(shared, k: int, batch: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        items, weights, documents, total = shared.value
        tops = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))] * len(items)
        counts = np.zeros(len(weights), dtype=np.int64)
        held, size = [], 0

        def search() -> None:
            ids = np.concatenate([h[0] for h in held])
            n, sizes, terms, tfs = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5))
            mine = Run(ids, np.concatenate([h[1] for h in held]), n, sizes, terms, tfs, weights, documents, total)
            for i, (_, own, times) in enumerate(items):
                counts[own] = times
                tops[i], _ = mine.search(own, times, counts, tops[i], k)
                counts[own] = 0

        for record in parts:
            for at in range(0, record.num_rows, 2048):
                b = record.slice(at, 2048)
                terms = b.column("terms").to_pylist()
                sizes = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms)) // 4
                ids = b.column("doc_id")
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column("n").to_numpy(), sizes, np.frombuffer(b"".join(terms), dtype="<u4"), np.frombuffer(b"".join(b.column("tfs").to_pylist()), dtype="<u4")))
                size += int(sizes.sum()) + len(sizes)
                if size >= RUN_POSTINGS:
                    search()
                    held, size = [], 0
        if held:
            search()
        part = TaskContext.get().partitionId()
        for i, (score, nameless, ids) in enumerate(tops):
            if len(score):
                same = np.ones(len(score), dtype=np.int64)
                columns = [pa.array((same * part).astype(np.int32)), pa.array(same * (batch << 32 | i)), pa.array([items[i][0]] * len(score), pa.int64()), pa.array(ids, mask=nameless), pa.array(score)]
                yield pa.record_batch(columns, names=["part", "item_no", "item_id", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of ``docs (doc_id, text)`` for each of ``items (item_id, text)``, with scores above 0.

    Items go to the tasks in blocks of bounded size, and documents are read once for each block.
    """
    spark = docs.sparkSession
    lists = spark.createDataFrame([], RANKED)
    for b, block in enumerate(item_batches(items)):
        number: dict[bytes, int] = {}
        known = []
        for item_id, text in block:
            terms = terms_of(text.encode("utf-8", "surrogatepass"))
            own, times = np.unique(np.array([number.setdefault(t, len(number)) for t in terms], dtype=np.int64), return_counts=True)
            if len(own):
                known.append((item_id, own, times))
        if not known:
            continue
        forward = stored(forward_index(docs, spark.sparkContext.broadcast(number)), "forward-index")
        facts = statistics(forward)
        documents = facts.get(-1, 0)
        weights = np.array([weight(documents, facts.get(t, 0)) for t in range(len(number))], dtype=np.int64)
        shared = spark.sparkContext.broadcast((known, weights, documents, max(facts.get(-2, 0), 1)))
        lists = lists.unionByName(forward.mapInArrow(_searcher(shared, k, b), RANKED))
    for by in (["item_no", F.col("part") % FAN], ["item_no"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
