"""Near-duplicates by a join of MinHash signatures over an inverted index of their coordinates.

A document is the set of its word n-grams (A-Z lower-cased, words between ASCII white space; fewer words than n make one n-gram). Documents with equal sets are one node. A node is posted under its coordinate-value pairs, but only under a
prefix of them: the pairs in order of their frequency, rarest first, without the last ``matches - 1``. Two signatures that agree in ``matches`` coordinates share a pair of their prefixes, so lists of frequent pairs are skipped and no
collision is lost. In each list collisions are counted over whole signatures; members that are merged already are skipped. Pairs with enough collisions make candidate components, whose texts are compared as whole sets.

With 64 coordinates and 40 matches a pair of similarity 0.85 is missed with a probability of 2.4e-6. Frequencies are counted over all nodes; pairs that no task meets twice count as rare. They decide which lists are read, not what is found.

Null texts and texts without words have an empty set, are linked with nothing, and are their own component. A null doc_id keeps its row, and is a component's id only where no member has another; repeated rows are documents of their
own with equal sets. An empty table gives no rows. Other columns are not looked at. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, stored
from .components import components
from .grouped import group_links
from .ngram_join import _words, identity, shingles
from .similar import is_wanted, mix, wanted_map

FACTS = "doc_id long, one long, two long, n_shingles long, low long, high long, signature binary, brief binary"
#: Coordinate-value pairs whose frequencies are broadcast at most, and the least frequency that counts.
FREQUENT, LEAST = 100_000, 64
#: Signatures of a list, and sets and their members of a component, that are compared in one piece.
LIST_ROWS, SET_ROWS, SET_SIZE = 4096, 512, 1 << 20


def sets_of(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    return shingles([t.lower() if t else None for t in texts], n)


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their last column, a text, as bytes."""
    for b in batches:
        yield pa.record_batch([*b.columns[:-1], b.columns[-1].cast(pa.binary())], names=b.schema.names)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of 32-bit values for each set; sets aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    out = np.empty((len(sets), coordinates), dtype="<u4")
    for c, a in enumerate(seeds):
        h = (flat ^ a) * (a | np.uint64(1))
        out[:, c] = mix(np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)) & np.uint64(0xFFFFFFFF)
    return out


def pairs_of(payloads: pa.Array) -> np.ndarray:
    """Coordinate-value pairs of signatures, as 64-bit numbers."""
    values = np.frombuffer(b"".join(payloads.to_pylist()), dtype="<u4").reshape(len(payloads), -1)
    return values.astype(np.int64) | np.arange(values.shape[1], dtype=np.int64)[None, :] << 32


def _facts(n: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_words)
        for ids, ones, twos, texts in slices(_bytes(batches), 3, limit=1 << 19):
            sets = sets_of(texts, n)
            worded = [i for i, s in enumerate(sets) if len(s)]
            marks = np.full((len(sets), 2), 0, dtype="<i8")
            payloads: list[bytes | None] = [None] * len(sets)
            briefs: list[bytes | None] = [None] * len(sets)
            if worded:
                for i, row in zip(worded, signatures([sets[i] for i in worded], coordinates)):
                    marks[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), dtype="<i8")
                    payloads[i] = row.tobytes()
                    briefs[i] = row.astype(np.uint8).tobytes()
            empty = np.array([p is None for p in payloads], dtype=bool)
            marks[empty, 0] = np.array(ones, dtype=np.int64)[empty]  # they match nothing, and are dealt out all the same
            columns = [pa.array(ids, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.record_batch([*columns, pa.array(marks[:, 0]), pa.array(marks[:, 1], mask=empty), pa.array(payloads, pa.binary()), pa.array(briefs, pa.binary())], names=[f.split()[0] for f in FACTS.split(", ")])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts > 1
        return pa.record_batch([pa.array(keys[often]), pa.array(counts[often].astype(np.int64))], names=["key", "n"])

    for b in batches:
        held.append(pairs_of(b.column(0)).ravel())
        size += len(held[-1])
        if size > 1 << 20:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def frequent_pairs(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent coordinate-value pairs, sorted, and their frequencies: of x postings at most x / least pairs, hence no more than FREQUENT."""
    total = nodes.agg(F.coalesce(F.sum(F.octet_length("signature")), F.lit(0))).first()[0] // 4
    least = max(LEAST, -(-total // FREQUENT))
    rows = nodes.select("signature").mapInArrow(_frequencies, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy("key").toArrow()
    return rows.column("key").to_numpy(), rows.column("n").to_numpy()


def _prefixes(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                keys = pairs_of(b.column(1))
                times = np.zeros(keys.shape, dtype=np.int64)
                if len(often):
                    place = np.minimum(np.searchsorted(often, keys), len(often) - 1)
                    times = np.where(often[place] == keys, counts[place], 0)
                order = np.lexsort((mix(keys.view(np.uint64)), times), axis=1)[:, :length]
                nodes = np.repeat(b.column(0).to_numpy(), order.shape[1])
                yield pa.record_batch([pa.array(np.take_along_axis(keys, order, 1).ravel()), pa.array(nodes)], names=["key", "node"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has another row."""
    key, node, again = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False

    def some(k, n, keep):
        return pa.record_batch([pa.array(k[keep]), pa.array(n[keep])], names=["group", "node"])

    for b in batches:
        if not b.num_rows:
            continue
        k, n = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([node, b.column(1).to_numpy()])
        same = k[1:] == k[:-1]
        before = np.concatenate([[again], same])
        yield some(k[:-1], n[:-1], before[:-1] | same)
        key, node, again = k[-1:], n[-1:], bool(before[-1])
    if again:
        yield some(key, node, slice(None))


def collided(matches: int):
    """Counts collisions in the low bytes of signatures: never fewer than there are, and few more."""

    def compare(payloads: list[bytes]):
        m = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(len(payloads), -1)
        return lambda i, js: (m[js] == m[i]).sum(axis=1) >= matches

    return compare


def alike_sets(n: int, percent: int):
    def compare(texts: list[bytes]):
        sets = []
        for at in range(0, len(texts), 64):
            sets += sets_of(texts[at : at + 64], n)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        values, columns = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), dtype=bool)

        def alike(i: int, js: np.ndarray) -> np.ndarray:
            mine, other = sizes[i], sizes[js]
            out = 100 * np.minimum(mine, other) >= percent * np.maximum(mine, other)
            if out.any():
                own = columns[starts[i] : starts[i] + mine]
                mark[own] = True
                other, first = other[out], np.cumsum(other[out]) - other[out]
                common = np.add.reduceat(mark[columns[np.repeat(starts[js[out]] - first, other) + np.arange(other.sum())]], first, dtype=np.int64)
                mark[own] = False
                out[out] = 100 * common >= percent * (mine + other - common)
            return out

        return alike

    return compare


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85, coordinates: int = 64, matches: int = 40) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked where their sets share at least ``percent`` of their union; the component's id is its least doc_id, and that document is kept."""
    spark = docs.sparkSession
    one, two = identity()
    texts = docs.select("doc_id", one.alias("one"), two.alias("two"), "text")
    facts = stored(texts.mapInArrow(_facts(n, coordinates), FACTS), "facts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "one", "two")).alias("first")
    distinct = facts.filter("signature is not null").groupBy("low", "high").agg(first, F.any_value("signature").alias("signature"), F.any_value("brief").alias("brief"))
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "low", "high", "first", "signature", "brief"), "nodes")

    shared = spark.sparkContext.broadcast(frequent_pairs(nodes))
    postings = nodes.select("node", "signature").mapInArrow(_prefixes(shared, coordinates - matches + 1), "key long, node long")
    lists = postings.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_keys, "group long, node long")
    lists = stored(lists.join(nodes.select("node", "brief"), "node").select("group", "node", F.lit(1).alias("size"), F.col("brief").alias("payload")), "lists")
    near = stored(components(group_links(lists, collided(matches), LIST_ROWS, LIST_ROWS)), "candidates")

    source = lambda: F.xxhash64("doc_id", "one", "two")
    asked = stored(near.join(nodes.select("node", "first.*"), "node").select("node", F.col("root").alias("group"), source().alias("source"), "one", "two"), "asked")
    wanted = wanted_map(asked.select(F.col("source").alias("node")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(is_wanted(wanted.value, b.column(0).to_numpy())))

    # Of equal texts those of the first id are fetched, hence few; the join drops what only shares a bit.
    fetched = texts.select(source().alias("source"), "one", "two", F.col("text").cast("binary").alias("payload")).mapInArrow(fetch, "source long, one long, two long, payload binary")
    members = stored(fetched.join(asked, ["source", "one", "two"]).select("group", "node", (F.octet_length("payload") / 5).cast("long").alias("size"), "payload"), "members")
    same = stored(components(group_links(members, alike_sets(n, percent), SET_ROWS, SET_SIZE, (_words,))), "classes")

    rooted = nodes.select("node", "low", "high", F.col("first.doc_id").alias("first_id")).join(same, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = stored(rooted.join(least, "root").select("low", "high", "component_id"), "component-ids")
    return facts.select("doc_id", "n_shingles", "low", "high").join(known, ["low", "high"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
