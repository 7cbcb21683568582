"""Content-addressed token store.

Documents become streams of token ids with an end id. A rolling hash over the last 32 ids cuts each stream into
chunks, so equal passages give equal chunks wherever they stand. A chunk's address is a digest of its ids; each distinct chunk
is stored once. A document's recipe lists the addresses and lengths of its chunks, and its Merkle root; recipes are
written in ascending ``doc_id`` order, and a manifest holds a Merkle root of each recipe part and of the whole. Files, all Parquet:

* ``parts/kind=chunk`` (address, width, ids): the unique chunks, ids as little-endian integers of 2 or 4 bytes;
* ``recipes`` (part, row, doc_id, row_key, start, n_tokens, root, chunks): one row per document, start counted within its part;
* ``manifest`` (part, documents, tokens, first, root): one row per part, and part -1 over all.

Tokens are made once and chunk bytes cross the network once, after each task has dropped the chunks it has already sent.

A null text is an empty one (only the end id). Repeated rows are stored as separate documents with one set of chunks; rows with equal ids are ordered by
a digest of the text. Null ids come first. An empty table gives an empty store. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, slices
from .tokens import encoder

#: Cut sizes in ids: a cut is made where the hash allows one, at least LEAST and at most MOST ids after the last.
LEAST, MEAN_BITS, MOST = 128, 10, 8192
DIGEST = 16

PARTS = "kind string, slot long, address binary, width int, ids binary, doc_id long, row_key long, n_tokens long, root binary, addresses binary, lengths binary"
RECIPES = "part int, row long, doc_id long, row_key long, start long, n_tokens long, root binary, addresses binary, lengths binary"
MANIFEST = "part int, documents long, tokens long, first long, root binary"


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    span = 1
    while span < 32:  # after each step, h sums the last 2 * span ids, each shifted by its age
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    places = np.flatnonzero(h >> np.uint64(64 - MEAN_BITS) == 0) + 1
    ends, last = [], 0
    for p in [*places.tolist(), len(ids)]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == len(ids) and p > last:
            ends.append(p)
            last = p
    return ends


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.tobytes(), digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up unpaired."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=DIGEST).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


class Roots:
    """The same root as ``merkle``, of leaves that come one by one: it holds one node for each level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=DIGEST).digest()
        while self.nodes and self.nodes[-1][0] == height:
            node = hashlib.blake2b(b"\1" + self.nodes.pop()[1] + node, digest_size=DIGEST).digest()
            height += 1
        self.nodes.append((height, node))

    def root(self) -> bytes:
        if not self.nodes:
            return merkle([])
        node = self.nodes[-1][1]
        for _, left in self.nodes[-2::-1]:
            node = hashlib.blake2b(b"\1" + left + node, digest_size=DIGEST).digest()
        return node


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 registers after so many zero bytes more: crc32(a + b) = crc_shift(crc32(a), len(b)) ^ crc32(b)."""
    crc = crc.astype(np.uint32)
    zeros = zeros.astype(np.int64).copy()
    rows = np.array([1 << i for i in range(32)], dtype=np.uint32)  # images of single bits after one zero byte
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1).astype(np.uint32)
    while zeros.any():
        odd = zeros & 1 == 1
        if odd.any():
            crc[odd] = _apply(rows, crc[odd])
        rows = _apply(rows, rows)
        zeros >>= 1
    return crc


def _apply(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & np.uint32(1), rows[i], np.uint32(0))
    return out


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Encode ``docs (doc_id, text)`` and write a store to ``path``."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([end_id], dtype="<u4")
        sent: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40  # recipes are dealt out by number, so copies of a text don't meet in one task
        for ids, texts, keys in slices(batches, 1):
            rows: list[tuple] = []
            for doc, key, stream in zip(ids, keys, encode(texts)):
                stream = np.concatenate([stream, end])
                addresses, lengths, last = [], [], 0
                for e in cuts(stream):
                    chunk = stream[last:e]
                    addresses.append(a := address(chunk))
                    lengths.append(e - last)
                    last = e
                    if a not in sent:
                        sent.add(a)
                        width = 2 if chunk.max() < 1 << 16 else 4
                        rows.append(("chunk", int.from_bytes(a[:7], "little"), a, width, chunk.astype(f"<u{width}").tobytes(), None, None, None, None, None, None))
                row += 1
                rows.append(("recipe", row, None, None, None, doc, key, len(stream), merkle(addresses), b"".join(addresses), np.array(lengths, dtype="<u4").tobytes()))
            if len(sent) > 1 << 20:
                sent.clear()
            yield _batch(rows, PARTS)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[bytes] = set()
        for batch in batches:
            keep = []
            for a in batch.column(2).to_pylist():
                keep.append(a is None or a not in stored)
                if a is not None:
                    stored.add(a)
            yield batch.filter(pa.array(keep, pa.bool_()))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    made = keyed.mapInArrow(run, PARTS).repartition("slot").mapInArrow(unique, PARTS)
    made.drop("slot").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            starts = start + np.cumsum(n) - n
            columns = [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(np.arange(row, row + len(n))), batch.column(0), batch.column(1), pa.array(starts)]
            yield pa.record_batch([*columns, *batch.columns[2:]], names=[f.split()[0] for f in RECIPES.split(", ")])
            row += len(n)
            start += int(n.sum())

    recipes = _read(spark, path, "recipe").select("doc_id", "row_key", "n_tokens", "root", "addresses", "lengths")
    ordered = recipes.repartitionByRange(F.col("doc_id"), F.col("row_key")).sortWithinPartitions("doc_id", "row_key")
    ordered.mapInArrow(numbered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = ", ".join(f for f in PARTS.split(", ") if not f.startswith("slot"))
    return spark.read.schema(schema).parquet(f"{path}/parts").filter(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per recipe part, from the recipes as written; then part -1, over the parts' roots."""

    def part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, n, root in zip(*(c.to_pylist() for c in batch.columns)):
                p = parts.setdefault(part, [0, 0, Roots()])
                p[0] += 1
                p[1] += n
                p[2].add(root)
        yield _batch([(part, d, n, 0, r.root()) for part, (d, n, r) in parts.items()], MANIFEST)

    rows = _recipes(spark, path).select("part", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "row")
    parts = sorted(rows.select("part", "n_tokens", "root").mapInArrow(part_roots, MANIFEST).collect())  # as many rows as parts
    out, first = [], 0
    for part, documents, tokens, _, root in parts:
        out.append((part, documents, tokens, first, bytes(root)))
        first += tokens
    out.append((-1, sum(p[1] for p in parts), first, 0, merkle([bytes(p[4]) for p in parts])))
    return spark.createDataFrame(out, MANIFEST)


FACTS = "address binary, n long, crc long"


def _chunk_facts(spark: SparkSession, path: str) -> DataFrame:
    """Address, length and checksum of each stored chunk, from its bytes; a chunk that isn't what its address says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                if address(ids) != a:
                    raise ValueError(f"chunk {a.hex()} is damaged")
                rows.append((a, len(ids), zlib.crc32(ids.tobytes())))
            yield _batch(rows, FACTS)

    return _read(spark, path, "chunk").select("address", "width", "ids").mapInArrow(run, FACTS)


def verify(spark: SparkSession, path: str) -> None:
    """Compare the manifest with one made anew from the recipes; a difference is an error."""
    written = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    if written != sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in _manifest(spark, path).collect()):
        raise ValueError(f"the manifest of {path} does not match its recipes")


ENTRIES = "part int, row long, address binary, length long, tail long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_chunks, root``: each document as its files say, in no order.

    Each chunk's checksum comes from its stored bytes; a document's is theirs, combined in the order of its recipe. Missing chunks, lengths that differ
    and roots that don't fit the addresses are errors.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for part, row, n, root, addresses, lengths in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    lengths = np.frombuffer(lengths, dtype="<u4").astype(np.int64)
                    leaves = [addresses[i : i + DIGEST] for i in range(0, len(addresses), DIGEST)]
                    if merkle(leaves) != root or int(lengths.sum()) != n:
                        raise ValueError(f"recipe {row} of part {part} is damaged")
                    rows += zip([part] * len(leaves), [row] * len(leaves), leaves, lengths.tolist(), (4 * (n - np.cumsum(lengths))).tolist())
                yield _batch(rows, ENTRIES)

    @F.pandas_udf("long")
    def shifted(crc, zeros):
        import pandas as pd

        return pd.Series(crc_shift(crc.to_numpy(), zeros.to_numpy()).astype(np.int64))

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", "first")
    recipes = _recipes(spark, path)
    listed = recipes.select("part", "row", "n_tokens", "root", "addresses", "lengths").mapInArrow(entries, ENTRIES)
    facts = _chunk_facts(spark, path).select("address", F.col("n").alias("stored"), "crc")
    pieces = listed.join(facts, "address", "left").withColumn(
        "crc", F.when(F.col("stored") == F.col("length"), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")))
    )
    whole = pieces.groupBy("part", "row").agg(F.bit_xor(shifted_col(shifted)).alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks"))
    heads = recipes.select("part", "row", "doc_id", "start", "n_tokens", "root")
    return (
        heads.join(whole, ["part", "row"])
        .join(F.broadcast(manifest), "part")  # as many rows as recipe parts
        .select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "n_chunks", "root")
    )


def shifted_col(udf):
    return udf(F.col("crc"), F.col("tail"))


def reconstruct(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents, from their recipes and chunks."""
    rows = _recipes(spark, path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "addresses").collect()
    wanted = {bytes(r[1][i : i + DIGEST]) for r in rows for i in range(0, len(r[1]), DIGEST)}
    chunks = _read(spark, path, "chunk").filter(F.col("address").isin(sorted(wanted))).select("address", "width", "ids").collect()
    ids = {bytes(a): np.frombuffer(raw, dtype=f"<u{w}").astype("<u4") for a, w, raw in chunks}
    return {r[0]: np.concatenate([ids[bytes(r[1][i : i + DIGEST])] for i in range(0, len(r[1]), DIGEST)]) for r in rows}


def token_store(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write a store of ``docs`` (under the shared folder, unless ``path`` is given), verify it and read it back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-store")
    write(docs, vocabulary, path, end_id)
    verify(spark, path)
    return read(spark, path)
