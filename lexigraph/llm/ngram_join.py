"""N-gram Jaccard self-join of documents with a MinHash LSH forest.

A document is the set of its word n-grams (words are split at white space; fewer words than n make one n-gram of all). Each tree of the forest reads the document's
MinHash values, one byte of each level, as a label; sorted labels are a prefix trie. Every document walks up the tries from whole labels, and whoever agrees with it in the
prefix is a candidate. It shortens the prefix until partners of the least similarity that a set of its size can have, at or above the threshold, are met in some tree with the
target recall: small sets stop early, as few of their possible similarities are near the threshold. All pairs of the candidate components are then verified exactly.

Equal texts (by 128 bits of hash) are one node and count as linked documents. Null texts and texts without words are linked with nothing, and are their own class. Repeated rows are separate documents.
A null ``doc_id`` keeps its row; classes take the least id. An empty table gives no rows. Other columns of the input are not looked at. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, only, slices, stored, unused
from .similar import KEYS, Sender, candidate_links, classes, is_wanted, mix, slots_of, verified, wanted_map
from .components import components

#: Most labels that a tree can hold in 64 bits beside its number.
LEVELS = 7


def identity() -> tuple[Column, Column]:
    """Two hashes of the text, from different seeds."""
    return F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))


class _Words(dict):
    """Hashes of words; dropped when there are too many, and long words are not held."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()
CACHES.append(_words)


def shingles(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Of each text, the sorted hashes of its distinct word n-grams."""
    if len(_words) > 300_000:
        _words.clear()
    out = []
    for t in texts:
        words = t.split() if t else []
        h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(n, len(h))
        if k:
            s = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for i in range(k):
                s = s * np.uint64(0x9E3779B97F4A7C15) + mix(h[i : len(h) - k + 1 + i])
            h = np.unique(mix(s + np.uint64(k)))
        out.append(h)
    return out


def prefix_length(trees: int, threshold: float, recall: float, longest: int = LEVELS) -> int:
    """Levels that must agree: shortened from the longest prefix until pairs at the threshold are found with the target recall."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


@lru_cache(maxsize=1 << 16)
def least_similarity(size: int, threshold: float) -> float:
    """The least Jaccard similarity at or above the threshold that a set of ``size`` members can have with any set."""
    common = np.arange(np.ceil(threshold * size - 1e-9), size + 1)
    other = np.floor(common / threshold + common - size + 1e-9)
    return float(np.min(common / (size + other - common)))


@lru_cache(maxsize=1 << 16)
def stop_of(size: int, trees: int, threshold: float, recall: float) -> int:
    """Bits of the prefix at which a set of ``size`` members ends its walk."""
    return 8 + 8 * prefix_length(trees, least_similarity(size, threshold), recall)


def labels(sets: list[np.ndarray], trees: int, levels: int = LEVELS) -> np.ndarray:
    """Trie labels, one row per set and one column per tree: the tree's number, then one byte of each MinHash value."""
    out = np.zeros((len(sets), trees), dtype=np.uint64)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, trees * levels + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for t in range(trees):
        label = np.full(len(sets), t, dtype=np.uint64)
        for level in range(levels):
            a = seeds[t * levels + level]
            h = (flat ^ a) * (a | np.uint64(1))
            least = np.minimum.reduceat(h ^ (h >> np.uint64(32)), starts)
            label = label << np.uint64(8) | mix(least) & np.uint64(255)
        out[:, t] = label << np.uint64(8 * (LEVELS - levels))
    return out


def text_facts(docs: DataFrame, n: int, threshold: float, trees: int, recall: float) -> DataFrame:
    """One row per distinct text: ``hash`` and ``check``, ``node`` (its number), whether it has words, its copies, links and first id, and the first id and text of its class (``head``)."""
    lengths = tuple(8 + 8 * n for n in range(LEVELS, prefix_length(trees, threshold, recall) - 1, -1))
    slots = slots_of(docs)
    hash, check = identity()
    hashed = docs.select("doc_id", hash.alias("hash"), check.alias("check"), "text")
    distinct = stored(hashed.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_id"), F.max(F.col("text").rlike(r"\S")).alias("worded")), "copies")
    # Texts that share the first hash only: all but one get a number of their own. There are hardly ever any.
    twins = distinct.groupBy("hash").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high").select("hash", "low")
    twins = stored(distinct.join(twins, "hash").filter("check > low").select("hash", "check", F.xxhash64(F.lit(2), "hash", "check").alias("node")), "twins")

    def with_node(df: DataFrame) -> DataFrame:
        return df.join(twins, ["hash", "check"], "left").withColumn("node", F.coalesce("node", "hash"))

    keyed, copies = with_node(hashed), with_node(distinct)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_words)
        sender, seen = Sender(slots, lengths), set()
        for nodes, texts in slices(batches, 1, limit=1 << 19):
            new = {}
            for node, t in zip(nodes, texts):
                if node not in seen and t and not t.isspace():
                    new[node] = t
            seen.update(new)
            if len(seen) > 250_000:
                seen.clear()
            if new:
                sets = shingles(list(new.values()), n)
                stops = np.array([stop_of(len(s), trees, threshold, recall) for s in sets], dtype=np.uint8)
                yield from sender.add(labels(sets, trees), np.repeat(np.array(list(new), dtype=np.int64), trees), np.repeat(stops, trees))
        yield from sender.flush()

    near = stored(components(candidate_links(keyed.select("node", "text").mapInArrow(send, KEYS), lengths), shrink=False), "candidates")
    wanted = wanted_map(near)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep = is_wanted(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))
            for i in np.flatnonzero(keep):
                if (node := batch.column(0)[int(i)].as_py()) in seen:
                    keep[i] = False
                seen.add(node)
            if len(seen) > 250_000:
                seen.clear()
            if keep.any():
                yield batch.filter(pa.array(keep))

    texts = keyed.select("node", "text").mapInArrow(fetch, "node long, text string").join(copies.select("node", F.col("n_copies").alias("weight")), "node")
    found = stored(verified(texts, near, lambda t: shingles(t, n), threshold), "verified")
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    known = stored(copies.join(classes(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "classes")
    least = stored(known.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("id"), F.col("node").alias("text"))).alias("head")), "class-heads")
    facts = known.join(least, "root").join(counts, "node", "left")
    return stored(facts.select("hash", "check", "node", F.coalesce("worded", F.lit(False)).alias("worded"), "n_copies", "first_id", "head", F.coalesce("others", F.lit(0)).alias("others")), "facts")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, recall: float = 0.999) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, text_class, n_copies``.

    class_id is the least doc_id that links reach; n_links the number of other documents with a similarity of at least the threshold;
    text_class the least doc_id with the same text, n_copies the number of documents that have it.
    """
    facts = text_facts(docs, n, threshold, trees, recall)
    worded = F.col("worded")
    hash, check = identity()
    return docs.select("doc_id", hash.alias("hash"), check.alias("check")).join(facts, ["hash", "check"]).select(
        "doc_id",
        F.when(worded, F.col("head.id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("others") + F.col("n_copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(worded, F.col("first_id")).otherwise(F.col("doc_id")).alias("text_class"),
        F.when(worded, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, recall: float = 0.999) -> DataFrame:
    """The documents, unchanged, without those whose class has one with a lesser id; documents without words stay.

    Of rows with equal id and text, one stays, or none.
    """
    facts = text_facts(docs, n, threshold, trees, recall)
    key, more, one, two, worded, first, copied = unused(docs, "key", "more", "one", "two", "worded", "first", "copied")
    stays = facts.filter(~F.col("worded") | (F.col("head.text") == F.col("node"))).select(
        F.col("hash").alias(one), F.col("check").alias(two), F.col("worded").alias(worded), F.col("first_id").alias(first), (F.col("worded") & (F.col("n_copies") > 1)).alias(copied)
    )
    hash, check = identity()
    marked = docs.withColumn(key, hash).withColumn(more, check)
    here = (F.col(key) == F.col(one)) & (F.col(more) == F.col(two)) & (~F.col(worded) | F.col("doc_id").eqNullSafe(F.col(first)))
    single = marked.join(stays.filter(~F.col(copied)), here, "left_semi")
    repeated = marked.join(stored(stays.filter(F.col(copied)), "copied-texts"), here, "left_semi").dropDuplicates([key, more, "doc_id"])
    return single.unionByName(repeated).select(*docs.columns)
