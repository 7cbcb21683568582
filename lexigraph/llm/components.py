"""Connected components of links between 64-bit nodes: union-find within tasks, then alternating large and small stars.

Each task first shrinks its links to a forest. Then every node is linked to the least node it knows, through its larger and its smaller neighbours in turn, until
all links end at roots; the number of rounds grows with the logarithm of a component's size. Every step is written to the shared folder. Joins have a plain exchange
on both sides, so that Spark can split a node that holds a large share of the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shuffles_dropped
from .common import stored

LINKS = "a long, b long"


class UnionFind:
    """Least members of the sets that links make."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        """Each node that isn't its set's least, with that."""
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def link_batch(links: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(list(links), dtype=np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.link(a, b)
        if len(sets.parent) > 500_000:
            yield link_batch(sets.links())
            sets = UnionFind()
    yield link_batch(sets.links())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none: then nothing can change."""
    ends = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    roots = links.select(F.col("v").alias("u")).distinct()
    with shuffles_dropped(links.sparkSession):
        return ends.filter("n > 1").isEmpty() and ends.join(roots, "u", "left_semi").isEmpty()


def components(links: DataFrame, shrink: bool = True) -> DataFrame:
    """``node, root``: every node of ``links (a, b)`` with the least node of its component. Loops and repeated links are harmless; no links, no rows.

    Without ``shrink`` the links are taken as they come: for those that tasks have made forests of already.
    """
    known = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    if shrink:
        known = known.mapInArrow(_shrunk, LINKS)
    now = stored(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
