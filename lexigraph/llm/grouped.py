"""Links between the members of groups of any size, without pairs of rows: connected members are found in bounded chunks.

A group is cut into chunks of bounded size. Every chunk also gets a few leaders of its group, so that chunks of alike members meet in one component. Within a chunk members are searched breadth first: whoever is linked
already is not compared again. What is left is compared in a second step: members outside of the largest component of their group, in blocks, with all members of other components. A group whose members are alike thus costs
as much as it has members; only members that are linked with few are compared with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, stored
from .components import LINKS, UnionFind, components, link_batch

LEADERS = 8


def spread_links(count: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph over ``count`` places; ``alike`` says which of some places are linked with one."""
    todo, queue, out = np.arange(1, count), [0], []
    while len(todo):
        while queue and len(todo):
            at = queue.pop()
            hit = alike(at, todo)
            near = todo[hit].tolist()
            out += [(at, x) for x in near]
            queue += near
            todo = todo[~hit]
        if len(todo):
            queue, todo = [int(todo[0])], todo[1:]
    return out


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Columns of the rows that share the first ``keys`` columns; rows come sorted by these."""
    held: list[list] = []
    key = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys]))
        begin = 0
        for i, k in enumerate(marks):
            if k != key:
                if held and i > begin:
                    held = [h + c[begin:i] for h, c in zip(held, columns[keys:])]
                if held and held[0]:
                    yield held
                held, key, begin = [[] for _ in columns[keys:]], k, i
        held = [h + c[begin:] for h, c in zip(held, columns[keys:])]
    if held and held[0]:
        yield held


def _within(compare: Callable[[list], Callable], caches: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(*caches)
        out: list[tuple[int, int]] = []
        for _, nodes, payloads in _units(batches, 2):
            known = list({n: i for i, n in reversed(list(enumerate(nodes)))}.values())[::-1]  # a leader may be in its own chunk
            if len(known) > 1:
                out += [(nodes[known[a]], nodes[known[b]]) for a, b in spread_links(len(known), compare([payloads[i] for i in known]))]
            if len(out) > 50_000:
                yield link_batch(out)
                out = []
        yield link_batch(out)

    return run


def _across(compare: Callable[[list], Callable], caches: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(*caches)
        for sides, nodes, labels, payloads in _units(batches, 3):
            alike, sets = compare(payloads), UnionFind()
            others = np.array([i for i, s in enumerate(sides) if s], dtype=np.int64)
            of = np.array(labels, dtype=np.int64)[others]
            for i, s in enumerate(sides):
                if not s and len(others):
                    apart = others[of != labels[i]]
                    for j in apart[alike(i, apart)] if len(apart) else ():
                        sets.link(nodes[i], nodes[j])
            yield link_batch(sets.links())

    return run


def group_links(members: DataFrame, compare: Callable[[list], Callable], most_rows: int, most_size: int, caches: tuple = ()) -> DataFrame:
    """``a, b``: links that connect the same members as all links between members of one group do. ``members`` are ``group, node, size, payload``, stored; a node has one payload.

    ``compare`` takes the payloads of some members and returns a function of a place and an array of places, which says which of these are linked with the first. A chunk has about ``most_rows`` members of ``most_size`` in
    sum at most, where no single one is larger.
    """
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1")
    parts = lambda n, size, rows: F.greatest(F.ceil(n / rows), F.ceil(size / most_size), F.lit(1)).cast("int")
    shape = stored(sizes.select("group", parts(F.col("n"), F.col("size"), most_rows).alias("chunks")), "group-sizes")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = members.join(shape, "group").select("group", chunk.alias("chunk"), F.lit(1).alias("turn"), "node", "payload")
    large = shape.filter("chunks > 1")
    cut = not large.isEmpty()
    if cut:
        mine = [F.min(F.when(F.pmod(F.hash("node"), F.lit(LEADERS)) == i, F.col("node"))) for i in range(LEADERS)]
        leaders = members.join(large, "group").groupBy("group", "chunks").agg(F.array(*mine).alias("nodes")).select("group", "chunks", F.explode("nodes").alias("node")).filter("node is not null")
        led = members.join(leaders, ["group", "node"]).select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("turn"), "node", "payload")
        rows = rows.unionByName(led)
    found = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "turn", "node").mapInArrow(_within(compare, caches), LINKS)
    if not cut:
        return found
    found = stored(found, "links-within")
    labels = stored(components(found), "labels")
    inside = members.join(large, "group").join(labels, "node", "left").select("group", "chunks", "node", "size", "payload", F.coalesce("root", "node").alias("label"))
    counts = inside.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = counts.groupBy("group").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("size", F.struct("n", "label")).alias("own"))
    odd = most.filter(F.col("n") > F.col("most.n")).select("group", F.col("most.label").alias("common"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("own"), most_rows).alias("blocks"))
    odd = stored(odd, "odd-groups")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    both = inside.join(odd, "group")
    left = both.filter(F.col("label") != F.col("common")).select("group", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "node", "label", "payload")
    right = both.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("side"), "node", "label", "payload")
    met = left.unionByName(right).repartition("group", "block", "chunk").sortWithinPartitions("group", "block", "chunk", "side", "node")
    return found.unionByName(met.mapInArrow(_across(compare, caches), LINKS))
