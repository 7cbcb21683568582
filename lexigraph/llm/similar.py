"""Machinery of the similarity operators: sorted keys to candidate links, and exact Jaccard verification in tiles.

Items (lines, documents) are 64-bit nodes. Tasks send (key, node) pairs as packed arrays; of the nodes that share a key within a task only one is sent on, the others are linked
to it at once, so a key that a third of all items share costs one entry per task. Candidate links join items into candidate components. The texts of one component meet
in tiles of bounded size, and all pairs of a component are compared there as sets; pairs are never emitted, only the links of a spanning forest and numbers of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shuffles_dropped
from .common import stored
from .components import LINKS, UnionFind, components, link_batch
from .grouped import group_links

KEYS = "slot int, linked boolean, a binary, b binary, stops binary"
#: (key, node) pairs that a task holds before it sends them on.
HELD = 1 << 19
#: Bits of the map of wanted nodes: its size is fixed, and with it that of the broadcast.
MAP_BITS = 1 << 26
TILE = 128
#: Characters of the groups whose texts become sets in one call.
HELD_TEXT = 1 << 17
#: Up to so many sets are compared pair by pair.
FEW = 6
#: Tiles of a component beyond which its members meet by their rare values instead; counters that order these.
MOST_TILES, COUNTERS = 8, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    y = x >> np.uint64(30)  # the only new array, but for the shifted ones
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _linked(keys: np.ndarray, nodes: np.ndarray, stops: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Walk up the trie of sorted keys, from the longest prefix length (in bits) to the shortest.

    Nodes whose keys agree in a prefix become one entry where one of them still asks at this length, that is, where its stop isn't above it; entries that have
    stopped all stay apart, but are there to be found. Returns the keys, nodes and stops that are left, and the links of the others to them.
    """
    order = np.lexsort((nodes, keys))
    keys, nodes, stops = keys[order], nodes[order], stops[order]
    a, b = [nodes[:0]], [nodes[:0]]
    for bits in lengths if len(keys) else ():
        starts = _runs(keys >> np.uint64(64 - bits))
        counts = np.diff(np.append(starts, len(keys)))
        least = np.minimum.reduceat(stops, starts)
        asked = least <= bits
        stops[starts[asked]] = least[asked]
        head = np.repeat(starts, counts)
        gone = np.repeat(asked, counts)
        gone[starts] = False
        off = gone & (nodes != nodes[head])
        a.append(nodes[off])
        b.append(nodes[head[off]])
        keys, nodes, stops = keys[~gone], nodes[~gone], stops[~gone]
    return keys, nodes, stops, np.concatenate(a), np.concatenate(b)


class Sender:
    """Gathers a task's pairs and packs them by slot. Keys that agree in the shortest of ``lengths`` bits share a slot."""

    def __init__(self, slots: int, lengths: tuple[int, ...] = (64,)):
        self.slots, self.lengths = slots, lengths
        self.keys: list[np.ndarray] = []
        self.nodes: list[np.ndarray] = []
        self.stops: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, nodes: np.ndarray, stops: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """``stops``: the prefix length at which each pair's walk ends, in bits; by default the shortest."""
        self.keys.append(keys.ravel())
        self.nodes.append(nodes.ravel())
        self.stops.append(np.full(keys.size, self.lengths[-1], dtype=np.uint8) if stops is None else stops.ravel())
        self.size += keys.size
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, nodes, stops, a, b = _linked(np.concatenate(self.keys), np.concatenate(self.nodes), np.concatenate(self.stops), self.lengths)
        self.keys, self.nodes, self.stops, self.size = [], [], [], 0
        slot = (mix(keys >> np.uint64(64 - self.lengths[-1])) % np.uint64(self.slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, keys, nodes, stops = slot[order], keys[order], nodes[order], stops[order]
        bounds = np.searchsorted(slot, np.arange(self.slots + 1))
        rows = [(s, False, keys[i:j].tobytes(), nodes[i:j].tobytes(), stops[i:j].tobytes()) for s, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        if len(a):
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            rows += [(at // 4096 % self.slots, True, pairs[at : at + 4096, 0].tobytes(), pairs[at : at + 4096, 1].tobytes(), b"") for at in range(0, len(pairs), 4096)]
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["slot", "linked", "a", "b", "stops"])


def slots_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def candidate_links(sent: DataFrame, lengths: tuple[int, ...] = (64,)) -> DataFrame:
    """``a, b``: links between the nodes whose keys agree in a prefix at which one of them asks; sorted keys stand for a trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sets = UnionFind()
        for batch in batches:
            for slot, linked, a, b, stops in zip(*(c.to_pylist() for c in batch.columns)):
                if linked:
                    for x, y in zip(np.frombuffer(a, dtype="<i8").tolist(), np.frombuffer(b, dtype="<i8").tolist()):
                        sets.link(x, y)
                else:
                    held.setdefault(slot, []).append((a, b, stops))
        for slot in list(held):
            rows = held.pop(slot)
            keys = np.frombuffer(b"".join(r[0] for r in rows), dtype="<u8")
            nodes = np.frombuffer(b"".join(r[1] for r in rows), dtype="<i8")
            stops = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
            _, _, _, x, y = _linked(keys, nodes, stops, lengths)
            for p, q in zip(x.tolist(), y.tolist()):
                sets.link(p, q)
        yield link_batch(sets.links())

    return sent.repartition("slot").mapInArrow(run, LINKS)


def wanted_map(labels: DataFrame):
    """A broadcast bitmap of fixed size that has the bit of every node of ``labels``; others may share bits."""
    at = F.pmod(F.col("node"), F.lit(MAP_BITS)) + 1
    with shuffles_dropped(labels.sparkSession):
        rows = labels.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for bucket, b in rows:
        part = np.frombuffer(b, dtype=np.uint8)
        bits[(bucket - 1) * 4096 : bucket * 4096] = part
    return labels.sparkSession.sparkContext.broadcast(bits)


def is_wanted(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = nodes % MAP_BITS
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def verified(items: DataFrame, labels: DataFrame, shingles: Callable[[list[str]], list[np.ndarray]], threshold: float) -> DataFrame:
    """``a, b, links``: of items ``(node, weight, text)`` of candidate components ``labels (node, root)``, the exact links.

    Rows with b are links of a spanning forest of the tile's graph; rows without say that node a has so many links, in weights, within one tile pair. Repeated items of a node count once.
    """
    return in_tiles(items.join(labels, "node").join(tiles_of(labels), "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))), shingles, threshold)


def tiles_of(labels: DataFrame) -> DataFrame:
    """``root, tiles`` of the candidate components with more than one tile."""
    return stored(labels.groupBy("root").count().filter(F.col("count") > TILE).select("root", (F.ceil(F.col("count") / TILE)).cast("int").alias("tiles")), "large-components")


def in_tiles(placed: DataFrame, shingles: Callable[[list[str]], list[np.ndarray]], threshold: float) -> DataFrame:
    """As ``verified``, of rows ``root, node, weight, text, tiles``."""
    mine = F.pmod(F.hash("node"), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("low"), F.greatest(t, F.col("tile")).alias("high")))
    tiled = placed.withColumn("tile", mine).select("root", "node", "weight", "text", "tile", F.explode(pairs).alias("pair")).select("root", "pair.low", "pair.high", "tile", "node", "weight", "text")
    dealt = tiled.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held, size = None, [], [], 0
        found: list[tuple] = []
        for batch in batches:
            for root, low, high, tile, node, weight, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, low, high) != key:
                    if len(rows) > 1:
                        held.append((key, rows))
                        size += sum(len(r[3] or "") for r in rows)
                    if size > HELD_TEXT:
                        found += compared(held, shingles, threshold)
                        held, size = [], 0
                    key, rows = (root, low, high), []
                if not rows or rows[-1][0] != node:
                    rows.append((node, tile, weight, text))
            if len(found) > 10_000:
                yield _found(found)
                found = []
        found += compared([*held, (key, rows)], shingles, threshold)
        yield _found(found)

    return dealt.mapInArrow(run, "a long, b long, links long")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["a", "b", "links"])


def compared(groups: list[tuple], shingles: Callable[[list[str]], list[np.ndarray]], threshold: float) -> Iterator[tuple]:
    """The links of some groups ``(key, rows)``, whose texts become sets in one call."""
    sets = shingles(texts) if (texts := [r[3] for _, rows in groups for r in rows]) else []
    at = 0
    for key, rows in groups:
        yield from _compare(rows, key, sets[at : at + len(rows)], threshold)
        at += len(rows)


def _links_of_few(rows: list[tuple], apart: bool, sets: list[np.ndarray], threshold: float) -> list[tuple]:
    """The links of a few sorted sets, pair by pair; with ``apart`` those between tiles only."""
    forest, counts = UnionFind(), [0] * len(rows)
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if not len(x) or not len(y) or apart and rows[i][1] == rows[j][1]:
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two runs are merged
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= threshold * (len(both) - common) - 1e-9:
                forest.link(rows[i][0], rows[j][0])
                counts[i] += rows[j][2]
                counts[j] += rows[i][2]
    return [(a, b, 0) for a, b in forest.links()] + [(r[0], None, n) for r, n in zip(rows, counts) if n]


def _common(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The numbers of common values of sets, as products of matrices."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    starts = _runs(flat)
    lengths = np.diff(np.append(starts, len(flat)))
    column = np.repeat(np.cumsum(lengths > 1) - 1, lengths)
    shared = np.repeat(lengths > 1, lengths)
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(1 << 14, max(columns, 1))
    bounds = np.searchsorted(column, np.arange(0, columns + width, width))
    for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[owner[i:j], column[i:j] - k * width] = 1
        common += x @ x.T
    return common


def _compare(rows: list[tuple], key, sets: list[np.ndarray], threshold: float) -> list[tuple]:
    if len(rows) < 2:
        return []
    if len(sets) <= FEW:
        return _links_of_few(rows, key[1] != key[2], sets, threshold)
    sizes = np.array([len(s) for s in sets])
    common = _common(sets, sizes)
    alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    alike &= (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(alike, False)
    if key[1] != key[2]:
        tiles = np.array([r[1] for r in rows])
        alike &= tiles[:, None] != tiles[None, :]
    weights = np.array([r[2] for r in rows], dtype=np.int64)
    counts = alike @ weights
    forest = UnionFind()
    for i, j in zip(*np.nonzero(np.triu(alike))):
        forest.link(rows[i][0], rows[j][0])
    return [(a, b, 0) for a, b in forest.links()] + [(rows[i][0], None, int(counts[i])) for i in np.flatnonzero(counts)]


def classes(found: DataFrame) -> DataFrame:
    """``node, root`` of the verified links."""
    return components(found.filter(F.col("b").isNotNull()).select("a", "b"), shrink=False)


def in_prefixes(members: DataFrame, shingles: Callable[[list[str]], list[np.ndarray]], threshold: float) -> DataFrame:
    """``a, b``: links that connect the same nodes as all links within components do, of ``members (root, node, text)``, stored, one row a node; for components that have too many tiles.

    Sets as similar as the threshold share one of the first values of both in any order, of which a set of n values has n less the threshold's share, and one. The order is from rare to common values, by counts in a table of
    fixed size. The members that share a first value are a group, so the number of rows grows with the number of members; with tiles it grows with its square.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for x in shingles(batch.column(0).to_pylist()) if batch.num_rows else ():
                np.add.at(total, (x % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = np.zeros(COUNTERS, dtype=np.int64)
    with shuffles_dropped(members.sparkSession):
        found = members.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                groups, rows = [], []
                roots = part.column(0).to_numpy().astype(np.int64).view(np.uint64)
                for i, x in enumerate(shingles(part.column(2).to_pylist())):
                    n = len(x) - int(np.ceil(threshold * len(x) - 1e-6)) + 1
                    rare = np.lexsort((x, shared.value[(x % np.uint64(COUNTERS)).astype(np.int64)]))[:n]
                    groups.append(mix(x[rare] ^ mix(roots[i : i + 1] + np.uint64(1))))
                    rows.append(np.full(len(rare), i))
                take = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64))
                group = np.concatenate(groups) if groups else np.zeros(0, dtype=np.uint64)
                text = part.column(2).take(take)
                yield pa.record_batch([pa.array(group.view(np.int64)), part.column(1).take(take), pc.utf8_length(text).cast(pa.int64()), text], names=["group", "node", "size", "payload"])

    def compare(texts: list[str]) -> Callable[[int, np.ndarray], np.ndarray]:
        sets = shingles(texts)
        sizes = np.array([len(x) for x in sets])
        common = _common(sets, sizes)
        close = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        return lambda i, others: close[i, others]

    met = stored(members.select("root", "node", "text").mapInArrow(first, "group long, node long, size long, payload string"), "prefixes")
    # Neighbouring values of alike texts have the same members: one group stands for all of these.
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    kept = met.groupBy("group").agg(*marks).filter("n > 1").groupBy("n", "x", "y").agg(F.min("group").alias("group")).select("group")
    return group_links(stored(met.join(kept, "group", "left_semi"), "rare-groups"), compare, 512, HELD_TEXT)
