"""Cost-balanced packing of token streams into sequences of fixed capacity.

A document's ids (with an end id) are cut into full-capacity pieces and a rest. Rests of a bounded block of
documents are packed together: in descending order of length, each goes to the sequence of lowest estimated
cost, linear plus quadratic in the lengths of its pieces, that still has room; where none has, it is cut to fill the
roomiest. A block opens only as many sequences as its tokens fill, so it leaves less than one sequence of
padding. Blocks are packed where they are read: there is no shuffle.

A null text is an empty one (its only id is the end id). Repeated rows are packed as separate documents. A null ``doc_id``
is carried through. An empty table gives no rows. Other columns of the input are not looked at. Sequence ids are
unique, not consecutive: the upper half is the task's partition.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release, slices
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)``; every token of every item lies in exactly one.

    Every sequence but the last is full, as the number of sequences is the least that holds all tokens.
    """
    out = []
    rests = []
    sequences = 0
    for item, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((item, k * capacity, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append((n % capacity, item, full * capacity))
    opened = -(-sum(r[0] for r in rests) // capacity)
    room = [capacity] * opened
    cost = [0.0] * opened
    # A tree over the values of room left: each node has the cheapest (cost, sequence) of a range of values.
    leaves = 1 << capacity.bit_length()
    with_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # a heap for each value: sequences enter it once
    none = (float("inf"), -1)
    least = [none] * (2 * leaves)

    def renew(r: int) -> None:
        i = leaves + r
        least[i] = with_room[r][0] if with_room[r] else none
        while i := i >> 1:
            least[i] = min(least[2 * i], least[2 * i + 1])

    def cheapest(n: int) -> int:
        """The sequence of lowest cost, of all with room for ``n``; -1 if there is none."""
        best, i = least[leaves + n], leaves + n
        while i > 1:
            if not i & 1:
                best = min(best, least[i + 1])
            i >>= 1
        return best[1]

    if opened:
        with_room[capacity] = [(0.0, s) for s in range(opened)]
        renew(capacity)

    def put(item: int, start: int, n: int, s: int) -> None:
        out.append((item, start, n, sequences + s, capacity - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    waiting: list[tuple[int, int, int]] = []
    for n, item, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        s = cheapest(n)
        if s < 0:
            waiting.append((n, item, start))
            continue
        heapq.heappop(with_room[room[s]])
        renew(room[s])
        put(item, start, n, s)
        heapq.heappush(with_room[room[s]], (cost[s], s))
        renew(room[s])
    roomiest = [(-r, s) for s, r in enumerate(room) if r]
    heapq.heapify(roomiest)
    for n, item, start in waiting:
        while n:
            r, s = heapq.heappop(roomiest)
            take = min(n, -r)
            put(item, start, take, s)
            start, n = start + take, n - take
            if room[s]:
                heapq.heappush(roomiest, (-room[s], s))
    return out


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 0, block: int = 1 << 21) -> DataFrame:
    """One row per piece of every document of ``docs (doc_id, text)``, in blocks of about ``block`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[int, np.ndarray]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held, tokens
            rows = pack([len(ids) for _, ids in held], capacity)
            crc = [zlib.crc32(held[i][1][a : a + n].tobytes()) for i, a, n, _, _ in rows]
            item, start, length, seq, offset = zip(*rows)
            columns = [[held[i][0] for i in item], start, length, crc, [len(held[i][1]) for i in item], [sequence + s for s in seq], offset]
            sequence += max(seq) + 1
            held, tokens = [], 0
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])

        end = np.array([end_id], dtype="<u4")
        for ids, texts in slices(batches, 1):
            for doc, stream in zip(ids, encode(texts)):
                held.append((doc, np.concatenate([stream, end])))
                tokens += len(stream) + 1
            if tokens >= block:
                yield from flush()
                release()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
