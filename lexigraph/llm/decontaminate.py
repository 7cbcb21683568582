"""Benchmark decontamination by pigeonhole edit matching.

An item of normalised length m may lie in a document with up to ``floor(rate * m)`` edits. Cut into one piece more than
that, at least one piece of it survives every such match unchanged. One automaton finds all pieces in a text; around each
hit, Myers' bit-parallel distance of the whole item to the text decides. Normalisation: lower case, runs of white space as one space.

Items go to the tasks in batches of bounded size. Null or empty texts and items match nothing. Equal items (id and text) are one. Repeated documents are answered
each. Empty tables give no rows. Other columns are not looked at. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices

MATCHES = "doc_id long, item_id long, distance int, budget int, start long, stop long"
#: Characters of items in one automaton.
BATCH_CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def cut(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """The error budget of an item, and its pieces with their offsets."""
    budget = int(rate * len(item))
    bounds = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


def myers(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``text`` (anchored: to any beginning of it), and where the first such part ends."""
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, distance = mask, 0, len(item)
    least, end = distance, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & mask
        down = plus & horizontal
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up, down = (up << 1 | anchored) & mask, down << 1 & mask
        plus = down | ~(vertical | up) & mask
        minus = up & vertical
        if distance < least:
            least, end = distance, at
    return least, end


class Finder:
    """Matches of items ``(item_id, text)`` in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if n := normal(text):
                budget, parts = cut(n, rate)
                for offset, piece in parts:
                    pieces.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, n, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, distance, budget, start, stop)`` of each item that lies in the normalised text: its best place."""
        spans: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text) if self.items else ():
            for item, offset in places:
                spans.setdefault(item, []).append(end + 1 - n - offset)
        out = []
        for item, begins in spans.items():
            item_id, n, budget = self.items[item]
            found = None
            low = high = None
            for b in [*sorted(set(begins)), None]:
                if low is not None and b is not None and b - budget <= high:
                    high = b + len(n) + budget
                    continue
                if low is not None:
                    low = max(0, low)
                    region = text[low:high]
                    exact = region.find(n)
                    distance, end = (0, exact + len(n)) if exact >= 0 else myers(n, region)
                    if distance <= budget and (found is None or distance < found[1]):
                        length = len(n) if exact >= 0 else myers(n[::-1], region[:end][::-1], anchored=True)[1]
                        found = (item_id, distance, budget, low + end - length, low + end)
                if b is not None:
                    low, high = b - budget, b + len(n) + budget
            if found:
                out.append(found)
        return sorted(out)


def _batches(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct items, in lists of bounded size; one list is held at a time."""
    held, size = [], 0
    for r in items.filter(F.length("text") > 0).select("item_id", "text").distinct().toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.08) -> DataFrame:
    """One row for each document and item that lies in it within its budget; start and stop are in the normalised text."""
    spark = docs.sparkSession
    found = [docs.select("doc_id", "text").mapInArrow(_matcher(spark.sparkContext.broadcast(held), rate), MATCHES) for held in _batches(items)]
    if not found:
        return spark.createDataFrame([], MATCHES)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _matcher(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        finder = Finder(shared.value, rate)
        for ids, texts in slices(batches, 1):
            rows = [(i, item, d, b, s, e) for i, t in zip(ids, texts) if t for item, d, b, s, e in finder.find(normal(t))]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in MATCHES.split(", ")])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.08) -> DataFrame:
    """The documents, unchanged, in which no item lies."""
    spark = docs.sparkSession
    for held in _batches(items):
        docs = docs.mapInArrow(_filter(spark.sparkContext.broadcast(held), rate), docs.schema)
    return docs


def _filter(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        finder = Finder(shared.value, rate)
        for batch in batches:
            keep = []
            for (texts,) in slices(iter([batch.select(["text"])]), 0):
                keep += [not (t and finder.find(normal(t))) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
