"""Sharding by longest-processing-time scheduling; groups of equal texts stay together.

Groups go in descending order of size to the least-loaded shard of a heap. The order needs only sizes: groups that are large in bytes or in rows, a bounded number, are scheduled one by one; all others are counted
by size class (sizes up to ``1 << precision`` bytes each are a class, beyond it sizes that agree in so many leading bits), and a class is dealt at once: its groups go where the heap would send them one
by one. How many each shard takes from each class is a table of bounded size; groups are numbered within their class and looked up in it. All else is DataFrame work.

Nulls and ties: a null text has size 1 and checksum 0, and all null texts are one group. Repeated rows are
separate rows of one group. Of equal sizes, the smaller key is scheduled first. A null ``doc_id`` sorts first.
An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def schedule(items: list[tuple[int, int]], shards: int, loads: list[float] | None = None) -> dict[int, int]:
    """Longest-processing-time: (key, size) in descending size, each to the shard with the least load so far; ``loads`` is brought up to date."""
    loads = [0.0] * shards if loads is None else loads
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        loads[shard] = load + size
        heapq.heappush(heap, (load + size, shard))
    return placed


def deal(count: int, size: float, loads: list[float]) -> list[int]:
    """How many of ``count`` groups of one size each shard takes when each goes to the least-loaded one; ``loads`` is brought up to date.

    All but a last round are dealt at once: the shards below a common level are filled to just below it.
    """
    taken = [0] * len(loads)
    low, high = min(loads), max(max(loads), (sum(loads) + count * size) / len(loads)) + size
    fits = lambda level: [max(0, int((level - x) // size)) for x in loads]
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(fits(middle)) <= count else (low, middle)
    taken = fits(low)
    loads[:] = [x + n * size for x, n in zip(loads, taken)]
    for shard in schedule([(i, size) for i in range(count - sum(taken))], len(loads), loads).values():
        taken[shard] += 1
    return taken


def lpt_shards(docs: DataFrame, shards: int = 8, large: int = 256, precision: int = 12, parts: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, group_key, shard, slot``.

    A group is large from a share of ``1 / (shards * large)`` of all bytes or rows on. ``parts`` divides the numbering within a shard or class, so no task numbers a whole one.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("group_key"),
    )
    rows = stored(rows, "sizes")  # texts are read once
    by = ["group_key", "text_crc32"]
    groups = rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("bytes")) - precision, F.lit(0))).cast("long")
    groups = stored(groups.withColumn("class", F.col("bytes") - F.col("bytes") % unit), "groups")
    total, count = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("n")).first())
    is_large = (F.col("bytes") * shards * large >= F.lit(total)) | (F.col("n") * shards * large >= F.lit(count))
    heavy = groups.filter(is_large).select(*by, "bytes").collect()  # at most 2 * shards * large groups
    classes = groups.filter(~is_large).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 2 ** precision for each bit of a size

    loads = [0.0] * shards
    placed: dict[int, int] = {}
    dealt: list[tuple[int, int, int]] = []
    at = 0
    heavy.sort(key=lambda r: (-r["bytes"], r["group_key"]))
    for c in sorted(classes, key=lambda r: -r["class"]):
        first = at
        while at < len(heavy) and heavy[at]["bytes"] >= c["class"]:
            at += 1
        placed |= schedule([(i, heavy[i]["bytes"]) for i in range(first, at)], shards, loads)
        end = 0
        for shard, n in enumerate(deal(c["n"], c["bytes"] / c["n"], loads)):
            end += n
            dealt += [(c["class"], end, shard)] if n else []
    placed |= schedule([(i, heavy[i]["bytes"]) for i in range(at, len(heavy))], shards, loads)

    by_group = spark.createDataFrame([(r["group_key"], r["text_crc32"], placed[i]) for i, r in enumerate(heavy)], "group_key long, text_crc32 long, shard int")
    ends = spark.createDataFrame(dealt, "class long, end long, shard int").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    light = numbered(groups.filter(~is_large).select(*by, "class"), "class", "at", F.xxhash64("group_key"), by, parts)
    taker = F.get(F.filter("ends", lambda e: e["end"] > F.col("at")), F.lit(0))
    light = light.join(ends, "class").select(*by, taker["shard"].alias("shard"))
    large_rows = rows.join(F.broadcast(by_group), by)
    light_rows = rows.join(F.broadcast(by_group), by, "left_anti").join(light, by)
    out = large_rows.unionByName(light_rows).select("doc_id", "size", "text_crc32", "group_key", "shard")
    return numbered(stored(out, "shards"), "shard", "slot", F.xxhash64("doc_id", "group_key"), ["doc_id", "group_key"], parts)


def numbered(rows: DataFrame, by: str, slot: str, spread: Column, order: list[str], parts: int) -> DataFrame:
    """Number the rows of each value of ``by`` from 0 without gaps, in ``parts`` independent runs for each value."""
    rows = rows.withColumn("_part", F.pmod(spread, F.lit(parts)).cast("int"))
    counts = rows.groupBy(by, "_part").count()
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # as many rows as values times parts
    within = Window.partitionBy(by, "_part").orderBy(*order)
    placed = rows.withColumn("_row", F.row_number().over(within) - 1)
    return placed.join(starts, [by, "_part"]).withColumn(slot, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start")
