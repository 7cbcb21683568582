"""Audit of filters that overlap: what each removes in every order of application, from one count for each combination of failures.

Every document has a mask, one bit for each filter that it fails. Counts of masks by part are all that is kept of the documents; the subset-zeta transform turns them into the survivors of every
subset of the filters at once. A step of an order is then a difference between two neighbouring subsets, and so are the documents that a filter alone removes; the same holds for counts of labelled
documents. A filter may fail documents whose text has occurred under a smaller id: texts are told apart by 128 bits, and groups of copies are counted by part, mask and label before they meet.

Null texts are empty ones. A null id is neither smaller nor larger than another: such rows count, but have no earlier copy, are none, and have no label. Repeated rows count each; rows of the same id and text are not
earlier copies of each other. A null part is the empty string. Several label rows of a document count as one that has all their marks. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import identity

#: White space between words.
SPACES = " \t\n\x0b\x0c\r"


def text_conditions(text: Column) -> dict[str, Column]:
    """The failures A to D of a text: few words, repetitive words, capitals, marks."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.split(bare, r"[\x20\x09-\x0D]+", -1)
    n = F.when(bare == "", 0).otherwise(F.size(words))
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out.cast("int")


def mask_counts(docs: DataFrame, conditions: dict[str, Column], marks: DataFrame, part: Column) -> DataFrame:
    """``part, mask, n, ...``: documents by part and combination of failures, and how many of them have each mark.

    ``conditions`` are on the columns of ``docs``; one more bit, the highest, is for texts that occur under a smaller id. ``marks`` has a ``doc_id`` and boolean columns.
    """
    names = [c for c in marks.columns if c != "doc_id"]
    marked = marks.filter("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in names))
    one, two = identity()
    # Expressions on the text stay where it is read; only hashes and masks are shuffled.
    facts = docs.withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.coalesce(part, F.lit("")).alias("part"), _bits(list(conditions.values())).alias("mask"), one.alias("one"), two.alias("two"))
    kinds = ["one", "two", "part", "mask", *names]
    rows = facts.join(marked, "doc_id", "left").fillna(False, names).groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*kinds).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first")
    )
    # One row for each part, mask and label of a text: a text with many copies has few.
    least = groups.groupBy("one", "two").agg(F.min("first.doc_id").alias("least"))
    split = groups.join(least, ["one", "two"]).withColumn("original", F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0))
    copy = 1 << len(conditions)
    both = F.array(F.struct("mask", (F.col("nameless") + F.col("original")).alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    counted = split.select("part", *names, F.explode(both).alias("m")).select("part", *names, "m.mask", "m.n")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in names))


def zeta(counts: Column, filters: int) -> Column:
    """Of an array of counts by mask, the sums over all masks within each set of bits."""
    bits = F.array(*(F.lit(1 << b) for b in range(filters)))
    return F.aggregate(bits, counts, lambda z, b: F.transform(z, lambda x, s: F.when(s.bitwiseAND(b) > 0, x + F.get(z, s - b)).otherwise(x)))


def survivors(counts: DataFrame, filters: int, values: list[str]) -> DataFrame:
    """``part`` and an array for each of ``values``: how many documents no filter of a set removes, by the set's bits. ``counts`` has a row for each part and mask."""
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*values)))).alias("held"))  # at most a row for each mask

    def counts_of(value: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("held", m)[value], F.lit(0)).cast("long"))

    found = by_mask.select("part", *(counts_of(v).alias(v) for v in values))
    return found.select("part", *(F.reverse(zeta(F.col(v), filters)).alias(v) for v in values))  # reversed: a set's place holds what lies outside of it


def shapley(kept: Column, filters: int) -> Column:
    """For each filter, what it removes, summed over all orders; ``kept`` are the survivors by set."""
    out = []
    for f in range(filters):
        total = F.lit(0).cast("long")
        for before in range(1 << filters):
            if not before >> f & 1:
                size = before.bit_count()
                total = total + (F.get(kept, F.lit(before)) - F.get(kept, F.lit(before | 1 << f))) * (factorial(size) * factorial(filters - 1 - size))
        out.append(total)
    return F.array(*out)


def order_steps(kept: DataFrame, names: str, labels: dict[str, str]) -> DataFrame:
    """A row for each part, order of the filters (one letter each, the first of ``names`` for the lowest bit) and step. ``labels`` maps names of result columns to columns of ``kept``, for what a step removes of them."""
    k = len(names)
    bit = lambda letter: F.get(F.array(*(F.lit(1 << b) for b in range(k))), F.instr(F.lit(names), letter) - 1)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(names)))
    each = kept.withColumn("shares", shapley(F.col("n"), k)).select("*", F.explode(orders).alias("filter_order"))
    each = each.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    before = F.aggregate(F.transform(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), bit), F.lit(0), lambda s, b: s + b)
    each = each.withColumns({"before": before, "own": bit(F.col("letter"))})
    everything = (1 << k) - 1
    of = lambda c, s: F.get(F.col(c), s)
    removed = of("n", F.col("before")) - of("n", F.col("before") + F.col("own"))
    return each.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        of("n", F.col("before") + F.col("own")).alias("kept"),
        removed.alias("removed"),
        (of("n", F.lit(0)) - of("n", F.col("own")) - removed).alias("redundant"),
        (of("n", everything - F.col("own")) - of("n", F.lit(everything))).alias("unique_fails"),
        *((of(c, F.col("before")) - of(c, F.col("before") + F.col("own"))).alias(name) for name, c in labels.items()),
        F.get("shares", F.instr(F.lit(names), F.col("letter")) - 1).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: the filters A to E over ``docs (doc_id, text, source)``, by source; ``labels (doc_id, quality, toxic)``."""
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad")).filter("good or bad")
    counts = mask_counts(docs, text_conditions(F.col("text")), marks, F.col("source"))
    return order_steps(survivors(counts, 5, ["n", "good", "bad"]), "ABCDE", {"good_lost": "good", "toxic_lost": "bad"})
