"""Sorted tables of terms: a term or the beginning of terms reads only the pages that may hold it.

A table is laid out by range and sorted by its term, in small Parquet pages, whose least and largest terms Spark's reader compares with the pushed conditions. Both tests of a condition (equal, begins with) are Parquet filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Terms and beginnings of one lookup up to which they are pushed to the scan; more read the whole table.
MOST_PUSHED = 1_000
#: Values that Spark pushes of one list as they are (more become one range from the least to the largest).
_LISTED = 10
#: Rows of a page.
PAGE_ROWS = 2_000


def write(terms: DataFrame, path: str, by: str = "term", then: tuple[str, ...] = ()) -> None:
    """Write a table sorted by a term, and within it by further columns, which split the rows of a frequent term over several files."""
    placed = terms.repartitionByRange(by, *then).sortWithinPartitions(by, *then)
    placed.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", 16 << 20).parquet(path)


def condition(column: Column, exact: list[str], begun: list[str]) -> Column:
    """Whether a term is one of ``exact`` or begins with one of ``begun``; of beginnings the shortest are enough."""
    short: list[str] = []
    for b in sorted(set(begun)):
        if not short or not b.startswith(short[-1]):
            short.append(b)
    left = sorted(e for e in set(exact) if not any(e.startswith(b) for b in short)) if len(short) * len(exact) < 10**6 else sorted(set(exact))
    parts = [column.isin(left[i : i + _LISTED]) for i in range(0, len(left), _LISTED)] + [column.startswith(b) for b in short]
    return _any(parts)


def _any(parts: list[Column]) -> Column:
    """A balanced disjunction, as a chain of a thousand would be as deep."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a | b, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def pushed(wanted: DataFrame) -> tuple[list[str], list[str]] | None:
    """The terms and beginnings of ``wanted (term, is_prefix)``; nothing if they are too many to be pushed."""
    few = wanted.select("term", "is_prefix").distinct().limit(MOST_PUSHED + 1).collect()
    if len(few) > MOST_PUSHED:
        return None
    return [r["term"] for r in few if not r["is_prefix"]], [r["term"] for r in few if r["is_prefix"]]


def narrowed(table: DataFrame, asked: tuple[list[str], list[str]] | None, by: str = "term") -> DataFrame:
    """The rows of a sorted table that may answer to what ``pushed`` gave."""
    return table if asked is None else table.filter(condition(F.col(by), *asked))


class TitleIndex:
    """Titles by their words, for suggestions while a word is typed.

    Null titles and titles without words are found by nothing; equal titles are one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, documents: DataFrame, folder: str) -> "TitleIndex":
        """Index the titles of ``documents``, in the place of what the folder holds; each distinct title is split once."""
        titles = documents.select("title").distinct()
        write(titles.select(F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("term"), "title"), folder, then=("title",))
        return cls(documents.sparkSession, folder)

    def read(self) -> DataFrame:
        return self.spark.read.schema("term string, title string").parquet(self.folder)

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        """Distinct titles with a word that begins with ``prefix``, in order."""
        return narrowed(self.read(), ([], [prefix.lower()])).select("title").distinct().orderBy("title").limit(limit)

    def suggest_each(self, prefixes: DataFrame, limit: int = 5) -> DataFrame:
        """``query_id, title, rank`` for each of ``prefixes (query_id, prefix)``: its first titles in order. A null or empty prefix has none."""
        asked = prefixes.select("query_id", F.lower("prefix").alias("prefix")).filter("prefix <> ''")
        distinct = asked.select("prefix").distinct()
        lengths = [r[0] for r in distinct.select(F.length("prefix")).distinct().collect()]  # one for each length of a beginning
        rows = narrowed(self.read(), pushed(distinct.select(F.col("prefix").alias("term"), F.lit(True).alias("is_prefix"))))
        begun = F.array(*(F.when(F.length("term") >= k, F.substring("term", 1, k)) for k in sorted(lengths))) if lengths else F.array().cast("array<string>")
        titles = rows.select("title", F.explode(begun).alias("prefix")).join(distinct, "prefix").distinct()
        first = titles.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("title"))).filter(F.col("rank") <= limit)
        return first.join(asked, "prefix").select("query_id", "title", "rank")
