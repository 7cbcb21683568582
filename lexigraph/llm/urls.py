"""URL filtering by a temporal list join: dated list entries become validity intervals, captures meet those active at fetch time.

An entry names a host (it also covers the hosts below it) and adds or removes it from a moment on. An addition holds until
the next entry of the same host. Of the active entries that cover a capture, the longest host decides. All work is DataFrame work: distinct (host, fetch time)
pairs, so copies of a hot pair are gathered before the shuffle, meet the intervals of their host suffixes in an as-of join, and the answers go back to the captures.

Captures with a null or hostless URL, or a null time, meet no entry and are not blocked. Entries with a null host, action or time are void. Of entries of one host
and moment a removal counts last. Repeated captures are answered each; repeated entries are as one. Empty tables are fine on either side. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The actions of list entries.
ADD, REMOVE = "add", "remove"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """``host, valid_from, valid_to`` of ``entries (host, action, listed_at)``; valid_to is exclusive, null where open."""
    known = entries.filter(F.col("host").isNotNull() & F.col("action").isin(ADD, REMOVE) & F.col("listed_at").isNotNull())
    known = known.select(F.lower("host").alias("host"), "action", "listed_at").groupBy("host", "listed_at").agg(F.max("action").alias("action"))
    later = Window.partitionBy("host").orderBy("listed_at")
    return known.select("host", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(later).alias("valid_to")).filter(F.col("action") == ADD).drop("action")


def url_list_join(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """One row per capture ``(page_id, url, fetched_at)``: ``page_id, host, fetched_at, blocked, matched, listed_at``.

    The as-of join sorts the asked moments of a host suffix among the interval starts of that suffix and takes the last start before each, so no moment meets more than one interval.
    Moments of one suffix are dealt over ``salts`` groups, each with all of the suffix's intervals.
    """
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = seen.filter(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).select("host", "fetched_at").distinct()
    listed = intervals(entries).withColumnRenamed("host", "suffix")
    asked = asked.select("host", F.col("fetched_at").alias("at"), F.explode(suffixes).alias("suffix")).join(listed.select("suffix").distinct(), "suffix", "left_semi")
    asked = asked.select("suffix", F.pmod(F.xxhash64("host", "at"), F.lit(salts)).cast("int").alias("salt"), "at", "host", F.lit(None).cast(listed.select(F.struct("valid_from", "valid_to").alias("i")).schema["i"].dataType).alias("interval"))
    starts = listed.select("suffix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("valid_from").alias("at"), F.lit(None).cast("string").alias("host"), F.struct("valid_from", "valid_to").alias("interval"))
    # Of a start and a moment at the same time, the start comes first.
    earlier = Window.partitionBy("suffix", "salt").orderBy("at", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    met = asked.unionByName(starts).withColumn("interval", F.last("interval", ignorenulls=True).over(earlier)).filter(F.col("host").isNotNull() & F.col("interval").isNotNull())
    active = met.filter(F.col("interval.valid_to").isNull() | (F.col("at") < F.col("interval.valid_to"))).withColumnRenamed("at", "fetched_at")
    answer = active.groupBy("host", "fetched_at").agg(F.max(F.struct(F.length("suffix").alias("n"), F.col("suffix"), F.col("interval.valid_from").alias("valid_from"))).alias("hit"))
    return seen.join(answer, ["host", "fetched_at"], "left").select(
        "page_id", "host", "fetched_at", F.col("hit").isNotNull().alias("blocked"), F.col("hit.suffix").alias("matched"), F.col("hit.valid_from").alias("listed_at")
    )
