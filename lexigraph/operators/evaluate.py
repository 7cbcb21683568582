"""Retrieval quality: golden cases and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``name, passed, reason`` of ``cases (name, expected_top_doc, must_contain, must_not_contain, min_results, max_rank)`` and ``hits (name, rank, path, snippet)``."""
    got = hits.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("rank", "path")).alias("paths"), F.collect_list(F.lower("snippet")).alias("texts"))
    both = cases.join(got, "name", "left")
    count = F.coalesce("n", F.lit(0))
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    expected = F.exists(F.coalesce("paths", F.array().cast("array<struct<rank:int,path:string>>")), lambda p: (p["rank"] <= F.col("max_rank")) & p["path"].contains(F.col("expected_top_doc")))
    missing = F.get(F.filter("must_contain", lambda m: ~F.exists(texts, lambda t: t.contains(F.lower(m)))), F.lit(0))
    found = F.get(F.filter("must_not_contain", lambda m: F.exists(texts, lambda t: t.contains(F.lower(m)))), F.lit(0))
    reason = (
        F.when(count < F.col("min_results"), "insufficient results")
        .when((F.coalesce("expected_top_doc", F.lit("")) != "") & (F.col("max_rank") > 0) & ~expected, "expected document not in top results")
        .when(missing.isNotNull(), F.concat(F.lit("missing required phrase: "), missing))
        .when(found.isNotNull(), F.concat(F.lit("found boilerplate phrase: "), found))
        .otherwise("")
    )
    return both.select("name", (reason == "").alias("passed"), reason.alias("reason"))


def metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, precision, recall, reciprocal_rank, ndcg`` at ``k`` of ``hits (query_id, document_id, rank)`` and ``relevant (query_id, document_id)``."""
    judged = hits.filter(F.col("rank") <= k).join(relevant.select("query_id", "document_id", F.lit(1.0).alias("rel")), ["query_id", "document_id"], "left")
    gain = F.coalesce("rel", F.lit(0.0)) / F.log2(F.col("rank") + 1)
    per = judged.groupBy("query_id").agg(F.count("rel").alias("found"), F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    total = relevant.groupBy("query_id").agg(F.countDistinct("document_id").alias("total"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    joined = total.join(per, "query_id", "left")
    return joined.select(
        "query_id",
        (F.coalesce("found", F.lit(0)) / k).alias("precision"),
        (F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def holding(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``query_id, document_id``: the documents ``(document_id, content)`` whose text holds the whole text of an item ``(query_id, text)``.

    What stands between the first and the last space of an item is whole words in every text that holds it. Candidates are the documents with the longest of these words; only they are searched. Items
    without such a word are looked for in every document.
    """
    words = F.split("text", " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    anchored = items.filter("text <> ''").select("query_id", "text", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    known = anchored.filter("word is not null")
    here = documents.select("document_id", "content", F.explode(F.array_distinct(F.split("content", " "))).alias("word")).join(known.select("word").distinct(), "word", "left_semi")
    met = here.join(known, "word").filter(F.contains("content", F.col("text"))).select("query_id", "document_id")
    short = anchored.filter("word is null")
    if short.isEmpty():
        return met
    return met.unionByName(documents.join(short, F.contains("content", F.col("text"))).select("query_id", "document_id"))
