"""Fusion of ranked lists: reciprocal ranks, boosts, floor, reranking, diversification, confidence and fallback.

Everything is per ``query_id``; ties are broken by (score, best rank, document id).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The rank constant, the agreement weight and the most that entities boost.
RANK_CONSTANT, AGREEMENT, MOST_BOOST = 60, 0.2, 3.0


def rrf(lexical: DataFrame, semantic: DataFrame, semantic_weight: float = 0.5, k: int = RANK_CONSTANT) -> DataFrame:
    """``query_id, document_id, score, strategies, best_rank, similarity`` of lists ``(query_id, document_id, rank[, score])``."""
    left = lexical.select("query_id", "document_id", F.col("rank").alias("lexical_rank"))
    right = semantic.select("query_id", "document_id", F.col("rank").alias("semantic_rank"), F.col("score").alias("similarity"))
    both = left.join(right, ["query_id", "document_id"], "full_outer")
    term = lambda rank, w: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    return both.select(
        "query_id",
        "document_id",
        (term("lexical_rank", 1 - semantic_weight) + term("semantic_rank", semantic_weight)).alias("score"),
        (F.col("lexical_rank").isNotNull().cast("int") + F.col("semantic_rank").isNotNull().cast("int")).alias("strategies"),
        F.least("lexical_rank", "semantic_rank").alias("best_rank"),
        "similarity",
    )


def agreement_boost(score: Column, strategies: Column, available: int = 2) -> Column:
    return score * (1 + AGREEMENT * strategies / available)


def entity_boost(score: Column, entities: Column, text: Column) -> Column:
    """Times 1.5 for each entity of several words, 1.2 for each of one, that the text holds; at most 3."""
    low = F.lower(text)
    factor = F.aggregate(entities, F.lit(1.0), lambda a, e: a * F.when(low.contains(F.lower(e)), F.when(e.contains(" "), 1.5).otherwise(1.2)).otherwise(1.0))
    return score * F.least(factor, F.lit(MOST_BOOST))


def ranked(hits: DataFrame, limit: int | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "document_id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def floored(hits: DataFrame, floor: float, seen: Observation | None = None) -> DataFrame:
    """The hits whose score is ``floor`` or more, all if it isn't above zero. ``seen`` gets ``before`` and ``rejected`` from the job that reads the hits; without a score a hit is rejected."""
    below = ~F.coalesce(F.col("score") >= floor, F.lit(False)) if floor > 0 else F.lit(False)
    counted = hits if seen is None else hits.observe(seen, F.count(F.lit(1)).alias("before"), F.count_if(below).alias("rejected"))
    return counted.filter(~below) if floor > 0 else counted


def rerank(hits: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` hits of each query, with scores raised by their similarity, where it is known."""
    return ranked(hits, top).withColumn("score", F.col("score") * (1 + F.coalesce("similarity", F.lit(0.0)))).drop("rank")


def mmr(hits: DataFrame, limit: int = 10, balance: float = 0.7) -> DataFrame:
    """``query_id, document_id, score, pick``: greedy maximal marginal relevance over ``hits (query_id, document_id, score, best_rank, snippet)``.

    A query has at most as many hits here as were reranked, so its group is small.
    """
    listed = hits.select("query_id", "document_id", "score", "best_rank", T.similarity_tokens(F.col("snippet")).alias("words"))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.assign(_s=group["score"].round(12)).sort_values(["_s", "best_rank", "document_id"], ascending=[False, True, True]).reset_index(drop=True)
        sets = [set(w) for w in rows["words"]]
        order = [0]
        while len(order) < min(limit, len(rows)):
            best, at = None, None
            for i in range(len(rows)):
                if i not in order:
                    near = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0) for j in order)
                    value = balance * rows["score"][i] - (1 - balance) * near * rows["score"][i]
                    if best is None or value > best:
                        best, at = value, i
            order.append(at)
        out = rows.loc[order, ["query_id", "document_id", "score"]]
        return out.assign(pick=range(1, len(out) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    return listed.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, document_id {kinds['document_id']}, score double, pick int")


def confidence(hits: DataFrame, strategies_used: int = 2, degraded: bool = False) -> DataFrame:
    """``query_id, confidence`` of hits with ``strategies``; a query without hits has no row (its confidence is none)."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strategies") >= 2).alias("agreeing"))
    both = F.lit(strategies_used >= 2)
    level = F.when(F.lit(degraded), "medium").when(both & (F.col("agreeing") >= F.floor(F.col("n") / 2)), "very_high").when(both & (F.col("agreeing") > 0), "high").otherwise("medium")
    return counts.select("query_id", level.alias("confidence"))


def fallback(levels: list[DataFrame]) -> DataFrame:
    """Hits of each query from the first level that has any, with ``level``."""
    all_levels = None
    for i, hits in enumerate(levels):
        marked = hits.select("query_id", "document_id", "score", F.lit(i).alias("level"))
        all_levels = marked if all_levels is None else all_levels.unionByName(marked)
    first = all_levels.groupBy("query_id").agg(F.min("level").alias("level"))
    return all_levels.join(first, ["query_id", "level"])


def fallback_confidence(level: Column) -> Column:
    return F.when(level == 1, "low").when(level == 2, "speculative").when(level >= 3, "none")


def partial(search: Callable[[DataFrame], DataFrame], queries: DataFrame, top: int = 5, limit: int = 10) -> DataFrame:
    """Every word of three characters or more searched by itself; of each word the ``top`` hits, of each document its best."""
    words = F.transform(F.filter(F.split("query", r"\s+"), lambda w: F.length(w) >= 3), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    asked = queries.select("query_id", F.posexplode(F.array_distinct(F.transform(words, lambda s: s["w"])))).select(F.struct("query_id", "pos").alias("query_id"), F.col("col").alias("query"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id")
    best = search(asked).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    one = best.groupBy(F.col("query_id.query_id").alias("query_id"), "document_id").agg(F.min_by("score", F.col("query_id.pos")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
