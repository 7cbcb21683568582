"""Query understanding, as columns over a table of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def is_quoted(query: Column) -> Column:
    return query.contains('"') | query.contains("'")


def _any(query: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (query.rlike(p) for p in patterns))


def entities(query: Column) -> Column:
    """Struct (singles, nouns): capitalised words that stand for entities, and runs of two or more of them; each once."""
    words = F.filter(F.transform(F.filter(F.split(query, r"[ \t\n\f\r]+"), lambda w: w != ""), lambda w, i: F.struct(F.btrim(w, F.lit(V.WORD_MARKS)).alias("w"), i.alias("i"))), lambda s: s["w"] != "")
    capital = lambda s: s["w"].rlike(r"^\p{Lu}") & (F.length(s["w"]) > 1) & ~(s["w"].isin(V.SKIP_WORDS) & (s["i"] > 0))
    singles = F.array_distinct(F.transform(F.filter(words, lambda s: capital(s) & (F.length(s["w"]) >= 3) & ~s["w"].isin(V.SKIP_WORDS)), lambda s: s["w"]))
    line = F.array_join(F.transform(words, lambda s: F.when(capital(s), s["w"]).otherwise(F.lit("\n"))), "\t")
    nouns = F.array_distinct(F.transform(F.filter(F.transform(F.split(line, "\n"), lambda r: F.btrim(r, F.lit("\t"))), lambda r: r.contains("\t")), lambda r: F.regexp_replace(r, "\t", " ")))
    return F.struct(singles.alias("singles"), nouns.alias("nouns"))


def query_type(query: Column, has_entities: Column) -> Column:
    return (
        F.when(is_quoted(query), "exact_quote").when(_any(query, V.CONCEPTUAL), "conceptual").when(_any(query, V.FACTUAL), "factual").when(has_entities, "entity").otherwise("exploratory")
    )


def analyze(queries: DataFrame) -> DataFrame:
    """``query_id, query, query_type, mode, entities, proper_nouns, semantic_weight, lexical_weight`` of ``queries (query_id, query)``."""
    found = queries.select("query_id", "query", entities(F.col("query")).alias("e"))
    all_entities = F.array_sort(F.array_union("e.singles", "e.nouns"))
    kind = query_type(F.col("query"), (F.size("e.singles") > 0) | (F.size("e.nouns") > 0))
    out = found.select("query_id", "query", kind.alias("query_type"), F.when(is_quoted(F.col("query")), "lexical").otherwise("fusion").alias("mode"), all_entities.alias("entities"), F.col("e.nouns").alias("proper_nouns"))
    weights = F.create_map(*(x for k, (s, l) in V.WEIGHTS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(l).alias("l")))))
    picked = F.element_at(weights, F.col("query_type"))
    return out.withColumn("semantic_weight", picked["s"]).withColumn("lexical_weight", picked["l"])
