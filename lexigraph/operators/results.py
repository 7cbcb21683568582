"""Result processing: hits merged by document, overlaps removed, boilerplate filtered, context for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def join_parts(parts: Column, least: int = 10, most: int = 150) -> Column:
    """An array of texts as one: where a text's end is the next one's beginning (``least`` to ``most`` characters), that is kept once, else a blank line stands between."""
    full = F.filter(F.transform(parts, T.trimmed), lambda p: p != "")

    def add(acc: Column, part: Column) -> Column:
        lengths = F.sequence(F.lit(least), F.lit(most))
        fits = F.filter(lengths, lambda n: (n <= F.length(acc)) & (n <= F.length(part)) & (F.right(acc, n) == F.left(part, n)))
        shared = F.coalesce(F.array_max(fits), F.lit(0))
        return F.when(acc == "", part).when(shared > 0, F.concat(acc, F.lit(" "), F.substr(part, shared + 1, F.length(part)))).otherwise(F.concat(acc, F.lit("\n\n"), part))

    return F.aggregate(full, F.lit(""), add)


def by_document(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, document_id, score, chunk_count, title, file, content`` of chunk hits ``(query_id, document_id, chunk_index, score, snippet)``.

    The score is the mean of the hits'; chunks are merged in the order of their index.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "snippet")))
    merged = hits.groupBy("query_id", "document_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("chunk_count"), ordered.alias("parts"))
    content = T.drop_result_boilerplate(join_parts(F.transform("parts", lambda p: p["snippet"])))
    facts = documents.select("document_id", "title", T.file_name(F.col("path")).alias("file"))
    return merged.join(facts, "document_id").select("query_id", "document_id", "score", "chunk_count", "title", "file", content.alias("content"))


def document_text(chunks: DataFrame) -> DataFrame:
    """``document_id, content``: chunks joined by their offsets, so nothing is doubled and nothing is lost but trimmed space."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "start_char", "end_char", "content")))
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def add(acc: Column, c: Column) -> Column:
        skip = F.greatest(acc["end"] - c["start_char"], F.lit(0))
        text = F.when(c["end_char"] <= acc["end"], acc["text"]).otherwise(F.concat(acc["text"], F.substr(c["content"], skip + 1, F.length(c["content"]))))
        return F.struct(text.alias("text"), F.greatest(acc["end"], c["end_char"]).alias("end"))

    return chunks.groupBy("document_id").agg(F.aggregate(ordered, zero, add)["text"].alias("content"))


def prompt_context(results: DataFrame) -> DataFrame:
    """``query_id, context``: the documents of each query, best first, as Markdown."""
    block = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n*Source: "), F.coalesce("file", F.lit("")), F.lit("*\n\n"), F.col("content"), F.lit("\n"))
    listed = results.select("query_id", F.struct((-F.round("score", 9)).alias("s"), F.col("document_id").alias("d"), block.alias("b")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n---\n\n")
    return listed.groupBy("query_id").agg(F.concat(F.lit("## Relevant Context\n\n"), body).alias("context"))
