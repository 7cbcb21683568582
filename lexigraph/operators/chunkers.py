"""Chunkers that follow structure: code blocks, Markdown sections, PDF paragraphs.

Block starts are found with column expressions; blocks that are too long fall back to the fixed or the sentence chunker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

_BLOCK = "struct<kind:string,lines:array<string>>"


def _grouped(lines: Column, start_kind) -> Column:
    """Lines gathered into blocks: ``start_kind`` of a line is the kind of the block it starts, or null."""

    def add(acc: Column, line: Column) -> Column:
        kind = start_kind(line)
        fresh = F.array(F.struct(kind.alias("kind"), F.array(line).alias("lines")))
        last = F.element_at(acc, -1)
        longer = F.array(F.struct(last["kind"].alias("kind"), F.concat(last["lines"], F.array(line)).alias("lines")))
        first = F.array(F.struct(F.coalesce(kind, F.lit("")).alias("kind"), F.array(line).alias("lines")))
        return F.when(F.size(acc) == 0, first).when(kind.isNotNull(), F.concat(acc, fresh)).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer))

    return F.aggregate(lines, F.array().cast(f"array<{_BLOCK}>"), add)


def code_start(ext: Column, line: Column) -> Column:
    """``class``, ``function`` or null for a line of code of a known language."""
    bare = T.trimmed(line)
    out = F.lit(None).cast("string")
    for e, (function, klass) in V.CODE_STARTS.items():
        out = F.when((ext == e) & bare.rlike(klass), "class").when((ext == e) & bare.rlike(function), "function").otherwise(out)
    return out


def code_blocks(content: Column, ext: Column) -> Column:
    """Blocks (kind, content) of code; of other languages the parts between blank lines."""
    known = reduce(lambda a, b: a | b, (ext == e for e in V.CODE_STARTS))
    by_start = F.transform(_grouped(F.split(content, "\n"), lambda line: code_start(ext, line)), lambda b: F.struct(b["kind"].alias("kind"), F.array_join(b["lines"], "\n").alias("content")))
    by_gap = F.transform(F.split(content, r"\n{2,}"), lambda p: F.struct(F.lit("block").alias("kind"), T.trimmed(p).alias("content")))
    return F.filter(F.when(known, by_start).otherwise(by_gap), lambda b: T.trimmed(b["content"]) != "")


def markdown_sections(content: Column) -> Column:
    """Sections (kind: the heading, empty before the first; content)."""
    heading = lambda line: F.when(line.rlike(r"^#{1,6} "), T.trimmed(F.regexp_replace(line, r"^#{1,6} ", "")))
    return F.transform(_grouped(F.split(content, "\n"), heading), lambda b: F.struct(b["kind"].alias("kind"), F.array_join(b["lines"], "\n").alias("content")))


def _line_paragraphs(content: Column) -> Column:
    """Lines joined until a blank one, or until one that ends with a full stop, makes more than 100 characters and is followed by a capital. A leading byte of C2 to DE, but D7, counts as a capital."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def add(s: Column, line: Column) -> Column:
        ends = s["open"].endswith(".") & (F.length(s["open"]) > 100) & line.rlike(r"^[A-Z\u0080-\u05BF\u0600-\u07BF]")
        end = (line == "") | ends
        done, rest = F.when(end, closed(s)).otherwise(s["done"]), F.when(end, "").otherwise(s["open"])
        return F.struct(done.alias("done"), F.when(rest == "", line).when(line == "", rest).otherwise(F.concat(rest, F.lit(" "), line)).alias("open"))

    return F.aggregate(F.transform(F.split(content, "\n"), T.trimmed), start, add, closed)


def pdf_paragraphs(content: Column) -> Column:
    """Blocks between blank lines of more than 20 characters; where a text of more than 500 has fewer than three of them, its lines joined to paragraphs follow."""
    blocks = F.filter(F.transform(F.split(content, r"\n{2,}"), T.trimmed), lambda p: F.length(p) > 20)
    return F.when((F.size(blocks) < 3) & (F.length(content) > 500), F.concat(blocks, _line_paragraphs(content))).otherwise(blocks)


def packed(parts: Column, size: int, glue: str = "\n\n") -> Column:
    """Parts joined greedily into texts of at most ``size`` characters; a longer part stands alone."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + len(glue) + F.length(p) <= size)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(glue), p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def chunk_by_type(documents: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``document_id, chunk_index, block, content`` of ``documents (document_id, path, content)``, each cut as its kind of content asks."""
    text = T.chunk_ready(F.col("content"))
    kind, ext = T.content_type(F.col("path")), T.extension(F.col("path"))
    typed = documents.select("document_id", kind.alias("kind"), ext.alias("ext"), text.alias("content")).filter(F.col("content") != "")
    one = lambda c: F.struct(F.lit("").alias("kind"), c.alias("content"))
    content = F.col("content")
    large = (
        F.when(F.col("kind") == "code", code_blocks(content, F.col("ext")))
        .when(F.col("kind") == "markdown", markdown_sections(content))
        .when(F.col("kind") == "pdf", F.transform(packed(pdf_paragraphs(T.pdf_text(content)), size), one))
        .otherwise(F.array(one(content)))
    )
    cut_up = typed.select("document_id", ((F.col("kind") == "code") & (F.length(content) > size)).alias("fixed"), F.when(F.length(content) <= size, F.array(one(content))).otherwise(large).alias("blocks"))
    blocks = cut_up.select("document_id", "fixed", F.posexplode("blocks").alias("b", "block"))
    body = F.col("block.content")
    fixed = F.transform(T.fixed_chunks(body, size, overlap), lambda c: c["content"])
    cut = F.when(F.length(body) <= size, F.array(T.trimmed(body))).when(F.col("fixed"), fixed).otherwise(T.sentence_chunks(body, size, overlap))
    flat = blocks.select("document_id", "b", F.col("block.kind").alias("kind"), F.posexplode(F.filter(cut, lambda c: c != "")).alias("i", "content"))
    listed = flat.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("b", "i", "kind", "content"))).alias("all"))
    return listed.select("document_id", F.posexplode("all").alias("chunk_index", "c")).select("document_id", "chunk_index", F.col("c.kind").alias("block"), F.col("c.content").alias("content"))
