"""Folders of files as documents: scan, text extraction, and the tables of a collection.

A mounted folder is read with the data source ``folder``, which enters no excluded folder; any other store that Spark reads with Spark's binary-file source. Extraction never stops at a bad file: its text is null.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import folder as folders

#: Fixed value: the largest file that is read.
MOST_BYTES = 100 * 1024 * 1024
#: Elements that end a line, by local name.
_BREAKS = {"docx": {"p", "br"}, "odt": {"p", "h", "line-break"}}


def _walk(node: ET.Element, kind: str, out: list[str]) -> None:
    name = node.tag.rpartition("}")[2]
    if kind == "docx":
        if name == "t":
            out.append(node.text or "")
    elif name == "tab":
        out.append("\t")
    elif name == "s":
        out.append(" ")
    elif node.text:
        out.append(node.text)
    for child in node:
        _walk(child, kind, out)
        if kind == "odt" and child.tail:
            out.append(child.tail)
    if name in _BREAKS[kind]:
        out.append("\n")


def archive_text(content: bytes, kind: str) -> str | None:
    """The text of a DOCX or ODT archive; null if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml" if kind == "docx" else "content.xml"))
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, KeyError, ET.ParseError, ValueError):  # damaged, encrypted, unknown compression, not the format
        return None
    body = root if kind == "docx" else next((e for e in root.iter() if e.tag.rpartition("}")[2] == "body"), root)
    out: list[str] = []
    _walk(body, kind, out)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def _archives(content: Column, kind: Column) -> Column:
    @F.pandas_udf("string")
    def run(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([archive_text(c, k) if c is not None else None for c, k in zip(content, kind)], dtype=object)

    return run(content, kind)


def converted_rtf(c):
    """Text that a converter made of RTF, without its header lines and tags."""
    return T.trimmed(F.regexp_replace(F.regexp_replace(c, r"(?m)(?d)^(###.*|-\*-.*)$\n?", ""), r"<[^>]*>", ""))


def chosen(files: DataFrame, folder: str, patterns: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """``path, name, size, modified_at, content`` of rows of Spark's binary-file source, by name pattern, without excluded folders below ``folder``."""
    patterns, excludes = patterns or V.DEFAULT_PATTERNS, excludes if excludes is not None else V.DEFAULT_EXCLUDES
    base = F.regexp_replace("path", r"^[a-z]+:(//)?", "")
    below = F.slice(F.split(base, "/"), 1, F.size(F.split(base, "/")) - 1)
    root = len(re.sub(r"^[a-z]+:(//)?", "", folder).rstrip("/").split("/"))
    inner = F.slice(below, root + 1, F.greatest(F.size(below) - root, F.lit(0)))
    out = files.withColumn("name", T.file_name(F.col("path"))).filter(T.matches_any(F.col("name"), patterns))
    if excludes:
        out = out.filter(~F.exists(inner, lambda d: reduce(lambda a, b: a | b, (d.rlike(T.glob_regex(e)) if "*" in e else d == e for e in excludes))))
    return out.filter(F.col("length") <= MOST_BYTES).select("path", "name", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def scan(spark: SparkSession, folder: str, patterns: list[str] | None = None, excludes: list[str] | None = None, content: bool = True, paths: list[str] | None = None) -> DataFrame:
    """``path, name, size, modified_at, content, error`` of the files of a folder and those below it, or of those of ``paths`` among them; without ``content`` that column is null and no file is opened.

    In a mounted folder (a plain path, or one of ``file:``), excluded folders are not entered, and a file that can't be read is a row with its error. Other stores are listed whole by Spark, and there such a file ends the job.
    """
    patterns, excludes = patterns or V.DEFAULT_PATTERNS, excludes if excludes is not None else V.DEFAULT_EXCLUDES
    if folder.startswith(("/", "file:")):
        return folders.read(spark, folder, patterns, excludes, MOST_BYTES, content, paths=paths)
    found = chosen(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder if paths is None else paths), folder, patterns, excludes)
    return found.withColumn("error", F.lit(None).cast("string")) if content else found.withColumns({"content": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")})


def documents(files: DataFrame, source_id: str) -> DataFrame:
    """Cleaned documents of scanned files: ``document_id, source_id, path, title, mime_type, size, modified_at, hash, content``."""
    ext = T.extension(F.col("path"))
    raw = F.when(ext.isin(".docx", ".odt"), _archives(F.col("content"), F.substring(ext, 2, 4))).otherwise(F.make_valid_utf8(F.decode("content", "UTF-8")))
    text = files.withColumn("raw", raw)
    cleaned = F.when(ext == ".pdf", T.clean(F.col("raw"), pdf=True)).otherwise(T.clean(F.col("raw")))
    return text.withColumn("clean", cleaned).select(
        T.document_id(F.col("path")).alias("document_id"),
        F.lit(source_id).alias("source_id"),
        "path",
        T.title(F.col("path"), F.col("raw")).alias("title"),
        T.mime_type(F.col("path")).alias("mime_type"),
        "size",
        "modified_at",
        F.sha2("clean", 256).alias("hash"),
        F.col("clean").alias("content"),
    )


def extractors() -> dict[str, bool]:
    """What can be read here: plain text and archives always; formats of other programs not."""
    return {"text": True, "docx": True, "odt": True, "pdf": False, "doc": False, "rtf": False}


def capabilities(has_index: bool, has_vectors: bool) -> str:
    """The search mode that the tables at hand allow."""
    return "hybrid" if has_index and has_vectors else "lexical" if has_index else "none"


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a table of the collection, partitioned by source where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
