"""Text as column expressions: identifiers, cleaning, chunk windows, tokens and snippets.

Regular expressions spell white space out as [ \\t\\n\\f\\r] and use \\z, so that they mean the same in engines with other rules.
Sizes are in characters. Null texts give nulls unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: White space that is trimmed.
SPACE = " \t\n\x0b\x0c\r"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def replaced(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row: what a function of an array's elements refers to else is computed for each of these."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


# identifiers


def hash_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, 16))


def document_id(path: Column) -> Column:
    return hash_id("doc_", path)


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    return hash_id("chunk_", F.concat(document, F.lit(":"), index.cast("string"), F.lit(":"), content))


def canonical_name(name: Column) -> Column:
    return F.regexp_replace(trimmed(F.lower(name)), r"[ \t\n\f\r]+", " ")


def entity_id(name: Column, kind: Column) -> Column:
    return hash_id("ent_", F.concat(canonical_name(name), F.lit("|"), kind))


def scoped_entity_id(name: Column, kind: Column, document: Column) -> Column:
    return hash_id("ent_", F.concat(name, F.lit("|"), kind, F.lit("|"), document))


def relation_id(subject: Column, predicate: Column, object_: Column) -> Column:
    return hash_id("rel_", F.concat(subject, F.lit("|"), predicate, F.lit("|"), object_))


# paths, names, types


def glob_regex(glob: str) -> str:
    """A file-name pattern (``*``, ``?``, ``[...]``) as a regular expression over the whole name; ``.pdf`` means ``*.pdf``."""
    glob = "*" + glob if glob.startswith(".") and "*" not in glob and glob.count(".") == 1 else glob
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := glob.find("]", i + 1)) > 0:
            out += glob[i : end + 1]
            i = end
        else:
            out += "\\" + ch if ch in r"\.^$+(){}|[]" else ch
        i += 1
    return f"^(?:{out})\\z"


def matches_any(name: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (name.rlike(glob_regex(g)) for g in globs), F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension with its dot, or an empty text."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)\z", 1))


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in V.MIME_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text/plain"))


def content_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(V.CODE_EXTENSIONS), "code").when(ext.isin(V.MARKDOWN_EXTENSIONS), "markdown").when(ext == ".pdf", "pdf").otherwise("text")


def markdown_title(text: Column) -> Column:
    """The first ``# `` heading; empty where there is none."""
    return trimmed(F.regexp_extract(text, r"(?:^|\n)[ \t\f\r]*# ([^\n]*)", 1))


def first_line_title(text: Column) -> Column:
    """The first line that has 4 to 199 characters without the space around it; null where there is none."""
    lines = F.transform(F.split(text, "\n"), trimmed)
    return F.get(F.filter(lines, lambda x: (F.length(x) > 3) & (F.length(x) < 200)), F.lit(0))


def title(path: Column, text: Column) -> Column:
    """Markdown: its heading; PDF: its first fitting line; else, and failing that, the file name."""
    ext = extension(path)
    heading = F.when(ext == ".md", F.nullif(markdown_title(text), F.lit(""))).when(ext == ".pdf", first_line_title(text))
    return F.coalesce(heading, file_name(path))


# cleaning


def fix_ocr(c: Column) -> Column:
    return replaced(c, [(rf"(?i)\b{a}\b", b) for a, b in V.OCR_WORDS] + V.OCR_MARKS)


def fix_pdf(c: Column) -> Column:
    """Broken words joined, lines that hold only a page number emptied, form feeds as line ends."""
    return replaced(
        c,
        [
            (r"(\w)-[ \t\n\f\r]*\n[ \t\n\f\r]*(\w)", "$1$2"),
            (r"(\w[A-Za-z])[ \t\n\f\r]*\n[ \t\n\f\r]*([a-z]\w)", "$1$2"),
            (r"(?m)(?d)^[ \t\n\f\r]*\d{1,4}[ \t\n\f\r]*$", ""),
            (r"\f", "\n"),
        ],
    )


def drop_boilerplate(c: Column) -> Column:
    return replaced(c, [(p.replace("(?m)", "(?m)(?d)"), " ") for p in V.BOILERPLATE])


def drop_result_boilerplate(c: Column) -> Column:
    out = replaced(c, [(p.replace("(?m)", "(?m)(?d)"), " ") for p in V.RESULT_BOILERPLATE])
    return trimmed(replaced(out, [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]))


def normal_space(c: Column) -> Column:
    squeezed = replaced(c, [(r"\t", " "), (r"[ ]+", " "), (r"\n{3,}", "\n\n")])
    return trimmed(F.array_join(F.transform(F.split(squeezed, "\n"), trimmed), "\n"))


def clean(c: Column, pdf: bool = False) -> Column:
    """The cleaning that comes before hashing and chunking."""
    return normal_space(drop_boilerplate(fix_pdf(fix_ocr(c)) if pdf else c))


def pdf_text(c: Column) -> Column:
    """The lighter cleaning of the PDF chunker."""
    return trimmed(
        replaced(c, [(r"(\w)-[ \t]*\n[ \t]*(\w)", "$1$2"), (r"\f", "\n\n"), (r"[ \t]+", " "), (r"(?m)(?d)^[ \t\n\f\r]*\d+[ \t\n\f\r]*$", ""), (r"\n{3,}", "\n\n")])
    )


def repeated_lines(c: Column) -> Column:
    """The lines that a text repeats so often that they are headers or footers: an array, empty for texts under 20 lines."""
    lines = F.transform(F.split(c, "\n"), trimmed)
    least = F.when(F.size(lines) > 100, F.floor(F.size(lines) / 30)).otherwise(F.lit(3))
    long = F.filter(lines, lambda x: (F.length(x) > 5) & (F.length(x) < 100))
    often = F.filter(F.array_distinct(long), lambda x: F.size(long) - F.size(F.array_remove(long, x)) >= least)
    return F.when(F.size(lines) >= 20, often).otherwise(F.array().cast("array<string>"))


def without_repeated_lines(c: Column) -> Column:
    gone = repeated_lines(c)
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~F.array_contains(gone, trimmed(x))), "\n")


# chunks


def windows(n: Column, size: int, overlap: int) -> Column:
    """Begin and end of the fixed windows over ``n`` characters, the last being the overlap alone."""
    overlap = overlap if overlap > 0 else 100
    step = size - overlap if size > overlap else size
    tail = F.array(F.struct((n - F.lit(overlap)).cast("int").alias("begin"), n.cast("int").alias("end")))
    last = F.ceil((n - F.lit(size)) / F.lit(step)).cast("int")
    full = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct((k * step).cast("int").alias("begin"), F.least(k * step + size, n).cast("int").alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("begin"), n.cast("int").alias("end")))
    return F.when(n == 0, F.array().cast("array<struct<begin:int,end:int>>")).when(n <= size, whole).otherwise(F.concat(full, tail) if size > overlap else full)


def chunk_ready(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, "\r\n", "\n"))


def fixed_chunks(c: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Chunks as structs (index, begin, end, content): trimmed windows; blank ones are left out and take no index."""

    def cut(text: Column, n: Column) -> Column:
        parts = F.transform(windows(n, size, overlap), lambda w: F.struct(w["begin"].alias("begin"), w["end"].alias("end"), trimmed(F.substr(text, w["begin"] + 1, w["end"] - w["begin"])).alias("content")))
        full = F.filter(parts, lambda w: w["content"] != "")
        return F.transform(full, lambda w, i: F.struct(i.alias("index"), w["begin"].alias("begin"), w["end"].alias("end"), w["content"].alias("content")))

    return F.when(c.isNotNull(), once(chunk_ready(c), lambda text: once(F.length(text), lambda n: cut(text, n))))


#: Separators in order of preference.
SEPARATORS = ["\n\n", "\n", ". ", " "]


def best_split(text: str, most: int, separators: list[str] = SEPARATORS) -> int:
    """Where to cut a text that is longer than ``most`` characters: after the last of the first separator that lies within it, else hard."""
    if len(text) <= most:
        return len(text)
    for s in separators:
        at = text.rfind(s, 0, most)
        if at > 0:
            return at + len(s)
    return most


def smart_chunks(c: Column, size: int = 1000) -> Column:
    """Chunks cut at separators, each as long as ``size`` allows, without overlap: an array of trimmed texts; of a null text null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts, at = [], 0
            while t is not None and at < len(t):
                n = best_split(t[at : at + size + 1], size)
                parts.append(t[at : at + n].strip(SPACE))
                at += n
            out.append(None if t is None else [p for p in parts if p])
        return pd.Series(out, dtype=object)

    return run(chunk_ready(c))


def leading_int(c: Column) -> Column:
    """The number that a text begins with; 0 where it begins with none."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(\d{1,18})", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def citation(path: Column, page: Column) -> Column:
    """A file's name, with the page where it is known."""
    return F.concat(file_name(path), F.when(leading_int(page) > 0, F.concat(F.lit(", page "), leading_int(page).cast("string"))).otherwise(""))


def chunk_estimate(n: Column, size: int, overlap: int) -> Column:
    return F.when(n <= size, F.lit(1)).otherwise(F.floor((n - F.lit(overlap)) / F.lit(size - overlap)) + 1).cast("int")


def sentences(c: Column) -> Column:
    """Sentences: an end is one of ``.!?`` before white space and a capital, a quote or a bracket; a line end always is one."""
    parts = F.split(c, r"(?<=[.!?])[ \t\n\f\r]+(?=[\p{Lu}\"'(\[])|\n+")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def overlap_text(c: Column, overlap: int) -> Column:
    """The end of a chunk that starts the next: its last characters, from a sentence's start on where one lies in them."""
    end = F.when(F.length(c) <= overlap, c).otherwise(F.right(c, F.lit(overlap)))
    at = F.locate(". ", end)
    return F.when((at > 1) & (at - 1 < F.length(end) - 10), F.substr(end, at + 2, F.length(end))).otherwise(end)


def sentence_chunks(c: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Sentences packed greedily into chunks; each chunk but the first starts with the end of the one before."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        flush = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) + 1 > size)
        done = F.when(flush, F.concat(acc["done"], F.array(trimmed(acc["open"])))).otherwise(acc["done"])
        carried = overlap_text(acc["open"], overlap)
        start = F.when(flush, F.when(F.lit(overlap > 0) & (carried != ""), F.concat(carried, F.lit(" "))).otherwise(F.lit(""))).when(acc["open"] != "", F.concat(acc["open"], F.lit(" "))).otherwise(F.lit(""))
        return F.struct(done.alias("done"), F.concat(start, s).alias("open"))

    whole = chunk_ready(c)
    packed = F.aggregate(sentences(whole), empty, add, lambda acc: F.when(trimmed(acc["open"]) != "", F.concat(acc["done"], F.array(trimmed(acc["open"])))).otherwise(acc["done"]))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.length(whole) <= size, F.array(whole)).otherwise(packed)


# tokens


def tokens(c: Column) -> Column:
    """Index tokens: runs of letters and digits, in lower case and without marks; of a null text none."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), V.MARKED, V.PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def graph_tokens(c: Column) -> Column:
    """Tokens of a graph query: no stop words, no single characters, pairs only of letters; each once, in order."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\-\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(V.STOP_WORDS) & ((F.length(w) > 2) | w.rlike(r"^[a-z]{2}\z"))))


def similarity_tokens(c: Column) -> Column:
    """Tokens of a snippet for diversification: lower case, without marks at the ends, of three characters or more."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.btrim(w, F.lit(V.WORD_MARKS)))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


# snippets


def snippet(text: Column, terms: Column, around: int = 150, most: int = 300) -> Column:
    """The text around the earliest place of a term (an array in lower case), with dots where it is cut; the beginning where no term occurs."""
    return once(F.lower(text), lambda low: once(F.length(text), lambda n: snippet_around(text, low, n, terms, around, most)))


def snippet_around(text: Column, low: Column, n: Column, terms: Column, around: int = 150, most: int = 300) -> Column:
    """As ``snippet``, of a text whose lower case and length are known."""
    places = F.filter(F.transform(terms, lambda t, i: F.struct(F.position(t, low).alias("at"), i.alias("i"), F.length(t).alias("n"))), lambda p: p["at"] > 0)

    def shown(first: Column) -> Column:
        at = first["at"] - 1
        begin = F.greatest(at - around, F.lit(0))
        end = F.least(at + first["n"] + around, n)
        around_it = F.concat(F.when(begin > 0, "...").otherwise(""), F.substr(text, begin + 1, end - begin), F.when(end < n, "...").otherwise(""))
        head = F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))
        return F.when(at.isNull(), head).otherwise(around_it)

    return once(F.array_min(places), shown)


def semantic_snippet(text: Column, most: int = 300) -> Column:
    """A text cut at its last sentence end in the second half, else its last space in the last quarter, else hard; the latter two get dots."""
    cut = F.substring(text, 1, most)
    stop = F.length(F.regexp_extract(cut, r"^([\s\S]*[.!?])", 1))
    space = F.length(F.regexp_extract(cut, r"^([\s\S]*) ", 1))
    return (
        F.when(F.length(text) <= most, text)
        .when(stop - 1 >= most // 2, F.substr(cut, F.lit(1), stop))
        .when(space >= most * 3 // 4, F.concat(F.substr(cut, F.lit(1), space), F.lit("...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def bytes_text(n: Column) -> Column:
    """A number of bytes as text, in steps of 1024."""
    units = "KMGTPE"
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, u in enumerate(units):
        part = F.format_string(f"%.1f {u}B", n / F.lit(float(1024 ** (i + 1))))
        out = out.when(n < F.lit(float(1024 ** (i + 2))), part) if u != units[-1] else out.when(n.isNotNull(), part)
    return out
