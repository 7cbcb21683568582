"""Registered queries: each operator over whole test tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import chunkers, control, dictionary, embedding, evaluate, fusion, graph, index, lexical, query, results, segments, vector, vector_index
from ..sources.shared import written
from ..sources.snapshots import SnapshotStore
from ..streaming import events as stream_events
from . import api, ingest
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of too few row groups for the task slots, dealt out over all of them, as a row group is read by one task; others as they are: texts are not shuffled for nothing."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(slots) if len(files) < slots and _row_groups(df.sparkSession, files) * 2 < slots else df


def _row_groups(spark: SparkSession, files: list[str]) -> int:
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf))
        n += reader.getFooter().getBlocks().size()
        reader.close()
    return n


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return api.collection(spread(read(spark, sf, "documents")))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The first three words of every benchmark item, as queries."""
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))


# identity, statistics, synchronisation


@registered(f"WITH {S.DOCS} SELECT doc_id, document_id, title, sha256(content) AS content_hash, CAST(size AS INTEGER) AS size FROM docs")
def doc_ids_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", "document_id", "title", F.sha2("content", 256).alias("content_hash"), "size")


@registered(f"WITH {S.DOCS} SELECT sha256(content) AS content_hash, count(*) AS copies, min(document_id) AS first_document FROM docs GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return index.exact_duplicates(docs(spark, sf))


@registered(f"WITH {S.DOCS}, {S.CHUNKS} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT source_id) FROM docs) AS sources, (SELECT CAST(sum(size) AS BIGINT) FROM docs) AS total_bytes")
def kb_index_stats(spark, sf):
    d = docs(spark, sf)
    return index.index_stats(d, index.chunk_table(d))


@registered(f"WITH {S.DOCS} SELECT source_id, count(*) AS doc_count, CAST(sum(size) AS BIGINT) AS size_bytes FROM docs GROUP BY ROLLUP (source_id)")
def source_rollup(spark, sf):
    return index.source_rollup(docs(spark, sf))


def _amount(e: str) -> str:
    steps = "".join(f" WHEN {e} < {1024 ** (i + 2)} THEN printf('%.1f {u}B', {e} / {float(1024 ** (i + 1))})" for i, u in enumerate("KMGTP"))
    return f"CASE WHEN {e} < 1024 THEN {e} || ' B'{steps} END"


@registered(f"WITH {S.DOCS}, t AS (SELECT source_id, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY source_id) SELECT source_id, {_amount('n')} AS stored, {_amount('n * 1048576')} AS million_fold FROM t")
def bytes_text(spark, sf):
    sizes = docs(spark, sf).groupBy("source_id").agg(F.sum("size").alias("n"))
    return sizes.select("source_id", T.bytes_text(F.col("n")).alias("stored"), T.bytes_text(F.col("n") * 1048576).alias("million_fold"))


def _states(spark, sf):
    """A scan, and an older state: unlabelled documents are new, those of low quality had another content, benchmark items have vanished."""
    d = docs(spark, sf).join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    scan = d.select("path", F.sha2("content", 256).alias("hash"))
    known = d.filter("quality is not null").select("path", F.when(F.col("quality") == 1, F.sha2("content", 256)).otherwise(F.sha2(F.concat("content", F.lit("!")), 256)).alias("hash"))
    gone = read(spark, sf, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"))
    return scan, known.unionByName(gone)


_SYNC = f"""WITH {S.DOCS}, marked AS (SELECT d.*, l.quality FROM docs d LEFT JOIN labels l USING (doc_id)),
scan AS (SELECT path, sha256(content) AS hash FROM marked),
known AS (SELECT path, CASE WHEN quality = 1 THEN sha256(content) ELSE sha256(content || '!') END AS hash FROM marked WHERE quality IS NOT NULL
  UNION ALL SELECT 'benchmark/' || CAST(item_id AS VARCHAR), sha256(text) FROM benchmark),
diff AS (SELECT path, CASE WHEN s.hash IS NULL THEN 'deleted' WHEN k.hash IS NULL THEN 'added' WHEN s.hash <> k.hash THEN 'updated' ELSE 'unchanged' END AS status FROM scan s FULL OUTER JOIN known k USING (path))"""


@registered(_SYNC + " SELECT path, status FROM diff")
def sync_diff(spark, sf):
    return index.sync_diff(*_states(spark, sf))


@registered(_SYNC + " SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "updated", "unchanged", "deleted", "error")) + " FROM diff")
def sync_summary(spark, sf):
    return index.sync_summary(index.sync_diff(*_states(spark, sf)))


@registered(f"WITH {S.DOCS} SELECT d.doc_id, d.source_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality FROM docs d LEFT JOIN labels l USING (doc_id) WHERE d.source_id <> 'src0'")
def remove_source_cascade(spark, sf):
    d = docs(spark, sf)
    labels = read(spark, sf, "labels").join(d.select("doc_id", "document_id"), "doc_id")
    _, left, kept = index.delete_source("src0", d.select("source_id").distinct(), d, labels)
    return left.select("doc_id", "source_id").join(kept.select("doc_id", "quality"), "doc_id", "left").fillna(-1, ["quality"])


@registered(f"WITH {S.DOCS} SELECT doc_id, 'new' AS state FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'old' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def upsert_documents(spark, sf):
    d = docs(spark, sf).select("doc_id")
    new = d.join(read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return index.upsert(d.withColumn("state", F.lit("old")), new.withColumn("state", F.lit("new")), "doc_id")


# paths and titles

_NAME = "split_part(url, '/', -1)"
_EXT = rf"lower(regexp_extract({_NAME}, '(\.[^.]*)\z', 1))"


@registered(f"SELECT page_id, CASE {' '.join(f'WHEN {_EXT} = {S.lit(e)} THEN {S.lit(m)}' for e, m in V.MIME_TYPES.items())} ELSE 'text/plain' END AS mime_type, CASE WHEN list_contains({S.names(V.CODE_EXTENSIONS)}, {_EXT}) THEN 'code' WHEN list_contains({S.names(V.MARKDOWN_EXTENSIONS)}, {_EXT}) THEN 'markdown' WHEN {_EXT} = '.pdf' THEN 'pdf' ELSE 'text' END AS content_type FROM pages")
def mime_detect(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.mime_type(F.col("url")).alias("mime_type"), T.content_type(F.col("url")).alias("content_type"))


@registered(f"SELECT doc_id, {S.MARKDOWN_TITLE} AS heading, {S.FIRST_LINE} AS first_line FROM documents")
def title_extract(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.markdown_title(F.col("text")).alias("heading"), T.first_line_title(F.col("text")).alias("first_line"))


_GLOBS = [".html", "1*", "??[0-4]?*#top"]


@registered(f"SELECT page_id, url FROM pages WHERE {S.any_of(_NAME, [T.glob_regex(g) for g in _GLOBS])}")
def glob_filter(spark, sf):
    return read(spark, sf, "pages").filter(T.matches_any(T.file_name(F.col("url")), _GLOBS)).select("page_id", "url")


# cleaning and chunking

_SPACED = S.replaced("{0}", [(r"\t", " "), (r"[ ]+", " "), (r"\n{3,}", "\n\n")])


def _normal_space(e: str) -> str:
    return S.trimmed(f"array_to_string(list_transform(string_split({_SPACED.replace('{0}', e)}, chr(10)), lambda x: {S.trimmed('x')}), chr(10))")


@registered(f"SELECT doc_id, {_normal_space(S.replaced('text', [(p, ' ') for p in V.BOILERPLATE]))} AS content FROM documents")
def clean_text(spark, sf):
    return spread(read(spark, sf, "documents")).select("doc_id", T.clean(F.col("text")).alias("content"))


_PDF = [(r"(\w)-[ \t\n\f\r]*\n[ \t\n\f\r]*(\w)", "$1$2"), (r"(\w[A-Za-z])[ \t\n\f\r]*\n[ \t\n\f\r]*([a-z]\w)", "$1$2"), (r"(?m)^[ \t\n\f\r]*\d{1,4}[ \t\n\f\r]*$", ""), (r"\f", "\n")]


@registered(f"SELECT doc_id, {S.replaced('text', _PDF)} AS content FROM documents")
def pdf_artifacts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fix_pdf(F.col("text")).alias("content"))


@registered("SELECT doc_id, " + S.replaced("text", [(rf"(?i)\b{a}\b", b) for a, b in V.OCR_WORDS] + V.OCR_MARKS) + " AS content FROM documents")
def ocr_fixes(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fix_ocr(F.col("text")).alias("content"))


@registered(
    f"""WITH lines AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {S.trimmed('x')}) AS l FROM documents),
each AS (SELECT doc_id, len(l) AS n, unnest(l) AS line FROM lines WHERE len(l) >= 20)
SELECT doc_id, line FROM each WHERE length(line) > 5 AND length(line) < 100 GROUP BY doc_id, n, line HAVING count(*) >= CASE WHEN n > 100 THEN n // 30 ELSE 3 END"""
)
def repeated_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(T.repeated_lines(F.col("text"))).alias("line"))


@registered(f"WITH {S.DOCS}, {S.CHUNKS} SELECT * FROM chunks")
def chunk_fixed(spark, sf):
    return index.chunk_table(docs(spark, sf))


@registered("SELECT doc_id, CAST(CASE WHEN length(text) <= 1000 THEN 1 ELSE floor((length(text) - 100) / 900.0) + 1 END AS INTEGER) AS chunks FROM documents")
def chunk_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.chunk_estimate(F.length("text"), 1000, 100).alias("chunks"))


@registered(
    rf"""WITH cut AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\f\r]+([\p{{Lu}}"''(\[])', '\1' || chr(1) || '\2', 'g'), '[\x01\n]+') AS s FROM documents),
full_ones AS (SELECT doc_id, list_filter(list_transform(s, lambda x: {S.trimmed('x')}), lambda x: x <> '') AS s FROM cut)
SELECT doc_id, len(s) AS n, s[1] AS first, s[-1] AS last, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM full_ones"""
)
def sentence_split(spark, sf):
    s = T.sentences(F.col("text"))
    rows = read(spark, sf, "documents").select("doc_id", s.alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.try_element_at("s", F.lit(-1)).alias("last"), chars.alias("chars"))


@registered()
def chunk_sentence(spark, sf):
    return docs(spark, sf).select("document_id", F.posexplode(T.sentence_chunks(F.col("content"))).alias("chunk_index", "content"))


@registered()
def chunk_by_type(spark, sf):
    return chunkers.chunk_by_type(docs(spark, sf))


# tokens and lexical search


@registered(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, t[1] AS first FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def tokenize_terms(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first"))


@registered(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    pairs = spread(read(spark, sf, "documents")).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").count()
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("count").alias("tf"))


@registered()
def stemmed_postings(spark, sf):
    return lexical.stemmed_postings(docs(spark, sf))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


_ALL = "(SELECT * FROM matched WHERE matched = n_terms)"
_ROUNDED = "round(score, 9) DESC, document_id"


def _order():
    return [F.desc(F.round("score", 9)), F.col("document_id")]


@registered(f"WITH {S.BM25} SELECT query_id, document_id, round(score, 6) AS score, rank FROM {S.page(_ALL, 10, _ROUNDED)}")
def bm25_topk(spark, sf):
    return _shown(lexical.ranked(lexical.matches(docs(spark, sf), asked(spark, sf), top=10), 10, by=_order()))


@registered(f"WITH {S.BM25} SELECT query_id, document_id, round(score, 6) AS score, rank FROM {S.page('matched', 10, _ROUNDED)}")
def match_or(spark, sf):
    return _shown(lexical.ranked(lexical.matches(docs(spark, sf), asked(spark, sf), require_all=False, top=10), 10, by=_order()))


_FILTERED = S.BM25.replace("FROM documents)", "FROM documents WHERE source IN ('src1', 'src2', 'src3'))", 1)


@registered(f"WITH {_FILTERED} SELECT query_id, document_id, round(score, 6) AS score, rank FROM {S.page('(SELECT * FROM matched WHERE score > 1.0)', 10, _ROUNDED)}")
def bm25_filtered(spark, sf):
    some = lexical.filtered(docs(spark, sf), source_ids=["src1", "src2", "src3"])
    return _shown(lexical.ranked(lexical.matches(some, asked(spark, sf), require_all=False).filter("score > 1.0"), 10, by=_order()))


def _chunks(spark, sf):
    d = docs(spark, sf)
    return d, index.chunk_rows(d)


def _shown_chunks(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _chunk_order():
    return [F.desc(F.round("score", 9)), F.col("chunk_id")]


_CHUNK_PAGE = f"SELECT query_id, document_id AS chunk_id, round(score, 6) AS score, rank FROM {S.page(_ALL, 10, _ROUNDED)}"


@registered(f"WITH {S.BM25_CHUNKS} {_CHUNK_PAGE}")
def chunk_topk(spark, sf):
    found = lexical.matches(_chunks(spark, sf)[1], asked(spark, sf), key="chunk_id", top=10)
    return _shown_chunks(lexical.ranked(found, 10, by=_chunk_order()))


@registered(f"WITH {S.BM25_CHUNKS} {_CHUNK_PAGE}")
def stored_index_topk(spark, sf):
    """The same from a stored index of words."""
    built = lexical.TextIndex.build(_chunks(spark, sf)[1], ingest.fresh_folder(spark, "index"), stem=False)
    built.optimise()
    return _shown_chunks(lexical.ranked(built.matches(asked(spark, sf), top=10), 10, by=_chunk_order()))


@registered()
def stemmed_index_topk(spark, sf):
    """Chunks by a stored index of Porter stems; SQL has no stemmer."""
    built = lexical.TextIndex.build(_chunks(spark, sf)[1], ingest.fresh_folder(spark, "index"))
    return _shown_chunks(lexical.ranked(built.matches(asked(spark, sf), top=10), 10, by=_chunk_order()))


def _segmented(spark, stem=False):
    return segments.SegmentedIndex.create(spark, ingest.fresh_folder(spark, "segments"), stem=stem)


@registered(f"WITH {S.BM25_CHUNKS} {_CHUNK_PAGE}")
def wand_topk(spark, sf):
    """Chunks by block-max skipping, from an index of one segment."""
    return _shown_chunks(_segmented(spark).put(_chunks(spark, sf)[1]).search(asked(spark, sf), 10))


@registered(f"WITH {S.BM25_CHUNKS} SELECT query_id, document_id AS chunk_id, round(score, 6) AS score, rank FROM {S.page('matched', 10, _ROUNDED)}")
def wand_topk_or(spark, sf):
    return _shown_chunks(_segmented(spark).put(_chunks(spark, sf)[1]).search(asked(spark, sf), 10, require_all=False))


_CHANGED = S.BM25.replace(f"{S.DOCS},", S.DOCS.replace("docs AS", "docs0 AS", 1) + ", docs AS (SELECT * REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN content || ' and more' ELSE content END AS content) FROM docs0 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),", 1)


@registered(f"WITH {_CHANGED} SELECT query_id, document_id, round(score, 6) AS score, rank FROM {S.page('matched', 10, _ROUNDED)}")
def index_after_changes(spark, sf):
    """Two puts, of which the second replaces documents, a removal and a merge of the smaller segments: as if the documents that are left were indexed afresh."""
    d = docs(spark, sf).join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    built = segments.SegmentedIndex.create(spark, ingest.fresh_folder(spark, "segments"), key="document_id", stem=False)
    built = built.put(d.filter("doc_id % 2 = 0")).put(d.filter("doc_id % 2 = 1"))
    built = built.put(d.filter("quality = 1").withColumn("content", F.concat("content", F.lit(" and more")))).remove(d.filter("quality = 0").select("document_id"))
    return _shown(built.merge(2).search(asked(spark, sf), 10, require_all=False))


@registered(f"WITH {S.BM25} SELECT query_id, count(*) AS n FROM {_ALL} GROUP BY query_id")
def match_count(spark, sf):
    return lexical.matches(docs(spark, sf), asked(spark, sf)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def _snipped(src: str) -> str:
    """CTEs that add the snippet around the first query word to ``src (query, content, ...)``; the last one is snipped."""
    return f"""placed AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda t: {{'at': strpos(lower(content), t), 'n': length(t)}}), lambda p: p.at > 0 AND p.n > 0) AS ps FROM {src}),
first AS (SELECT *, list_min(list_transform(ps, lambda p: p.at)) AS at1 FROM placed),
chosen AS (SELECT *, at1 - 1 AS pos, list_filter(ps, lambda p: p.at = at1)[1].n AS n FROM first),
ends AS (SELECT *, greatest(pos - 150, 0) AS b, least(pos + n + 150, length(content)) AS e FROM chosen),
snipped AS (SELECT *, CASE WHEN pos IS NULL THEN CASE WHEN length(content) <= 300 THEN content ELSE content[1:300] || '...' END
  ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || content[b + 1:e] || CASE WHEN e < length(content) THEN '...' ELSE '' END END AS snippet FROM ends)"""


@registered(f"WITH {S.BM25}, hit AS (SELECT h.query_id, h.document_id, d.content, a.query FROM {_ALL} h JOIN docs d USING (document_id) JOIN asked a USING (query_id)), {_snipped('hit')} SELECT query_id, document_id, snippet FROM snipped")
def snippet(spark, sf):
    d, q = docs(spark, sf), asked(spark, sf)
    return lexical.with_snippets(lexical.matches(d, q).select("query_id", "document_id"), d, q).select("query_id", "document_id", "snippet")


@registered("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.') ORDER BY url, page_id LIMIT 20")
def path_prefix(spark, sf):
    return read(spark, sf, "pages").filter(F.col("url").startswith("https://m.")).orderBy("url", "page_id").limit(20).select("page_id", "url")


@registered(f"WITH {S.DOCS} SELECT DISTINCT title FROM docs WHERE len(list_filter({S.tokens('title')}, lambda t: starts_with(t, 'th'))) > 0 ORDER BY title LIMIT 5")
def suggest_titles(spark, sf):
    return lexical.suggest(docs(spark, sf), "th")


@registered(
    f"""WITH {S.DOCS}, typed AS (SELECT item_id AS query_id, substr(({S.tokens('text')})[1], 1, 2) AS prefix FROM benchmark), words AS (SELECT title, unnest({S.tokens('title')}) AS token FROM docs),
hit AS (SELECT DISTINCT query_id, title FROM typed JOIN words ON starts_with(token, prefix)) SELECT query_id, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY title) AS INTEGER) AS rank FROM hit QUALIFY rank <= 5"""
)
def suggest_indexed(spark, sf):
    """Titles for the first two characters of each benchmark item, from a sorted table of the titles' words."""
    typed = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.substring(F.get(T.tokens(F.col("text")), F.lit(0)), 1, 2).alias("prefix"))
    return dictionary.TitleIndex.build(docs(spark, sf), ingest.fresh_folder(spark, "titles")).suggest_each(typed)


@registered(
    f"WITH {S.BM25}, loose AS (SELECT query_id, document_id, score, 1 AS level FROM matched WHERE query_id NOT IN (SELECT query_id FROM {_ALL})), picked AS (SELECT query_id, document_id, score, 0 AS level FROM {_ALL} UNION ALL SELECT * FROM loose) SELECT query_id, document_id, round(score, 6) AS score, rank, CAST(level AS INTEGER) AS level, CASE level WHEN 1 THEN 'low' END AS confidence FROM {S.page('picked', 10, _ROUNDED)}"
)
def fallback_cascade(spark, sf):
    read_once = lexical.Reading(docs(spark, sf), asked(spark, sf))
    hits = fusion.fallback([read_once.matches(True, 10), read_once.matches(False, 10)])
    return lexical.ranked(hits, 10, by=_order()).select("query_id", "document_id", F.round("score", 6).alias("score"), "rank", "level", fusion.fallback_confidence(F.col("level")).alias("confidence"))


@registered()
def partial_match(spark, sf):
    d = docs(spark, sf)
    return _shown(fusion.partial(lambda q: lexical.matches(d, q), asked(spark, sf)))


# vectors


def _centroids(spark, sf):
    return vector.centroids(read(spark, sf, "embeddings"), "label", 64)


def _near(limit: int, offset: int = 0, more: str = "") -> str:
    return f"WITH {S.VECTORS}, {S.NEAR} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM near {more}) WHERE rank > {offset} AND rank <= {offset + limit}"


def _neighbours(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@registered(_near(10))
def knn_cosine(spark, sf):
    return _neighbours(vector.knn(read(spark, sf, "embeddings"), _centroids(spark, sf), 10))


@registered(_near(10, 5, "WHERE score >= 0.2"))
def knn_offset(spark, sf):
    return _neighbours(vector.knn(read(spark, sf, "embeddings"), _centroids(spark, sf), 10, 5, 0.2))


@registered(_near(10, 0, "WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def knn_filtered(spark, sf):
    mine = read(spark, sf, "embeddings").join(read(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return _neighbours(vector.knn(mine, _centroids(spark, sf), 10))


def _vector_index(spark, sf):
    return vector_index.VectorIndex.build(spread(read(spark, sf, "embeddings")), ingest.fresh_folder(spark, "vectors"))


@registered()
def knn_indexed(spark, sf):
    """The second page from an index, of vectors of some labels. SQL has no such index; the tests measure its recall."""
    return _neighbours(_vector_index(spark, sf).search(_centroids(spark, sf), 10, 5, where=F.col("label") % 2 == 0))


@registered(_near(10, 5, "WHERE vec_id IN (SELECT e.vec_id FROM embeddings e WHERE label % 2 = 0)"))
def knn_indexed_exact(spark, sf):
    return _neighbours(_vector_index(spark, sf).search(_centroids(spark, sf), 10, 5, where=F.col("label") % 2 == 0, exact=True))


@registered(
    """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT min(vec_id) AS query_id FROM v GROUP BY label),
near AS (SELECT q.query_id, v.vec_id, list_cosine_similarity(v.v, a.v) AS score FROM q JOIN v a ON a.vec_id = q.query_id JOIN v ON v.vec_id <> q.query_id)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM near) WHERE rank <= 5"""
)
def similar_docs(spark, sf):
    e = read(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("query_id"))
    return _neighbours(vector.knn(e, first.select("query_id", "vector"), 5, skip_own=True))


@registered(f"WITH {S.VECTORS}, {S.NEAR} SELECT query_id, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM near GROUP BY ALL")
def score_bands(spark, sf):
    return vector.band_counts(read(spark, sf, "embeddings"), _centroids(spark, sf))


@registered(
    r"""WITH c AS (SELECT doc_id, text, text[1:300] AS cut FROM documents),
e AS (SELECT *, length(regexp_extract(cut, '^([\s\S]*[.!?])', 1)) AS stop, length(regexp_extract(cut, '^([\s\S]*) ', 1)) AS space FROM c)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN stop - 1 >= 150 THEN cut[1:stop] WHEN space >= 225 THEN cut[1:space] || '...' ELSE cut || '...' END AS snippet FROM e"""
)
def semantic_snippet(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.semantic_snippet(F.col("text")).alias("snippet"))


# queries, fusion


def _user_turns(spark, sf):
    turns = read(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))


_ENTITY_SQL = rf"""words AS (SELECT query_id, query, list_filter(list_transform(w, lambda x: trim(x, {S.lit(V.WORD_MARKS)})), lambda x: x <> '') AS c, trim(w[1], {S.lit(V.WORD_MARKS)}) <> '' AS whole
  FROM (SELECT query_id, query, list_filter(regexp_split_to_array(query, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM turns)),
numbered AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: {{'w': c[i], 'cap': regexp_matches(c[i], '^\p{{Lu}}') AND length(c[i]) > 1 AND NOT (list_contains({S.names(V.SKIP_WORDS)}, c[i]) AND (i > 1 OR NOT whole))}}) AS s FROM words),
singles AS (SELECT *, list_distinct(list_transform(list_filter(s, lambda x: x.cap AND length(x.w) >= 3 AND NOT list_contains({S.names(V.SKIP_WORDS)}, x.w)), lambda x: x.w)) AS one,
  list_distinct(list_transform(list_filter(list_transform(string_split(array_to_string(list_transform(s, lambda x: CASE WHEN x.cap THEN x.w ELSE chr(10) END), chr(9)), chr(10)), lambda r: trim(r, chr(9))), lambda r: contains(r, chr(9))), lambda r: replace(r, chr(9), ' '))) AS many FROM numbered)"""


@registered(
    f"""WITH turns AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS query_id, text AS query FROM conversations WHERE role = 'user'), {_ENTITY_SQL}
SELECT query_id, {S.query_type('query', 'len(one) > 0 OR len(many) > 0')} AS query_type, CASE WHEN contains(query, '"') OR contains(query, '''') THEN 'lexical' ELSE 'fusion' END AS mode,
  array_to_string(list_sort(list_distinct(list_concat(one, many))), '|') AS entities FROM singles"""
)
def query_classify(spark, sf):
    return query.analyze(_user_turns(spark, sf)).select("query_id", "query_type", "mode", F.array_join("entities", "|").alias("entities"))


@registered(f"WITH t AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS query_id, {S.graph_tokens('text')} AS w FROM conversations WHERE role = 'user') SELECT query_id, len(list_distinct(w)) AS n, w[1] AS first FROM t")
def kag_tokens(spark, sf):
    rows = _user_turns(spark, sf).select("query_id", T.graph_tokens(F.col("query")).alias("w"))
    return rows.select("query_id", F.size("w").cast("long").alias("n"), F.get("w", F.lit(0)).alias("first"))


def _two_lists(spark, sf):
    """Lexical hits of the benchmark queries, and the vectors near the label centroids under the same query ids."""
    d = docs(spark, sf)
    words = lexical.ranked(lexical.matches(d, asked(spark, sf), require_all=False, top=30), 30, by=_order())
    near = vector.knn(read(spark, sf, "embeddings"), _centroids(spark, sf), 30).withColumn("query_id", F.col("query_id").cast("long"))
    near = near.join(d.select(F.col("doc_id").alias("vec_id"), "document_id"), "vec_id").select("query_id", "document_id", "rank", "score")
    return d, words, near


_FUSED = f"""{S.BM25}, {S.VECTORS}, {S.NEAR}, lexical_list AS (SELECT query_id, document_id, rank FROM {S.page('matched', 30, _ROUNDED)}),
semantic_list AS (SELECT CAST(n.query_id AS BIGINT) AS query_id, d.document_id, n.rank, n.score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM near) n JOIN docs d ON d.doc_id = n.vec_id WHERE n.rank <= 30),
fused AS (SELECT query_id, document_id, coalesce(0.5 / (60 + l.rank), 0) + coalesce(0.5 / (60 + s.rank), 0) AS score, (l.rank IS NOT NULL)::INT + (s.rank IS NOT NULL)::INT AS strategies, least(l.rank, s.rank) AS best_rank, s.score AS similarity
  FROM lexical_list l FULL OUTER JOIN semantic_list s USING (query_id, document_id))"""


@registered(f"WITH {_FUSED} SELECT query_id, document_id, round(CAST(score AS DOUBLE), 9) AS score, strategies, best_rank, round(similarity, 6) AS similarity FROM fused")
def rrf_fusion(spark, sf):
    _, words, near = _two_lists(spark, sf)
    return fusion.rrf(words, near).select("query_id", "document_id", F.round("score", 9).alias("score"), "strategies", "best_rank", F.round("similarity", 6).alias("similarity"))


_BOOSTED = f"""{_FUSED}, turns AS (SELECT query_id, query FROM asked), {_ENTITY_SQL},
named AS (SELECT query_id, list_sort(list_distinct(list_concat(one, many))) AS es FROM singles),
texts AS (SELECT f.*, n.es, d.content, d.title, d.path, a.query FROM fused f JOIN docs d USING (document_id) JOIN named n USING (query_id) JOIN asked a USING (query_id)), {_snipped('texts')},
full_text AS (SELECT *, lower(concat_ws(' ', snippet, title, path)) AS t FROM snipped),
boosted AS (SELECT query_id, document_id, strategies, best_rank, similarity, score * least(3.0, list_product(list_concat([1.0], list_transform(es, lambda e: CASE WHEN contains(t, lower(e)) THEN CASE WHEN contains(e, ' ') THEN 1.5 ELSE 1.2 END ELSE 1.0 END)))) * (1 + 0.2 * strategies / 2) AS score FROM full_text)"""


def _boosted(spark, sf):
    d, words, near = _two_lists(spark, sf)
    q = asked(spark, sf)
    named = query.analyze(q).select("query_id", "entities")
    hits = lexical.with_snippets(fusion.rrf(words, near), d, q).join(d.select("document_id", "path", "title"), "document_id").join(named, "query_id")
    score = fusion.entity_boost(F.col("score"), F.col("entities"), F.concat_ws(" ", "snippet", "title", "path"))
    return hits.withColumn("score", fusion.agreement_boost(score, F.col("strategies")))


@registered(f"WITH {_BOOSTED} SELECT query_id, document_id, round(CAST(score AS DOUBLE), 9) AS score FROM boosted")
def fusion_boosts(spark, sf):
    return _boosted(spark, sf).select("query_id", "document_id", F.round("score", 9).alias("score"))


_TOP = f"{_BOOSTED}, floored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 12) DESC, best_rank, document_id) AS r FROM boosted WHERE score >= 0.008) WHERE r <= 20)"


@registered(f"WITH {_TOP} SELECT query_id, document_id, round(CAST(score * (1 + coalesce(similarity, 0)) AS DOUBLE), 9) AS score FROM floored")
def floor_rerank(spark, sf):
    return fusion.rerank(fusion.floored(_boosted(spark, sf), 0.008), 20).select("query_id", "document_id", F.round("score", 9).alias("score"))


@registered(f"WITH {_TOP}, n AS (SELECT query_id, count(*) AS n, count(*) FILTER (strategies >= 2) AS a FROM floored GROUP BY query_id) SELECT query_id, CASE WHEN a >= n // 2 THEN 'very_high' WHEN a > 0 THEN 'high' ELSE 'medium' END AS confidence FROM n")
def confidence(spark, sf):
    return fusion.confidence(fusion.rerank(_boosted(spark, sf).filter("score >= 0.008"), 20))


@registered()
def mmr_select(spark, sf):
    return fusion.mmr(fusion.rerank(_boosted(spark, sf), 30), 10, 0.7)


@registered()
def hybrid_search(spark, sf):
    d = docs(spark, sf)
    near = read(spark, sf, "embeddings").join(d.select(F.col("doc_id").alias("vec_id"), "document_id"), "vec_id").select(F.col("document_id").alias("vec_id"), "embedding")
    kb = api.KnowledgeBase(d, near)
    return kb.search(asked(spark, sf), _centroids(spark, sf).withColumn("query_id", F.col("query_id").cast("long")), api.SearchOptions(limit=10))


# results

_HITS = f"""hit AS (SELECT m.query_id, c.document_id, c.chunk_index, c.content AS snippet, m.score FROM {_ALL} m JOIN chunks c ON c.chunk_id = m.document_id)"""


def _chunk_hits(spark, sf):
    d, rows = _chunks(spark, sf)
    found = lexical.matches(rows, asked(spark, sf), key="chunk_id")
    return d, found.join(rows.select("chunk_id", "document_id", "chunk_index", F.col("content").alias("snippet")), "chunk_id")


@registered(f"WITH {S.BM25_CHUNKS}, {_HITS} SELECT h.query_id, h.document_id, round(avg(h.score), 6) AS score, count(*) AS chunk_count, d.title, split_part(d.path, '/', -1) AS file FROM hit h JOIN docs d USING (document_id) GROUP BY h.query_id, h.document_id, d.title, d.path")
def results_by_document(spark, sf):
    d, hits = _chunk_hits(spark, sf)
    return results.by_document(hits, d).select("query_id", "document_id", F.round("score", 6).alias("score"), "chunk_count", "title", "file")


@registered()
def overlap_merge(spark, sf):
    return results.document_text(index.chunk_table(docs(spark, sf)))


@registered("SELECT doc_id, " + S.trimmed(S.replaced("text", [(p, " ") for p in V.RESULT_BOILERPLATE] + [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")])) + " AS content FROM documents")
def result_boilerplate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.drop_result_boilerplate(F.col("text")).alias("content"))


@registered(
    f"""WITH {S.BM25_CHUNKS}, best AS (SELECT m.query_id, m.document_id, round(m.score, 9) AS s, '### ' || d.title || chr(10) || '*Source: ' || split_part(d.path, '/', -1) || '*' || chr(10) || chr(10) || c.content || chr(10) AS b FROM {S.page(_ALL, 10, _ROUNDED)} m JOIN chunks c ON c.chunk_id = m.document_id JOIN docs d ON d.document_id = c.document_id)
SELECT query_id, '## Relevant Context' || chr(10) || chr(10) || string_agg(b, chr(10) || '---' || chr(10) || chr(10) ORDER BY s DESC, document_id) AS context FROM best GROUP BY query_id"""
)
def prompt_context(spark, sf):
    """The ten best chunks of each query, whole."""
    rows = _chunks(spark, sf)[1]
    hits = written(lexical.ranked(lexical.matches(rows, asked(spark, sf), key="chunk_id", top=10), 10, by=_chunk_order()), "page")  # few, so texts stay where they are
    facts = rows.select("chunk_id", "title", T.file_name(F.col("path")).alias("file"), "content")
    return results.prompt_context(hits.join(facts, "chunk_id").withColumnRenamed("chunk_id", "document_id"))


# graph


def _entities(spark, sf):
    money = lambda c: F.lit(0.5) + F.round(F.abs(c) / 25000, 2)
    rows = [
        read(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("location").alias("type"), F.lit("region").alias("description"), F.lit(0.95).alias("confidence"), F.concat(F.lit("r"), "r_regionkey").alias("key")),
        read(spark, sf, "nation").select(F.col("n_name"), F.lit("location"), F.lit("nation"), F.lit(0.9), F.concat(F.lit("n"), "n_nationkey")),
        read(spark, sf, "supplier").select(F.col("s_name"), F.lit("organization"), F.lit("supplier"), money(F.col("s_acctbal")), F.concat(F.lit("s"), "s_suppkey")),
        read(spark, sf, "customer").select(F.col("c_name"), F.lit("person"), F.lower("c_mktsegment"), money(F.col("c_acctbal")), F.concat(F.lit("c"), "c_custkey")),
        read(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")), F.lit("technology"), F.lower("p_type"), F.lit(0.5) + F.col("p_size") / 100.0, F.concat(F.lit("p"), "p_partkey")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.select(T.entity_id(F.col("name"), F.col("type")).alias("entity_id"), "name", "type", "description", F.col("confidence").cast("double").alias("confidence"), "key")


def _relations(spark, sf, entities):
    pair = lambda df, a, p, b, c: df.select(a.alias("a"), F.lit(p).alias("predicate"), b.alias("b"), F.lit(c).alias("confidence"))
    key = lambda prefix, c: F.concat(F.lit(prefix), c)
    pairs = (
        pair(read(spark, sf, "nation"), key("n", "n_nationkey"), "part_of", key("r", "n_regionkey"), 0.9)
        .union(pair(read(spark, sf, "supplier"), key("s", "s_suppkey"), "relates_to", key("n", "s_nationkey"), 0.8))
        .union(pair(read(spark, sf, "customer"), key("c", "c_custkey"), "relates_to", key("n", "c_nationkey"), 0.7))
        .union(pair(read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), key("s", "l_suppkey"), "contains", key("p", "l_partkey"), 0.6))
    )
    ids = entities.select("entity_id", "key")
    named = pairs.join(ids.select(F.col("entity_id").alias("subject_id"), F.col("key").alias("a")), "a").join(ids.select(F.col("entity_id").alias("object_id"), F.col("key").alias("b")), "b")
    return named.select("subject_id", "predicate", "object_id", "confidence")


def _graph(spark, sf):
    e = _entities(spark, sf)
    return e, _relations(spark, sf, e), spark.createDataFrame(S.GRAPH_ASKED, "query_id string, query string")


_G = f"WITH {S.GRAPH}, {S.GRAPH_QUERIES}, {S.ENTITY_HITS}"


@registered(_G + " SELECT query_id, entity_id, name, type, round(score, 6) AS score, rank FROM found")
def entity_search(spark, sf):
    e, _, q = _graph(spark, sf)
    return graph.search_entities(e, q).select("query_id", "entity_id", "name", "type", F.round("score", 6).alias("score"), "rank")


#: Queries with names to look for: as parts of names, none, none and no tokens either, with one of a single character.
_HINTED = [("h1", "what lies near", ["asia", "EUROPE", ""]), ("h2", "blue bolt", []), ("h3", "The", None), ("h4", "machinery", ["Customer#00000000"]), ("h5", "", ["7"]), ("h6", "", None)]
_HINT_SOURCES = ["src2", "src3", "src7"]
_HINTS_SQL = ", ".join(f"({S.lit(i)}, {S.lit(q)}, {S.names([h for h in hints or [] if h]) if any(hints or []) else 'CAST([] AS VARCHAR[])'})" for i, q, hints in _HINTED)


@registered(
    f"""WITH {S.GRAPH}, {S.DOCS}, kept AS (SELECT e.* FROM entities e JOIN docs d ON d.doc_id = CAST(substr(e.key, 2) AS BIGINT) WHERE d.source_id IN ({', '.join(map(S.lit, _HINT_SOURCES))})),
tok AS (SELECT query_id, query, hints, {S.graph_tokens('query')} AS tokens FROM (VALUES {_HINTS_SQL}) asked(query_id, query, hints)),
cand AS (SELECT * FROM (SELECT t.query_id, t.tokens, e.*, row_number() OVER (PARTITION BY t.query_id ORDER BY e.confidence DESC, e.entity_id) AS r FROM kept e JOIN tok t
  ON CASE WHEN len(t.hints) > 0 THEN len(list_filter(t.hints, lambda h: contains(lower(e.name), lower(h)))) > 0 WHEN len(t.tokens) > 0 THEN len(list_filter(t.tokens, lambda w: contains(lower(e.name || chr(10) || e.description), w))) > 0 ELSE t.query <> '' AND contains(lower(e.name || chr(10) || e.description), lower(t.query)) END) WHERE r <= 60),
{S.ENTITY_SCORES} SELECT query_id, entity_id, name, type, round(score, 6) AS score, rank FROM found"""
)
def graph_query_hinted(spark, sf):
    """Entities of three sources by hints; an entity belongs to the document with its number."""
    e, r, _ = _graph(spark, sf)
    d = docs(spark, sf)
    placed = e.withColumn("doc_id", F.substring("key", 2, 20).cast("long")).join(d.select("doc_id", "document_id"), "doc_id", "left").drop("doc_id")
    kb = api.KnowledgeBase(d, entities=placed, relations=r)
    q = spark.createDataFrame(_HINTED, "query_id string, query string, hints array<string>")
    found = kb.graph_query(q, hops=1, source_ids=_HINT_SOURCES)["entities"]
    return found.select("query_id", "entity_id", "name", "type", F.round("score", 6).alias("score"), "rank")


_OTHER = f"""{S.VECTORS}, evec AS (SELECT e.entity_id, v.v, e.type FROM vectors v JOIN entities e ON e.key = 'p' || (v.vec_id + 1)),
near_e AS (SELECT 'g' || (q.query_id + 1) AS query_id, e.entity_id, list_cosine_similarity(e.v, q.vector) AS score FROM evec e CROSS JOIN asked_vectors q WHERE q.query_id < 5),
other AS (SELECT * FROM (SELECT query_id, entity_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity_id) AS INTEGER) AS rank FROM near_e WHERE score >= 0) WHERE rank <= 20)"""


def _entity_vectors(spark, sf, e):
    """Part n + 1 has vector n; graph query n + 1 has the mean vector of label n."""
    v = read(spark, sf, "embeddings").select(F.concat(F.lit("p"), (F.col("vec_id") + 1).cast("string")).alias("key"), "embedding")
    asked_vectors = _centroids(spark, sf).filter("query_id < 5").select(F.concat(F.lit("g"), (F.col("query_id") + 1).cast("string")).alias("query_id"), "vector")
    return v.join(e, "key").select(F.col("entity_id").alias("vec_id"), "type", "embedding"), asked_vectors


@registered(f"WITH {S.GRAPH}, {_OTHER} SELECT query_id, entity_id, round(score, 6) AS score, rank FROM other")
def entity_knn(spark, sf):
    vectors, asked_vectors = _entity_vectors(spark, sf, _entities(spark, sf))
    return vector.entity_knn(vectors, asked_vectors, ["technology"]).select("query_id", "entity_id", F.round("score", 6).alias("score"), "rank")


@registered(
    f"""{_G}, {_OTHER}, both_lists AS (SELECT query_id, entity_id, f.rank AS a, o.rank AS b, (coalesce(0.5 / (60 + f.rank), 0) + coalesce(0.5 / (60 + o.rank), 0)) * CASE WHEN f.rank IS NOT NULL AND o.rank IS NOT NULL THEN 1.2 ELSE 1.0 END AS score FROM found f FULL OUTER JOIN other o USING (query_id, entity_id))
SELECT query_id, entity_id, round(CAST(score AS DOUBLE), 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 12) DESC, least(a, b), entity_id) AS INTEGER) AS rank FROM both_lists) WHERE rank <= 20"""
)
def entity_hybrid(spark, sf):
    """Entities by words, fused with the nearest by vector."""
    e, r, q = _graph(spark, sf)
    vectors, asked_vectors = _entity_vectors(spark, sf, e)
    kb = api.KnowledgeBase(docs(spark, sf), entities=e, relations=r, entity_vectors=vectors)
    return kb.entities_of(q, asked_vectors).select("query_id", "entity_id", F.round("score", 9).alias("score"), "rank")


@registered(f"WITH {S.GRAPH} SELECT entity_id, name, type FROM entities WHERE contains(lower(name), 'asia') ORDER BY lower(name) = 'asia' DESC, confidence DESC, entity_id LIMIT 1")
def entity_by_name(spark, sf):
    return graph.entity_by_name(_entities(spark, sf), "Asia").select("entity_id", "name", "type")


@registered(f"WITH {S.GRAPH} SELECT entity_id, name, confidence FROM entities WHERE contains(lower(name), 'blue') AND type = 'technology' AND confidence >= 0.7 ORDER BY confidence DESC, entity_id LIMIT 50")
def entity_filter(spark, sf):
    return graph.find_entities(_entities(spark, sf), "Blue", "technology", 0.7).select("entity_id", "name", "confidence")


@registered(f"WITH {S.GRAPH}, gone AS (SELECT entity_id FROM entities WHERE description = 'nation') SELECT (SELECT count(*) FROM entities WHERE entity_id NOT IN (FROM gone)) AS entities, (SELECT count(*) FROM relations WHERE subject_id NOT IN (FROM gone) AND object_id NOT IN (FROM gone)) AS relations")
def graph_detach(spark, sf):
    e, r, _ = _graph(spark, sf)
    left, links = graph.detach(e, r, e.filter("description = 'nation'").select("entity_id"))
    return left.agg(F.count(F.lit(1)).alias("entities")).crossJoin(links.agg(F.count(F.lit(1)).alias("relations")))  # single rows


@registered(f"WITH {S.GRAPH} SELECT count(*) FILTER (name = '') AS no_name, count(*) FILTER (length(name) > 500) AS long_name, count(*) FILTER (length(description) > 2000) AS long_description, count(*) FILTER (NOT list_contains({S.names(list(V.ENTITY_ALIASES))}, type)) AS bad_type, count(*) FILTER (confidence < 0 OR confidence > 1) AS bad_confidence FROM (SELECT CASE WHEN key LIKE 'r%' THEN '' ELSE name END AS name, CASE WHEN key LIKE 'n%' THEN 'land' ELSE type END AS type, description, confidence + 0.1 AS confidence FROM entities)")
def entity_faults(spark, sf):
    e = _entities(spark, sf)
    worn = e.select(F.when(F.col("key").startswith("r"), "").otherwise(F.col("name")).alias("name"), F.when(F.col("key").startswith("n"), "land").otherwise(F.col("type")).alias("type"), "description", (F.col("confidence") + 0.1).alias("confidence"))
    return graph.entity_faults(worn)


@registered(f"WITH {S.GRAPH} SELECT count(*) FILTER (subject_id = '') AS no_subject, count(*) FILTER (object_id = '') AS no_object, count(*) FILTER (predicate = 'contains') AS bad_predicate, count(*) FILTER (confidence > 0.5) AS bad_confidence FROM relations")
def relation_faults(spark, sf):
    e = _entities(spark, sf)
    r = _relations(spark, sf, e)
    return graph.relation_faults(r.withColumn("predicate", F.when(F.col("predicate") == "contains", "holds").otherwise(F.col("predicate"))).withColumn("confidence", F.col("confidence") + 0.5))


_RELATED = """touching AS (SELECT DISTINCT f.query_id, s.name AS subject, r.predicate, o.name AS object, r.confidence FROM relations r JOIN found f ON f.entity_id = r.subject_id OR f.entity_id = r.object_id JOIN entities s ON s.entity_id = r.subject_id JOIN entities o ON o.entity_id = r.object_id),
linked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, subject, predicate, object) AS INTEGER) AS rank FROM touching) WHERE rank <= 50)"""


@registered(f"{_G}, {_RELATED} SELECT query_id, subject, predicate, object, confidence, rank FROM linked")
def entity_relations(spark, sf):
    e, r, q = _graph(spark, sf)
    return graph.relations_of(graph.search_entities(e, q), r, e)


_SEEDS = "seeds AS (SELECT entity_id FROM entities WHERE description = 'region'), edges AS (SELECT DISTINCT a, b FROM (SELECT subject_id AS a, object_id AS b FROM relations UNION ALL SELECT object_id, subject_id FROM relations) WHERE a <> b)"


@registered(f"WITH {S.GRAPH}, {_SEEDS} SELECT seed, entity_id, name, confidence, rank FROM (SELECT s.entity_id AS seed, e.entity_id, e.name, e.confidence, CAST(row_number() OVER (PARTITION BY s.entity_id ORDER BY e.confidence DESC, e.entity_id) AS INTEGER) AS rank FROM seeds s JOIN edges x ON x.a = s.entity_id JOIN entities e ON e.entity_id = x.b) WHERE rank <= 20")
def entity_neighbors(spark, sf):
    e, r, _ = _graph(spark, sf)
    return graph.neighbours(e.filter("description = 'region'").select("entity_id"), r, e)


@registered(
    f"WITH RECURSIVE {S.GRAPH}, {_SEEDS}, walk(seed, entity_id, hops) AS (SELECT entity_id, entity_id, 0 FROM seeds UNION SELECT w.seed, x.b, w.hops + 1 FROM walk w JOIN edges x ON x.a = w.entity_id WHERE w.hops < 2) SELECT seed, entity_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY seed, entity_id HAVING min(hops) > 0"
)
def graph_khop(spark, sf):
    e, r, _ = _graph(spark, sf)
    return graph.k_hop(e.filter("description = 'region'").select("entity_id"), r, 2)


@registered(f"WITH {S.GRAPH} SELECT 'entity' AS kind, type AS label, count(*) AS n FROM entities GROUP BY ROLLUP (type) UNION ALL SELECT 'relation', predicate, count(*) FROM relations GROUP BY ROLLUP (predicate)")
def graph_stats(spark, sf):
    e, r, _ = _graph(spark, sf)
    return graph.graph_stats(e, r)


@registered(
    f"""{_G}, {_RELATED}, a AS (SELECT f.query_id, string_agg('- **' || f.name || '** (' || f.type || ')' || CASE WHEN e.description <> '' THEN ': ' || e.description ELSE '' END || chr(10), '' ORDER BY f.rank) FILTER (f.rank <= 10) AS t, count(*) AS n FROM found f JOIN entities e USING (entity_id) GROUP BY f.query_id),
b AS (SELECT query_id, string_agg('- ' || subject || ' → ' || predicate || ' → ' || object || chr(10), '' ORDER BY rank) FILTER (rank <= 15) AS t, count(*) AS n FROM linked GROUP BY query_id)
SELECT a.query_id, '## Entities' || chr(10) || a.t || CASE WHEN a.n > 10 THEN '... and ' || (a.n - 10) || ' more entities' || chr(10) ELSE '' END || CASE WHEN b.t IS NOT NULL THEN chr(10) || '## Relationships' || chr(10) || b.t || CASE WHEN b.n > 15 THEN '... and ' || (b.n - 15) || ' more relationships' || chr(10) ELSE '' END ELSE '' END AS context FROM a LEFT JOIN b USING (query_id)"""
)
def graph_context(spark, sf):
    e, r, q = _graph(spark, sf)
    hits = graph.search_entities(e, q)
    return graph.context(hits, e, graph.relations_of(hits, r, e))


#: Mentions of parts: each part of a colour and thing is a mention of one entity; the brand stands for the document.
_MENTIONS = "mentions AS (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type AS kind, p_name || ' of ' || p_type AS description, p_size / 50.0 AS confidence, p_brand AS document_id, p_partkey AS seq FROM part)"


def _mentions(spark, sf):
    return read(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("kind"), F.concat_ws(" of ", "p_name", "p_type").alias("description"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("seq"))


_ALIAS = lambda e, table, default: "CASE " + " ".join(f"WHEN list_contains({S.names(n)}, lower({e})) THEN {S.lit(k)}" for k, n in table.items()) + f" ELSE {S.lit(default)} END"


@registered(
    f"WITH {_MENTIONS}, m AS (SELECT *, {S.hash_id('ent_', 'trim(lower(name)) || {0}'.replace('{0}', S.lit('|technology')))} AS entity_id FROM mentions) SELECT entity_id, arg_min(name, seq) AS name, 'technology' AS type, arg_max(description, {{'n': length(description), 's': -seq}}) AS description, max(CAST(confidence AS DOUBLE)) AS confidence, array_to_string(list_sort(list_distinct(list(document_id))), ',') AS documents, count(*) AS mentions FROM m GROUP BY entity_id"
)
def entity_merge(spark, sf):
    m = _mentions(spark, sf).withColumn("type", F.lit("technology"))
    return graph.merge_entities(m).withColumn("documents", F.array_join("documents", ","))


_SOURCES = f"{_MENTIONS}, m AS (SELECT *, {S.hash_id('ent_', "trim(lower(name)) || '|' || kind")} AS entity_id FROM mentions), sources AS (SELECT entity_id, document_id, count(*) AS mentions, max(CAST(confidence AS DOUBLE)) AS confidence FROM m GROUP BY ALL)"


@registered(f"WITH {_SOURCES} SELECT * FROM sources")
def entity_sources(spark, sf):
    return graph.entity_sources(_mentions(spark, sf).withColumnRenamed("kind", "type"))


@registered(f"WITH {_SOURCES}, kept AS (SELECT * FROM sources WHERE document_id NOT LIKE 'Brand#1%') SELECT entity_id, min(trim(lower(m.name))) AS name, count(DISTINCT kept.document_id) AS sources FROM kept JOIN m USING (entity_id) GROUP BY entity_id")
def entities_after_removal(spark, sf):
    """The entities that are left, and by how many documents, once a group of documents has gone."""
    m = _mentions(spark, sf).withColumnRenamed("kind", "type")
    links = spark.createDataFrame([], "relation_id string, subject_id string, predicate string, object_id string, confidence double")
    gone = m.filter("document_id like 'Brand#1%'").select("document_id")
    entities, _, sources = graph.without_documents(graph.canonical_entities(m), links, graph.entity_sources(m), gone)
    left = sources.groupBy("entity_id").agg(F.count(F.lit(1)).alias("sources"))
    return entities.select("entity_id", T.canonical_name(F.col("name")).alias("name")).join(left, "entity_id")


@registered(f"WITH {_MENTIONS} SELECT trim(lower(name)) AS name_key, kind AS type, count(*) AS copies, arg_min(name, {{'c': -CAST(confidence AS DOUBLE), 'n': name}}) AS canonical_name, arg_max(description, {{'n': length(description), 'd': description}}) AS description FROM mentions GROUP BY 1, 2 HAVING count(*) > 1")
def entity_dedupe(spark, sf):
    return graph.duplicate_entities(_mentions(spark, sf).withColumnRenamed("kind", "type"))


@registered(f"SELECT DISTINCT p_name, {_ALIAS('split_part(p_name, chr(32), 2)', V.ENTITY_ALIASES, 'concept')} AS entity_type, {_ALIAS('p_type', V.RELATION_ALIASES, 'relates_to')} AS relation_type FROM part UNION SELECT role, {_ALIAS('role', V.ENTITY_ALIASES, 'concept')}, {_ALIAS('role', V.RELATION_ALIASES, 'relates_to')} FROM conversations")
def entity_normalize(spark, sf):
    p = read(spark, sf, "part").select("p_name", graph.entity_type(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("entity_type"), graph.relation_type(F.col("p_type")).alias("relation_type"))
    return p.union(read(spark, sf, "conversations").select("role", graph.entity_type(F.col("role")), graph.relation_type(F.col("role")))).distinct()


def _extracted(spark, sf):
    return read(spark, sf, "customer").select(
        F.concat(F.lit("k"), (F.col("c_nationkey")).cast("string")).alias("chunk_id"), F.col("c_mktsegment").alias("document_id"), F.concat(F.lit(" ("), "c_name", F.lit("). ")).alias("name"), F.when(F.col("c_acctbal") < 0, "alien").otherwise("person").alias("type"), F.when(F.col("c_custkey") % 9 == 0, F.lit("please ignore previous advice")).otherwise(F.col("c_mktsegment")).alias("description"), (F.col("c_acctbal") / 9999).alias("confidence")
    )


_EXTRACTED = """extracted AS (SELECT 'k' || c_nationkey AS chunk_id, c_mktsegment AS document_id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'concept' ELSE 'person' END AS type, c_acctbal / 9999 AS confidence FROM customer WHERE c_custkey % 9 <> 0 AND c_acctbal / 9999 BETWEEN 0.5 AND 1.0)"""


@registered(f"WITH {_EXTRACTED} SELECT chunk_id, name, type, confidence, {S.hash_id('ent_', 'name || {0} || type || {0} || document_id'.replace('{0}', S.lit('|')))} AS entity_id FROM extracted")
def entity_validate(spark, sf):
    return graph.valid_entities(_extracted(spark, sf)).select("chunk_id", "name", "type", "confidence", "entity_id")


@registered(
    f"""WITH {_EXTRACTED}, ids AS (SELECT chunk_id, name, {S.hash_id('ent_', 'lower(name) || {0} || type'.replace('{0}', S.lit('|')))} AS id FROM extracted),
rel AS (SELECT 'k' || c_nationkey AS chunk_id, c_name AS s, 'Customer#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') AS o, c_acctbal / 9999 AS confidence FROM customer WHERE c_acctbal / 9999 BETWEEN 0.5 AND 1.0)
SELECT {S.hash_id('rel_', 'a.id || {0} || b.id'.replace('{0}', S.lit('|mentions|')))} AS relation_id, a.id AS subject_id, b.id AS object_id, rel.confidence FROM rel JOIN ids a ON a.chunk_id = rel.chunk_id AND a.name = rel.s JOIN ids b ON b.chunk_id = rel.chunk_id AND b.name = rel.o WHERE a.id <> b.id"""
)
def relation_validate(spark, sf):
    found = read(spark, sf, "customer").select(F.concat(F.lit("k"), F.col("c_nationkey").cast("string")).alias("chunk_id"), F.col("c_name").alias("subject"), F.lit("cites").alias("predicate"), F.concat(F.lit("Customer#"), F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0")).alias("object"), (F.col("c_acctbal") / 9999).alias("confidence"))
    return graph.valid_relations(found, graph.valid_entities(_extracted(spark, sf))).select("relation_id", "subject_id", "object_id", "confidence")


@registered()
def extraction_parse(spark, sf):
    answer = F.concat(F.lit('Here: {"entities": [{"name": "'), "p_name", F.lit('", "type": "tool", "description": ["'), "p_type", F.lit('", "x"], "confidence": "0.9"}, {"name": "cut'), F.when(F.col("p_size") % 2 == 0, F.lit('"')).otherwise(F.lit('"}], "relations": []} done')))
    return graph.parse_responses(read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), answer.alias("raw")))


def _status(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    return rows, read(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("quality") == 1, "completed").otherwise("error").alias("status"), F.when(F.col("toxic") == 1, "Connection refused").when(F.col("quality") == 0, "Incomplete JSON answer").otherwise("").alias("error_message"))


@registered("SELECT d.doc_id AS chunk_id, CASE WHEN l.quality = 0 THEN 'error' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 0")
def extraction_pending(spark, sf):
    return graph.pending(*_status(spark, sf)).select("chunk_id", "status")


@registered("SELECT coalesce(CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'error' END, 'pending') AS status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 3) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def extraction_dashboard(spark, sf):
    chunks, status = _status(spark, sf)
    total = chunks.count()
    counts = chunks.join(status, "chunk_id", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.round(F.try_divide(F.lit(100.0) * F.col("n"), F.lit(total)), 3))


@registered("SELECT CASE WHEN toxic = 1 THEN 'Connection' WHEN quality = 0 THEN 'Incomplete JSON' ELSE 'Other' END AS class, count(*) AS n FROM labels GROUP BY 1")
def error_categories(spark, sf):
    _, status = _status(spark, sf)
    return status.groupBy(graph.error_class(F.col("error_message")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_ANSWER = {"purchase": None, "signup": None, "error": "Connection refused", "view": "timeout", "click": "no such model"}
_ANSWER_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {S.lit(v)}" for k, v in _ANSWER.items() if v) + " END"


@registered(
    f"""WITH a AS (SELECT user_id, ts, event_id % 7 AS n, {_ANSWER_SQL} AS m FROM events), r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS attempts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, m IS NULL DESC, n DESC, coalesce(m, '') DESC) AS k FROM a)
SELECT user_id AS chunk_id, CASE WHEN m IS NULL THEN 'completed' ELSE 'error' END AS status, CAST(attempts AS INTEGER) AS attempts, CAST(n AS INTEGER) AS entity_count, m AS error_message, ts AS updated_at,
CASE WHEN m IN ('Connection refused', 'timeout') AND attempts < 70 THEN CAST(least(pow(2, attempts - 1), 16) AS INTEGER) ELSE 0 END AS wait_seconds FROM r WHERE k = 1"""
)
def status_upsert(spark, sf):
    """Events of a user as answers about a chunk: its status, attempts, and the wait before the next one."""
    message = F.lit(None).cast("string")
    for kind, text in _ANSWER.items():
        message = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(message)
    history = read(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("at"), message.alias("error_message"), F.pmod("event_id", F.lit(7)).cast("int").alias("entity_count"))
    history = history.withColumn("status", F.when(F.col("error_message").isNull(), "completed").otherwise("error"))
    return graph.status_upsert(history, 70).fillna(0, ["wait_seconds"]).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def _letters():
    """A stand-in for a model with a limit: how often each letter occurs in a text of at most 8,000 characters."""

    def model(texts):
        if any(len(t) > 8000 for t in texts):
            raise ValueError("a text is too long")
        return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]

    return model


_BAD = "text IS NULL OR length(text) > 8000"


@registered(f"SELECT doc_id, CASE WHEN {_BAD} THEN 0 ELSE 26 END AS dimension, CASE WHEN {_BAD} THEN 0 ELSE CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) END AS letter_e, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) > 8000 THEN 'ValueError: a text is too long' END AS error FROM documents")
def embed_failures(spark, sf):
    """Documents in batches of twenty, of which those that fail by themselves are failures."""
    done = embedding.vectorize(spread(read(spark, sf, "documents")), _letters, "letters", "doc_id", "text", size=20, isolate=True)
    good = done.vectors.select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dimension"), F.get("embedding", F.lit(4)).cast("int").alias("letter_e"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(done.failures.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("dimension"), F.lit(0).alias("letter_e"), "error"))


def _safe_sql(e: str) -> str:
    e = f"CASE WHEN length({e}) > 5000 THEN {e}[1:5000] || '...' ELSE {e} END"
    for d in V.DANGEROUS:
        pattern = "(?i)" + "".join("\\" + ch if not ch.isalnum() and ch not in " _" else ch for ch in d)
        e = f"regexp_replace({e}, {S.lit(pattern)}, '[FILTERED]', 'g')"
    return e


@registered(f"SELECT conv_id, turn, {_safe_sql('t')} AS safe FROM (SELECT conv_id, turn, role || ': ' || text AS t FROM conversations)")
def prompt_safe(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", graph.prompt_safe(F.concat_ws(": ", "role", "text")).alias("safe"))


@registered(f"WITH {S.DOCS} SELECT d.doc_id AS chunk_id, CASE WHEN l.toxic = 1 THEN 'Connection' ELSE 'Incomplete JSON' END AS class, d.title, true AS again FROM labels l JOIN docs d USING (doc_id) WHERE l.quality = 0")
def retry_list(spark, sf):
    d = docs(spark, sf)
    rows, status = _status(spark, sf)
    chunks = rows.join(d.select(F.col("doc_id").alias("chunk_id"), "document_id"), "chunk_id")
    return graph.retry_list(chunks, status, d).select("chunk_id", "class", "title", graph.retryable(F.col("class")).alias("again"))


@registered("SELECT count(*) AS chunks, count(*) FILTER (quality = 1) AS completed, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS percent, round(sum(CASE WHEN quality = 1 THEN d.doc_id % 7 END) / count(*) FILTER (quality = 1), 6) AS entities_each FROM documents d LEFT JOIN labels l USING (doc_id)")
def extraction_rates(spark, sf):
    chunks, status = _status(spark, sf)
    out = graph.extraction_rates(chunks, status.withColumn("entity_count", F.col("chunk_id") % 7))
    return out.select("chunks", "completed", F.round("percent", 6).alias("percent"), F.round("entities_each", 6).alias("entities_each"))


@registered(f"WITH {S.GRAPH} SELECT entity_id, name, confidence FROM entities")
def entity_json(spark, sf):
    """Entities as JSON, and back."""
    e = _entities(spark, sf).select("entity_id", "name", "type", "description", "confidence")
    return e.select(graph.from_json(graph.as_json(e)).alias("e")).select("e.entity_id", "e.name", "e.confidence")


@registered()
def extraction_prompts(spark, sf):
    rows = read(spark, sf, "conversations")
    return rows.select("conv_id", "turn", graph.extraction_prompt(F.col("role"), F.lit(""), F.col("text")).alias("prompt"))


@registered()
def extraction_stage(spark, sf):
    """Answers about parts, half of them cut: what becomes of their chunks."""
    p = read(spark, sf, "part")
    answer = F.concat(F.lit('{"entities": [{"name": "'), "p_name", F.lit('", "type": "tool", "confidence": 0.9}], "relations": []'), F.when(F.col("p_size") % 2 == 0, F.lit("}")).otherwise(F.lit("")))
    responses = p.select(F.col("p_partkey").alias("chunk_id"), answer.alias("raw"), F.when(F.col("p_size") == 3, "timeout").alias("error"))
    return graph.extract(responses, p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id")))[2]


# sources and sinks


def _tables(spark, sf) -> ingest.Tables:
    d = docs(spark, sf)
    sources = d.select("source_id").distinct().withColumn("name", F.col("source_id")).unionByName(spark.createDataFrame([("empty", "empty")], "source_id string, name string"))
    v = read(spark, sf, "embeddings").join(d.select(F.col("doc_id").alias("vec_id"), "document_id"), "vec_id").select(F.col("vec_id").cast("string").alias("vec_id"), "document_id", "embedding")
    return ingest.Tables(sources, d, index.chunk_table(d), v)


@registered(f"WITH {S.DOCS}, {S.CHUNKS}, s AS (SELECT DISTINCT source_id FROM docs UNION SELECT 'empty') SELECT source_id, CAST(coalesce((SELECT count(*) FROM docs d WHERE d.source_id = s.source_id), 0) AS BIGINT) AS doc_count, CAST(coalesce((SELECT count(*) FROM chunks JOIN docs d USING (document_id) WHERE d.source_id = s.source_id), 0) AS BIGINT) AS chunk_count, CAST(coalesce((SELECT sum(size) FROM docs d WHERE d.source_id = s.source_id), 0) AS BIGINT) AS size_bytes FROM s")
def source_stats(spark, sf):
    return ingest.refresh_stats(_tables(spark, sf)).select("source_id", "doc_count", "chunk_count", "size_bytes")


_NEWER = S.DOCS.replace("docs AS", "docs0 AS", 1) + ", docs AS (SELECT * REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN content || ' and more' ELSE content END AS content) FROM docs0)"


@registered(f"WITH {_NEWER}, {S.CHUNKS}, v AS (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM docs) AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT content) FROM chunks) AS texts, (SELECT count(*) FROM v) AS vectors")
def document_sink(spark, sf):
    """Documents of good quality come again with more text: their chunks are replaced, their vectors go."""
    t = _tables(spark, sf)
    new = t.documents.join(read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").withColumn("content", F.concat("content", F.lit(" and more")))
    after = ingest.put_documents(t, new)
    one = lambda df, c, name: df.agg(c.alias(name))
    n = F.count(F.lit(1))
    return one(after.documents, n, "documents").crossJoin(after.chunks.agg(n.alias("chunks"), F.countDistinct("content").alias("texts"))).crossJoin(one(after.vectors, n, "vectors"))  # single rows


@registered("SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'updated' ELSE 'removed' END AS change FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1) UNION ALL SELECT item_id + 1000000000 AS doc_id, 'added' AS change FROM benchmark")
def snapshot_diff(spark, sf):
    """A versioned store before and after a change: good documents get more text, bad ones go, benchmark items come."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    store = SnapshotStore(spark, ingest.fresh_folder(spark, "store"))
    first = store.commit({"documents": d})
    judged = d.join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    longer = judged.filter("quality = 1").select("doc_id", F.concat("text", F.lit(" and more")).alias("text"))
    new = read(spark, sf, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text")
    return store.diff("documents", first, store.change({"documents": longer.unionByName(new)}, {"documents": judged.filter("quality in (0, 1)").select("doc_id")}), "doc_id")


@registered("SELECT CAST(vec_id AS VARCHAR) AS vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 2 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("vec_id"), "label")
    third = v.filter("cast(vec_id as long) % 3 = 0")
    twice = third.select("vec_id", (F.col("label") + 1).alias("label"), F.lit(1).alias("seq")).unionByName(third.select("vec_id", (F.col("label") + 2).alias("label"), F.lit(2).alias("seq")))
    return ingest.upsert_vectors(v, twice, order="seq")


@registered("SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 3)")
def vector_delete(spark, sf):
    return ingest.delete_vectors(read(spark, sf, "embeddings"), label=[2, 3])[0].select("vec_id", "label")


@registered("SELECT count(*) AS vectors, max(len(embedding)) AS dimension, 'hashing' AS model, 'ready' AS status FROM embeddings")
def vector_stats(spark, sf):
    return ingest.vector_stats(read(spark, sf, "embeddings")).withColumn("dimension", F.col("dimension").cast("long"))


@registered(f"WITH {S.DOCS}, {S.CHUNKS} SELECT chunk_id, 64 AS dimension FROM chunks")
def vector_backfill(spark, sf):
    """Every chunk gets a vector, of the hashing stand-in."""
    t = _tables(spark, sf)
    from dataclasses import replace

    after = ingest.backfill(replace(t, vectors=t.vectors.limit(0)), vector.hashing_embedder(64))
    return after.vectors.select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dimension"))


@registered(f"WITH {S.DOCS}, {S.CHUNKS} SELECT c.chunk_id, d.source_id AS source, d.title FROM chunks c JOIN docs d USING (document_id)")
def chunk_metadata(spark, sf):
    t = _tables(spark, sf)
    out = ingest.with_metadata(t.chunks, t.documents, F.create_map(F.lit("source"), F.col("source_id"), F.lit("title"), F.col("title")))
    return out.select("chunk_id", F.col("metadata")["source"].alias("source"), F.col("metadata")["title"].alias("title"))


@registered(f"WITH {S.DOCS}, {S.CHUNKS} SELECT chunk_id, chunk_index, content FROM chunks WHERE document_id = (SELECT min(document_id) FROM docs) ORDER BY chunk_index")
def document_chunks(spark, sf):
    t = _tables(spark, sf)
    return ingest.get_chunks(t, t.documents.agg(F.min("document_id")).first()[0]).select("chunk_id", "chunk_index", "content")


@registered("SELECT page_id, CAST(coalesce(TRY_CAST(nullif(regexp_extract(split_part(url, '/', -1), '^(\\d{1,18})', 1), '') AS BIGINT), 0) AS BIGINT) AS n, split_part(url, '/', -1) || CASE WHEN page_id > 0 THEN ', page ' || page_id ELSE '' END AS cited FROM pages")
def citations(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.leading_int(T.file_name(F.col("url"))).alias("n"), T.citation(F.col("url"), F.col("page_id").cast("string")).alias("cited"))


@registered()
def chunk_smart(spark, sf):
    return docs(spark, sf).select("document_id", F.posexplode(T.smart_chunks(F.col("content"))).alias("chunk_index", "content"))


# evaluation, control, streams


@registered(
    f"""WITH {S.BM25}, ranked AS (SELECT query_id, document_id, rank FROM {S.page('matched', 10, _ROUNDED)}),
relevant AS (SELECT b.item_id AS query_id, d.document_id FROM benchmark b JOIN docs d ON contains(d.content, b.text)),
per AS (SELECT r.query_id, count(v.document_id) AS found, min(CASE WHEN v.document_id IS NOT NULL THEN r.rank END) AS first, sum(CASE WHEN v.document_id IS NOT NULL THEN 1.0 / log2(r.rank + 1) ELSE 0 END) AS dcg FROM ranked r LEFT JOIN relevant v USING (query_id, document_id) GROUP BY r.query_id),
total AS (SELECT query_id, count(DISTINCT document_id) AS total FROM relevant GROUP BY query_id)
SELECT t.query_id, round(coalesce(p.found, 0) / 10.0, 6) AS precision, round(coalesce(p.found, 0) / t.total, 6) AS recall, round(coalesce(1.0 / p.first, 0), 6) AS reciprocal_rank,
  round(coalesce(p.dcg, 0) / list_sum(list_transform(range(1, CAST(least(t.total, 10) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg FROM total t LEFT JOIN per p USING (query_id)"""
)
def retrieval_metrics(spark, sf):
    d = docs(spark, sf)
    hits = lexical.ranked(lexical.matches(d, asked(spark, sf), require_all=False), 10, by=_order())
    holds = evaluate.holding(d, read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    out = evaluate.metrics(hits, holds, 10)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")))


@registered(
    f"""WITH {S.BM25}, best AS (SELECT r.query_id, r.rank, d.path, d.content, a.query FROM {S.page(_ALL, 10, _ROUNDED)} r JOIN docs d USING (document_id) JOIN asked a USING (query_id)), {_snipped('best')},
ranked AS (SELECT query_id, rank, path, lower(snippet) AS t FROM snipped),
cases AS (SELECT item_id AS query_id, lower(split_part(text, ' ', 1)) AS must FROM benchmark),
got AS (SELECT query_id, count(*) AS n, bool_or(rank <= 3 AND contains(path, 'src')) AS top, list(t) AS ts FROM ranked GROUP BY query_id)
SELECT CAST(c.query_id AS VARCHAR) AS name, CASE WHEN coalesce(n, 0) < 1 THEN 'insufficient results' WHEN NOT top THEN 'expected document not in top results' WHEN len(list_filter(ts, lambda t: contains(t, must))) = 0 THEN 'missing required phrase: ' || split_part(b.text, ' ', 1)
  WHEN len(list_filter(ts, lambda t: contains(t, 'license'))) > 0 THEN 'found boilerplate phrase: license' ELSE '' END AS reason FROM cases c LEFT JOIN got g USING (query_id) JOIN benchmark b ON b.item_id = c.query_id"""
)
def retrieval_eval(spark, sf):
    d, q = docs(spark, sf), asked(spark, sf)
    hits = lexical.with_snippets(lexical.ranked(lexical.matches(d, q), 10, by=_order()), d, q).join(d.select("document_id", "path"), "document_id").withColumn("name", F.col("query_id").cast("string"))
    cases = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.lit("src").alias("expected_top_doc"), F.array(F.split_part("text", F.lit(" "), F.lit(1))).alias("must_contain"), F.array(F.lit("license")).alias("must_not_contain"), F.lit(1).alias("min_results"), F.lit(3).alias("max_rank"))
    return evaluate.evaluate_cases(cases, hits).select("name", "reason")


@registered("SELECT event_id AS request_id, CASE WHEN event_type = 'error' THEN 'deny' WHEN user_id % 2 = 0 THEN 'allow' WHEN event_type = 'purchase' THEN 'warn' ELSE 'allow' END AS decision FROM events")
def policy_eval(spark, sf):
    """Event types stand for requested targets; users with even ids hold grants for all they do."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("instance_id"), F.lit("network").alias("kind"), F.col("event_type").alias("target"))
    rules = spark.createDataFrame([(0, "network", "^error$", "deny", "errors are forbidden"), (10, "network", "^purchase$", "warn", "purchases are watched")], "priority int, kind string, pattern string, decision string, reason string")
    grants = e.filter("instance_id % 2 = 0").select("instance_id", "kind", "target")
    return control.decide(e, rules, grants).select("request_id", "decision")


#: States that the types of events stand for.
_STATES = {"click": "STARTING", "error": "DEGRADED", "purchase": "STOPPING", "signup": "INSTALLED", "view": "RUNNING"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items()) + " ELSE 'STOPPED' END"
_LAWFUL = ", ".join(f"('{a}', '{b}')" for a, ends in V.TRANSITIONS.items() for b in ends)


@registered(
    f"""WITH s AS (SELECT user_id, {_STATE_SQL} AS to_status, lag({_STATE_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events), lawful(a, b) AS (VALUES {_LAWFUL})
SELECT from_status, to_status, (from_status, to_status) IN (SELECT (a, b) FROM lawful) AS lawful, count(*) AS n, count(DISTINCT user_id) AS users FROM s WHERE from_status IS NOT NULL GROUP BY ALL"""
)
def state_transitions(spark, sf):
    """Consecutive events of a user as changes of state: each kind of change once, with how often it occurs."""
    state = F.lit("STOPPED")
    for kind, name in _STATES.items():
        state = F.when(F.col("event_type") == kind, name).otherwise(state)
    before = F.lag("to_status").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    changes = read(spark, sf, "events").select("user_id", "ts", "event_id", state.alias("to_status")).select("user_id", "to_status", before.alias("from_status")).filter("from_status is not null")
    counted = changes.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return control.check_transitions(counted).select("from_status", "to_status", "lawful", "n", "users")


@registered("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    out = stream_events.windowed(read(spark, sf, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
