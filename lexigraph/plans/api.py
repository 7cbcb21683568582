"""A collection with its searches: the calls that users make, each over a table of queries.

Presets only fill in what the caller leaves open. Fallback: all terms, then any, then single words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import fusion, graph, index, lexical, query, results, vector
from ..sources.shared import written


@dataclass
class SearchOptions:
    """Options of a search; None takes the preset's value."""

    limit: int = 10
    offset: int = 0
    mode: str = "auto"  # auto, lexical, semantic or fusion
    recall: str = "balanced"
    semantic_weight: float = 0.5
    adaptive_weights: bool = False
    diversify: bool | None = None
    balance: float | None = None
    rerank: bool | None = None
    floor: float | None = None
    rerank_top: int | None = None
    min_score: float = 0.0
    source_ids: list[str] = field(default_factory=list)
    mime_types: list[str] = field(default_factory=list)
    path: str | None = None  # a part of the path, for semantic searches

    def filled(self) -> "SearchOptions":
        diversify, balance, rerank, floor, top = V.PRESETS[self.recall]
        pick = lambda mine, preset: preset if mine is None else mine
        return SearchOptions(**self.__dict__ | {"diversify": pick(self.diversify, diversify), "balance": pick(self.balance, balance), "rerank": pick(self.rerank, rerank), "floor": pick(self.floor, floor), "rerank_top": pick(self.rerank_top, top)})


@dataclass
class KnowledgeBase:
    """Tables of a collection: documents (document_id, source_id, path, title, mime_type, content), vectors (vec_id = document_id, embedding), entities, relations."""

    documents: DataFrame
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    chunks: DataFrame | None = None
    index: lexical.TextIndex | None = None
    entity_vectors: DataFrame | None = None

    def units(self, options: SearchOptions = SearchOptions()) -> DataFrame:
        """What is searched: chunks with what their documents say, where the collection has chunks, else documents as one chunk each."""
        docs = lexical.filtered(self.documents, options.source_ids, options.mime_types)
        if self.chunks is not None:
            return index.search_rows(docs, self.chunks)
        return docs.select("document_id", F.col("document_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), "content", *(c for c in ("title", "path", "source_id", "mime_type") if c in docs.columns))

    def matches(self, queries: DataFrame, options: SearchOptions = SearchOptions(), require_all: bool = True, top: int | None = None) -> DataFrame:
        """``query_id, document_id, score``: from the stored index where there is one, else by reading the texts. The score of a document is that of its best chunk. With ``top`` worse hits than so many of a query may be left out where documents are searched whole."""
        units = self.units(options)
        if self.index is not None:
            found = self.index.matches(queries, require_all).join(units.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
        else:
            found = lexical.matches(units, queries, require_all, key="chunk_id", top=top if self.chunks is None else None)
            if self.chunks is None:
                found = found.select("chunk_id", "query_id", "score", F.col("chunk_id").alias("document_id"), F.lit(0).alias("chunk_index"))
            else:
                found = found.join(units.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
        if options.min_score > 0:
            found = found.filter(F.col("score") > options.min_score)
        return found

    def chunk_hits(self, queries: DataFrame, options: SearchOptions = SearchOptions(), require_all: bool = True) -> DataFrame:
        """``query_id, chunk_id, document_id, chunk_index, score, rank, snippet, title, path``: a page of chunks for each query."""
        hits = lexical.ranked(self.matches(queries, options, require_all), options.limit, options.offset, key="chunk_id")
        texts = self.units(options).select(F.col("chunk_id").alias("_chunk"), "content", "title", "path")
        words = queries.select("query_id", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "").alias("_words"))
        return hits.join(texts, F.col("chunk_id") == F.col("_chunk")).join(words, "query_id").withColumn("snippet", T.snippet(F.col("content"), F.col("_words"))).drop("_chunk", "_words", "content")

    def lexical(self, queries: DataFrame, options: SearchOptions = SearchOptions(), require_all: bool = True) -> DataFrame:
        """``query_id, document_id, score, rank`` by each document's best chunk."""
        best = self.matches(queries, options, require_all, options.limit + options.offset).groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
        return lexical.ranked(best, options.limit, options.offset)

    def semantic(self, vectors: DataFrame, options: SearchOptions = SearchOptions(), least: float = 0.0) -> DataFrame:
        """``vectors (query_id, vector)``; filters come before the nearest are taken."""
        mine = self.vectors
        if options.source_ids or options.mime_types or options.path:
            kept = lexical.filtered(self.documents, options.source_ids, options.mime_types)
            if options.path:
                kept = kept.filter(F.col("path").contains(options.path))
            mine = mine.join(kept.select(F.col("document_id").alias("vec_id")), "vec_id", "left_semi")
        return vector.knn(mine, vectors, options.limit, options.offset, least).withColumnRenamed("vec_id", "document_id")

    def search(self, queries: DataFrame, vectors: DataFrame | None = None, options: SearchOptions = SearchOptions(), seen: Observation | None = None) -> DataFrame:
        """``query_id, document_id, score, strategies, rank`` of ``queries (query_id, query)``: fused, boosted, floored, reranked and diversified; the page that limit and offset ask for.

        ``seen`` is told how many hits there were before the floor, and how many it rejected, by the job that writes those that are left.
        In lexical mode, and in semantic mode where there are no vectors, the lexical ranking stands as it is.
        """
        o = options.filled()
        has_vectors = vectors is not None and self.vectors is not None
        if o.mode == "lexical" or o.mode == "semantic" and not has_vectors:
            return self.lexical(queries, o).select("query_id", "document_id", "score", "rank", F.lit(1).alias("strategies"))
        page = o.limit + o.offset
        wide = SearchOptions(limit=max(3 * page, 30), min_score=o.min_score, source_ids=o.source_ids, mime_types=o.mime_types, path=o.path)
        words = self.lexical(queries, wide)
        analysis = query.analyze(queries)
        if o.mode == "semantic":
            words = words.limit(0)
        if not has_vectors:
            near = words.select("query_id", "document_id", "rank", "score").limit(0)
        else:
            fused = analysis.filter("mode = 'fusion'") if o.mode == "auto" else analysis
            near = self.semantic(vectors.join(fused.select("query_id"), "query_id", "left_semi"), wide)
        if o.adaptive_weights:
            one = fusion.rrf(words, near, 1.0).select("query_id", "document_id", F.col("score").alias("s"))
            hits = fusion.rrf(words, near, 0.0).join(one, ["query_id", "document_id"]).join(analysis.select("query_id", "semantic_weight", "lexical_weight"), "query_id")
            hits = hits.withColumn("score", F.col("score") * F.col("lexical_weight") + F.col("s") * F.col("semantic_weight")).drop("s", "semantic_weight", "lexical_weight")
        else:
            hits = fusion.rrf(words, near, o.semantic_weight)
        hits = written(lexical.with_snippets(hits, self.documents, queries, carry=("path", "title")), "found")
        hits = hits.join(analysis.select("query_id", "entities"), "query_id")
        boosted = fusion.entity_boost(F.col("score"), F.col("entities"), F.concat_ws(" ", "snippet", "title", "path"))
        hits = fusion.floored(hits.withColumn("score", fusion.agreement_boost(boosted, F.col("strategies"))), o.floor, seen)
        if seen is not None:
            hits = written(hits, "floored")
        if o.rerank:
            hits = fusion.rerank(hits, max(o.rerank_top, page))
        if o.diversify:
            picked = fusion.mmr(hits.select("query_id", "document_id", "score", "best_rank", "snippet"), page, o.balance)
            out = picked.select("query_id", "document_id", "score", F.col("pick").alias("rank")).join(hits.select("query_id", "document_id", "strategies"), ["query_id", "document_id"])
        else:
            out = fusion.ranked(hits, page).select("query_id", "document_id", "score", "rank", "strategies")
        return out.filter(F.col("rank") > o.offset)

    def confidence(self, hits: DataFrame, queries: DataFrame, has_vectors: bool = True) -> DataFrame:
        """``query_id, confidence`` of the hits of a search; ``none`` for queries without any."""
        known = fusion.confidence(hits, 2 if has_vectors else 1)
        return queries.select("query_id").join(known, "query_id", "left").fillna("none", ["confidence"])

    def search_with_fallback(self, queries: DataFrame, options: SearchOptions = SearchOptions(), vectors: DataFrame | None = None) -> DataFrame:
        """Hits of each query from the strictest level that has any: the search itself, any of its terms, single words. With ``level``, its confidence and a note."""
        plain = lambda df: df.select("query_id", "document_id", "score")
        primary = plain(self.search(queries, vectors, options)) if vectors is not None else plain(self.lexical(queries, options))
        loose = self.matches(queries, options, False).groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
        words = fusion.partial(lambda q: self.matches(q, options).groupBy("query_id", "document_id").agg(F.max("score").alias("score")), queries, limit=options.limit).drop("rank")
        hits = lexical.ranked(fusion.fallback([primary, loose, words]), options.limit)
        note = F.when(F.col("level") == 1, "any of the words").when(F.col("level") == 2, "single words")
        return hits.withColumn("confidence", fusion.fallback_confidence(F.col("level"))).withColumn("note", note)

    def search_with_context(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Documents with the text of the chunks that were hit, best first."""
        hits = self.chunk_hits(queries, SearchOptions(limit=3 * limit))
        texts = self.units().select(F.col("chunk_id"), F.col("content"))
        parts = hits.drop("snippet").join(texts, "chunk_id").select("query_id", "document_id", "score", "chunk_index", F.col("content").alias("snippet"))
        return lexical.ranked(results.by_document(parts, self.documents), limit)

    def kb_search(self, queries: DataFrame, vectors: DataFrame | None = None, limit: int = 10, **options) -> DataFrame:
        """The search tool: fifty hits at most, with fallback."""
        return self.search_with_fallback(queries, SearchOptions(limit=min(max(limit, 1), 50), **options), vectors)

    def stats(self) -> DataFrame:
        """One row: documents, chunks, sources, bytes, entities and relations."""
        none = self.documents.select("document_id").limit(0)
        counts = index.index_stats(self.documents, none if self.chunks is None else self.chunks)
        size = lambda df, name: (none if df is None else df).agg(F.count(F.lit(1)).alias(name))
        return counts.crossJoin(size(self.entities, "entities")).crossJoin(size(self.relations, "relations"))  # single rows

    def document_text(self, document_id: str) -> DataFrame:
        """A document's text, from its chunks."""
        return results.document_text(self.chunks.filter(F.col("document_id") == document_id))

    def get_document(self, document_id: str) -> DataFrame:
        return self.documents.filter(F.col("document_id") == document_id)

    def sources(self) -> DataFrame:
        return self.documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("doc_count")).orderBy("source_id")

    def entities_of(self, queries: DataFrame, vectors: DataFrame | None = None, limit: int = 20, source_ids: list[str] | None = None) -> DataFrame:
        """``query_id, entity_id, score, rank``: entities by words or hints, fused with the nearest by vector where there are any. Entities of other sources leave before either is taken."""
        mine = graph.of_sources(self.entities, self.documents, source_ids) if source_ids else self.entities
        words = graph.search_entities(mine, queries, limit)
        if vectors is None or self.entity_vectors is None:
            return words
        known = self.entity_vectors.join(mine.select(F.col("entity_id").alias("vec_id")), "vec_id", "left_semi") if source_ids else self.entity_vectors
        near = vector.entity_knn(known, vectors, limit=limit)
        return graph.fuse_entities(words, near, limit).join(self.entities.select("entity_id", "name", "type"), "entity_id")

    def graph_query(self, queries: DataFrame, limit: int = 20, hops: int = 2, with_relations: bool = True, vectors: DataFrame | None = None, source_ids: list[str] | None = None) -> dict[str, DataFrame]:
        """Entities, relations, and context of ``queries (query_id, query)``, with names to look for in an array column ``hints`` where there is one; with more than one hop also what lies around the entities. At most 100 entities and five hops.

        ``source_ids`` are the sources whose entities may be found; relations and what lies around may lead out of them.
        """
        limit = min(limit, 100)
        found = self.entities_of(queries, vectors, limit, source_ids)
        linked = graph.relations_of(found, self.relations, self.entities) if with_relations else graph.relations_of(found.limit(0), self.relations, self.entities)
        out = {"entities": found, "relations": linked, "context": graph.context(found, self.entities, linked)}
        if hops > 1:
            out["around"] = graph.k_hop(found.select("entity_id").distinct(), self.relations, hops)
        return out


def collection(documents: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table of texts as documents: ids and paths from the source and the key, titles from the first fitting line."""
    path = F.concat(F.col(source), F.lit("/"), F.col(key).cast("string"), F.lit(".txt"))
    return documents.select(
        T.document_id(path).alias("document_id"), F.col(key).alias("doc_id"), F.col(source).alias("source_id"), path.alias("path"), F.coalesce(T.first_line_title(F.col(text)), T.file_name(path)).alias("title"), T.mime_type(path).alias("mime_type"), F.octet_length(text).alias("size"), F.col(text).alias("content")
    )
