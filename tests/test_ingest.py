import pytest
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import graph, lexical, vector
from lexigraph.plans import api, ingest


def hashing(c):
    return vector.hashing_embedder(8)(c)


def test_a_folder_is_brought_up_to_date(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    put = lambda name, text: (tmp_path / "src" / name).write_text(text)
    put("a.md", "# Alpha\n" + "The xylophone plays. " * 100)
    put("b.txt", "Nothing much here.")
    put("c.bin", "not read")
    put("node_modules/d.md", "excluded")
    t = ingest.Tables.empty(spark)
    t.sources = ingest.register_source(ingest.register_source(t.sources, str(tmp_path / "src")), str(tmp_path / "src"), name="Mine", patterns=[".md", "*.txt"])
    source = ingest.list_sources(t.sources).first()
    assert t.sources.count() == 1 and source["name"] == "Mine" and source["patterns"] == ["*.md", "*.txt"] and ingest.get_source(t.sources, source["source_id"])["status"] == "active"
    with pytest.raises(KeyError):
        ingest.get_source(t.sources, "src_none")
    t, summary = ingest.sync_source(t, source["source_id"], embed=hashing)
    assert summary.first().asDict() == {"added": 2, "updated": 0, "unchanged": 0, "deleted": 0, "error": 0}
    t = t.written(spark, f"file://{tmp_path}/t1")
    assert t.documents.count() == 2 and t.chunks.count() == t.vectors.count() > 3
    put("a.md", "# Alpha\nThe accordion plays.")
    (tmp_path / "src" / "b.txt").unlink()
    t, results = ingest.sync_all(t, embed=hashing)
    assert results[source["source_id"]].asDict() == {"added": 0, "updated": 1, "unchanged": 0, "deleted": 1, "error": 0}
    t = t.written(spark, f"file://{tmp_path}/t2")
    q = spark.createDataFrame([(1, "accordion"), (2, "xylophone")], "query_id long, query string")
    kb = api.KnowledgeBase(t.documents, chunks=t.chunks)
    assert [r["query_id"] for r in kb.chunk_hits(q).collect()] == [1] and kb.stats().first()["chunks"] == 1
    assert ingest.refresh_stats(t).first()["chunk_count"] == 1 and ingest.vector_stats(t.vectors).first()["dimension"] == 8
    assert [c["content"] for c in ingest.get_chunks(t, t.documents.first()["document_id"]).collect()] == ["# Alpha\nThe accordion plays."]
    left, gone = ingest.delete_vectors(t.vectors, document_id=t.documents.first()["document_id"])
    assert gone == 1 and left.count() == 0 and ingest.backfill(ingest.Tables(t.sources, t.documents, t.chunks, left), hashing).vectors.count() == 1
    t, n = ingest.remove_source(t, source["source_id"])
    assert n == 1 and t.sources.count() == t.documents.count() == t.chunks.count() == t.vectors.count() == 0


def test_a_source_that_fails_keeps_its_rows(spark, tmp_path):
    t = ingest.Tables.empty(spark)
    t.sources = ingest.register_source(t.sources, str(tmp_path / "gone"))
    after, results = ingest.sync_all(t)
    assert after.sources.count() == 1 and all(isinstance(r, Exception) for r in results.values())


def test_stored_index_with_stems(spark, tmp_path):
    rows = [(f"c{i}", t) for i, t in enumerate(["he runs a mile", "running water", "a café in town", "unrelated words", *(f"filler number {k}" for k in range(8))])]
    d = spark.createDataFrame(rows, "chunk_id string, content string")
    built = lexical.TextIndex.build(d, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "runs"), (2, "running miles"), (3, "cafe"), (4, "runner"), (5, "")], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]) for r in built.matches(q).collect()}
    assert got == {(1, "c0"), (1, "c1"), (2, "c0"), (3, "c2")}
    plain = lexical.TextIndex.build(d, f"file://{tmp_path}/plain", stem=False)
    assert {(r["query_id"], r["chunk_id"]) for r in plain.matches(q, prefix=False).collect()} == {(1, "c0"), (3, "c2")}
    same = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert same(plain.matches(q, False)) == same(lexical.matches(d, q, False, key="chunk_id"))


def test_many_terms_are_looked_up_in_the_dictionary(spark, monkeypatch):
    d = spark.createDataFrame([(f"d{i}", f"word{i} shared token{i % 3}") for i in range(40)], "document_id string, content string")
    q = spark.createDataFrame([(1, "shared token1"), (2, "word7 nothing"), (3, "wor")], "query_id long, query string")
    same = lambda: sorted((r["query_id"], r["document_id"], round(r["score"], 9)) for r in lexical.matches(d, q, False).collect())
    few = same()
    monkeypatch.setattr(lexical, "MOST_TERMS", 1)
    assert same() == few and few


def test_pages_and_modes(spark):
    d = spark.createDataFrame([(f"d{i:02}", "s", f"/p/{i}.md", f"Title {i}", "database " * (i + 1) + "and other words here") for i in range(12)] + [(f"e{i:02}", "s", f"/q/{i}.md", "Other", "nothing") for i in range(20)], "document_id string, source_id string, path string, title string, content string")
    q = spark.createDataFrame([(1, "database")], "query_id long, query string")
    kb = api.KnowledgeBase(d)
    page = lambda **o: [r["document_id"] for r in kb.search(q, None, api.SearchOptions(diversify=False, **o)).orderBy("rank").collect()]
    assert page(limit=8)[4:] == page(limit=4, offset=4) and len(page(limit=4)) == 4
    assert page(mode="lexical", limit=5) == page(mode="semantic", limit=5) == [r["document_id"] for r in kb.lexical(q, api.SearchOptions(limit=5)).orderBy("rank").collect()]
    assert kb.kb_search(q, limit=500).count() == 12 and kb.confidence(kb.search(q), q).first()["confidence"] in ("medium", "high")


def test_smart_split():
    assert T.best_split("short", 10) == 5 and T.best_split("one two three", 8) == 8 and T.best_split("ab. cd ef gh", 9) == 4 and T.best_split("x" * 30, 10) == 10


def test_smart_chunks_lose_no_word(spark):
    text = "First part here. Second part.\n\nThird paragraph with more words than fit in one chunk of it."
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.smart_chunks(F.col("t"), 30).alias("c")).collect()
    assert " ".join(got[0]["c"]).split() == text.split() and all(len(c) <= 30 for c in got[0]["c"]) and got[1]["c"] is None and got[2]["c"] == []


def test_extraction_stage(spark):
    raw = '{"entities": [{"name": "Acme", "type": "company", "confidence": 0.9}, {"name": "Bolt", "type": "tool", "confidence": 0.9}], "relations": [{"subject": "Acme", "predicate": "uses", "object": "Bolt", "confidence": 0.8}]}'
    responses = spark.createDataFrame([("c1", raw, None), ("c2", raw, None), ("c3", "no answer", None), ("c4", None, "timeout")], "chunk_id string, raw string, error string")
    chunks = spark.createDataFrame([(c, f"doc {c}", "text") for c in ("c1", "c2", "c3", "c4")], "chunk_id string, document_id string, content string")
    e, r, s = graph.extract(responses, chunks)
    assert {(x["name"], x["type"], tuple(x["documents"])) for x in e.collect()} == {("Acme", "organization", ("doc c1", "doc c2")), ("Bolt", "technology", ("doc c1", "doc c2"))}
    assert [x["predicate"] for x in r.collect()] == ["implements"]
    assert {(x["chunk_id"], x["status"], x["entity_count"], x["error_message"]) for x in s.collect()} == {("c1", "completed", 2, None), ("c2", "completed", 2, None), ("c3", "error", 0, "no JSON found"), ("c4", "error", 0, "timeout")}
    assert graph.valid_requests(chunks).count() == 4
    asked = chunks.select(graph.extraction_prompt(F.lit("system: x"), F.lit(None).cast("string"), F.col("content")).alias("p")).first()["p"]
    assert "[FILTERED]" in asked and "<text_to_analyze>\ntext\n</text_to_analyze>" in asked


def test_graph_edits(spark):
    e = spark.createDataFrame([("a", "Alpha", "concept", "d", 0.9, "doc1"), ("b", "alpha beta", "person", "d", 0.95, "doc2")], "entity_id string, name string, type string, description string, confidence double, document_id string")
    r = spark.createDataFrame([("r1", "a", "uses", "b", 0.9)], "relation_id string, subject_id string, predicate string, object_id string, confidence double")
    new = spark.createDataFrame([("r1", "a", "has", "b", 0.5), ("r2", "a", "uses", "a", 0.5)], r.schema)
    assert [x["predicate"] for x in graph.put_relations(r, new).collect()] == ["has"]
    assert graph.entity_by_name(e, "ALPHA").first()["entity_id"] == "a" and graph.entity_by_name(e, "bet").first()["entity_id"] == "b" and graph.entity(e, "b").count() == 1
    assert [x["entity_id"] for x in graph.find_entities(e, "alpha", document_id="doc2").collect()] == ["b"]
    left, links = graph.detach(e, r, e.filter("entity_id = 'b'"))
    assert left.count() == 1 and links.count() == 0
